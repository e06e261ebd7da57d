"""Explicit table schemas; nothing is inferred."""

FILES = "path string, size_bytes bigint, content string, error string"
LISTING = "path string, size_bytes bigint"
ENTRIES = f"{LISTING}, is_folder boolean, opened boolean"
MANIFEST = "path string, sha256 string"
SUMMARIES = "path string, description string"
IGNORE_RULES = "dir string, pattern string"
VECTORS = (
    "id string, document string, metadata map<string,string>, "
    "embedding array<float>, tokens bigint, file_type string"
)
HISTORY = "path string, content string, run int, stamp string"
COMPLETION = "text string, attempts int, status string, error string"
TOOL_ARGUMENTS = "new_file_content string"

DEFINITION = (
    "struct<ordinal:int, name:string, qualified_name:string, kind:string, "
    "docstring:string, parents:array<string>, symbol_position:int, class_position:int>"
)
IMPORT = "struct<ordinal:int, module:string, name:string>"
PARSED = f"definitions array<{DEFINITION}>, imports array<{IMPORT}>, parse_error string"
