"""Code tables: definitions and imports of every module, from one parse.

The parse keeps a file's definitions together in its row, so symbols, classes,
compiled text and descriptions are array expressions and need no shuffle.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillframe import schemas
from quillframe.functions.text import first_line, strip
from quillframe.operators.ordering import first_per_key
from quillframe.session import bound_batches
from quillframe.spreading import spread

KINDS = {
    ast.Module: "module",
    ast.ClassDef: "class",
    ast.FunctionDef: "function",
    ast.AsyncFunctionDef: "async function",
}
ROWS_PER_BATCH = 256


def _base_name(base: ast.expr) -> str:
    match base:
        case ast.Name(id=name) | ast.Attribute(attr=name):
            return name
        case _:
            return "Unknown"


def _qualified_names(tree: ast.Module) -> list[tuple[str, ast.AST]]:
    """Definitions reached through direct children only, in reading order."""
    found: list[tuple[str, ast.AST]] = [("module", tree)]

    def visit(node: ast.AST, prefix: str) -> None:
        for child in ast.iter_child_nodes(node):
            if type(child) in KINDS:
                found.append((prefix + child.name, child))
                visit(child, f"{prefix}{child.name}.")

    visit(tree, "")
    return found


def parse_module(source: str) -> dict:
    """Definitions in breadth-first order and names imported with ``from``."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(source)
    nodes = list(ast.walk(tree))
    docs = {node: ast.get_docstring(node) for node in nodes if type(node) in KINDS}
    qualified = _qualified_names(tree)
    names = {node: name for name, node in qualified}
    # A dict keeps the first position of a key and its last value.
    symbols = {name: node for name, node in qualified if docs[node]}
    classes = {node.name: node for node in docs if isinstance(node, ast.ClassDef)}
    symbol_at = {node: at for at, node in enumerate(symbols.values())}
    class_at = {node: at for at, node in enumerate(classes.values())}
    definitions = [
        {
            "ordinal": at,
            "name": getattr(node, "name", "module"),
            "qualified_name": names.get(node),
            "kind": KINDS[type(node)],
            "docstring": doc,
            "parents": [_base_name(b) for b in node.bases] if isinstance(node, ast.ClassDef) else None,
            "symbol_position": symbol_at.get(node),
            "class_position": class_at.get(node),
        }
        for at, (node, doc) in enumerate(docs.items())
    ]
    imported = [
        (node.module, alias.name)
        for node in nodes
        if isinstance(node, ast.ImportFrom)
        for alias in node.names
    ]
    imports = [{"ordinal": at, "module": m, "name": n} for at, (m, n) in enumerate(imported)]
    return {"definitions": definitions, "imports": imports, "parse_error": None}


def _parsed_or_error(source: str | None) -> dict:
    try:
        return parse_module(source)
    except Exception as problem:  # unparsable source gives no rows, not a failed job
        return {"definitions": [], "imports": [], "parse_error": f"{type(problem).__name__}: {problem}"}


def parse_modules(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, definitions, imports, parse_error), one row per file.

    Read by several tables below: write it once.
    """
    bound_batches(files.sparkSession)
    fields = T.StructType.fromDDL(schemas.PARSED).fields
    schema = T.StructType([files.schema[key], *fields])
    target = to_arrow_schema(schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_PER_BATCH):
                part = batch.slice(low, ROWS_PER_BATCH)
                rows = [
                    {key: k, **_parsed_or_error(source)}
                    for k, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    return spread(files.select(key, "content")).mapInArrow(parse, schema)


def _ordered_symbols() -> Column:
    current = F.filter("definitions", lambda d: d["symbol_position"].isNotNull())
    return F.array_sort(
        F.transform(
            current,
            lambda d: F.struct(
                d["symbol_position"].alias("position"),
                d["qualified_name"].alias("qualified_name"),
                d["kind"].alias("kind"),
                d["docstring"].alias("docstring"),
            ),
        )
    )


def symbols(parsed: DataFrame, key: str = "path") -> DataFrame:
    """Documented modules, classes and functions by qualified name."""
    return parsed.select(key, F.inline(_ordered_symbols()))


def definitions(parsed: DataFrame, key: str = "path") -> DataFrame:
    """Every definition, documented or not, in breadth-first order."""
    return parsed.select(key, F.inline("definitions"))


def class_parents(parsed: DataFrame, key: str = "path") -> DataFrame:
    """Classes with their parents; of equal names in a file the last counts."""
    return definitions(parsed, key).where(F.col("class_position").isNotNull()).select(
        key, F.col("class_position").alias("position"), F.col("name").alias("class_name"), "parents", "docstring"
    )


def class_edges(classes: DataFrame, key: str = "path") -> DataFrame:
    return classes.select(key, "class_name", F.posexplode("parents").alias("parent_position", "parent"))


def import_list(parsed: DataFrame, key: str = "path") -> DataFrame:
    return parsed.select(key, F.inline("imports"))


def is_from_package(module: Column, name: Column, package: str) -> Column:
    inside = (module == package) | module.startswith(package + ".")
    return module.isNotNull() & inside & (name != "*")


def imports_from(imports: DataFrame, package: str) -> DataFrame:
    """Names imported from the package or below it; no wildcards."""
    return imports.where(is_from_package(F.col("module"), F.col("name"), package))


def import_query(parsed: DataFrame, package: str, key: str = "path") -> DataFrame:
    """(key, query): imported names in order, separated by spaces."""
    wanted = F.filter("imports", lambda i: is_from_package(i["module"], i["name"], package))
    names = F.transform(F.array_sort(wanted), lambda i: i["name"])
    return parsed.select(key, F.array_join(names, " ").alias("query"))


def compiled_docstrings(parsed: DataFrame, key: str = "path") -> DataFrame:
    """(key, compiled): ``name (kind):`` and docstring of every symbol."""
    blocks = F.transform(
        _ordered_symbols(),
        lambda s: F.concat(s["qualified_name"], F.lit(" ("), s["kind"], F.lit("):\n"), s["docstring"], F.lit("\n\n")),
    )
    return parsed.select(key, strip(F.array_join(blocks, "")).alias("compiled"))


def docstring_descriptions(parsed: DataFrame, key: str = "path") -> DataFrame:
    """(key, description): ``name: first line`` of every documented definition."""
    documented = F.filter("definitions", lambda d: F.length(d["docstring"]) > 0)
    lines = F.transform(documented, lambda d: F.concat(d["name"], F.lit(": "), first_line(d["docstring"])))
    return parsed.select(key, F.array_join(lines, "; ").alias("description"))


def class_docstrings(requests: DataFrame, parsed: DataFrame, key: str = "path") -> DataFrame:
    """Docstring of the first class with the name; empty if there is no such
    class, null if it has no docstring."""
    classes = definitions(parsed, key).where(F.col("kind") == "class").select(
        key, F.col("name").alias("class_name"), "ordinal", "docstring"
    )
    firsts = first_per_key(classes, [key, "class_name"], "ordinal")
    return requests.join(firsts, [key, "class_name"], "left").select(
        *requests.columns,
        F.when(F.col("ordinal").isNull(), F.lit("")).otherwise(F.col("docstring")).alias("docstring"),
    )
