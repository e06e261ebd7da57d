"""One query per row of the operator inventory."""

from __future__ import annotations

import json
import uuid
from functools import reduce
from hashlib import sha256

from pyspark.sql import DataFrame, functions as F

from quillframe import schemas
from quillframe.checks import fixtures as fx
from quillframe.functions import paths, prompts, text
from quillframe.operators import (
    changes, code, completion, embedding, folders, ignore, metric_index, ordering, packing, postprocess,
    reports, revisions, search, vectors as vec,
)
from quillframe.plans import describe, project_tree, retrieval, run
from quillframe.scratch import scratch_path, written
from quillframe.sources import source_tree, state, storage
from quillframe.streaming import manifest_state

FOLDER_DEPTH = 2  # fixed value: default depth of report folders
PACKAGE = "shop"
TAG = "# tagged"
HISTORY_TIME = "2024-03-05 06:07:08"
KEPT_REPLY = "reply "
RUN_DOCSTRING = '"""Doc."""\n'


# Sources ------------------------------------------------------------------

def scan_source_tree(spark, sf) -> DataFrame:
    root = scratch_path(spark, "tree")
    source_tree.write_tree(fx.code_files(spark, sf), root).agg(F.count(F.lit(1))).collect()
    return source_tree.scan_tree(spark, root).select(
        "path", "size_bytes", text.content_hash(F.col("content")).alias("sha256"), "error"
    )


def load_manifest(spark, sf) -> DataFrame:
    """The manifest written as JSON objects, one of them cut short, read back."""
    path = scratch_path(spark, "manifest-json")
    entry = F.to_json(F.create_map("path", "sha256"))
    cut_short = F.when(F.col("sha256") == "stale", F.left(entry, F.length(entry) - 1)).otherwise(entry)
    fx.manifest(spark, sf).select(cut_short.alias("value")).write.text(path)
    return state.load_manifest_json(spark, path)


def load_summaries(spark, sf) -> DataFrame:
    path = scratch_path(spark, "summaries-json")
    entry = F.struct(F.col("path").alias("file"), "description")
    fx.summaries(spark, sf).select(F.to_json(F.array(entry)).alias("value")).write.text(path)
    return state.load_summaries_json(spark, path).select("path", "description")


def parse_ignore_rules(spark, sf) -> DataFrame:
    return state.parse_ignore_rules(fx.rule_files(spark, sf))


# Sinks --------------------------------------------------------------------

def save_manifest(spark, sf) -> DataFrame:
    """Two versions saved; the newest is read."""
    root = scratch_path(spark, "manifest")
    storage.save_version(fx.manifest(spark, sf), root)
    current = changes.fingerprints(fx.doc_files(spark, sf))
    merged = changes.merge_manifest(storage.load_version(spark, root, schemas.MANIFEST), current)
    storage.save_version(merged, root)
    return storage.load_version(spark, root, schemas.MANIFEST)


def save_summaries(spark, sf) -> DataFrame:
    root = scratch_path(spark, "summaries")
    storage.save_version(fx.summaries(spark, sf), root)
    return storage.load_version(spark, root, schemas.SUMMARIES)


def save_descriptions(spark, sf) -> DataFrame:
    root = scratch_path(spark, "descriptions")
    rows = fx.summaries(spark, sf).withColumn("path", paths.normalize(F.col("path")))
    storage.save_descriptions(rows, root, "data")
    return spark.read.parquet(root).select("path", "out_path", "description", F.col("top_folder").cast("string"))


def vector_collection(spark, sf) -> DataFrame:
    """Create, fill, get again, fill again: nothing is stored twice."""
    name = f"vectors_{uuid.uuid4().hex}"
    location = scratch_path(spark, "collection")
    rows = fx.vectors(spark, sf).withColumn("tokens", text.token_count(F.col("document")))
    for _ in range(2):
        stored = storage.get_or_create_collection(spark, name, location)
        storage.append_to_collection(vec.absent_only(rows, stored), name)
    return spark.table(name).select(
        "id", "document", F.col("metadata")["file_path"].alias("file_path"), "file_type", "tokens",
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("embedding_sum"),
    )


def class_vectors(spark, sf) -> DataFrame:
    """Class summaries stored twice as vectors of their own: nothing is stored twice."""
    name = f"classes_{uuid.uuid4().hex}"
    storage.get_or_create_collection(spark, name, scratch_path(spark, "class-collection"))
    classes = code.class_parents(_parsed(spark, sf)).select("path", "class_name", F.col("docstring").alias("summary"))
    rows = written(describe.class_vector_rows(classes, {"file_type": "class"}), "class-rows")
    for _ in range(2):
        describe.store_vectors(rows, name, "classes", embeddings=scratch_path(spark, "class-embeddings"))
    tag = F.col("metadata").getItem
    return spark.table(name).select(
        "id", "document", tag("file_path").alias("file_path"), tag("class_name").alias("class_name"), "file_type", "tokens")


def keep_history(spark, sf) -> DataFrame:
    root = scratch_path(spark, "history")
    prior = fx.revisions(spark, sf).where(F.col("old") != F.col("new"))
    rows = prior.select(F.col("doc_id").cast("string").alias("path"), F.col("old").alias("content"))
    storage.keep_history(rows, F.to_timestamp(F.lit(HISTORY_TIME)), root)
    return spark.read.schema(schemas.HISTORY).parquet(root).drop("run")


# Filters ------------------------------------------------------------------

def suffix_filter(spark, sf) -> DataFrame:
    return ignore.with_suffix_in_scope(fx.page_files(spark, sf), ".html").select("page_id", "path")


def hidden_folder_filter(spark, sf) -> DataFrame:
    return ignore.without_hidden_folders(fx.page_files(spark, sf)).select("page_id", "path")


def ignore_rule_filter(spark, sf) -> DataFrame:
    return ignore.without_ignored(fx.page_files(spark, sf), fx.ignore_rules(spark, sf)).select("page_id", "path")


def ignore_subtree_filter(spark, sf) -> DataFrame:
    blogs = fx.hosts(spark, sf).where(F.col("host").startswith("blog."))
    listed = blogs.select(F.concat(F.lit("./"), "host", F.lit("//en/")).alias("folder"))
    return ignore.without_subtrees(fx.page_files(spark, sf), listed).select("page_id", "path")


def ignore_suffix_filter(spark, sf) -> DataFrame:
    return ignore.without_suffixes(fx.page_files(spark, sf), [".html"]).select("page_id", "path")


def _all_queries(spark, sf) -> DataFrame:
    return fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def metadata_filter(spark, sf) -> DataFrame:
    """Neighbours of every vector among those of one file type."""
    kept = fx.vectors(spark, sf).where(vec.metadata_equals("file_type", "label_3"))
    return search.nearest(_all_queries(spark, sf), kept)


def folder_depth_filter(spark, sf) -> DataFrame:
    return folders.within_depth(folders.folders_of(fx.page_files(spark, sf)), FOLDER_DEPTH)


def blank_entry_filter(spark, sf) -> DataFrame:
    lines = text.nonblank_lines(F.col("content"))
    return fx.doc_files(spark, sf).select(
        "doc_id", F.size(lines).alias("lines"), F.array_join(lines, "\n").alias("kept")
    )


def _parsed(spark, sf) -> DataFrame:
    return code.parse_modules(fx.code_files(spark, sf))


def package_import_filter(spark, sf) -> DataFrame:
    return code.imports_from(code.import_list(_parsed(spark, sf)), PACKAGE)


def empty_output_filter(spark, sf) -> DataFrame:
    content = postprocess.tool_content(F.col("args"))
    return fx.model_output(spark, sf).select("doc_id", changes.output_status(content).alias("status"))


# Joins --------------------------------------------------------------------

def changed_files(spark, sf) -> DataFrame:
    return changes.changed(changes.fingerprints(fx.doc_files(spark, sf)), fx.manifest(spark, sf))


def skip_described(spark, sf) -> DataFrame:
    return vec.not_described(fx.doc_files(spark, sf).select("doc_id", "path"), fx.summaries(spark, sf))


def description_lookup(spark, sf) -> DataFrame:
    """Two descriptions per summary path; the first counts, none is empty."""
    first = fx.summaries(spark, sf).withColumn("ordinal", F.lit(0))
    second = first.select("path", F.lit("later").alias("description"), F.lit(1).alias("ordinal"))
    return describe.first_descriptions(fx.doc_files(spark, sf).select("path"), first.unionByName(second))


def folder_assignment(spark, sf) -> DataFrame:
    return folders.assign_by_depth(fx.page_files(spark, sf), FOLDER_DEPTH).select("page_id", "path", "folder")


def listed_folder_assignment(spark, sf) -> DataFrame:
    """Only blog hosts and English folders are listed; the rest goes to the root."""
    every = folders.folders_of(fx.page_files(spark, sf))
    listed = every.where(F.col("folder").startswith("blog.") | F.col("folder").endswith("/en"))
    return folders.assign_to_listed(fx.page_files(spark, sf).select("page_id", "path"), listed)


def insert_if_absent(spark, sf) -> DataFrame:
    rows = fx.vectors(spark, sf)
    stored = fx.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return vec.absent_only(rows, stored).select("id", "document", "file_type")


def vector_top_k(spark, sf) -> DataFrame:
    return search.nearest(_all_queries(spark, sf), fx.vectors(spark, sf))


def vector_top_k_cosine(spark, sf) -> DataFrame:
    return search.nearest(_all_queries(spark, sf), fx.vectors(spark, sf), metric="cosine")


def vector_top_k_blocks(spark, sf) -> DataFrame:
    """The way taken when the queries are too many to share."""
    return search.nearest(
        _all_queries(spark, sf), fx.vectors(spark, sf),
        max_shared_bytes=0, block_bytes=64 * 1024,
    )


def indexed_top_k(spark, sf) -> DataFrame:
    index = metric_index.write_index(fx.vectors(spark, sf), scratch_path(spark, "index"))
    return metric_index.nearest_indexed(_all_queries(spark, sf), index)


def indexed_top_k_cosine_visits(spark, sf) -> DataFrame:
    """The way taken when the queries are too many to share."""
    index = metric_index.write_index(fx.vectors(spark, sf), scratch_path(spark, "index"), "cosine")
    return metric_index.nearest_indexed(
        _all_queries(spark, sf), index, max_shared_bytes=0, block_bytes=64 * 1024)


def approval_gate(spark, sf) -> DataFrame:
    changed = fx.revisions(spark, sf).select("doc_id", (F.col("old") != F.col("new")).alias("changed"))
    return reports.approved_only(changed, fx.decisions(spark, sf), "doc_id")


def class_docstring_lookup(spark, sf) -> DataFrame:
    """Per module: a documented class, a nested one, and one that is not there."""
    key = F.regexp_extract("path", r"part_(\d+)", 1)
    names = [F.concat(F.lit(stem), key) for stem in ("Part", "Spare", "Missing")]
    requests = fx.code_files(spark, sf).select("path", F.explode(F.array(*names)).alias("class_name"))
    return code.class_docstrings(requests, _parsed(spark, sf))


def import_context(spark, sf) -> DataFrame:
    """Imported names retrieve other modules as context, per module."""
    files = written(fx.code_files(spark, sf), "files")
    parsed = written(code.parse_modules(files), "parsed")
    stored = written(
        embedding.with_embedding(files.select(F.col("path").alias("id"), F.col("content").alias("document"))),
        "embedded",
    )
    return retrieval.import_contexts(parsed, files, stored, PACKAGE).select(
        "path", "query", F.sha2("context", 256).alias("context_sha256")
    )


# Aggregations ---------------------------------------------------------------

def batch_validation(spark, sf) -> DataFrame:
    return vec.batch_verdicts(fx.batches(spark, sf))


def folders_by_depth(spark, sf) -> DataFrame:
    every = folders.within_depth(folders.folders_of(fx.page_files(spark, sf)), FOLDER_DEPTH)
    return folders.folder_levels(every).select(
        "depth", "part", F.size("folders").alias("n_folders"), F.array_join("folders", "\n").alias("folders")
    )


def folder_change_reports(spark, sf) -> DataFrame:
    changed = changed_files(spark, sf)
    return reports.change_reports(folders.assign_by_depth(changed, FOLDER_DEPTH))


def compiled_docstrings(spark, sf) -> DataFrame:
    return code.compiled_docstrings(_parsed(spark, sf))


def docstring_descriptions(spark, sf) -> DataFrame:
    return code.docstring_descriptions(_parsed(spark, sf))


def import_query_text(spark, sf) -> DataFrame:
    return code.import_query(_parsed(spark, sf), PACKAGE)


def directory_rollup(spark, sf) -> DataFrame:
    return folders.directory_totals(fx.page_files(spark, sf))


def directory_listing(spark, sf) -> DataFrame:
    return folders.tree_lines(fx.page_files(spark, sf).select("path"))


def ignored_tree(spark, sf) -> DataFrame:
    """The tree under its own rules, without the English folders of blogs and without one suffix."""
    blogs = fx.hosts(spark, sf).where(F.col("host").startswith("blog.")).select(
        F.concat(F.lit("./"), "host", F.lit("//en/")).alias("folder"))
    return project_tree.project_tree(fx.ruled_files(spark, sf), blogs, [".htm"], root_name="pages")


def run_counters(spark, sf) -> DataFrame:
    return changes.run_counters(changes.fingerprints(fx.doc_files(spark, sf)), fx.manifest(spark, sf))


def _budgeted_queries(spark, sf) -> DataFrame:
    budget = prompts.context_budget(F.col("document"), limit=4000)
    return fx.vectors(spark, sf).select(
        F.col("id").alias("query_id"), "embedding", budget.alias("budget")
    )


def packed_context(spark, sf) -> DataFrame:
    """Every vector asks; its hits are packed into what its own text leaves."""
    return retrieval.retrieved_context(_budgeted_queries(spark, sf), fx.vectors(spark, sf))


# Windows --------------------------------------------------------------------

def token_budget_packing(spark, sf) -> DataFrame:
    """Documents of a source, in id order, into the budget its longest text leaves."""
    docs = fx.doc_files(spark, sf)
    narrow = docs.select("source", "doc_id", text.token_count(F.col("content")).alias("tokens"))
    ranked = ordering.with_position(narrow, [F.col("doc_id")], ["source"], "rank")
    budgets = docs.groupBy("source").agg(
        F.floor((F.lit(prompts.REQUEST_TOKEN_LIMIT) - F.max("n_chars")) / 2).alias("budget")
    )
    of_source = budgets.select(F.col("source").alias("_source"), "budget")
    joined = ranked.join(of_source, F.col("source").eqNullSafe(F.col("_source")))
    return packing.pack_ranked_any_size(joined, ["source"], F.col("budget")).select(
        "source", "doc_id", "rank", "tokens", "running_tokens"
    )


def last_message(spark, sf) -> DataFrame:
    return reports.last_messages(fx.table(spark, sf, "conversations"))


def last_assistant_message(spark, sf) -> DataFrame:
    return reports.last_messages(fx.table(spark, sf, "conversations"), role="assistant")


def first_match(spark, sf) -> DataFrame:
    """First document of every text."""
    rows = fx.doc_files(spark, sf).select(F.sha2("content", 256).alias("sha256"), "doc_id", "path", "lang")
    return ordering.first_per_key(rows, ["sha256"], "doc_id")


def last_definition(spark, sf) -> DataFrame:
    """Part names defined again and again within a brand."""
    rows = fx.table(spark, sf, "part").select("p_brand", "p_name", "p_partkey", "p_type", "p_size")
    return ordering.last_definition_wins(rows, ["p_brand", "p_name"], "p_partkey")


# Order ------------------------------------------------------------------------

def work_order(spark, sf) -> DataFrame:
    return changes.work_order(changed_files(spark, sf))


def top_five(spark, sf) -> DataFrame:
    """Five longest documents per source."""
    rows = fx.doc_files(spark, sf).select("source", "doc_id", "n_chars")
    return ordering.top_k(rows, ["source"], [F.col("n_chars").desc(), F.col("doc_id")], search.DEFAULT_K)


def deepest_folders_first(spark, sf) -> DataFrame:
    return folders.deepest_first(folders.folders_of(fx.page_files(spark, sf)))


def messages_in_order(spark, sf) -> DataFrame:
    return reports.messages_in_order(fx.table(spark, sf, "conversations"))


# Streams -------------------------------------------------------------------------

def _followed(spark, sf) -> tuple[str, str]:
    """Documents landed as a stream of arrivals on top of the last run's manifest: output and checkpoint."""
    landing, start, out, check = (scratch_path(spark, name) for name in ("landing", "start", "changed", "state"))
    fx.manifest(spark, sf).write.parquet(start)
    fx.doc_files(spark, sf).select("path", "content", F.lit(1).cast("long").alias("arrived")).write.parquet(landing)
    manifest_state.follow_manifest(spark, landing, check, manifest_state.table_writer(out), start).awaitTermination()
    return out, check


def changed_by_state(spark, sf) -> DataFrame:
    rows = spark.read.schema(manifest_state.CHANGED).parquet(_followed(spark, sf)[0])
    return rows.select("path", "sha256", "size_bytes")


def manifest_in_state(spark, sf) -> DataFrame:
    return manifest_state.manifest_of(spark, _followed(spark, sf)[1])


# Sets ---------------------------------------------------------------------------

def manifest_merge(spark, sf) -> DataFrame:
    """Changed files replace their hashes in the last run's manifest."""
    return changes.merge_manifest(fx.manifest(spark, sf), changed_files(spark, sf))


def append_summaries(spark, sf) -> DataFrame:
    old = fx.summaries(spark, sf).withColumn("path", paths.normalize(F.col("path")))
    fresh = vec.not_described(fx.doc_files(spark, sf), old).select(
        "path", F.concat(F.lit("New text in "), "lang").alias("description")
    )
    return describe.keep_summaries(old, fresh, scratch_path(spark, "summaries-state"))


def merge_metadata(spark, sf) -> DataFrame:
    tags = F.create_map(F.lit("file_type"), F.lit("script"), F.lit("lang"), F.col("lang"))
    rows = fx.vectors(spark, sf).join(
        fx.doc_files(spark, sf).select(F.col("doc_id").cast("string").alias("id"), "lang"), "id"
    )
    merged = rows.select("id", vec.merge_metadata(F.col("metadata"), tags).alias("m"))
    return merged.select(
        "id", F.size("m").alias("n_keys"), *[F.col("m")[k].alias(k) for k in ("file_path", "file_type", "lang")]
    )


def line_diff(spark, sf) -> DataFrame:
    return revisions.line_changes(fx.revisions(spark, sf), "doc_id")


# Scalars --------------------------------------------------------------------------

def content_hash(spark, sf) -> DataFrame:
    return changes.fingerprints(fx.doc_files(spark, sf))


def path_functions(spark, sf) -> DataFrame:
    path = F.col("path")
    raw = F.concat(F.lit("./site//"), path)
    return fx.page_files(spark, sf).select(
        "page_id",
        paths.normalize(raw).alias("normalized"),
        paths.relative_to(paths.normalize(raw), "site").alias("relative"),
        paths.depth(path).alias("depth"),
        paths.parent(path).alias("parent"),
        paths.suffix(path).alias("suffix"),
        paths.with_suffix(path, ".txt").alias("swapped"),
    )


def byte_sizes(spark, sf) -> DataFrame:
    return fx.doc_files(spark, sf).select("doc_id", paths.size_bytes(F.col("content")).alias("size_bytes"))


def header_tag(spark, sf) -> DataFrame:
    tagged = text.ensure_header(postprocess.tool_content(F.col("args")), TAG)
    return fx.model_output(spark, sf).select("doc_id", tagged.alias("content"))


def trailing_newline(spark, sf) -> DataFrame:
    ended = text.ensure_trailing_newline(postprocess.tool_content(F.col("args")))
    return fx.model_output(spark, sf).select("doc_id", ended.alias("content"))


def fence_escape(spark, sf) -> DataFrame:
    escaped = text.escape_fences(F.col("content"))
    return fx.fenced(spark, sf).select(
        "doc_id", escaped.alias("escaped"), (text.unescape_fences(escaped) == F.col("content")).alias("restored")
    )


def sanitized_names(spark, sf) -> DataFrame:
    return fx.table(spark, sf, "pages").select(
        "page_id", text.sanitize_name(F.col("url")).alias("name"), text.stable_suffix(F.col("url")).alias("suffix")
    )


def repository_names(spark, sf) -> DataFrame:
    found = text.repository_owner_and_name(F.col("url"))
    return fx.repo_urls(spark, sf).select("doc_id", found["owner"].alias("owner"), found["name"].alias("name"))


def token_counts(spark, sf) -> DataFrame:
    return fx.doc_files(spark, sf).select("doc_id", text.token_count(F.col("content")).alias("tokens"))


def prompt_columns(spark, sf) -> DataFrame:
    """Both prompts, section, id and budget for every document."""
    content, path = F.col("content"), F.col("path")
    section = prompts.context_section(F.when(F.col("quality") == 1, content), F.col("source"))
    context = F.when(F.col("toxic") == 1, F.lit("")).otherwise(section)
    rows = fx.labelled(spark, sf).withColumn("content", F.concat(F.lit("```\n"), content))
    return rows.select(
        "doc_id",
        prompts.describe_prompt(content, path).alias("describe"),
        prompts.describe_prompt(content, tree=F.when(F.col("quality") == 0, F.lit("a/\n  b"))).alias("describe_tree"),
        prompts.document_prompt(content, context).alias("document"),
        prompts.composite_id(path, F.col("lang")).alias("composite"),
        prompts.context_budget(content).alias("budget"),
    )


def small_text_maps(spark, sf) -> DataFrame:
    secret = F.when(F.col("quality") == 1, F.col("lang")).when(F.col("quality") == 0, F.lit(""))
    rows = fx.labelled(spark, sf).join(fx.decisions(spark, sf), "doc_id", "left")
    parsed = fx.model_output(spark, sf).select("doc_id", postprocess.tool_content(F.col("args")).alias("parsed"))
    return rows.join(parsed, "doc_id").select(
        "doc_id",
        text.decision(F.col("answer")).alias("decision"),
        text.first_line(F.col("content")).alias("first_line"),
        text.preview(F.col("content")).alias("preview"),
        text.secret_state(secret).alias("secret"),
        F.length("parsed").alias("parsed_chars"),
    )


# Python jobs ----------------------------------------------------------------------

def symbol_extraction(spark, sf) -> DataFrame:
    return code.symbols(_parsed(spark, sf))


def class_hierarchy(spark, sf) -> DataFrame:
    return code.class_edges(code.class_parents(_parsed(spark, sf)))


def class_table(spark, sf) -> DataFrame:
    return code.class_parents(_parsed(spark, sf)).select(
        "path", "position", "class_name", F.array_join("parents", ",").alias("parents"), "docstring"
    )


def import_listing(spark, sf) -> DataFrame:
    return code.import_list(_parsed(spark, sf))


def batch_embedding(spark, sf) -> DataFrame:
    rows = embedding.with_embedding(fx.doc_files(spark, sf), "content")
    slots = rows.select("doc_id", F.posexplode("embedding").alias("slot", "weight"))
    return slots.where(F.col("weight") != 0).select(
        "doc_id", "slot", F.round(F.col("weight").cast("double"), 6).alias("weight")
    )


def echoing_model():
    """The reply follows from the prompt alone."""
    return lambda batch: [KEPT_REPLY + sha256(prompt.encode()).hexdigest() for prompt in batch]


def batch_completion(spark, sf) -> DataFrame:
    asked = fx.doc_files(spark, sf).select(prompts.describe_prompt(F.col("content")).alias("prompt"))
    return completion.complete_prompts(asked, echoing_model, backoff=0)


def named_post_processor(spark, sf) -> DataFrame:
    return postprocess.apply_named(fx.model_output(spark, sf), "write_new_content", '{"tag": "%s"}' % TAG)


# Whole runs -----------------------------------------------------------------

def describing_model():
    """Stands for a hosted model: the reply follows from the prompt alone."""
    return lambda batch: [f"About {sha256(p.encode()).hexdigest()}" for p in batch]


def documenting_model():
    """Replies as asked: a JSON object with the file's new content."""
    def reply(prompt: str) -> str:
        code_block = prompt.rsplit("python\n", 1)[1][:-4]
        return json.dumps({"new_file_content": RUN_DOCSTRING + code_block.rstrip("\n")})

    return lambda batch: [reply(p) for p in batch]


def _run_twice(spark, sf, times: int):
    """Runs over all modules, the next one on the files that the last one left."""
    root, name = scratch_path(spark, "run-state"), f"run_{uuid.uuid4().hex}"
    files = fx.code_files(spark, sf)
    for _ in range(times):
        done = run.run(
            files,
            run.RunSettings(state_root=root, collection=name, package=PACKAGE, tag=TAG,
                            at=F.lit(HISTORY_TIME).cast("timestamp"), retry=(("backoff", 0),)),
            describing_model, documenting_model)
        files = written(done.files, "files-after-run")
    spark.sql(f"DROP TABLE {name}")
    return done


def first_run(spark, sf) -> DataFrame:
    """Detect, describe, store, retrieve, document and version: the hash of every new content."""
    return _run_twice(spark, sf, 1).manifest


def second_run(spark, sf) -> DataFrame:
    """Nothing has changed since the first run: nothing is done, the state stays."""
    done = _run_twice(spark, sf, 2)
    counted = [
        getattr(done, name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name in ("pending", "descriptions", "contents", "reports", "manifest", "files")
    ]
    return reduce(DataFrame.unionByName, counted)


QUERIES = {
    "run_first": first_run,
    "run_second": second_run,
    "src1_scan_source_tree": scan_source_tree,
    "src2_load_manifest": load_manifest,
    "src3_load_summaries": load_summaries,
    "src4_parse_ignore_rules": parse_ignore_rules,
    "snk1_save_manifest": save_manifest,
    "snk2_save_summaries": save_summaries,
    "snk3_save_descriptions": save_descriptions,
    "snk4_vector_collection": vector_collection,
    "snk4_class_vectors": class_vectors,
    "snk5_keep_history": keep_history,
    "flt1_suffix_filter": suffix_filter,
    "flt2_hidden_folder_filter": hidden_folder_filter,
    "flt3_ignore_rule_filter": ignore_rule_filter,
    "flt4_ignore_subtree_filter": ignore_subtree_filter,
    "flt5_ignore_suffix_filter": ignore_suffix_filter,
    "flt6_metadata_filter": metadata_filter,
    "flt7_folder_depth_filter": folder_depth_filter,
    "flt8_blank_entry_filter": blank_entry_filter,
    "flt9_package_import_filter": package_import_filter,
    "flt10_empty_output_filter": empty_output_filter,
    "jon1_changed_files": changed_files,
    "jon1_changed_by_state": changed_by_state,
    "jon2_skip_described": skip_described,
    "jon3_description_lookup": description_lookup,
    "jon4_folder_assignment": folder_assignment,
    "jon4_listed_folder_assignment": listed_folder_assignment,
    "jon5_insert_if_absent": insert_if_absent,
    "jon6_vector_top_k": vector_top_k,
    "jon6_vector_top_k_cosine": vector_top_k_cosine,
    "jon6_vector_top_k_blocks": vector_top_k_blocks,
    "jon6_indexed_top_k": indexed_top_k,
    "jon6_indexed_top_k_cosine_visits": indexed_top_k_cosine_visits,
    "jon7_approval_gate": approval_gate,
    "jon8_class_docstring_lookup": class_docstring_lookup,
    "jon9_import_context": import_context,
    "agg1_batch_validation": batch_validation,
    "agg2_folders_by_depth": folders_by_depth,
    "agg3_folder_change_reports": folder_change_reports,
    "agg4_compiled_docstrings": compiled_docstrings,
    "agg5_docstring_descriptions": docstring_descriptions,
    "agg6_import_query_text": import_query_text,
    "agg7_directory_rollup": directory_rollup,
    "agg7_directory_listing": directory_listing,
    "agg7_ignored_tree": ignored_tree,
    "agg8_run_counters": run_counters,
    "agg9_packed_context": packed_context,
    "win1_token_budget_packing": token_budget_packing,
    "win2_last_message": last_message,
    "win2_last_assistant_message": last_assistant_message,
    "win3_first_match": first_match,
    "win4_last_definition": last_definition,
    "srt1_work_order": work_order,
    "srt2_top_five": top_five,
    "srt3_deepest_folders_first": deepest_folders_first,
    "srt4_messages_in_order": messages_in_order,
    "set1_manifest_merge": manifest_merge,
    "set1_manifest_in_state": manifest_in_state,
    "set2_append_summaries": append_summaries,
    "set3_merge_metadata": merge_metadata,
    "set4_line_diff": line_diff,
    "scl1_content_hash": content_hash,
    "scl2_path_functions": path_functions,
    "scl2_byte_sizes": byte_sizes,
    "scl3_header_tag": header_tag,
    "scl4_trailing_newline": trailing_newline,
    "scl5_fence_escape": fence_escape,
    "scl6_sanitized_names": sanitized_names,
    "scl7_repository_names": repository_names,
    "scl8_token_counts": token_counts,
    "scl9_prompt_columns": prompt_columns,
    "scl10_small_text_maps": small_text_maps,
    "udf1_symbol_extraction": symbol_extraction,
    "udf2_class_hierarchy": class_hierarchy,
    "udf2_class_table": class_table,
    "udf3_import_listing": import_listing,
    "udf4_batch_embedding": batch_embedding,
    "udf5_batch_completion": batch_completion,
    "udf6_named_post_processor": named_post_processor,
}
