"""Path filters: hidden folders, suffixes, ignore rules, ignored subtrees.

Rules are tried on distinct folders, not on every file with all its ancestors:
there are far fewer folders than files, and files then only need an anti-join
on their own folder, which AQE splits when one folder holds most of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quillframe.functions import paths


def with_suffix_in_scope(files: DataFrame, file_suffix: str = ".py") -> DataFrame:
    return files.where(F.col("path").endswith(file_suffix))


def without_hidden_folders(files: DataFrame) -> DataFrame:
    return files.where(~paths.is_hidden(F.col("path")))


def without_suffixes(files: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    return files.where(~paths.suffix(F.col("path")).isin(*suffixes))


def glob_regex(pattern: Column) -> Column:
    """Right-anchored regular expression of a glob, component by component."""
    tokens = F.regexp_extract_all(
        F.array_join(paths.components(pattern), "/"), F.lit(r"\[!?\]?[^\]]*\]|[\s\S]"), F.lit(0)
    )
    return F.concat(F.lit("(^|/)"), F.array_join(F.transform(tokens, _glob_token), ""), F.lit(r"\z"))


def _glob_token(token: Column) -> Column:
    return (
        F.when(F.length(token) > 2, _glob_class(token))
        .when(token == "*", F.lit("[^/]*"))
        .when(token == "?", F.lit("[^/]"))
        .otherwise(F.regexp_replace(token, r"[\\.^$+{}()|\[\]]", r"\\$0"))
    )


def _glob_class(token: Column) -> Column:
    negated = token.startswith("[!")
    body = F.regexp_replace(token, r"^\[!?|\]\z", "")
    members = F.filter(
        F.regexp_extract_all(body, F.lit(r"[\s\S]-[\s\S]|[\s\S]"), F.lit(0)),
        lambda m: (F.length(m) < 3) | (F.substring(m, 1, 1) <= F.substring(m, 3, 1)),
    )
    inner = F.array_join(
        F.transform(
            members,
            lambda m: F.when(
                F.length(m) == 3,
                F.concat(_in_class(F.substring(m, 1, 1)), F.lit("-"), _in_class(F.substring(m, 3, 1))),
            ).otherwise(_in_class(m)),
        ),
        "",
    )
    return (
        F.when((inner == "") & negated, F.lit("[^/]"))
        .when(inner == "", F.lit("(?!)"))
        .when(negated, F.concat(F.lit("[^/"), inner, F.lit("]")))
        .otherwise(F.concat(F.lit("(?!/)["), inner, F.lit("]")))
    )


def _in_class(char: Column) -> Column:
    return F.regexp_replace(char, r"[\\\[\]^&\-]", r"\\$0")


#: Characters that make a pattern more than a name.
WILD = r"[*?\[]"


def compiled_rules(rules: DataFrame) -> DataFrame:
    """(dir, pattern) -> (dir, kind, key, regex), by what a rule needs to be found.

    A ``name`` without wildcards is looked up by folder and name, ``*.suffix`` by
    folder and last extension with ``key`` as the whole ending, and the ``rest``
    has a regular expression. A pattern of several components only ever meets
    one folder, its own, so whether the folder ends like the pattern's front is
    settled here. A rooted pattern never meets a relative path.
    """
    pattern = F.col("pattern")
    parts = paths.components(pattern)
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    front = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    folder = paths.normalize(F.col("dir"))
    plain = ~last.rlike(WILD)
    ending = last.rlike(r"(?s)\A\*(\.[^*?\[.]+)+\z")
    known_front = ~front.rlike(WILD)
    # the folder of the rule must end with the components before the last one
    fits = (front == "") | (folder == front) | folder.endswith(F.concat(F.lit("/"), front))
    usable = rules.where((F.size(parts) > 0) & ~pattern.startswith("/")).select(
        folder.alias("_rule_dir"),
        F.when(known_front & plain, F.lit("name")).when(known_front & ending, F.lit("suffix")).otherwise(F.lit("rest")).alias("_kind"),
        F.when(plain, last).otherwise(F.substring(last, 2, 1 << 30)).alias("_key"),
        glob_regex(pattern).alias("_regex"), (~known_front | fits).alias("_fits"))
    return usable.where("_fits").drop("_fits").distinct()


def _rule_tables(compiled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rules by name, by ending, and one alternation of all others per folder."""
    names = compiled.where("_kind = 'name'").select("_rule_dir", "_key")
    endings = compiled.where("_kind = 'suffix'").select(
        "_rule_dir", "_key", F.concat(F.lit("."), F.substring_index("_key", ".", -1)).alias("_suffix"))
    rest = compiled.where("_kind = 'rest'").groupBy("_rule_dir").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("(?:"), "_regex", F.lit(")")))), "|").alias("_regex"))
    return names, endings, rest


def _met(entries: DataFrame, tables: tuple[DataFrame, DataFrame, DataFrame], how: str) -> list[DataFrame]:
    """``entries`` joined with the rules of each kind, one after the other for anti joins."""
    names, endings, rest = tables
    at, last = F.col("_at"), paths.base_name(F.col("_entry"))
    dotted = F.concat(F.lit("."), F.substring_index(last, ".", -1))
    # regexp_instr keeps the last compiled pattern, so neighbours of one folder share it
    joins = [
        (names, lambda t: (at == t["_rule_dir"]) & (last == t["_key"])),
        (endings, lambda t: (at == t["_rule_dir"]) & (dotted == t["_suffix"]) & last.endswith(t["_key"])),
        (rest, lambda t: (at == t["_rule_dir"]) & (
            t["_regex"].isNull() | (F.regexp_instr(F.col("_entry"), F.coalesce(t["_regex"], F.lit(""))) > 0))),
    ]
    if how == "left_semi":
        return [entries.join(table, condition(table), how) for table, condition in joins]
    for table, condition in joins:
        entries = entries.join(table, condition(table), how)
    return [entries]


def _folder_entries(files: DataFrame) -> DataFrame:
    """(_parent, _entry): each distinct folder of the files, with every folder
    on the way to it and itself."""
    parents = files.select(paths.parent(F.col("path")).alias("_parent")).distinct()
    return parents.select("_parent", F.explode(paths.folders_down_to(F.col("_parent"))).alias("_entry"))


def without_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop entries matching a rule of the folder they are directly in.

    Rules are not inherited downward, but a dropped folder takes everything
    below it along. Rules are found by equi-joins on folder and name, on folder
    and extension, and on folder for the few that need a regular expression, of
    which a folder has one. Rules are tried on each distinct folder once; dropped
    folders become rules without a pattern, so files meet them in the last join.
    """
    names, endings, rest = _rule_tables(compiled_rules(rules))
    entries = _folder_entries(files).where(F.col("_entry") != "")
    distinct = entries.select("_entry").distinct().withColumn("_at", paths.parent(F.col("_entry")))
    hit = reduce(DataFrame.unionByName, _met(distinct, (names, endings, rest), "left_semi")).select("_entry").distinct()
    dead = entries.join(hit, "_entry", "left_semi").select(
        F.col("_parent").alias("_rule_dir"), F.lit(None).cast("string").alias("_regex")).distinct()
    # a folder's one row: without a pattern if the folder is dropped
    by_folder = rest.unionByName(dead).groupBy("_rule_dir").agg(
        F.when(F.count_if(F.col("_regex").isNull()) == 0, F.max("_regex")).alias("_regex"))
    placed = files.withColumn("_entry", F.col("path")).withColumn("_at", paths.parent(F.col("path")))
    return _met(placed, (names, endings, by_folder), "left_anti")[0].select(*files.columns)


def without_subtrees(files: DataFrame, ignored: DataFrame) -> DataFrame:
    """Drop everything under the listed folders; ``ignored`` has a ``folder`` column."""
    listed = ignored.select(paths.normalize(F.col("folder")).alias("_entry")).distinct()
    dead = _folder_entries(files).join(listed, "_entry", "left_semi").select("_parent").distinct()
    return files.join(dead, paths.parent(files["path"]) == dead["_parent"], "left_anti")
