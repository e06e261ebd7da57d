"""Inputs derived from the driver's tables, whole tables every time.

Each has a twin of the same name in ``oracles.CTES``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillframe.functions import paths

MODULE = '''"""Part {key} of the catalogue.

Sold as {brand}.
"""
import os
from shop.{type} import Base{size}
from shop.{type}.mix import Mixin{size}, helper_{size}
from shop.wild import *
from . import sibling


class Part{key}(Base{size}, shop.Mixin{size}, make(1)):
    """{name}"""

    def price(self):
        return {size}

    async def fetch(self):
        """Fetch {name}.

        In the background.
        """


if os.name:
    class Spare{key}(Part{key}, shop.kit.Kit[int]):
        """Spare for {brand}"""


def cost():
    """First cost of {name}"""


def cost():
    """Last cost of {brand}"""


def cost():
    return {size}


class Part{key}:
    pass
'''
BROKEN = "def broken(:\n"
BROKEN_BRAND = "Brand#13"
RULE_FILE = "# made for {host}\n\n  es/  \n #odd\n*.{host}\n"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def doc_files(spark, sf) -> DataFrame:
    """Documents as files: source/lang/doc_N.txt."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf, "documents").select(
        "doc_id", path.alias("path"), F.col("text").alias("content"), "lang", "source", "n_chars"
    )


def labelled(spark, sf) -> DataFrame:
    """doc_files with their labels, null where there are none."""
    return doc_files(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")


def manifest(spark, sf) -> DataFrame:
    """State of the last run: good labelled files are current, bad ones stale, the rest unknown."""
    rows = labelled(spark, sf).where(F.col("quality").isNotNull())
    current = F.when(F.col("quality") == 1, F.sha2("content", 256)).otherwise(F.lit("stale"))
    return rows.select("path", current.alias("sha256"))


def summaries(spark, sf) -> DataFrame:
    """Descriptions of the labelled files, under a path not yet normalised."""
    text = F.concat(F.lit("Text in "), "lang", F.lit(" from "), "source", F.lit(", characters: "), F.col("n_chars").cast("string"))
    return labelled(spark, sf).where(F.col("quality").isNotNull()).select(
        F.concat(F.lit(".//"), "path").alias("path"), text.alias("description")
    )


def page_files(spark, sf) -> DataFrame:
    """Pages as files: host/lang/name; mobile hosts are hidden folders, blogs have hidden files."""
    path = paths.url_path(F.col("url"))
    path = F.regexp_replace(path, r"^m\.", ".")
    path = F.when(path.startswith("blog."), F.regexp_replace(path, r"/([^/]*)\z", "/.$1")).otherwise(path)
    return table(spark, sf, "pages").select(
        "page_id", path.alias("path"), F.octet_length("html").cast("bigint").alias("size_bytes")
    )


def hosts(spark, sf) -> DataFrame:
    return page_files(spark, sf).select(paths.folder_of(F.col("path"), 1).alias("host")).distinct()


def rule_files(spark, sf) -> DataFrame:
    text = F.replace(F.lit(RULE_FILE), F.lit("{host}"), F.col("host"))
    return hosts(spark, sf).select(F.col("host").alias("dir"), text.alias("content"))


def ignore_rules(spark, sf) -> DataFrame:
    """Rules per host: the Spanish folder, some English names, French pages ending .html."""
    host = F.col("host")
    per_host = hosts(spark, sf).select(
        F.explode(
            F.array(
                F.struct(F.lit("").alias("dir"), F.when(host.startswith("spam-"), F.lit("spam-*.org/")).otherwise(F.lit("!*")).alias("pattern")),
                F.struct(host.alias("dir"), F.lit("es/").alias("pattern")),
                F.struct(F.concat(host, F.lit("/en")).alias("dir"), F.lit("[0-4]?[!5]*").alias("pattern")),
                F.struct(F.concat(host, F.lit("/fr")).alias("dir"), F.lit("fr/*.html").alias("pattern")),
                F.struct(host.alias("dir"), F.lit("/de").alias("pattern")),
            )
        ).alias("rule")
    )
    return per_host.select("rule.*").distinct()


def ruled_files(spark, sf) -> DataFrame:
    """Pages as files with rule files in hosts and in their English folders."""
    rules = page_files(spark, sf).select(paths.parent(F.col("path")).alias("folder")).where(
        F.col("folder").endswith("/en")).select(
        F.concat("folder", F.lit("/.gitignore")).alias("path"), F.lit("[0-4]*\r\n#[5-9]*\r\n").alias("content")).distinct()
    hosts_own = hosts(spark, sf).select(
        F.concat("host", F.lit("/.gitignore")).alias("path"), F.lit("  es/ \n\n/de\n").alias("content"))
    return page_files(spark, sf).select("path", F.lit("").alias("content")).unionByName(rules).unionByName(hosts_own)


def code_files(spark, sf) -> DataFrame:
    """One module per part; the modules of one brand do not parse."""
    content = F.lit(MODULE)
    for hole, column in (("key", "p_partkey"), ("brand", "p_brand"), ("type", "p_type"), ("size", "p_size"), ("name", "p_name")):
        content = F.replace(content, F.lit("{%s}" % hole), F.col(column).cast("string"))
    content = F.when(F.col("p_brand") == BROKEN_BRAND, F.concat(content, F.lit(BROKEN))).otherwise(content)
    path = F.concat(F.lit("pkg/"), "p_type", F.lit("/part_"), F.col("p_partkey").cast("string"), F.lit(".py"))
    return table(spark, sf, "part").select(path.alias("path"), content.alias("content"))


def vectors(spark, sf) -> DataFrame:
    both = table(spark, sf, "embeddings").join(
        doc_files(spark, sf), F.col("vec_id") == F.col("doc_id")
    )
    file_type = F.concat(F.lit("label_"), F.col("label").cast("string"))
    return both.select(
        F.col("vec_id").cast("string").alias("id"),
        F.col("content").alias("document"),
        F.create_map(F.lit("file_type"), file_type, F.lit("file_path"), F.col("path")).alias("metadata"),
        "embedding",
        file_type.alias("file_type"),
    )


def batches(spark, sf) -> DataFrame:
    """A batch per source: one with repeated ids, one with an empty and one with a missing document."""
    source = F.col("source")
    document = (
        F.when((source == "src5") & F.col("quality").isNull(), F.lit(""))
        .when((source == "src7") & F.col("quality").isNull(), F.lit(None).cast("string"))
        .otherwise(F.col("content"))
    )
    return labelled(spark, sf).select(
        source.alias("batch"),
        F.when(source == "src3", F.col("lang")).otherwise(F.col("doc_id").cast("string")).alias("id"),
        document.alias("document"),
        F.create_map(F.lit("file_path"), F.col("path")).alias("metadata"),
    )


def revisions(spark, sf) -> DataFrame:
    """Bad documents get a line more, toxic ones lose their first, the others stay."""
    content = F.col("content")
    new = (
        F.when(F.col("quality") == 0, F.concat(content, F.lit("\nreviewed")))
        .when(F.col("toxic") == 1, F.regexp_replace(content, r"^[^\n]*\n", ""))
        .otherwise(content)
    )
    return labelled(spark, sf).select("doc_id", content.alias("old"), new.alias("new"))


def decisions(spark, sf) -> DataFrame:
    answer = (
        F.when(F.col("toxic") == 1, F.lit("maybe"))
        .when(F.col("quality") == 1, F.lit(" Yes \n"))
        .otherwise(F.lit("n"))
    )
    return table(spark, sf, "labels").select("doc_id", answer.alias("answer"))


def fenced(spark, sf) -> DataFrame:
    """Documents with a code fence around them."""
    return doc_files(spark, sf).select(
        "doc_id", F.concat(F.lit("```python\n"), "content", F.lit("\n```")).alias("content")
    )


def model_output(spark, sf) -> DataFrame:
    """Tool arguments: escaped fences, empty for toxic, tagged for bad, newline-ended for good ones."""
    text = F.concat(F.lit("` ``python\n"), "content", F.lit("\n` ``"))
    content = (
        F.when(F.col("toxic") == 1, F.lit(""))
        .when(F.col("quality") == 0, F.concat(F.lit("# tagged\n"), text))
        .when(F.col("quality") == 1, F.concat(text, F.lit("\n")))
        .otherwise(text)
    )
    return labelled(spark, sf).select(
        "doc_id", F.to_json(F.struct(content.alias("new_file_content"))).alias("args")
    )


def repo_urls(spark, sf) -> DataFrame:
    name = F.concat("lang", F.lit("/"), "source", F.lit("-"), F.col("doc_id").cast("string"))
    url = (
        F.when(F.col("source") == "src3", F.concat(F.lit("https://example.org/"), name))
        .when(F.col("quality") == 1, F.concat(F.lit("git@github.com:"), name, F.lit(".git")))
        .when(F.col("quality") == 0, F.concat(F.lit("https://github.com/"), name, F.lit(".git")))
        .otherwise(F.concat(F.lit("https://github.com/"), name))
    )
    return labelled(spark, sf).select("doc_id", url.alias("url"))
