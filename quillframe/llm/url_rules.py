"""URL filtering by host and path rules, in DataFrame expressions only.

Each URL is expanded into the host suffixes and path prefixes that a rule could
name. The expansions meet the rules in an equi-join on a short digest prefix;
the full digests confirm a hit, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RULE_SCHEMA = "host string, path string, verdict string"
#: Hex digits of the SHA-256 that the join is made on.
KEY_DIGITS = 8
DEFAULT_VERDICT = "allow"

_AFTER_SCHEME = r"(?s)^.*?://(.*)$"
_HOST = r"^([^/?#]*)"
_PATH = r"^[^/?#]*([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Text between ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), _AFTER_SCHEME, 1)
    return F.translate(F.regexp_extract(rest, _HOST, 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), _AFTER_SCHEME, 1)
    return F.regexp_extract(rest, _PATH, 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (host, path, verdict), verdict ``allow`` or ``block``."""
    return spark.createDataFrame(rules, RULE_SCHEMA)


def _prepared(rules: DataFrame) -> DataFrame:
    """One row per rule text: key, digest, text, verdict; ``block`` wins between equals."""
    host = F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER)
    text = F.concat(host, F.coalesce("path", F.lit("")))
    return (
        rules.where(F.coalesce("host", F.lit("")) != "")
        .select(
            text.alias("_rule"), "verdict",
            F.size(F.split(host, r"\.")).alias("_labels"),
            F.length(F.coalesce("path", F.lit(""))).alias("_path_chars"),
        )
        .groupBy("_rule", "_labels", "_path_chars")
        .agg(F.max("verdict").alias("_verdict"))
        .withColumn("_digest", F.sha2("_rule", 256))
        .withColumn("_key", F.left("_digest", F.lit(KEY_DIGITS)))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url",
               default: str = DEFAULT_VERDICT) -> DataFrame:
    """Adds host, path, rule (null without one) and verdict to every row.

    A rule fits its host and all subdomains when the path starts with the
    rule's. The longest rule text wins, ``block`` between two rules of equal
    text. Null URLs and URLs without ``://`` have an empty host and path and no
    rule. Rules without a host are ignored; an empty rule table gives the
    default everywhere. Columns of the result replace columns of those names,
    repeated rows stay repeated.

    Only suffixes with as many labels as some rule and prefixes as long as some
    rule's path are formed, so a very long URL makes no more expansions than
    there are rule shapes. Every distinct (host, path) is judged once. The
    rules' side is broadcast only when Spark's size estimate is below its
    threshold; else the join shuffles, and AQE may split a hot key.
    """
    prepared = _prepared(rules)
    shapes = prepared.agg(
        F.coalesce(F.collect_set("_labels"), F.array().cast("array<int>")).alias("labels"),
        F.coalesce(F.collect_set("_path_chars"), F.array().cast("array<int>")).alias("chars"),
    ).first()
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*kept, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))

    labels = F.split("host", r"\.")
    hosts = F.transform(
        F.filter(F.lit(sorted(shapes.labels) or None).cast("array<int>"),
                 lambda n: (n <= F.size(labels)) & (F.col("host") != "")),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + F.lit(1), n), "."),
    )
    prefixes = F.transform(
        F.filter(F.lit(sorted(shapes.chars) or None).cast("array<int>"), lambda n: n <= F.length("path")),
        lambda n: F.left(F.col("path"), n),
    )
    expressions = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    candidates = (
        parts.select("host", "path").distinct()
        .select("host", "path", F.explode(expressions).alias("_text"))
        .withColumn("_full", F.sha2("_text", 256))
        .withColumn("_key", F.left("_full", F.lit(KEY_DIGITS)))
    )
    winner = (
        candidates.join(prepared, "_key")
        .where((F.col("_full") == F.col("_digest")) & (F.col("_text") == F.col("_rule")))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("_rule", "_verdict"), F.length("_rule")).alias("_won"))
    )
    return parts.join(winner, ["host", "path"], "left").select(
        *kept, "host", "path", F.col("_won._rule").alias("rule"),
        F.coalesce("_won._verdict", F.lit(default)).alias("verdict"),
    )
