from pyspark.sql import functions as F

from quillframe.llm import url_rules
from quillframe.llm.queries import URL_RULES

URLS = [
    "http://www.example.com/en/1", "http://a.example.com/en/x?y=/fr/", "HTTP://A.Example.COM/EN/",
    "https://b.net/es/#t", "https://net/fr/", "https://b.net/de/", "https://xnet/es/", "http://com",
    "http://example.com?q=1", "http://example.com#/en/", "no scheme", "", None, "://", "a://b://c/d",
    "http://.com/", "http://" + "a." * 3000 + "com/" + "x/" * 3000, "https://b.net/es/#t",
    "http://u:p@www.example.com:80/en/", "http://é.com/ü",
]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    hits = [(len(h + p), h + p, v) for h, p, v in rules
            if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    top = max(hits, default=(0, None, "allow"))
    return host, path, top[1], top[2]


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    return url_rules.judge_urls(pages, url_rules.rule_table(spark, rules))


def test_every_url_as_by_brute_force(spark):
    rules = [*URL_RULES, ("b.net", "/de/", "allow"), ("b.net", "/de/", "block"), ("", "/", "block"), ("EXAMPLE.com", "", "block")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged(spark, URLS, rules).collect()}
    low = [(h.lower(), p, v) for h, p, v in rules]
    assert got == {i: brute(u, low) for i, u in enumerate(URLS)}


def test_no_rules_no_rows_and_repeated_rows(spark):
    assert {r.verdict for r in judged(spark, URLS, []).collect()} == {"allow"}
    assert judged(spark, [], URL_RULES).count() == 0
    pages = spark.createDataFrame([(None, "http://a.com/")] * 3, "page_id long, url string")
    assert url_rules.judge_urls(pages, url_rules.rule_table(spark, URL_RULES)).where("rule = 'com/'").count() == 3


def test_many_rules_shuffle_join_agrees(spark):
    """Beyond the broadcast threshold the join shuffles and gives the same."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    a = sorted(map(str, judged(spark, URLS, URL_RULES).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, judged(spark, URLS, URL_RULES).collect())) == a
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_python_in_the_plan(spark):
    df = judged(spark, URLS, URL_RULES).where(F.col("verdict") == "block")
    assert "Python" not in df._jdf.queryExecution().toString()
