import html as entities
import random
import re

import pyarrow as pa
import pytest

from quillframe.llm import html_text as h
from quillframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_the_query_as_by_its_markup(spark):
    """The tables' pages mark the article: read it off with patterns."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op3_html_extraction"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        parts = re.split(r"</?p>|</?h1>", article.replace("<br>", " "))
        lines = (" ".join(entities.unescape(re.sub("</?b>", "", p)).split()) for p in parts)
        assert r.text == "\n".join(x for x in lines if x)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def slow_match(a, b):
    """The recursion as it is defined, without short cuts."""
    if (a.tag, a.names) != (b.tag, b.names):
        return 0
    x, y = a.children(), b.children()

    def best(i, j):
        if not i or not j:
            return 0
        return max(best(i - 1, j), best(i, j - 1), best(i - 1, j - 1) + slow_match(x[i - 1], y[j - 1]))

    return 1 + best(len(x), len(y))


def some_tree(rng, depth=3):
    tag = rng.choice(["div", "section", "span"])
    inner = "".join(some_tree(rng, depth - 1) for _ in range(rng.randrange(4))) if depth else "x"
    return f"<{tag}>{inner}</{tag}>"


@pytest.mark.parametrize("seed", range(25))
def test_simple_tree_matching(seed):
    rng = random.Random(seed)
    a, b = h.parse(some_tree(rng)), h.parse(some_tree(rng))
    pairs = list(h.align(a, b))
    assert len(pairs) == h.matched(a, b, {}) == slow_match(a, b)
    assert all(x.tag == y.tag for x, y in pairs)


SITE = """<html><head><title>t</title></head><body><div class=x1>Welcome to our site</div>
<div><p>{0}</p><p>{1}</p></div><div>All about us<span>Imprint</span></div></body></html>"""


def test_what_is_the_same_on_all_pages_is_template():
    pages = [SITE.format(f"first {i}", f"second &amp; {i * i}") for i in range(8)]
    assert h.texts_of_pages(pages) == [f"first {i}\nsecond & {i * i}" for i in range(8)]
    # too few pages tell nothing, and copies of one page count once
    assert "Welcome" in h.texts_of_pages(pages[:2])[0]
    assert "Welcome" in h.texts_of_pages([pages[0]] * 40)[0]


def plain_host(choose, n):
    """Pages without an article, a main part or a telling name, and their articles."""
    words = lambda k: " ".join(choose.choice("lorem ipsum dolor sit amet elit sed do".split()) + str(choose.randrange(999)) for _ in range(k))
    for i in range(n):
        title, parts = words(6), [words(choose.randrange(30, 90)) for _ in range(choose.randrange(1, 6))]
        links = "".join(f"<li><a href=/{k}>{words(2)}</a></li>" for k in range(5))
        yield (f"""<body><div class=a1><div>Our company</div><ul><li><a href=/>Start</a></li><li><a href=/c>Contact</a></li></ul></div>
<div class=a2><div class=b1><h2>{title}</h2>{''.join(f'<p>{p}</p>' for p in parts)}</div>
<div class=b2><div>More for you</div><ul>{links}</ul></div></div><div class=a3>All rights kept. Page no. <i>{i}</i></div></body>""",
               "\n".join([title, *parts]))


def test_a_host_whose_markup_tells_nothing():
    pages, wanted = zip(*plain_host(random.Random(4), 12))
    assert h.texts_of_pages(list(pages)) == list(wanted)


def test_the_wrapper_makes_the_result(monkeypatch):
    pages = [SITE.format(f"first {i}", f"second {i * i}") for i in range(8)]
    with_it = h.texts_of_pages(pages)
    monkeypatch.setattr(h, "TEMPLATE_PAGES", 99)
    without = h.texts_of_pages(pages)
    assert all(a != b and "Welcome" in b and "Welcome" not in a for a, b in zip(with_it, without))


def test_the_host_tells_where_a_short_page_has_its_content():
    pages = [p for p, _ in plain_host(random.Random(5), 9)]
    short = re.sub(r"<h2>.*</p>", "<h2>Ab</h2><p>cd</p>", pages[0])
    assert h.texts_of_pages([*pages, short])[-1] == "Ab\ncd"
    assert h.texts_of_pages([short])[0] != "Ab\ncd"  # alone its links weigh more


@pytest.mark.parametrize("page,want", [
    ("<nav>n</nav><article class='post has-sidebar'><p>text of it</p></article>", "text of it"),
    ("<div class='no-comments'><article><p>text</p></article></div><footer>f</footer>", "text"),
    ("<form id=aspnetForm><input type=hidden><div class=menu>m</div><div><p>a long text of the page</p></div></form>", "a long text of the page"),
    ("<p>two <label>three</label> four</p>", "two three four"),
    (f"<div id=content><h2>T</h2><p>{'long ' * 40}</p></div><article class=card><p>teaser</p></article>", "T\n" + " ".join(["long"] * 40)),
    ("<div class=sidebar><p>all of the page is in here</p></div>", "all of the page is in here"),
    ("<article><p>short</p></article><div id=comments>" + "<p>readers wrote a lot</p>" * 9 + "</div>", "short"),
    ("<article><p>text before it</p><form><input><label>Mail</label></form><p>text behind</p></article>", "text before it\ntext behind"),
    ("<p class='ad-free'>kept</p>", "kept"),
])
def test_names_never_drop_what_holds_the_text(page, want):
    assert h.texts_of_pages([page]) == [want]


def test_constant_headings_and_words_inside_the_content_stay():
    pages = [f"<div>Site</div><div><h2>Title {i}</h2><h3>Summary</h3><p>Sum {i}</p><p><b>Note:</b> this {i}</p><h3>Share</h3><p>Send it</p></div>" for i in range(7)]
    assert h.texts_of_pages(pages) == [f"Title {i}\nSummary\nSum {i}\nNote: this {i}" for i in range(7)]


def test_a_group_in_several_batches_loses_no_row():
    batch = lambda host, ids: pa.RecordBatch.from_pydict({"h": [host] * len(ids), "g": [0] * len(ids), "i": ids})
    groups = list(h._groups(iter([batch("a", [1, 2]), batch("a", [3]), batch("b", [4]), batch("b", [5, 6])])))
    assert [[i for part in group for i in part.column(2).to_pylist()] for group in groups] == [[1, 2, 3], [4, 5, 6]]


def test_input_columns_of_any_name(spark):
    names = "_page _host _copied _cell _bytes _group _to _cells n".split()
    rows = [(i, f"http://a/{i}", SITE.format(i, -i), *[f"{i}{c}" for c in names]) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string" + "".join(f", {c} string" for c in names))
    out = h.extract_text(df)
    assert out.columns == [*df.columns, "text", "n_chars"]
    assert sorted(tuple(r)[3:-1] for r in out.collect()) == sorted((*r[3:], f"{r[0]}\n{-r[0]}") for r in rows)


def test_passages_that_many_pages_share_stay():
    pages = [f"<article><p>own {i}</p>{'<p>shared by many</p>' if i % 3 else ''}<p>end {i}</p></article>" for i in range(30)]
    assert [t.count("shared") for t in h.texts_of_pages(pages)] == [int(bool(i % 3)) for i in range(30)]


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("a&lt;b &eacute;&#233;&#x1F600; &amp;amp;", "a<b éé\U0001f600 &amp;"),
    ("<p>one<p>two<br>three<b>four</b>", "one\ntwo threefour"),
    ("<ul class=menu><li>m</ul><main><h1>T</h1><div>a<div>b</div>c</div><form>f</form></main>after", "T\na\nb\nc"),
    ("<header>h</header><article><header><h1>T</h1></header><p>x</p><section id='comments'><p>c</p></section></article><footer>f", "T\nx"),
    ("<article><p>a</p><article class='comment'>c</article></article><aside>s</aside>", "a"),
    ("<div class='side-bar'>k</div><div class='sidebar'>s</div><div id='cookie-notice'>c</div><p hidden>h</p><p style='display: none'>h</p><p>k2", "k\nk2"),
    ("<script>var t='</p>';</script><style>p{}</style><!-- x --><p>a</p><noscript>n</noscript>", "a"),
    ("<body class='sidebar'><p>x</p></body>", "x"), ("</p></div><p>x</i>y</p></nav>z", "xy\nz"), ("<div role='navigation'>n</div><p>x", "x"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<p>a\x00b", "ab"), ("<b>" * 3000 + "deep", "deep"), ("<p>cut <a hr", "cut"),
])
def test_pages_by_themselves(page, want):
    assert h.texts_of_pages([page]) == [want]


def test_long_sibling_lists():
    pages = ["<div>" + "".join(f"<p>{i} {k}</p>" for k in range(900 + i)) + "</div>" for i in range(6)]
    assert [t.count("\n") for t in h.texts_of_pages(pages)] == [899 + i for i in range(6)]


def test_rows_of_every_kind(spark, monkeypatch):
    rows = [(i, f"http://hot/{i}", SITE.format(i, i * 7)) for i in range(90)]
    rows += [(None, None, None), (200, "no host", "<p>x"), (200, "no host", "<p>x"), (201, "http://b/", "")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, n_chars string").repartition(5)
    results = []
    for size in (h.SHARED_BYTES, -1):
        monkeypatch.setattr(h, "SHARED_BYTES", size)
        out = h.extract_text(df)
        assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
        results.append(sorted(map(str, out.collect())))
        got = {r.page_id: r.text for r in out.collect()}
        assert out.count() == len(rows)
        assert all(got[i] == f"{i}\n{i * 7}" for i in range(90)) and got[200] == "x" and got[None] == got[201] == ""
    assert results[0] == results[1]
    assert h.extract_text(df.limit(0)).count() == 0


def with_template_dropped(spark, rows):
    got = h.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert len(got) == len(rows)
    return {r.page_id: r.text for r in got}


def test_a_long_page_leaves_its_host_whole(spark, monkeypatch):
    monkeypatch.setattr(h, "GROUP_BYTES", 20_000)
    pages = [SITE.format(f"first {i}", "long " * 40_000 if i == 3 else i) for i in range(31)]
    got = with_template_dropped(spark, [(i, f"http://a/{i}", p) for i, p in enumerate(pages)])
    assert all(got[i].startswith(f"first {i}\n") and "Imprint" not in got[i] for i in range(31))
    assert got[3].count("long") == 40_000


@pytest.mark.parametrize("copies_bytes", [0, 1 << 20])
def test_copies_take_no_places_of_other_pages(spark, monkeypatch, copies_bytes):
    monkeypatch.setattr(h, "COPIES_BYTES", copies_bytes)
    rows = [(i, f"http://a/{i}", SITE.format("copy", 7)) for i in range(900)]
    rows += [(i, f"http://a/{i}", SITE.format(i, i * 7)) for i in range(900, 1000)]
    got = with_template_dropped(spark, rows)
    assert all(got[i] == (f"{i}\n{i * 7}" if i >= 900 else "copy\n7") for i in range(1000))


def test_every_group_can_learn(spark, monkeypatch):
    monkeypatch.setattr(h, "GROUP_BYTES", 1)
    for n in range(5, 60, 9):
        got = with_template_dropped(spark, [(i, f"http://a{n}/{i}", SITE.format(i, -i)) for i in range(n)])
        assert got == {i: f"{i}\n{-i}" for i in range(n)}


@pytest.mark.parametrize("page,want", [
    ("<div><article><p>a</p>" + "<font>x" * 300 + "<div>in</div>rest</article></div>after", "a\n" + "x" * 300 + "\nin\nrest"),
    ("<div>" * 250 + "<script>code</script><aside>side</aside><p hidden>no</p><div class=comments><p>reader</p></div>text", "text"),
    ("<article>" + "<span>" * 100_000 + "deep<form>f</form>" + "</span>" * 100_000 + "<p>end</article>", "deep\nend"),
    ("<article>" + "<font>line<br>" * 20_000 + "</article>tail", " ".join(["line"] * 20_000)),
])
def test_any_depth(page, want):
    assert h.texts_of_pages([page]) == [want]


def test_deep_pages_are_aligned():
    pages = [SITE.format(i, "<b>" * 5000 + f"deep {i}") for i in range(6)]
    assert h.texts_of_pages(pages) == [f"{i}\ndeep {i}" for i in range(6)]


def test_long_lists_as_short_ones(monkeypatch):
    """Weights decide: the large sections are paired, not the longest run of labels."""
    rows = "<i>x</i>" * 10
    a = h.parse("<div>" + "<p></p>" * 250 + f"<section>{rows}</section>" * 40 + "</div>")
    b = h.parse("<div>" + f"<section>{rows}<b></b></section>" * 40 + "<p></p>" * 240 + "</div>")
    assert h.matched(a, b, {}) == len(list(h.align(a, b))) == 2 + 40 * 11
    rng = random.Random(3)
    for _ in range(10):
        x, y = (h.parse("".join(some_tree(rng, 1) for _ in range(60))) for _ in range(2))
        found = []
        for long_row in (0, 1 << 30):
            monkeypatch.setattr(h, "LONG_ROW", long_row)
            found.append([(id(p), id(q)) for p, q in h.align(x, y)])
        assert found[0] == found[1]
