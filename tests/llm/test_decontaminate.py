import random
import re

import numpy as np
import pytest

from quillframe.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, size=13):
    doc, hit, found, longest = words(text), set(), set(), 0
    for item, other in items:
        w = words(other)
        n = min(size, len(w))
        for p in range(len(w) - n + 1) if w else ():
            for q in range(len(doc) - n + 1):
                if doc[q:q + n] == w[p:p + n]:
                    hit.update(range(q, q + n))
                    found.add("" if item is None else str(item))
                    k = n
                    while p + k < len(w) and q + k < len(doc) and doc[q + k] == w[p + k]:
                        k += 1
                    longest = max(longest, k)
    return len(doc), len(hit), sorted(found), longest, bool(hit) and 20 * len(hit) >= len(doc)


def cases(seed):
    rng = random.Random(seed)
    letters = ["a", "B", "c1", "é", "Ñu", "d"]
    text = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 5, 12, 13, 14, 30]) if i else 13)) for i in range(6)]
    items += [(2, text(20)), (None, items[3][1]), items[4], (9, None), (11, "only here " * 8)]
    docs = [None, "", "...", text(400), "Only  HERE," * 7, "A" * 50]
    for _ in range(25):
        parts = [text(rng.randrange(30)), rng.choice(items)[1] or "", rng.choice(items)[1] or "", text(rng.randrange(30))]
        docs.append(rng.choice([" ", ", ", "\n"]).join(parts).replace(" ", rng.choice([" ", " - "])))
    return items, docs


@pytest.mark.parametrize("seed,block_words", [(1, 10**6), (2, 40), (3, 10**6)])
def test_as_by_brute_force(spark, seed, block_words):
    items, texts = cases(seed)
    if seed == 3:  # windows of several words only
        items = [(i, t) for i, t in items if t and len(words(t)) > 4]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as items").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as n_hit")
    got = dc.find_contamination(docs, bench, block_words=block_words).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_hit, r["items"], r.longest_words, r.contaminated) == brute(r.text, items), r.text
        assert sum(s.length for s in r.spans) == r.n_hit


def test_filter_empty_tables_and_repeats(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id int, text string")
    docs = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(13)), "x"), (2, "clean", "y"), (2, "clean", "y"), (None, None, None)],
                                 "doc_id long, text string, contaminated string")
    left = dc.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(map(str, (r.doc_id for r in left.collect()))) == ["2", "2", "None"]
    assert dc.drop_contaminated(docs, bench.limit(0)).count() == 4
    assert dc.find_contamination(docs.limit(0), bench).count() == 0


def test_suffix_array_order():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50):
        a = rng.integers(1, 4, n)
        order = dc.suffix_array(a, 64)
        assert [a[i:].tolist() for i in order] == sorted(a[i:].tolist() for i in range(n))


def test_words_across_pieces(monkeypatch):
    monkeypatch.setattr(dc, "PIECE_BYTES", 7)
    text = ("aé" * 2600 + " Bc d-1 " + "x" * 5000).encode() * 3
    assert [w.decode() for part in dc.words_of(text) for w in part] == words(text.decode())


def found_in(text, items):
    block, shard = dc.Block([(i, t.encode().split()) for i, t in items], 13), dc.Shard([text.encode()])
    shard.search(block)
    n_words, n_hit, names, longest, spans, _ = (c.to_pylist()[0] for c in shard.columns(20))
    return n_words, n_hit, names, longest, [(s["start"], s["length"]) for s in spans]


def test_one_word_again_and_again():
    """Occurrences times places would be a thousand million pairs."""
    assert found_in("the " * 200_000, [("a", "the " * 5000), ("b", "the " * 14 + "end")]) == (200_000, 200_000, ["a", "b"], 5000, [(0, 200_000)])
    text = " ".join(["a b c"] * 30_000)
    assert found_in(text, [("x", " ".join(["b c a"] * 2000))]) == (90_000, 90_000, ["x"], 6000, [(0, 90_000)])


def test_many_items_that_share_a_window():
    shared = " ".join(f"s{i}" for i in range(15))
    items = [(f"i{n:05d}", f"{shared} own{n} words{n}") for n in range(10_000)]
    n_words, n_hit, names, longest, spans = found_in(f"before {shared} own77 other {shared}", items)
    assert (n_words, n_hit, longest, spans) == (33, 31, 16, [(1, 16), (18, 15)]) and names == [i for i, _ in items]


def test_longest_common_of_random_numbers():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = (rng.integers(0, 3, rng.integers(1, 40)) for _ in range(2))
        starts = np.arange(len(a))
        want = []
        for i in starts:
            best = 0
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] != 0:
                    k += 1
                best = max(best, k)
            want.append(best)
        assert dc.longest_common(a, starts, b).tolist() == want
