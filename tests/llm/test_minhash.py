import itertools
import random

import numpy as np
import pytest

from quillframe.llm import components, minhash


def shingles(text, size):
    raw = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", raw) if w]
    n = min(size, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, shingles(t, size))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def cases(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["é", "Ü", " x"]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:  # a near copy of an earlier text
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.choice([0, len(words) - 1, rng.randrange(len(words))])
                words[at:at + 1] = rng.choice([[], [rng.choice(vocab)], [words[at], rng.choice(vocab)]])
                words = words or ["w"]
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 20, 60, 200, 900])))))
    return rows


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string").repartition(3)
    return minhash.near_duplicates(df, **options).collect()


@pytest.mark.parametrize("seed,size", [(1, 4), (2, 5)])
def test_as_by_brute_force(spark, seed, size):
    rows = cases(seed)
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "ONE two"), (1004, "one\ttwo"), (1005, "one two three four")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found(spark, rows, shingle_words=size)}
    assert got == brute(rows, size)


def test_hot_groups_nulls_repeats_and_empty(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 3)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(40)]
    rows += [(100 + i, " ".join([*base[:i], "other", *base[i + 1:]])) for i in range(60)]
    rows += [(300 + i, " ".join([*base[:60], *(f"x{i}-{k}" for k in range(60))])) for i in range(40)]
    rows += [(7, rows[7][1]), (None, "a b c d e"), (None, "a b c d e"), (500, "a b c d e")]
    out = found(spark, rows)
    assert len(out) == len(rows)
    want = brute(rows, 5)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])
    assert found(spark, []) == []
    assert all(r.kept for r in found(spark, [(1, None), (2, None)]))


def test_buckets_with_several_components(spark):
    """A pivot that only some of its bucket resemble: the rest is still found."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(90):  # a drifting chain: neighbours are alike, far ones aren't
        for _ in range(4):
            base[rng.randrange(300)] = f"n{rng.random()}"
        rows.append(((i * 37) % 90, " ".join(base)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found(spark, rows)}
    assert got == brute(rows, 5)


def test_long_texts_are_taken_in_pieces(monkeypatch):
    text = ("Word éü  other\n" * 900).encode() + b"z" * 5000
    whole = minhash.word_hashes(text)
    monkeypatch.setattr(minhash, "PIECE_BYTES", 11)
    assert np.array_equal(minhash.word_hashes(text), whole) and len(whole) == 2701


def test_registers_estimate_similarity():
    rng = np.random.default_rng(2)
    estimate = minhash.Estimator(80)
    for n in (1, 3, 40, 500, 5000):
        for share in (1.0, 0.5, 0.0):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = a.copy()
            b[: int(n * (1 - share))] = rng.integers(0, 2**63, int(n * (1 - share)))
            c = minhash.size_classes(n, 80)[-1]
            x, y = minhash.registers(a, c)[None], minhash.registers(b, c)[None]
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            if abs(true - 0.66) > 0.2:
                assert estimate.similar(x, y, np.array([c]))[0] == (true > 0.66)
    assert 0 < estimate.chance[5] < 0.002


def found_pairs(pairs, shingles, seed, least=0.8, most=0.82):
    """Of planted pairs with a similarity in that range: how many share a band and pass the estimate."""
    rng = np.random.default_rng(seed)
    estimate, banded, passed = minhash.Estimator(80), 0, 0
    for _ in range(pairs):
        share = rng.uniform(least, most)
        both = int(np.ceil(2 * shingles * share / (1 + share)))
        own = rng.integers(0, 2**63, 2 * shingles - both).astype(np.uint64)
        a, b = own[:shingles], np.concatenate([own[:both], own[shingles:]])
        c = minhash.size_classes(shingles, 80)[-1]
        x, y = minhash.registers(a, c)[None], minhash.registers(b, c)[None]
        banded += minhash._share_bands(x, y, minhash.BANDS)[0]
        passed += estimate.similar(x, y, np.array([c]))[0]
    return banded, passed


@pytest.mark.parametrize("shingles", [40, 300, 2500])
def test_planted_pairs_at_the_threshold_are_found(shingles):
    assert found_pairs(1500, shingles, shingles) == (1500, 1500)


def test_blocks_are_bounded_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 400)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(60):
        for _ in range(5):
            base[rng.randrange(300)] = f"n{rng.random()}"
        rows.append(((i * 37) % 60, " ".join(base)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found(spark, rows)} == brute(rows, 5)


def test_similar_sizes_share_a_class():
    for n in range(1, 6000):
        for m in range(-(-n * 4 // 5), n + 1):
            if m in (-(-n * 4 // 5), n - 1, n) and m:
                assert set(minhash.size_classes(n, 80)) & set(minhash.size_classes(m, 80)), (n, m)


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    links += [(5, 5), (None, 3), (160, 100), (100, 101)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    parent = {x: x for p in links if None not in p and p[0] != p[1] for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a in parent and b in parent:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in parent}
    assert components.connected_components(df.limit(0)).count() == 0


def test_pairs_at_the_threshold_share_a_band():
    assert minhash.BANDS * minhash.BAND_REGISTERS <= minhash.BUCKETS
    assert (1 - (minhash.LEAST_PERCENT / 100) ** minhash.BAND_REGISTERS) ** minhash.BANDS < 1e-5
