import math

import numpy as np
import pytest

from quillframe.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, least=0.98):
    good = {}
    for k, (i, v, label) in enumerate(rows):
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = np.array(v, np.float32).astype(np.float64)
        if x.any():
            x = x / np.abs(x).max()
            good[k] = (label, x / np.linalg.norm(x))
    links, parent = {k: 0 for k in range(len(rows))}, {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in good:
        for b in good:
            if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= least:
                links[a] += 1
                links[b] += 1
                x, y = root(rows[a][0]), root(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted(((r[0], links[k], None if r[0] is None else root(r[0])) for k, r in enumerate(rows)), key=str)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    out = ed.near_vectors(df).collect()
    for r in out:
        assert r.kept == (r.vec_id is None or r.vec_id == r.component_id)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str)


def groups(seed, sizes, width=32, labels=2):
    rng, rows = np.random.default_rng(seed), []
    for size in sizes:
        base, label = rng.standard_normal(width), int(rng.integers(labels))
        for _ in range(size):
            noisy = base + rng.standard_normal(width) * rng.choice([0, 0.05, 0.1, 0.14])
            rows.append((len(rows) * 7 % 10007, (noisy * rng.choice([1, 3])).astype(np.float32).tolist(), label))
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_as_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ed, "BLOCK_ROWS", block)
    rows = groups(1, [1] * 60 + [2, 3, 5, 9, 40, 90])
    assert got(spark, rows) == brute(rows)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0] * 3, 1),
            (8, [nan, 1.0, 1.0], 1), (9, [inf, 1.0, 1.0], 1), (10, [None, 1.0, 1.0], 1), (11, v, 2), (12, v + [0.0], 1),
            (None, v, 1), (13, [1e38, 2e38, 3e38], 1), (14, [1e-40, 2e-40, 3e-40], 1), (15, [-0.0, 1.0, 0.0], 3), (16, [0.0, 1.0, -0.0], 3)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == [] and got(spark, [(1, None, None)]) == [(1, 0, 1)]


def test_shape_follows_size_and_keeps_recall():
    for rows in (0, 1, 500, 10**4, 10**6, 10**9):
        bits, tables = ed.table_shape(rows)
        agree = (1 - math.acos(0.98) / math.pi) ** bits
        assert (1 - agree) ** tables <= 1e-4 and (rows <= 500 * 16 or rows / 2**bits <= 500)
    assert ed.table_shape(10**4)[1] < ed.table_shape(10**9)[1] < 80


def test_recall_of_the_tables(spark):
    """Pairs right above the threshold, many bits: found as often as planned."""
    rng, rows = np.random.default_rng(8), []
    for i in range(1500):
        a = rng.standard_normal(24)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(24)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (0.981 * a + math.sqrt(1 - 0.981**2) * b).tolist(), 0)]
    found = sum(n > 0 for _, n, _ in got(spark, rows))
    assert found >= 2990
