import zlib

import numpy as np
import pytest

from quillframe.llm import quality
from quillframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
GOOD, BAD = "a calm sentence of words ", "x## y$$ ** z%% "


def test_held_out_quality(spark):
    """Learned on the other folds, judged on rows that were held out."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = QUERIES["op9_quality_classifier"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    assert all(r.predicted == int(r.score >= 0.3) for r in out)
    held = [(labels[r.doc_id], r.score, r.predicted) for r in out if r.held_out and r.doc_id in labels]
    y, score, predicted = map(np.array, zip(*held))
    rank = np.argsort(np.argsort(score))
    ones, zeros = (y == 1).sum(), (y == 0).sum()
    assert (rank[y == 1].sum() - ones * (ones - 1) / 2) / (ones * zeros) > 0.97
    assert (predicted == y).mean() > 0.95


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = quality.Network.fresh(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = [rng.integers(1, 255, n, dtype=np.uint8).tobytes() for n in (5, 300, 1200)]
    docs, sizes, labels = [quality.blocks_of(t) for t in texts], [len(t) for t in texts], np.array([0, 1, 1.0])

    def loss():
        pairs = net.pairs()
        z = np.array([net.logit(quality.Network.responses(d, pairs, False)[0], s) for d, s in zip(docs, sizes)])
        return np.mean(np.logaddexp(0, z) - labels * z)

    grads = quality._step(net, docs, sizes, labels)
    for name, g in grads.items():
        place = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = net.p[name][place], 1e-3
        net.p[name][place] = old + step
        up = loss()
        net.p[name][place] = old - step
        down = loss()
        net.p[name][place] = old
        assert g[place] == pytest.approx((up - down) / 2 / step, rel=0.05, abs=1e-4), name


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame(
        [(i, (GOOD if i % 2 else BAD) * (1 + i % 40)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(300)] + [(None, 1, 0), (5000, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    return quality.learn(docs, labels)


def test_edge_rows(spark, model):
    texts = [GOOD * 9, BAD * 9, None, "", GOOD * 60_000, GOOD * 9, "é"]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)] + [(None, BAD * 9, "old")] * 2,
                               "doc_id long, text string, quality_score string").repartition(2)
    out = quality.score_quality(df, model)
    assert out.columns == ["doc_id", "text", "quality_score"] and out.count() == len(texts) + 2
    got = {r.doc_id: r.quality_score for r in out.collect()}
    assert got[0] == got[5] > 0.9 > 0.1 > got[1] == got[None] and got[2] == got[3] and 0 <= got[2] <= 1
    assert got[4] > 0.9
    assert quality.score_quality(df.limit(0), model).count() == 0


def test_whole_text_counts(spark, model):
    """A bad end of a long good text lowers its score."""
    scorer = quality.Scorer(model)
    good, mixed = scorer.score([(GOOD * 900).encode(), (GOOD * 600 + BAD * 500).encode()])
    assert mixed < good


def test_pieces_agree(model, monkeypatch):
    text = np.random.default_rng(1).integers(0, 255, 9001, dtype=np.uint8).tobytes()
    scorer = quality.Scorer(model)
    whole = scorer.score([text, text[:512], b""])
    monkeypatch.setattr(quality, "PIECE_BYTES", 1024)
    assert scorer.score([text, text[:512], b""]) == pytest.approx(whole)


def test_without_labels_the_score_is_the_prior(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r.quality_score for r in quality.score_quality(docs, quality.learn(docs, labels)).collect()} == {0.75}
    assert {r.quality_score for r in quality.score_quality(docs, quality.learn(docs, labels.limit(0))).collect()} == {0.5}
