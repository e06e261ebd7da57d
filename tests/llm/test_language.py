import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import language
from quillframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
AA, BB = "abba baab aba bab ", "xyyx yxxy xyx yxy "


def model(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return language.learn(df, F.lit(True))


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = QUERIES["op6_language_id"](spark, SF).collect()
    assert len(out) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert len(held) > 150
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.96


def test_mixtures_and_edge_rows(spark):
    path = model(spark, [(1, AA * 30, "a"), (2, BB * 30, "b"), (3, None, "a"), (4, AA, None), (5, "", "c")])
    texts = [AA * 3, BB * 3, AA * 3 + BB, None, "", " 12 !? ", "ABBA", AA * 300_000, AA * 3, "é"]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)] + [(None, AA, "old")] * 2,
                               "doc_id long, text string, lang_pred string").repartition(2)
    out = language.identify(df, path)
    assert out.columns == ["doc_id", "text", "lang_pred", "lang_score"]
    got = {r.doc_id: (r.lang_pred, round(r.lang_score, 2)) for r in out.collect()}
    assert out.count() == len(texts) + 2
    assert got[0] == got[7] == got[8] == ("a", 1.0) and got[1] == ("b", 1.0) and got[2] == ("a", 0.75)
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[6][0] == got[None][0] == "a" and got[9][0] in "ab"
    assert language.identify(df.limit(0), path).count() == 0


def test_nothing_learned(spark):
    path = model(spark, [])
    df = spark.createDataFrame([(1, AA)], "doc_id long, text string")
    assert language.identify(df, path).first().lang_pred == "und"


def test_only_usable_rows_and_a_bounded_sample_teach(spark):
    df = spark.createDataFrame([(i, AA, "a") for i in range(400)] + [(900, BB, "b")], "doc_id long, text string, lang string")
    assert language.load(language.learn(df, F.col("doc_id") < 400)).languages == ["a"]
    few = language.load(language.learn(df, F.lit(True), sample_documents=40))
    every = language.load(language.learn(df, F.lit(True)))
    assert few.languages == every.languages == ["a", "b"]


def test_pieces_agree(monkeypatch):
    text = ("Wörter und mehr, " * 50 + "x" * 90).lower()
    grams = language.Grams()
    whole = grams.of(text)
    monkeypatch.setattr(language, "PIECE_CHARS", 40)
    parts = [grams.of(p) for p in language._pieces(text)]
    assert sum(len(p[2]) for p in parts) == len(whole[2])
    assert sorted(np.concatenate([p[0] for p in parts])) == sorted(whole[0])


@pytest.mark.parametrize("share", [0.0, 0.3, 0.6])
def test_proportions_are_found(share):
    rng = np.random.default_rng(1)
    own = rng.random(600) < share
    words = np.where(own[:, None], [[-1.0, -6.0, -6.0]], [[-6.0, -1.0, -6.0]]) + rng.normal(0, 0.1, (600, 3))
    found, _ = language.mixtures(words.astype(np.float32), np.array([0]))
    assert abs(found[0, 0] - own.mean()) < 0.05 and found[0, 2] == 0


def test_documents_of_a_batch_dont_change_each_other():
    rng = np.random.default_rng(5)
    parts = [rng.normal(0, rng.choice([0.3, 1, 3]), (int(n), 5)).astype(np.float32) for n in rng.integers(1, 60, 300)]
    first = np.cumsum([0, *map(len, parts[:-1])])
    shares, worths = language.mixtures(np.concatenate(parts), first)
    for part, share, worth in zip(parts, shares, worths):
        alone, value = language.mixtures(part, np.array([0]))
        assert np.array_equal(alone[0], share) and value[0] == worth


def test_a_larger_set_is_found_behind_a_worse_one():
    """A larger set of languages wins here, though one more than the best so far doesn't pay."""
    words = np.random.default_rng(738194061).choice([0, -1, -2, -4], (20, 5)).astype(np.float32)
    share, worth = language.mixtures(words, np.array([0]))
    assert (share[0] > 0.1).sum() == 4 and worth[0] > -22


def test_learning_moves_no_texts(spark, monkeypatch):
    """Shares of languages are literals: the sample is a filter on the scan."""
    plans = []
    docs = spark.createDataFrame([(i, "text und so", lang) for i, lang in enumerate(["a", "b", None] * 20)], "doc_id long, text string, lang string")
    cls = type(docs)
    inner = cls.mapInArrow

    def seen(self, *args, **options):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return inner(self, *args, **options)

    monkeypatch.setattr(cls, "mapInArrow", seen)
    language.learn(docs, F.lit(True))
    assert len(plans) == 1 and "Exchange" not in plans[0] and "Join" not in plans[0]
    nothing = language.learn(docs.where("lang IS NULL"), F.lit(True))
    assert language.load(nothing).languages == []
