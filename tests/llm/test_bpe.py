import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer as Library

from quillframe.llm import bpe
from quillframe.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Library.from_file(PATH)
OWN = bpe.Tokenizer(PATH, cache_words=50)
TEXTS = [
    None, "", "   ", "Hello  world's <|endoftext|>x it'S", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|>",
    "é́ ﬁ İ ß ẞ Σας ΑΣ \U0001f600 a\x00b 12 345 _-_ 'll ''s", "a\x1cb\x1fc\x85d　e​f", "x" * 5000,
    "ab" * 3000 + " !?" * 2000, "é" * 9, "  ²½Ⅷ", "don't we'll I'M you'd they've",
]


def library(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(text):
    ids = OWN.encode(text or "")
    assert (np.frombuffer(ids, "<u4").tolist(), OWN.decode(ids)) == library(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FFF, exclude_categories=["Cn", "Cs"])))
def test_any_text_as_the_library(text):
    ids = OWN.encode(text)
    assert (np.frombuffer(ids, "<u4").tolist(), OWN.decode(ids)) == library(text)


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("form", ["{}", "a{}b"])
def test_every_code_point_as_the_library(form):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [form.format(chr(c)) for c in points]
    assert [hex(c) for c, t, want in zip(points, texts, LIBRARY.encode_batch(texts, add_special_tokens=False))
            if OWN.encode(t) != packed(want.ids)] == []


def test_newer_letters_and_unknown_marks_in_words():
    rng = random.Random(5)
    runs = [*bpe.NEWER_LETTERS, *bpe.NEWER_NUMBERS, *(r[:2] for r in bpe.NEWER_CAPITALS), *bpe.UNMOVED]
    pool = [c for r in runs for c in r] + [ord(c) for c in "a'sreltmv1 !éΣς\u0301\u0316\u0345\u0338İ\U00011935"]
    for _ in range(20_000):
        text = "".join(chr(rng.choice(pool)) for _ in range(rng.randrange(1, 9)))
        assert OWN.encode(text) == packed(LIBRARY.encode(text, add_special_tokens=False).ids), ascii(text)


def test_columns_and_edge_rows(spark):
    df = spark.createDataFrame(
        [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "again", "c"), (None, "again", "c")],
        "doc_id long, text string, decoded string")
    out = bpe.decode(bpe.encode(df, PATH), PATH)
    assert out.columns == ["doc_id", "text", "token_ids", "n_tokens", "decoded"]
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        ids, text = library(r.text)
        assert (np.frombuffer(r.token_ids, "<u4").tolist(), r.n_tokens, r.decoded) == (ids, len(ids), text)
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_batches_are_passed_on_in_bounded_pieces(spark, monkeypatch):
    df = spark.createDataFrame([(i, "some words " * (i % 90)) for i in range(400)], "doc_id long, text string").coalesce(1)
    whole = sorted(map(str, bpe.encode(df, PATH).collect()))
    monkeypatch.setattr(bpe, "BATCH_BYTES", 300)
    assert sorted(map(str, bpe.encode(df, PATH).collect())) == whole


def test_the_query_as_the_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, text = library(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_a_file_with_other_steps_is_refused():
    with pytest.raises(ValueError):
        bpe.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
