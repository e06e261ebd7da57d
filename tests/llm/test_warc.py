import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from quillframe.llm import warc
from quillframe.scratch import scratch_path

LONG = "x" * 999
PAGES = [
    (1, "http://a/1", LONG + "é"), (2, "http://a/2", LONG + "é"), (3, None, LONG + "é"), (4, "http://a/4\r\nEvil: 1", "small"),
    (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", LONG), (9, "u", LONG), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 90),
    (None, "u", "y" * 1000), (11, "u", "y" * 1000), (12, "u", "z" * 3_000_000), (13, "u", "only null" * 200), (13, "u", "only null" * 200),
]


def archive(spark, pages, **options):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("_first", F.lit(1)).drop("_first")
    return warc.write_archive(warc.with_record_types(df, "page_id", "html"), scratch_path(spark, "warc"), **options)


@pytest.mark.parametrize("split", [100, 1000, 1 << 20])
def test_round_trip_whatever_the_split(spark, split):
    manifest = archive(spark, PAGES, file_bytes=1500)
    rows = warc.read_archive(manifest, split_bytes=split).collect()
    assert len(rows) == len(PAGES) and not [r.problem for r in rows if r.problem]
    got = sorted(((r.record_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to,
                   None if r.payload is None else bytes(r.payload)) for r in rows), key=str)
    want = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        first = max((p for p, _, h in PAGES if h == html and p is not None), default=None)
        again = len(body) >= 1000 and i != first
        want.append((None if i is None else str(i), "revisit" if again else "response", len(body),
                     hashlib.sha1(body).hexdigest(), str(first) if again else None, None if again else body))
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert warc.read_archive(archive(spark, [])).count() == 0


def row(i, body):
    return {"record_id": str(i), "record_type": "response", "payload_digest": hashlib.sha1(body).hexdigest(),
            "payload_bytes": len(body), "payload": body, "url": "u", "refers_to": None}


def test_magic_inside_records_and_every_cut():
    rng = random.Random(5)
    bodies = [rng.randbytes(300) + warc.MAGIC * 3 + rng.randbytes(90) for _ in range(6)]
    data = b"".join(warc._member(row(i, b)) for i, b in enumerate(bodies))
    for cut in range(1, len(data), 7):
        ids = [r["record_id"] for s, e in ((0, cut), (cut, len(data)))
               for r in warc.records_of_range(io.BytesIO(data), s, e)]
        assert ids == [str(i) for i in range(6)]


def test_a_damaged_member_is_reported_and_the_rest_read():
    members = [warc._member(row(i, b"%d" % i * 400)) for i in range(3)]
    bad = bytearray(members[1])
    bad[-20:-12] = b"\0" * 8
    data = members[0] + bytes(bad) + members[2]
    found = list(warc.records_of_range(io.BytesIO(data), 0, len(data)))
    assert [r["record_id"] for r in found if r["record_id"]] == ["0", "2"]
    assert any(r["problem"] for r in found)
    cut = data[:-5]
    assert list(warc.records_of_range(io.BytesIO(cut), 0, len(cut)))[-1]["problem"]
