"""The manifest in the state store against the manifest as a table."""

import pytest
from conftest import rows

from quillframe.operators import changes
from quillframe.streaming import manifest_state as ms
from quillframe.streaming.arrivals import ARRIVALS


@pytest.fixture
def stream(spark, tmp_path):
    class Stream:
        landing, out, check = (str(tmp_path / n) for n in ("landing", "out", "check"))

        def land(self, *files):
            spark.createDataFrame(files, ARRIVALS).coalesce(1).write.mode("append").parquet(self.landing)

        def run(self, manifest=None, handle=None):
            ms.follow_manifest(spark, self.landing, self.check, handle or ms.table_writer(self.out), manifest, files_per_batch=1).awaitTermination()

        def changed(self, batch):
            return rows(spark.read.schema(ms.CHANGED).parquet(f"{self.out}/batch={batch}"), "path", "size_bytes")

        def manifest(self):
            return rows(ms.manifest_of(spark, self.check), "path", "sha256")

    return Stream()


def table_manifest(spark, *batches, start=None):
    """The same by the batch operators."""
    known, found = start if start is not None else spark.createDataFrame([], "path string, sha256 string"), []
    for batch in batches:
        files = changes.latest(spark.createDataFrame(batch, ARRIVALS), "arrived")
        fresh = changes.fingerprints(files)
        found.append(rows(changes.changed(fresh, known), "path", "size_bytes"))
        known = changes.merge_manifest(known, fresh)
    return found, rows(known, "path", "sha256")


FIRST = [("a.py", "0", 1), ("a.py", "11", 2), ("b.py", "2", 1), ("old.py", "same", 1)]
SECOND = [("a.py", "11", 3), ("b.py", "333", 3), ("c.py", None, 3), ("b.py", "2", 2)]


def test_batches_restarts_and_a_start_manifest(spark, stream, tmp_path):
    start = changes.fingerprints(spark.createDataFrame([("old.py", "same"), ("kept.py", "x")], "path string, content string")).select("path", "sha256")
    start.write.parquet(str(tmp_path / "start"))
    for files in (FIRST, SECOND, []):  # each time a new query on the same checkpoint
        if files:
            stream.land(*files)
        stream.run(str(tmp_path / "start"))
    found, manifest = table_manifest(spark, FIRST, SECOND, start=start)
    assert [stream.changed(0), stream.changed(1)] == found == [[("a.py", 2), ("b.py", 1)], [("b.py", 3), ("c.py", None)]]
    assert stream.manifest() == manifest and len(manifest) == 5
    with pytest.raises(Exception):
        stream.changed(2)


def test_a_batch_that_died_is_replayed_with_the_state_of_before(spark, stream):
    stream.land(*FIRST)
    stream.run()
    stream.land(*SECOND)
    died = []

    def dying(changed, batch):
        died.append(rows(changed, "path", "size_bytes"))  # the new state has been computed
        raise RuntimeError("lost")

    with pytest.raises(Exception):
        stream.run(handle=dying)
    stream.run()
    found, manifest = table_manifest(spark, FIRST, SECOND)
    assert stream.changed(1) == found[1] == died[0]
    assert stream.manifest() == manifest


def test_null_paths_and_unordered_arrivals(spark, stream):
    files = [(None, "a", None), (None, "b", 0), ("x", "c", None), ("x", "d", None), ("y", "e", -5), ("y", "f", None)]
    stream.land(*files)
    stream.run()
    hashed = spark.createDataFrame(files, ARRIVALS).selectExpr("path", "sha2(content, 256) AS sha256", "arrived")
    newest = changes.merge_manifest(hashed.limit(0), hashed, order="arrived")
    assert stream.manifest() == rows(newest, "path", "sha256") and len(stream.changed(0)) == 3


def test_paths_are_not_frames_and_a_null_hash_is_kept(spark, stream, tmp_path):
    """The state takes rows: a frame or two per path cost far more than its hashes."""
    spark.createDataFrame([("kept", None), ("b", "old")], "path string, sha256 string").write.parquet(str(tmp_path / "start"))
    stream.land(("a", "1", 1), ("b", "2", 1))
    stream.run(str(tmp_path / "start"))
    assert [r.operatorName for r in spark.read.format("state-metadata").load(stream.check).select("operatorName").distinct().collect()] == ["transformWithStateInPySparkExec"]
    known = rows(spark.read.schema(ms.CHANGED).parquet(f"{stream.out}/batch=0"), "path", "known")
    assert known == [("a", None), ("b", "old")]
    assert [(path, sha256 is None) for path, sha256 in stream.manifest()] == [("a", False), ("b", False), ("kept", True)]
