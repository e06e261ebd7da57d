from conftest import rows

from quillframe.plans import incremental
from quillframe.sources import storage
from quillframe.streaming.arrivals import ARRIVALS, process_arrivals


def test_only_new_contents_are_handled(spark, tmp_path):
    landing, state = str(tmp_path / "landing"), str(tmp_path / "state")
    seen = []

    def arrive(*files):
        spark.createDataFrame(files, ARRIVALS).coalesce(1).write.mode("append").parquet(landing)
        query = process_arrivals(
            spark, landing, state, str(tmp_path / "check"), lambda pending, files: seen.append(rows(pending, "path"))
        )
        query.awaitTermination()

    arrive(("a.py", "0", 1), ("a.py", "1", 2), ("b.py", "2", 1))
    arrive(("a.py", "1", 3), ("b.py", "3", 3), ("c.py", "4", 3), ("b.py", "2", 2))
    assert seen == [[("a.py",), ("b.py",)], [("b.py",), ("c.py",)]]
    known = [("a.py",), ("b.py",), ("c.py",)]
    assert rows(incremental.known_hashes(spark, state), "path") == known
    arrive(("d.py", "9", 4))
    # a batch writes its own arrivals only
    assert spark.read.parquet(f"{state}/manifest/v=3").count() == 1
    before = rows(incremental.known_hashes(spark, state))
    incremental.compact_hashes(spark, state)
    assert storage.versions(spark, f"{state}/manifest") == [4]
    assert rows(incremental.known_hashes(spark, state)) == before and len(before) == 4
