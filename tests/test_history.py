import csv
import glob
from datetime import datetime, timedelta

import pytest
from pyspark.sql import DataFrameWriter

from plumbline.sources import history

SCHEMA = "ts timestamp_ntz, id long, kind string, note string"


def log(n):
    """Runs of one kind, with text that CSV has to quote."""
    start = datetime(2024, 1, 1)
    notes = ["plain", 'a "quoted", b', "two\nlines", None, " edge ", "back\\slash"]
    return [(start + timedelta(minutes=i // 2), i, ["x", "x", None, "y"][i // 3 % 4], notes[i % 6]) for i in range(n)]


def changed(rows):
    return [r for i, r in enumerate(rows) if i == 0 or rows[i - 1][2] != r[2]]


@pytest.fixture
def folder(tmp_path):
    return f"{tmp_path}/history"


def reread(spark, folder, frame):
    return sorted(tuple(r)[:4] for r in history.read(spark, folder, frame.schema).collect())


def test_overlapping_and_repeated_batches_equal_one(spark, folder):
    rows = log(60)
    frame = lambda a, b: spark.createDataFrame(rows[a:b], SCHEMA).repartition(3)
    for batch, a, b in ((0, 0, 20), (1, 10, 33), (1, 10, 33), (2, 33, 33), (3, 5, 30), (4, 30, 60), (1, 10, 33)):
        history.append(frame(a, b), folder, batch, ["ts", "id"], "kind")
    assert reread(spark, folder, frame(0, 1)) == sorted(changed(rows))
    assert {r.batch for r in history.read(spark, folder, frame(0, 1).schema).collect()} == {0, 1, 4}


def test_a_batch_that_failed_half_way_is_repeated(spark, folder, monkeypatch):
    """The rows are there, the note of where the batch ended is not: running it again gives the same as one run."""
    rows = log(24)
    frame = spark.createDataFrame(rows[:12], SCHEMA)
    history.append(frame, folder, 0, ["ts", "id"], "kind")
    late = spark.createDataFrame(rows[8:], SCHEMA)
    parquet = DataFrameWriter.parquet

    def lost(self, path, *args, **kwargs):
        if path.endswith("/last"):
            raise RuntimeError("lost")
        return parquet(self, path, *args, **kwargs)

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", lost)
        with pytest.raises(RuntimeError):
            history.append(late, folder, 1, ["ts", "id"], "kind")
    assert glob.glob(f"{folder}/rows/batch=1/*") and not glob.glob(f"{folder}/last/batch=1")
    history.append(late, folder, 1, ["ts", "id"], "kind")
    assert reread(spark, folder, frame) == sorted(changed(rows))


def test_first_batches_without_rows(spark, folder):
    rows = log(9)
    empty, frame = spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows, SCHEMA)
    for batch, part in ((0, empty), (1, empty), (2, frame)):
        history.append(part, folder, batch, ["ts", "id"], "kind")
    assert reread(spark, folder, frame) == sorted(changed(rows))


def test_files_have_a_header_and_rfc_quoting(spark, folder):
    rows = log(12)
    history.append(spark.createDataFrame(rows, SCHEMA).coalesce(1), folder, 0, ["ts", "id"], "kind")
    found = [r for f in glob.glob(f"{folder}/rows/batch=0/*.csv") for r in list(csv.reader(open(f, newline="")))]
    assert [r for r in found if r[0] == "ts"] == [["ts", "id", "kind", "note"]]
    assert {r[3] for r in found if r[0] != "ts"} <= {"plain", 'a "quoted", b', "two\nlines", "", " edge ", "back\\slash"}


def test_a_stream_writes_every_change_once(spark, folder, tmp_path):
    rows = log(40)
    source = f"{tmp_path}/in"
    for a, b in ((0, 15), (15, 16), (16, 40)):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source)
        query = history.sink(stream, folder, ["ts", "id"], "kind").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert reread(spark, folder, spark.createDataFrame(rows[:1], SCHEMA)) == sorted(changed(rows))
