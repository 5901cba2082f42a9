from plumbline.streaming import logs


def drained(spark, frame, name):
    q = frame.writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def stream(spark, tmp_path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_change_log_over_batches(spark, tmp_path):
    s = stream(spark, tmp_path, [[(1, 1, "a"), (1, 2, "a"), (1, 3, "b")], [(1, 4, "b"), (1, 5, "a")]], "u int, ts int, k string")
    assert sorted(drained(spark, logs.change_log(s, "u", "ts", "k"), "changes")) == [(1, 1, "a"), (1, 3, "b"), (1, 5, "a")]


def test_running_ratchet(spark, tmp_path):
    s = stream(spark, tmp_path, [[("x", 5.0)], [("x", 3.0)], [("x", 4.0)]], "k string, v double")
    assert drained(spark, logs.running_ratchet(s, "k", "v"), "worse") == [("x", 4.0, 3.0)]
