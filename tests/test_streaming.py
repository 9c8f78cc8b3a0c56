from lamina.streaming import append_changes, latest

SCHEMA = "k string, seq long, op tinyint, v string"


def test_stream_equals_batch(spark, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    for rows in ([("a", 1, 1, "1"), ("b", 2, 1, "2")], [("a", 3, 0, None), ("c", 4, 1, "4")]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        append_changes(spark.readStream.schema(SCHEMA).parquet(source), log, str(tmp_path / "check")).awaitTermination(60)
    got = sorted(tuple(r) for r in latest(spark.read.parquet(log)).collect())
    assert got == [("b", 2, "2"), ("c", 4, "4")]
