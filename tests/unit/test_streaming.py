from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sheaf.streaming import process


def folder(spark, path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "user_id long, event_type string, value double, ts timestamp").coalesce(1).write.parquet(f"{path}/b{i}")
    return process.source(spark, str(path))


START = datetime(2024, 1, 1)


def event(user, minutes, kind="a", value=100.0):
    return (user, kind, value, START + timedelta(minutes=minutes))


def test_state_over_batches_equals_one_table(spark, tmp_path):
    stream = folder(spark, tmp_path, [[event(1, 0), event(2, 1)], [event(1, 2, value=400.0)], [event(1, 3), event(3, 4)]])
    got = {r.domain: (r.n, r.mean_quality) for r in process.drained(process.running_domain_state(stream)).collect()}
    assert got == {"host1.example.org": (3, round((0.5 + 1 + 0.5) / 3, 6)), "host2.example.org": (1, 0.5), "host3.example.org": (1, 0.5)}


def test_sliding_windows_and_sessions(spark, tmp_path):
    batches = [[event(1, 10), event(1, 70)], [event(1, 75), event(2, 300)]]
    windows = process.drained(process.windowed(folder(spark, tmp_path, batches), "2 hours", "1 hour"))
    got = {(r.w, r.n) for r in windows.select(F.date_format("window.start", "dd HH").alias("w"), "n").collect()}
    assert got == {("31 23", 1), ("01 00", 3), ("01 01", 2), ("01 04", 1), ("01 05", 1)}
    rows = process.drained(process.sessions(process.source(spark, str(tmp_path)))).select("user_id", "n").collect()
    assert sorted(map(tuple, rows)) == [(1, 1), (1, 2), (2, 1)]


def test_first_sightings_and_sinks(spark, tmp_path):
    stream = folder(spark, tmp_path / "in", [[event(1, 0), event(1, 1)], [event(1, 2), event(2, 3)]])
    assert sorted(r.user_id for r in process.drained(process.first_seen(stream, ["user_id"], "9 days"), "append").collect()) == [1, 2]
    process.to_json_lines(stream.select("user_id"), f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    assert sorted(r.user_id for r in spark.read.json(f"{tmp_path}/out").collect()) == [1, 1, 1, 2]
