import datetime as dt

from pyspark.sql import functions as F

from weftline.streaming import events, packer


def write(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(path)


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    path, state = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, path, [(1, at(1), 1, "a", 1.0), (2, at(2), 1, "a", 2.0)])
    run = lambda: events.run_available(events.source(spark, path).select("event_id"), folder=state)
    run()
    run()
    write(spark, path, [(3, at(3), 1, "a", 3.0)])
    run()
    assert sorted(r.event_id for r in events.result(spark, state, "event_id long, batch int").collect()) == [1, 2, 3]


def test_late_and_repeated_events(spark, tmp_path):
    path, state = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: events.run_available(events.unique(events.source(spark, path), ["event_id"], "10 minutes").select("event_id"), folder=state)
    write(spark, path, [(1, at(0), 1, "a", 1.0), (1, at(0), 1, "a", 1.0), (2, at(60), 1, "a", 1.0)])
    run()
    write(spark, path, [(9, at(1), 1, "a", 1.0), (2, at(61), 1, "a", 1.0)])  # 9 is behind the watermark
    run()
    assert sorted(r.event_id for r in events.result(spark, state, "event_id long, batch int").collect()) == [1, 2]


def test_sessions_in_batch(spark, tmp_path):
    write(spark, str(tmp_path / "in"), [(k, at(m), 1, "a", 1.0) for k, m in enumerate((0, 10, 50, 55))])
    got = events.sessions(spark.read.parquet(str(tmp_path / "in")), "30 minutes")
    assert sorted(r.n for r in got.collect()) == [2, 2]


def test_packer_keeps_the_remainder(spark, tmp_path):
    path, state = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "source string, at long, ids array<int>"

    def run():
        rows = spark.readStream.schema(schema).parquet(path)
        return events.run_available(packer.cut(rows, 4), folder=state)

    for k, rows in enumerate(([("s", 1, [1, 2, 3]), ("t", 1, [7])], [("s", 3, [6, 7, 8]), ("s", 2, [4, 5])], [("s", 4, None), ("t", 2, [8, 9, 10, 11])])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        assert k >= 0
        run()
    got = sorted((r.source, r.chunk_no, r.ids) for r in events.result(spark, state, "source string, chunk_no long, ids array<int>, batch int").collect())
    assert got == [("s", 0, [1, 2, 3, 4]), ("s", 1, [5, 6, 7, 8]), ("t", 0, [7, 8, 9, 10])]


def test_watermark_takes_time_without_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), "a", 1.0)], "ts timestamp_ntz, event_type string, value double")
    assert events.tumbling(df, "1 hour", late="1 day").agg(F.sum("n")).head()[0] == 1
