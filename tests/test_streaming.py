import datetime as dt

from tidemark.streaming import waves


def run(spark, tmp_path, batch, make, mode):
    src, out = str(tmp_path / "in"), "out_" + make.__name__
    batch.write.parquet(src)
    q = make(spark.readStream.schema(batch.schema).parquet(src)).writeStream.format("memory").queryName(out).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(out).collect()


def hours(spark, hs):
    t = dt.datetime(2023, 9, 15)
    return spark.createDataFrame([(1, t + dt.timedelta(hours=i), float(v), 9.0, 10.0) for i, v in enumerate(hs)], "mop_id int, ts timestamp, hs double, tp double, dp double")


def test_resample(spark, tmp_path):
    rows = run(spark, tmp_path, hours(spark, range(12)), waves.resample_stream, "complete")
    assert sorted((r["n"], r["hs"]) for r in rows) == [(6, 2.5), (6, 8.5)]


def test_storms(spark, tmp_path):
    rows = run(spark, tmp_path, hours(spark, [3] * 4 + [1] * 30 + [3] * 5), waves.storm_stream, "complete")
    assert sorted(r["n_rows"] for r in rows) == [4, 5]


def test_dry_days(spark, tmp_path):
    d = dt.date(2023, 1, 1)
    df = spark.createDataFrame([(7, d + dt.timedelta(days=i), float(p)) for i, p in enumerate([5, 0, 0, 3, 0])], "beach long, date date, precip_mm double")
    rows = run(spark, tmp_path, df, waves.dry_day_stream, "append")
    assert [r["days_since_rain"] for r in sorted(rows, key=lambda r: r["date"])] == [0, 1, 2, 0, 1]
