import datetime

from pyspark.sql import functions as F

from lumenfold.streaming import monitor


def test_windows_and_first_seen(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, day + datetime.timedelta(hours=6 * i), i % 3, "error" if i % 4 == 0 else "click", 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, monitor.SCHEMA)
    for k in range(4):
        df.where(F.col("event_id").between(10 * k, 10 * k + 9)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df.limit(5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = monitor.events(spark, str(tmp_path / "in"), 10)
    q = monitor.start(monitor.windows(stream), "by_day", str(tmp_path / "c1"), "complete")
    q.awaitTermination(60)
    got = spark.table("by_day").agg(F.sum("n_rows"), F.sum("n_errors")).first()
    assert got[0] == 45
    q = monitor.start(monitor.first_seen(stream, late="60 days"), "once", str(tmp_path / "c2"))
    q.awaitTermination(60)
    assert spark.table("once").count() == 40
