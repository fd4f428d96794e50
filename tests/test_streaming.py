from pyspark.sql import functions as F

from tideline.streaming.months import stream_site_months

EVENTS = "studyid string, invid string, date string, kind string"
FIRST = [("S1", "a", "2024-01-05", "x"), ("S1", "a", "2024-01-20", "y"), ("S1", "b", "2024-02-01", "x"), ("S2", "a", None, "x")]
SECOND = [("S1", "a", "2024-01-31", "x"), ("S2", "a", "2024-03-01", "y")]


def test_counts_are_kept(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame(FIRST, EVENTS).write.parquet(source)
    counts = stream_site_months(spark.readStream.schema(EVENTS).parquet(source), F.col("kind") == "x")
    run = lambda: counts.writeStream.outputMode("complete").format("memory").queryName("months").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    run()
    assert {tuple(r) for r in spark.table("months").collect()} == {("S1", "a", 202401, 1, 2), ("S1", "b", 202402, 1, 1)}
    spark.createDataFrame(SECOND, EVENTS).write.mode("append").parquet(source)
    run()
    got = {tuple(r) for r in spark.table("months").collect()}
    assert got == {tuple(r) for r in stream_site_months(spark.createDataFrame(FIRST + SECOND, EVENTS), F.col("kind") == "x").collect()}
    assert ("S1", "a", 202401, 2, 3) in got


def test_watermark(spark):
    table = spark.createDataFrame(FIRST + SECOND, EVENTS)
    days = stream_site_months(table, F.col("kind") == "x", watermark="60 days")
    months = days.groupBy("StudyID", "GroupID", "MonthYYYYMM").agg(F.sum("Numerator"), F.sum("Denominator"))
    assert {tuple(r) for r in months.collect()} == {tuple(r) for r in stream_site_months(table, F.col("kind") == "x").collect()}
