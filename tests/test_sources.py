import uuid

from tideline.sources import io

ROWS = [(k, f"s{k % 3}", k / 2) for k in range(30)]
SCHEMA = "id int, study string, value double"


def test_parquet(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    io.write_parquet(df, str(tmp_path / "t"), partition_by=["study"])
    got = io.read_parquet(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, got.select("id", "study", "value").collect())) == ROWS
    assert io.materialise(df, str(tmp_path / "m")).count() == 30


def test_catalog_tables(spark):
    name = f"t_{uuid.uuid4().hex}"
    io.save_table(spark.createDataFrame(ROWS, SCHEMA), name, bucket_by=["study"], buckets=2)
    try:
        table = io.read_table(spark, name)
        assert sorted(map(tuple, table.select("id", "study", "value").collect())) == ROWS
        plan = table.groupBy("study").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan  # the buckets are the groups
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_jdbc(spark):
    url, driver = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.createDataFrame(ROWS, SCHEMA).write.jdbc(url, "facts", properties={"driver": driver})
    whole = io.read_jdbc(spark, url, "facts", driver=driver)
    parts = io.read_jdbc(spark, url, "facts", "id", (0, 30), 3, driver=driver)
    assert parts.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect())) == ROWS


def test_ingest(spark):
    raw = {"AE": spark.createDataFrame([("1", "x")], "subject string, more string"), "other": spark.createDataFrame([(1,)], "a int")}
    out = io.ingest(raw, {"AE": [io.ColumnSpec("subjid", "integer", "subject")]}, keep_all=True)
    assert out["AE"].columns == ["subjid", "more"] and out["AE"].first()["subjid"] == 1 and out["other"] is raw["other"]
