from pixeltide.streaming import incremental


def run(spark, out, name):
    q = out.writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}")


def test_carry_forward_keeps_state_between_batches(spark, tmp_path):
    schema = "x long, t timestamp, v double"
    for i, rows in enumerate([[(1, "2024-01-01 00:00:00", 5.0)], [(1, "2024-01-02 00:00:00", None), (2, "2024-01-02 00:00:00", None)]]):
        df = spark.createDataFrame(rows, "x long, s string, v double")
        df.selectExpr("x", "cast(s as timestamp) as t", "v").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.x, str(r.t)[:10]): r.v for r in run(spark, incremental.carry_forward(stream, "v", ["x"], "t"), "carried").collect()}
    assert got[1, "2024-01-02"] == 5.0 and got[2, "2024-01-02"] != got[2, "2024-01-02"] or got[2, "2024-01-02"] is None


def test_windowed_composite(spark, tmp_path):
    rows = [(1, f"2024-01-0{d} 00:00:00", float(d)) for d in (1, 1, 2, 5, 9)]
    df = spark.createDataFrame(rows, "x long, s string, v double").selectExpr("x", "cast(s as timestamp) as t", "v")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x long, t timestamp, v double").parquet(str(tmp_path / "in"))
    out = run(spark, incremental.composite(stream, ["v"], ["x"], "t", "1 day", "1 hour"), "means")
    assert out.filter("v = 1.0").count() == 1
