"""Small cubes for the tests."""

from pixeltide.sources.rasters import from_table


def cube_of(spark, rows, bands=("a", "b")):
    """rows: (item, day, x, y, values...)"""
    schema = "item long, day int, x long, y long, " + ", ".join(f"{b} double" for b in bands)
    df = spark.createDataFrame(rows, schema)
    df = df.selectExpr("item", "timestamp_seconds(day * 86400) as t", "x", "y", *bands)
    return from_table(df, list(bands))


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
