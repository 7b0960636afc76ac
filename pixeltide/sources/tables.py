"""Cubes over the shared tables: each is a projection, so only the columns it names are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Cube
from .rasters import from_table

# Classes of the event types, in the manner of a scene classification.
CLASSES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_cube(spark: SparkSession, sf_dir: str) -> Cube:
    """A cell per user, in time; ``cls`` is a class band, ``qa`` a bit-flag band of seven bits."""
    e = table(spark, sf_dir, "events")
    cls = F.lit(5)
    for name, number in CLASSES.items():
        cls = F.when(F.col("event_type") == name, number).otherwise(cls)
    df = e.select(
        F.col("event_id").alias("item"), F.col("ts").cast("timestamp").alias("t"),
        (F.col("user_id") % 15).alias("x"), F.floor(F.col("user_id") / 15).alias("y"),
        F.col("value"), cls.cast("int").alias("cls"), F.get_json_object("props", "$.k").cast("int").alias("qa"),
    )
    return from_table(df, ["value", "cls", "qa"], mask_band="cls")


def line_cube(spark: SparkSession, sf_dir: str) -> Cube:
    """A cell per supplier with four bands; the item numbers order rows of one time by their values."""
    df = table(spark, sf_dir, "lineitem").select(
        F.struct("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("item"),
        F.col("l_shipdate").alias("t"), (F.col("l_suppkey") % 10).alias("x"), F.floor(F.col("l_suppkey") / 10).alias("y"),
        F.col("l_quantity").alias("blue"), (F.col("l_extendedprice") / 1000).alias("green"),
        (F.col("l_discount") * 100).alias("red"), (F.col("l_tax") * 1000).alias("nir"), "l_returnflag",
    )
    return from_table(df, ["blue", "green", "red", "nir"])


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as catalog items: the box from the customer, cloud cover from the price in cents."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_custkey")
    x, y = (k % 36 * 10 - 180).cast("double"), (k % 17 * 10 - 90).cast("double")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    asset = F.map_from_arrays(
        F.array(*map(F.lit, ("SCL", "B12", "B8A", "B08", "B02"))),
        F.transform(
            F.array(*map(F.lit, ("SCL", "B12", "B8A", "B08", "B02"))),
            lambda a: F.struct(F.concat(F.lit("https://example.org/"), F.col("o_orderkey").cast("string"), F.lit("/"), a, F.lit(".tif")).alias("href")),
        ),
    )
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("c"), F.substring("o_orderpriority", 1, 1)).alias("collection"),
        F.array(x, y, x + 15, y + 12).alias("bbox"), F.col("o_orderdate").alias("datetime"), (cents % 10000 / 100.0).alias("cloud_cover"),
        F.when(F.col("o_orderstatus") == "O", "ascending").when(F.col("o_orderstatus") == "F", "descending").alias("orbit_state"),
        F.col("o_orderpriority").alias("platform"), asset.alias("assets"), F.col("o_orderkey").alias("_pos"),
    )
