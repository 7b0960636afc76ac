"""Catalog operators on an ``items`` table.

items(id, collection, bbox ARRAY<DOUBLE>, datetime, cloud_cover, orbit_state,
platform, assets MAP<STRING, STRUCT<href>>).  All are lazy filters and projections;
box and time predicates on plain columns reach the scan.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import OutOfRange, need, need_bands
from ..functions.geometry import coverage, validate_box

# Asset names of the usual collections.
SENTINEL2_ASSETS = ("B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B11", "B12", "SCL")
HLS_ASSETS = ("B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B10", "B11", "B12", "Fmask")
SENTINEL1_ASSETS = ("hh", "hv", "vh", "vv")
# Harmonised collections by source.
HLS_COLLECTIONS = {"planetary": ("hls2-s30", "hls2-l30"), "earthdata": ("HLSS30_2.0", "HLSL30_2.0")}


def iso_time(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def collections(items: DataFrame) -> DataFrame:
    return items.select("collection").distinct()


def has_collection(items: DataFrame, name: str) -> bool:
    """Stops at the first row found."""
    return not items.filter(F.col("collection") == name).limit(1).isEmpty()


def cloud_filter(items: DataFrame, most: float) -> DataFrame:
    """Strictly less than ``most``."""
    need(0 <= most <= 100, OutOfRange, "cloud cover is a percentage")
    return items.filter(F.col("cloud_cover") < most)


def orbit_filter(items: DataFrame, states) -> DataFrame:
    states = [states] if isinstance(states, str) else list(states)
    need(bool(states) and set(states) <= {"ascending", "descending"}, OutOfRange, "orbit states are ascending and descending")
    return items.filter(F.col("orbit_state").isin(states))


def coverage_filter(items: DataFrame, box, least: float = 0.5) -> DataFrame:
    """Items that cover strictly more than ``least`` of the box, by area on the sphere."""
    need(0 <= least <= 1, OutOfRange, "coverage is between 0 and 1")
    return items.filter(coverage(F.col("bbox"), validate_box(box)) > least)


def drop_duplicates(items: DataFrame, order: Column, places: int = 4) -> DataFrame:
    """First item, by ``order``, of each (rounded box, time, platform, orbit state)."""
    key = [
        F.transform("bbox", lambda v: F.round(v, places) + F.lit(0.0)),
        F.col("datetime"),
        F.coalesce("platform", F.lit("")),
        F.coalesce("orbit_state", F.lit("")),
    ]
    first = Window.partitionBy(*key).orderBy(order)
    return items.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def select_assets(items: DataFrame, names) -> DataFrame:
    names = list(names)
    return items.withColumn("assets", F.map_filter("assets", lambda k, _: k.isin(names)))


class Tokens:
    """Access tokens by collection: a token is asked for once and kept until shortly before it expires.

    ``issue`` is the caller's function from a collection to (token, seconds of life).
    """

    def __init__(self, issue, margin: float = 60.0, clock=time.monotonic):
        self._issue, self._margin, self._clock = issue, margin, clock
        self._held: dict[str, tuple[str, float]] = {}

    def get(self, collection: str) -> str:
        held = self._held.get(collection)
        if held is None or held[1] <= self._clock():
            token, life = self._issue(collection)
            held = self._held[collection] = (token, self._clock() + life - self._margin)
        return held[0]

    def forget(self, collection: str | None = None) -> None:
        """Drops one token, or all."""
        if collection is None:
            self._held.clear()
        else:
            self._held.pop(collection, None)


def sign_collection(items: DataFrame, collection: str, tokens: Tokens) -> DataFrame:
    """Signs the items of one collection by its token; the others stay as they are."""
    own = F.col("collection").eqNullSafe(collection)
    return items.withColumn("assets", F.when(own, signed_assets(tokens.get(collection))).otherwise(F.col("assets")))


def signed_assets(token: str) -> Column:
    return F.transform_values("assets", lambda _, v: v.withField("href", F.concat(v["href"], F.lit("?"), F.lit(token))))


def sign_assets(items: DataFrame, token: str) -> DataFrame:
    """Appends an access token to every address."""
    return items.withColumn("assets", signed_assets(token))


def query(items: DataFrame, box, collection: str, start, end, assets=None, order: Column | None = None) -> DataFrame:
    """Items of a collection that meet a box and a time range (both ends included), duplicates dropped."""
    x0, y0, x1, y1 = validate_box(box)
    b = [F.get("bbox", i) for i in range(4)]
    found = items.filter(
        (F.col("collection") == collection)
        & F.col("datetime").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
        & (b[0] <= x1) & (b[2] >= x0) & (b[1] <= y1) & (b[3] >= y0)
    )
    found = drop_duplicates(found, F.col("id") if order is None else order)
    return found if assets is None else select_assets(found, assets)


def _clear(items: DataFrame, most: float | None) -> DataFrame:
    return items if most is None else cloud_filter(items, most)


def sentinel2_query(items, box, start, end, collection="sentinel-2-l2a", assets=SENTINEL2_ASSETS, max_cloud_cover=10.0, order=None):
    return _clear(query(items, box, collection, start, end, assets, order), max_cloud_cover)


def hls_query(items, box, start, end, collection="hls2-s30", assets=HLS_ASSETS, max_cloud_cover=10.0, source="planetary", order=None):
    """Harmonised images; each source has collections of its own names."""
    need(source in HLS_COLLECTIONS, OutOfRange, f"a source is one of {sorted(HLS_COLLECTIONS)}")
    need(collection in HLS_COLLECTIONS[source], OutOfRange, f"the collections of {source} are {HLS_COLLECTIONS[source]}")
    return _clear(query(items, box, collection, start, end, assets, order), max_cloud_cover)


def sentinel1_query(items, box, start, end, collection="sentinel-1-rtc", assets=SENTINEL1_ASSETS, orbit_state=("ascending", "descending"), order=None):
    return orbit_filter(query(items, box, collection, start, end, assets, order), orbit_state)


def asset_number(name: Column) -> Column:
    """Digits in an asset's name as a number, null without any."""
    return F.expr(f"try_cast(nullif(regexp_replace({name}, '[^0-9]', ''), '') as int)") if isinstance(name, str) else F.try_to_number(
        F.nullif(F.regexp_replace(name, "[^0-9]", ""), F.lit("")), F.lit("999999999")
    ).cast("int")


def asset_rows(items: DataFrame) -> DataFrame:
    """One row per item and asset, with its place in the order of asset numbers (names without digits last)."""
    names = items.select("id", "datetime", F.posexplode(F.map_entries("assets")).alias("pos", "e")).select(
        "id", "datetime", "pos", F.col("e.key").alias("asset"), F.col("e.value.href").alias("href")
    )
    order = Window.partitionBy("id").orderBy(F.asc_nulls_last(asset_number(F.col("asset"))), "pos")
    return names.withColumn("place", F.row_number().over(order))


def collect_sources(items: DataFrame, prefix: str = "", driver: str = "") -> DataFrame:
    """Per item its sources in asset order; with several times, the time of the first asset."""
    rows = asset_rows(items).withColumn("source", source_name(F.col("href"), prefix, driver))
    return rows.groupBy("id").agg(
        F.min_by("datetime", "place").alias("datetime"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "asset", "source"))), lambda e: e["asset"]).alias("assets"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "asset", "source"))), lambda e: e["source"]).alias("sources"),
    )


def plan(items: DataFrame, prefix: str = "", driver: str = "") -> DataFrame:
    """``collect_sources`` in order of time; nothing is read until an action."""
    return collect_sources(items, prefix, driver).orderBy(F.asc_nulls_last("datetime"), "id")


def source_name(href: Column, prefix: str = "", driver: str = "") -> Column:
    """Address with a virtual file prefix, or ``DRIVER:"address"``; array stores keep the part after ``.zarr`` apart."""
    path = F.concat(F.lit(prefix), href)
    if not driver:
        return path
    if driver.upper() == "EOPFZARR":
        store = F.regexp_extract(path, r"^(.*?\.zarr)", 1)
        rest = F.regexp_extract(path, r"^.*?\.zarr(.*)$", 1)
        return F.concat(F.lit(f'{driver}:"'), store, F.lit('":'), rest)
    return F.concat(F.lit(f'{driver}:"'), path, F.lit('"'))


def shortened(text: Column, width: int = 60) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)


def need_assets(items: DataFrame, names) -> None:
    """Raises if an asset occurs in no item; only the names asked for come back."""
    names = list(names)
    have = items.select(F.explode(F.map_keys("assets")).alias("name")).filter(F.col("name").isin(names)).distinct()
    need_bands([r[0] for r in have.collect()], names)
