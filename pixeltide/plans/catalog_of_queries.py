"""The registered queries over the shared tables, each with the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, pixel
from ..functions.distances import DISTANCES
from ..model import GridSpec
from ..operators import bands, composites, grids, masks, reducers, rendering, series, sets, tiles
from ..sources import catalog, rasters, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    """Registers a query, and its SQL if SQL can express it."""

    def put(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql
        return query

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the last bits of either engine do not matter; -0 becomes 0."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


E = """e AS (
  SELECT event_id AS item, ts AS t, user_id % 15 AS x, user_id // 15 AS y, value,
         CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE 5 END AS cls,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS qa
  FROM events)"""
#: Valid values only where the class is not 1 or 3, and no flag of bits 2 and 3 is set.
M = E + """,
m AS (SELECT item, t, x, y, CASE WHEN cls NOT IN (1, 3) THEN value END AS value, cls, qa FROM e)"""
L = """l AS (
  SELECT {'a': l_orderkey, 'b': l_partkey, 'c': l_linenumber, 'd': l_quantity, 'e': l_extendedprice, 'f': l_discount, 'g': l_tax} AS item,
         l_shipdate AS t, l_suppkey % 10 AS x, l_suppkey // 10 AS y,
         l_quantity AS blue, l_extendedprice / 1000 AS green, l_discount * 100 AS red, l_tax * 1000 AS nir, l_returnflag
  FROM lineitem)"""
C = """c AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, 'c' || substr(o_orderpriority, 1, 1) AS collection,
         (o_custkey % 36 * 10 - 180)::DOUBLE AS x0, (o_custkey % 17 * 10 - 90)::DOUBLE AS y0, o_orderdate AS datetime,
         (round(o_totalprice * 100)::BIGINT % 10000) / 100.0 AS cloud_cover,
         CASE o_orderstatus WHEN 'O' THEN 'ascending' WHEN 'F' THEN 'descending' END AS orbit_state,
         o_orderpriority AS platform, o_orderkey AS pos
  FROM orders)"""


def masked(spark: SparkSession, sf: str):
    return masks.set_mask(tables.event_cube(spark, sf), "cls", [1, 3])


def by_cell(df: DataFrame, digits: int = 6) -> DataFrame:
    return rounded(df.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *[c for c in df.columns if c not in "xy"]), digits)


# ---------------------------------------------------------------- catalog


def _brief(items: DataFrame) -> DataFrame:
    return items.select("id", "collection", F.round("cloud_cover", 2).alias("cloud_cover"), "orbit_state", "platform")


@add("stac_cloud_filter", f"WITH {C} SELECT id, collection, round(cloud_cover, 2) AS cloud_cover, orbit_state, platform FROM c WHERE cloud_cover < 25")
def _(spark, sf):
    return _brief(catalog.cloud_filter(tables.catalog(spark, sf), 25))


@add("stac_orbit_filter", f"WITH {C} SELECT id, collection, round(cloud_cover, 2) AS cloud_cover, orbit_state, platform FROM c WHERE orbit_state = 'ascending'")
def _(spark, sf):
    return _brief(catalog.orbit_filter(tables.catalog(spark, sf), "ascending"))


COVER = """greatest(radians(least(x0 + 15, 30)) - radians(greatest(x0, 0)), 0)
  * greatest(sin(radians(least(y0 + 12, 20))) - sin(radians(greatest(y0, 0))), 0) / (radians(30) * sin(radians(20)))"""


@add("stac_coverage_filter", f"WITH {C} SELECT id, collection, round(cloud_cover, 2) AS cloud_cover, orbit_state, platform FROM c WHERE {COVER} > 0.1")
def _(spark, sf):
    return _brief(catalog.coverage_filter(tables.catalog(spark, sf), (0, 0, 30, 20), 0.1))


DUPLICATES = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x0, y0, datetime, platform, coalesce(orbit_state, '') ORDER BY pos) AS rn FROM {0}) WHERE rn = 1"""


@add("stac_drop_duplicates", f"WITH {C} SELECT id, collection, round(cloud_cover, 2) AS cloud_cover, orbit_state, platform FROM ({DUPLICATES.format('c')})")
def _(spark, sf):
    return _brief(catalog.drop_duplicates(tables.catalog(spark, sf), F.col("_pos")))


FOUND = f"""f AS (SELECT * FROM c WHERE collection = 'c1' AND datetime BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'
  AND x0 <= 60 AND x0 + 15 >= -60 AND y0 <= 50 AND y0 + 12 >= -30), g AS ({DUPLICATES.format('f')})"""


@add("stac_query", f"WITH {C}, {FOUND} SELECT id, 'B02,B08' AS assets FROM g")
def _(spark, sf):
    found = catalog.query(tables.catalog(spark, sf), (-60, -30, 60, 50), "c1", "1996-01-01", "1998-12-31", ["B08", "B02"], F.col("_pos"))
    return found.select("id", F.array_join(F.array_sort(F.map_keys("assets")), ",").alias("assets"))


SEARCH = ((-60, -30, 60, 50), "1996-01-01", "1998-12-31")


@add("stac_sentinel2_query", f"WITH {C}, {FOUND} SELECT id, 5 AS n_assets FROM g WHERE cloud_cover < 10")
def _(spark, sf):
    found = catalog.sentinel2_query(tables.catalog(spark, sf), *SEARCH, collection="c1", order=F.col("_pos"))
    return found.select("id", F.size("assets").alias("n_assets"))


@add("stac_hls_query", f"WITH {C}, {FOUND} SELECT id, 4 AS n_assets FROM g WHERE cloud_cover < 30")
def _(spark, sf):
    items = tables.catalog(spark, sf).withColumn("collection", F.when(F.col("collection") == "c1", "HLSS30_2.0").otherwise(F.col("collection")))
    found = catalog.hls_query(items, *SEARCH, collection="HLSS30_2.0", max_cloud_cover=30, source="earthdata", order=F.col("_pos"))
    return found.select("id", F.size("assets").alias("n_assets"))


@add("stac_sentinel1_query", f"WITH {C}, {FOUND} SELECT id, orbit_state FROM g WHERE orbit_state IN ('ascending', 'descending')")
def _(spark, sf):
    return catalog.sentinel1_query(tables.catalog(spark, sf), *SEARCH, collection="c1", order=F.col("_pos")).select("id", "orbit_state")


@add("stac_collections", f"WITH {C} SELECT DISTINCT collection FROM c")
def _(spark, sf):
    return catalog.collections(tables.catalog(spark, sf))


@add("asset_select", f"WITH {C} SELECT id, 'B02,SCL' AS names FROM c")
def _(spark, sf):
    chosen = catalog.select_assets(tables.catalog(spark, sf), ["SCL", "B02"])
    return chosen.select("id", F.array_join(F.array_sort(F.map_keys("assets")), ",").alias("names"))


A = "(VALUES ('B02', 1), ('B8A', 2), ('B08', 3), ('B12', 4), ('SCL', 5)) AS a(asset, place)"


@add("asset_order", f"WITH {C} SELECT id, asset, place::INTEGER AS place, 'https://example.org/' || id || '/' || asset || '.tif' AS href FROM c, {A}")
def _(spark, sf):
    return catalog.asset_rows(tables.catalog(spark, sf)).select("id", "asset", "place", "href")


@add("asset_sign", f"WITH {C} SELECT id, 'https://example.org/' || id || '/B02.tif?tok' AS href FROM c")
def _(spark, sf):
    signed = catalog.sign_assets(tables.catalog(spark, sf), "tok")
    return signed.select("id", F.element_at("assets", "B02")["href"].alias("href"))


@add("asset_sign_collection", f"WITH {C} SELECT id, 'https://example.org/' || id || '/B02.tif' || CASE WHEN collection = 'c1' THEN '?k1' ELSE '' END AS href FROM c")
def _(spark, sf):
    signed = catalog.sign_collection(tables.catalog(spark, sf), "c1", catalog.Tokens(lambda _: ("k1", 3600)))
    return signed.select("id", F.element_at("assets", "B02")["href"].alias("href"))


@add("collect_sources", f"""WITH {C} SELECT id, strftime(datetime, '%Y-%m-%dT%H:%M:%SZ') AS time,
  array_to_string(list_transform(['B02', 'B8A', 'B08', 'B12', 'SCL'], lambda a: '/vsicurl/https://example.org/' || id || '/' || a || '.tif'), ' ') AS sources FROM c""")
def _(spark, sf):
    found = catalog.collect_sources(tables.catalog(spark, sf), "/vsicurl/")
    return found.select("id", catalog.iso_time(F.col("datetime").cast("timestamp")).alias("time"), F.array_join("sources", " ").alias("sources"))


@add("source_plan", f"WITH {C} SELECT id, 5 AS n_assets FROM c")
def _(spark, sf):
    return catalog.plan(tables.catalog(spark, sf)).select("id", F.size("assets").alias("n_assets"))


@add("source_driver_names", f"""WITH {C} SELECT id, 'ZARR:"/vsi/s/' || id || '.zarr/r10m"' AS zarr, 'EOPFZARR:"/vsi/s/' || id || '.zarr":/r10m' AS split FROM c""")
def _(spark, sf):
    items = tables.catalog(spark, sf).withColumn("h", F.concat(F.lit("s/"), "id", F.lit(".zarr/r10m")))
    return items.select("id", catalog.source_name(F.col("h"), "/vsi/", "ZARR").alias("zarr"), catalog.source_name(F.col("h"), "/vsi/", "EOPFZARR").alias("split"))


@add("plan_print_shortened", f"WITH {C} SELECT id, CASE WHEN length(s) > 60 THEN substr(s, 1, 57) || '...' ELSE s END AS shown FROM (SELECT id, repeat('abcdef/', 2 + (pos % 12)::INTEGER) || id AS s FROM c)")
def _(spark, sf):
    text = F.concat(F.repeat(F.lit("abcdef/"), (F.col("_pos") % 12).cast("int") + 2), "id")
    return tables.catalog(spark, sf).select("id", catalog.shortened(text).alias("shown"))


@add("source_header", "SELECT p_partkey, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part")
def _(spark, sf):
    text = F.concat(F.lit("brand="), "p_brand", F.lit(",size="), F.col("p_size").cast("string"))
    h = tables.table(spark, sf, "part").select("p_partkey", rasters.header(text).alias("h"))
    return h.select("p_partkey", F.element_at("h", "brand").alias("brand"), F.element_at("h", "size").alias("size"))


BOXES = f"""{C}, b AS (SELECT CASE WHEN pos % 2 = 0 THEN 'EPSG:4326' ELSE 'EPSG:32630' END AS srs, x0 AS xmin, y0 AS ymin, x0 + 15 AS xmax, y0 + 12 AS ymax,
  10.0 + pos % 3 AS xres, 10.0 + pos % 2 AS yres FROM c)"""


def _boxes(spark, sf):
    c = tables.catalog(spark, sf)
    return c.select(
        F.when(F.col("_pos") % 2 == 0, "EPSG:4326").otherwise("EPSG:32630").alias("srs"), F.get("bbox", 0).alias("xmin"), F.get("bbox", 1).alias("ymin"),
        F.get("bbox", 2).alias("xmax"), F.get("bbox", 3).alias("ymax"), (F.col("_pos") % 3 + 10.0).alias("xres"), (F.col("_pos") % 2 + 10.0).alias("yres"),
    )


@add("collect_summary", f"""WITH {BOXES} SELECT count(*) AS n_items, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax,
  min(xres)::DOUBLE AS xres, min(yres)::DOUBLE AS yres, array_to_string(list_sort(list(DISTINCT srs)), ',') AS srs, count(DISTINCT (srs, xmin, ymin, xmax, ymax, xres, yres)) = 1 AS aligned FROM b""")
def _(spark, sf):
    return rasters.summary(_boxes(spark, sf)).withColumn("srs", F.array_join("srs", ","))


@add("bbox_of_points", f"WITH {C} SELECT min(x0) - 2 AS xmin, min(y0) - 2 AS ymin, max(x0) + 2 AS xmax, max(y0) + 2 AS ymax FROM c")
def _(spark, sf):
    return rasters.box_of(_boxes(spark, sf), "xmin", "ymin", 2.0)


@add("bbox_wkt", f"""WITH {C} SELECT id, 'POLYGON ((' || x0 || ' ' || y0 || ', ' || (x0 + 15) || ' ' || y0 || ', ' || (x0 + 15) || ' ' || (y0 + 12) || ', ' || x0 || ' ' || (y0 + 12) || ', ' || x0 || ' ' || y0 || '))' AS wkt FROM c""")
def _(spark, sf):
    return tables.catalog(spark, sf).select("id", geometry.box_wkt(F.col("bbox")).alias("wkt"))


LAEA = """sqrt(2 / (1 + sin(radians(45)) * sin(radians(lat)) + cos(radians(45)) * cos(radians(lat)) * cos(radians(lon - 10))))"""


@add("project_laea", f"""WITH {C}, p AS (SELECT id, x0 / 10 AS lon, y0 / 3 + 40 AS lat FROM c)
SELECT id, round(6371008.8 * {LAEA} * cos(radians(lat)) * sin(radians(lon - 10)), 2) + 0.0 AS east,
  round(6371008.8 * {LAEA} * (cos(radians(45)) * sin(radians(lat)) - sin(radians(45)) * cos(radians(lat)) * cos(radians(lon - 10))), 2) + 0.0 AS north FROM p""")
def _(spark, sf):
    p = tables.catalog(spark, sf).select("id", (F.get("bbox", 0) / 10).alias("lon"), (F.get("bbox", 1) / 3 + 40).alias("lat"))
    east, north = geometry.laea(F.col("lon"), F.col("lat"), 10, 45)
    return rounded(p.select("id", east.alias("east"), north.alias("north")), 2)


@add("box_valid", f"WITH {C} SELECT id, CASE WHEN ok THEN x0 END AS xmin, CASE WHEN ok THEN y0 END AS ymin, CASE WHEN ok THEN x0 + 15 END AS xmax, CASE WHEN ok THEN y0 + 12 END AS ymax FROM (SELECT *, x0 + 15 <= 180 AND y0 + 12 <= 90 AS ok FROM c)")
def _(spark, sf):
    turned = F.array(F.get("bbox", 2), F.get("bbox", 1), F.get("bbox", 0), F.get("bbox", 3))
    box = geometry.ordered_box(turned)
    return tables.catalog(spark, sf).select("id", *(F.get(box, i).alias(n) for i, n in enumerate(("xmin", "ymin", "xmax", "ymax"))))


AEQD = "sqrt(pow(cos(radians(45)) * sin(radians(lat)) - sin(radians(45)) * cos(radians(lat)) * cos(radians(lon - 10)), 2) + pow(cos(radians(lat)) * sin(radians(lon - 10)), 2))"


@add("project_box_laea", f"""WITH {C}, b AS (SELECT id, x0 / 10 AS x0, y0 / 3 + 40 AS y0, x0 / 10 + 2 AS x1, y0 / 3 + 41 AS y1 FROM c),
s AS (SELECT i / 20.0 AS s FROM range(21) r(i)),
p AS (SELECT id, x0 + (x1 - x0) * s AS lon, y AS lat FROM b, s, LATERAL (SELECT unnest([y0, y1]) AS y) UNION ALL SELECT id, x AS lon, y0 + (y1 - y0) * s AS lat FROM b, s, LATERAL (SELECT unnest([x0, x1]) AS x)),
e AS (SELECT id, 6371008.8 * {LAEA} * cos(radians(lat)) * sin(radians(lon - 10)) AS east,
  6371008.8 * {LAEA} * (cos(radians(45)) * sin(radians(lat)) - sin(radians(45)) * cos(radians(lat)) * cos(radians(lon - 10))) AS north FROM p)
SELECT id, round(min(east), 1) + 0.0 AS xmin, round(min(north), 1) + 0.0 AS ymin, round(max(east), 1) + 0.0 AS xmax, round(max(north), 1) + 0.0 AS ymax FROM e GROUP BY id""")
def _(spark, sf):
    low = (F.get("bbox", 0) / 10, F.get("bbox", 1) / 3 + 40)
    box = F.array(low[0], low[1], low[0] + 2, low[1] + 1)
    b = tables.catalog(spark, sf).select("id", geometry.projected_box(box, "laea", 10, 45).alias("b"))
    return rounded(b.select("id", *(F.get("b", i).alias(n) for i, n in enumerate(("xmin", "ymin", "xmax", "ymax")))), 1)


@add("project_there_and_back", f"WITH {C} SELECT id, round(x0 / 10, 6) + 0.0 AS lon, round(y0 / 3 + 40, 6) + 0.0 AS lat FROM c")
def _(spark, sf):
    p = tables.catalog(spark, sf).select("id", (F.get("bbox", 0) / 10).alias("lon"), (F.get("bbox", 1) / 3 + 40).alias("lat"))
    for kind in ("laea", "aeqd"):
        x, y = geometry.FORWARD[kind](F.col("lon"), F.col("lat"), 10, 45)
        lon, lat = geometry.INVERSE[kind](F.col("x"), F.col("y"), 10, 45)
        p = p.select("id", x.alias("x"), y.alias("y")).select("id", lon.alias("lon"), lat.alias("lat"))
    return rounded(p, 6)


@add("tap_extent", f"WITH {BOXES} SELECT floor((xmin + 0.3) / 20) * 20 + 0.0 AS xmin, floor(ymin / 20) * 20 + 0.0 AS ymin, ceil(xmax / 20) * 20 + 0.0 AS xmax, ceil(ymax / 20) * 20 + 0.0 AS ymax FROM b")
def _(spark, sf):
    b = _boxes(spark, sf).select((F.col("xmin") + 0.3).alias("xmin"), "ymin", "xmax", "ymax")
    out = grids.snapped_extent(b, 20.0)
    return out.select(*(F.col(c).cast("double").alias(c) for c in out.columns))


# ---------------------------------------------------------------- bands


@add("band_rename", f"WITH {L} SELECT x, y, round(sum(blue), 4) AS \"B02\", round(sum(green), 4) AS \"B03\", round(sum(red), 4) AS \"B04\", round(sum(nir), 4) AS \"B08\" FROM l GROUP BY x, y")
def _(spark, sf):
    cube = bands.rename(tables.line_cube(spark, sf), ["B02", "B03", "B04", "B08"])
    return by_cell(composites.composite(cube, "sum"), 4)


@add("band_move", f"WITH {L} SELECT x, y, round(green, 6) AS b1, round(blue, 6) AS b2, round(red, 6) AS b3 FROM l")
def _(spark, sf):
    cube = bands.move(tables.line_cube(spark, sf), 1, 2)
    return rounded(cube.df.select("x", "y", *(F.col(b).alias(f"b{i + 1}") for i, b in enumerate(cube.bands[:3]))))


@add("band_add_empty", f"WITH {L} SELECT x, y, count(blue) AS blue, 0::BIGINT AS extra, count(nir) AS nir FROM l GROUP BY x, y")
def _(spark, sf):
    cube = bands.add_empty(tables.line_cube(spark, sf), 1, "extra")
    return composites.composite(cube, "count", ["blue", "extra", "nir"])


@add("band_subset", f"WITH {L} SELECT x, y, round(avg(blue), 6) AS blue, round(avg(red), 6) AS red FROM l GROUP BY x, y")
def _(spark, sf):
    return by_cell(composites.composite(bands.subset(tables.line_cube(spark, sf), ["red", "blue"]), "mean"))


@add("band_collapse", f"WITH {L} SELECT x, y, round(sum(blue + green + red + nir), 3) AS total FROM l GROUP BY x, y")
def _(spark, sf):
    cube = bands.collapse(tables.line_cube(spark, sf))
    whole = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return by_cell(cube.df.groupBy("x", "y").agg(F.sum(whole).alias("total")), 3)


@add("band_scale", f"WITH {L} SELECT x, y, round(avg(blue * 0.0001 + -0.1), 8) AS blue, round(avg(red * 0.0001 + -0.1), 8) AS red FROM l GROUP BY x, y")
def _(spark, sf):
    cube = bands.set_scale(bands.subset(tables.line_cube(spark, sf), ["blue", "red"]), 0.0001, -0.1)
    return by_cell(composites.composite(composites.apply_rowwise(cube, "scale"), "mean"), 8)


@add("band_nodata", f"WITH {L} SELECT x, y, count(nullif(red, 5.0)) AS red, sum(coalesce(CASE WHEN red <> 5.0 THEN red END, -9999.0)) AS stored FROM (SELECT x, y, round(red, 6) AS red FROM l) GROUP BY x, y")
def _(spark, sf):
    cube = bands.subset(tables.line_cube(spark, sf), ["red"])
    cube = bands.set_nodata(cube.with_bands({"red": F.round("red", 6)}), -9999.0, 5.0)
    stored = sinks.to_nodata(cube)
    both = cube.df.groupBy("x", "y").agg(F.count("red").alias("red"))
    return both.join(stored.groupBy("x", "y").agg(F.sum("red").alias("stored")), ["x", "y"])


@add("band_first_nodata_only", f"WITH {L} SELECT x, y, count(nullif(blue, 10.0)) AS blue, count(red) AS red FROM l GROUP BY x, y")
def _(spark, sf):
    cube = bands.set_nodata(tables.line_cube(spark, sf), 9999.0, 10.0, ["blue"])
    return composites.composite(cube, "count", ["blue", "red"])


INDEX_SQL = {
    "ndvi": "(nir - red) / nullif(nir + red, 0)", "ndti": "(red - green) / nullif(red + green, 0)",
    "evi": "2.5 * (nir - red) / nullif(nir + 6.0 * red - 7.5 * blue + 1.0, 0)", "evi2": "2.5 * (nir - red) / nullif(nir + 2.4 * red + 1.0, 0)",
    "vgnirbi": "(green - nir) / nullif(green + nir, 0)",
}


def _index(name: str) -> None:
    @add(f"derived_{name}", f"WITH {L} SELECT x, y, round(quantile_cont({INDEX_SQL[name]}, 0.5), 5) + 0.0 AS v, count({INDEX_SQL[name]}) AS n FROM l GROUP BY x, y")
    def _(spark, sf):
        cube = bands.derive(tables.line_cube(spark, sf), v=bands.INDICES[name])
        return by_cell(cube.df.groupBy("x", "y").agg(F.median("v").alias("v"), F.count("v").alias("n")), 5)


for _name in INDEX_SQL:
    _index(_name)


@add("derived_scaled_ndvi", f"WITH {L}, s AS (SELECT x, y, nir * 0.0001 + -0.1 AS n, red * 0.0002 + 0.3 AS r FROM l) SELECT x, y, round(avg((n - r) / nullif(n + r, 0)), 6) + 0.0 AS ndvi FROM s GROUP BY x, y")
def _(spark, sf):
    cube = bands.set_scale(bands.set_scale(tables.line_cube(spark, sf), 0.0001, -0.1, "nir"), 0.0002, 0.3, "red")
    return by_cell(composites.composite(bands.derive(cube, ndvi=bands.INDICES["ndvi"]), "mean"))


# ---------------------------------------------------------------- masks


@add("mask_int", f"WITH {M} SELECT item, round(value, 6) AS value FROM m")
def _(spark, sf):
    return rounded(masked(spark, sf).df.select("item", "value"))


@add("mask_bit", f"WITH {E} SELECT item, CASE WHEN (qa & 12) = 0 THEN value END AS value FROM e")
def _(spark, sf):
    return masks.set_mask(tables.event_cube(spark, sf), "qa", [3, 2], masks.bit_mask).df.select("item", "value")


@add("mask_bit_remainder", f"WITH {E} SELECT item, CASE WHEN NOT (qa % 8 >= 4 OR qa % 16 >= 8) THEN value END AS value FROM e")
def _(spark, sf):
    return masks.set_mask(tables.event_cube(spark, sf), "qa", [3, 2], masks.bit_mask_by_remainder).df.select("item", "value")


@add("mask_keep_band", f"WITH {E} SELECT item, CASE WHEN cls <> 2 THEN value END AS value, cls FROM e")
def _(spark, sf):
    return masks.set_mask(tables.event_cube(spark, sf), "cls", [2], drop_mask=False).df.select("item", "value", "cls")


GRID = f"""{E}, g AS (SELECT x, y, avg(value) AS value, max(qa) AS qa FROM e GROUP BY x, y)"""


def _image(spark, sf):
    """One image: the mean value and the largest flag of each cell."""
    cube = tables.event_cube(spark, sf)
    df = cube.df.groupBy("x", "y").agg(F.avg("value").alias("value"), F.max("qa").alias("qa"))
    df = df.withColumns({"item": F.lit(1).cast("long"), "t": F.lit("2024-01-01").cast("timestamp")})
    return rasters.from_table(df, ["value", "qa"], mask_band="qa")


@add("mask_buffered", f"""WITH {GRID} SELECT x, y, round(CASE WHEN NOT EXISTS (SELECT 1 FROM g b WHERE (b.qa & 4) <> 0 AND (b.qa & 1) <> 0 AND abs(b.x - g.x) <= 1 AND abs(b.y - g.y) <= 1) THEN value END, 6) AS value FROM g""")
def _(spark, sf):
    def build(band, bits):
        return F.when((band.bitwiseAND(F.lit(4)) != 0) & (band.bitwiseAND(F.lit(1)) != 0), 0).otherwise(1)

    return by_cell(masks.set_mask(_image(spark, sf), "qa", [], build, buffer=1).df.select("x", "y", "value"))


@add("mask_from_table", f"WITH {E} SELECT item, CASE WHEN qa % 5 <> 0 THEN value END AS value FROM e")
def _(spark, sf):
    cube = tables.event_cube(spark, sf)
    table = cube.df.filter("qa % 5 = 0").select("item", "x", "y", F.lit(False).alias("valid"))
    return masks.apply_mask_table(bands.subset(cube, ["value"]), table).df.select("item", "value")


@add("mask_created", f"WITH {L} SELECT x, y, count(*) FILTER (WHERE red > 5.5 AND green > 50 AND nir > 35) AS cloudy FROM l GROUP BY x, y")
def _(spark, sf):
    def bright(red: pd.Series, green: pd.Series, nir: pd.Series) -> pd.Series:
        return ((red > 5.5) & (green > 50) & (nir > 35)).astype(float)

    cube = masks.create_mask(tables.line_cube(spark, sf), masks.MaskFunction(bright, ("red", "green", "nir"), "cloud"), red="red", green="green", nir="nir")
    return cube.df.groupBy("x", "y").agg(F.sum("cloud").cast("long").alias("cloudy"))


@add("masked_median", f"WITH {E} SELECT x, y, round(quantile_cont(CASE WHEN (qa & 15) = 0 THEN value END, 0.5), 6) AS value FROM e GROUP BY x, y")
def _(spark, sf):
    cube = masks.set_mask(tables.event_cube(spark, sf), "qa", [0, 1, 2, 3], masks.bit_mask)
    return by_cell(composites.composite(bands.subset(cube, ["value"]), "median"))


@add("window_filter", f"WITH {L} SELECT x, y, round(avg(red), 6) AS red FROM l WHERE x BETWEEN 2 AND 5 AND y >= 4 GROUP BY x, y")
def _(spark, sf):
    return by_cell(composites.composite(bands.subset(masks.window(tables.line_cube(spark, sf), 2, 5, 4), ["red"]), "mean"))


# ---------------------------------------------------------------- composites

COMPOSITES = {
    "median": ("quantile_cont(value, 0.5)", {}),
    "mean": ("avg(value)", {}),
    "geometric_mean": ("exp(avg(ln(value)) FILTER (WHERE value > 0))", {}),
    "quantile": ("quantile_cont(value, 0.4)", {"q": 0.4}),
    "mean_db": ("10 * log10(avg(value))", {}),
    "min": ("min(value)", {}),
    "max": ("max(value)", {}),
    "sum": ("sum(value)", {}),
    "harmonic_mean": ("count(value) / sum(1 / value)", {}),
    "count": ("count(value)::DOUBLE", {}),
}


def _composite(name: str, sql: str, options: dict) -> None:
    @add(f"composite_{name}", f"WITH {M} SELECT x, y, round({sql}, 4) AS value FROM m GROUP BY x, y")
    def _(spark, sf):
        out = composites.composite(bands.subset(masked(spark, sf), ["value"]), name, **options)
        return by_cell(out.withColumn("value", F.col("value").cast("double")), 4)


for _name, (_sql, _options) in COMPOSITES.items():
    _composite(_name, _sql, _options)


@add("composite_min_propagate", f"WITH {E}, p AS (SELECT x, y, CASE WHEN qa <> 7 THEN value END AS value FROM e) SELECT x, y, CASE WHEN count(*) = count(value) THEN min(value) END AS value FROM p GROUP BY x, y")
def _(spark, sf):
    cube = masks.set_mask(tables.event_cube(spark, sf), "qa", [7])
    return composites.composite(bands.subset(cube, ["value"]), "min", propagate=True)


@add("composite_max_propagate", f"WITH {E}, p AS (SELECT x, y, CASE WHEN qa <> 9 THEN value END AS value FROM e) SELECT x, y, CASE WHEN count(*) = count(value) THEN max(value) END AS value FROM p GROUP BY x, y")
def _(spark, sf):
    cube = masks.set_mask(tables.event_cube(spark, sf), "qa", [9])
    return composites.composite(bands.subset(cube, ["value"]), "max", propagate=True)


@add("composite_mode", f"WITH {E}, k AS (SELECT x, y, qa % 10 AS v, count(*) AS n FROM e GROUP BY x, y, v) SELECT x, y, v::INTEGER AS qa FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY n DESC, v) AS rn FROM k) WHERE rn = 1")
def _(spark, sf):
    cube = tables.event_cube(spark, sf).with_bands({"qa": F.col("qa") % 10})
    return composites.composite(cube, "mode")


#: Growth rates near one, so that products of long series stay in range.
@add("composite_product", f"WITH {M} SELECT x, y, round(exp(sum(ln(1 + value / 100000))), 6) AS value FROM m GROUP BY x, y")
def _(spark, sf):
    cube = bands.subset(masked(spark, sf), ["value"])
    return by_cell(composites.composite(cube.with_bands({"value": 1 + F.col("value") / 100000}), "mul"))


@add("composite_argmax", f"WITH {M} SELECT x, y, arg_max(item, (value, -item)) FILTER (WHERE value IS NOT NULL) AS n FROM m GROUP BY x, y")
def _(spark, sf):
    cube = masked(spark, sf).with_bands({"value": F.col("value"), "n": F.col("item")})
    return composites.arg_extreme(cube, "value", "n")


@add("composite_argmin", f"WITH {M} SELECT x, y, arg_min(item, (value, item)) FILTER (WHERE value IS NOT NULL) AS n FROM m GROUP BY x, y")
def _(spark, sf):
    cube = masked(spark, sf).with_bands({"value": F.col("value"), "n": F.col("item")})
    return composites.arg_extreme(cube, "value", "n", False)


@add("mosaic_last_valid", f"WITH {M} SELECT x, y, arg_max(value, (t, item)) FILTER (WHERE value IS NOT NULL) AS value FROM m GROUP BY x, y")
def _(spark, sf):
    return composites.mosaic(bands.subset(masked(spark, sf), ["value"]).stack())


@add("mosaic_first_valid", f"WITH {M} SELECT x, y, arg_min(value, (t, item)) FILTER (WHERE value IS NOT NULL) AS value FROM m GROUP BY x, y")
def _(spark, sf):
    return composites.mosaic(bands.subset(masked(spark, sf), ["value"]), first=True)


@add("composite_quantiles", f"WITH {L} SELECT x, y, round(quantile_cont(red, 0.1), 5) AS red_q10, round(quantile_cont(red, 0.9), 5) AS red_q90, round(quantile_cont(nir, 0.1), 5) AS nir_q10, round(quantile_cont(nir, 0.9), 5) AS nir_q90 FROM l GROUP BY x, y")
def _(spark, sf):
    return by_cell(composites.quantiles(tables.line_cube(spark, sf), [0.1, 0.9], ["red", "nir"]), 5)


@add("composite_user_function", f"WITH {M} SELECT x, y, round(max(value) - min(value), 6) AS value FROM m GROUP BY x, y")
def _(spark, sf):
    return by_cell(composites.composite_with(bands.subset(masked(spark, sf), ["value"]), lambda v: v.max() - v.min()))


SERIES = f"{E}, a AS (SELECT x, y, list(value ORDER BY t, item) AS v, len(v) AS n FROM e GROUP BY x, y), s AS (SELECT *, greatest(0, least({{at}}, n - 2)) AS i FROM a)"


@add("pixfun_interpolate_linear", f"""WITH {SERIES.format(at=3)}, z AS (SELECT *, greatest(0, least(1000, n - 2)) AS j FROM s)
SELECT x, y, round(CASE WHEN n > 1 THEN v[i + 1] + (v[i + 2] - v[i + 1]) * (3.5 - i) ELSE v[1] END, 6) AS inside,
  round(CASE WHEN n > 1 THEN v[j + 1] + (v[j + 2] - v[j + 1]) * (1000 - j) ELSE v[1] END, 4) AS beyond FROM z""")
def _(spark, sf):
    cube = bands.subset(tables.event_cube(spark, sf), ["value"])
    inside = composites.interpolated(cube, 0, 2, 7).withColumn("inside", F.round("value", 6))
    beyond = composites.interpolated(cube, 0, 1, 1000).withColumn("beyond", F.round("value", 4))
    return by_cell(inside.drop("value").join(beyond.drop("value"), ["x", "y"]))


@add("pixfun_interpolate_exp", f"""WITH {SERIES.format(at=3)} SELECT x, y, round(CASE WHEN n > 1 AND v[i + 1] > 0 AND v[i + 2] > 0 THEN v[i + 1] * pow(v[i + 2] / v[i + 1], 3.5 - i) END, 5) AS value FROM s""")
def _(spark, sf):
    return by_cell(composites.interpolated(bands.subset(tables.event_cube(spark, sf), ["value"]), 0, 2, 7, how="exp"), 5)


ROWWISE = {
    "sqrt": ("CASE WHEN value - 200 >= 0 THEN sqrt(value - 200) END", {}),
    "log10": ("CASE WHEN value - 200 > 0 THEN log10(value - 200) END", {}),
    "dB": ("CASE WHEN value - 200 > 0 THEN 20 * log10(value - 200) END", {}),
    "pow": ("(value - 200) * (value - 200)", {"power": 2}),
    "inv": ("1 / nullif(value - 200, 0)", {}),
    "intensity": ("(value - 200) * (value - 200)", {}),
    "dB2pow": ("pow(10.0, (value - 200) / 10 / 10)", {}),
    "replace_nodata": ("coalesce(value - 200, -1.0)", {"to": -1.0}),
    "phase": ("CASE WHEN value - 200 < 0 THEN pi() ELSE 0.0 END", {}),
    "exp": ("exp((value - 200) * 0.01)", {"fact": 0.01}),
    "mod": ("abs(value - 200)", {}),
    "real": ("value - 200", {}),
    "imag": ("0.0", {}),
    "conj": ("value - 200", {}),
    "dB2amp": ("pow(10.0, (value - 200) / 10 / 20)", {}),
}


def _rowwise(name: str, sql: str, options: dict) -> None:
    @add(f"pixfun_{name}", f"WITH {E} SELECT item, round({sql}, 6) + 0.0 AS value FROM e")
    def _(spark, sf):
        shift = F.col("value") - 200
        cube = tables.event_cube(spark, sf).with_bands({"value": shift / 10 if name in ("dB2pow", "dB2amp") else shift})
        return rounded(composites.apply_rowwise(cube, name, **options).df.select("item", "value"))


for _name, (_sql, _options) in ROWWISE.items():
    _rowwise(_name, _sql, _options)


@add("pixfun_norm_diff", f"WITH {L} SELECT x, y, round(avg((nir - red) / nullif(nir + red, 0)), 6) + 0.0 AS v, round(avg(nir - red), 6) + 0.0 AS d FROM l GROUP BY x, y")
def _(spark, sf):
    a, b = F.col("nir"), F.col("red")
    cube = tables.line_cube(spark, sf).with_bands({"v": pixel.PAIRWISE["norm_diff"](a, b), "d": pixel.PAIRWISE["diff"](a, b)})
    return by_cell(composites.composite(cube, "mean"))


@add("pixfun_div", f"WITH {L} SELECT x, y, round(avg(green / nullif(red, 0)), 5) AS v, count(green / nullif(red, 0)) AS n FROM l GROUP BY x, y")
def _(spark, sf):
    v = pixel.PAIRWISE["div"](F.col("green"), F.col("red"))
    return by_cell(tables.line_cube(spark, sf).df.groupBy("x", "y").agg(F.avg(v).alias("v"), F.count(v).alias("n")), 5)


@add("pixfun_complex", f"WITH {L} SELECT x, y, round(sum(red), 4) AS re, round(sum(nir), 4) AS im FROM l GROUP BY x, y")
def _(spark, sf):
    pair = tables.line_cube(spark, sf).with_bands({"z": pixel.PAIRWISE["complex"](F.col("red"), F.col("nir"))}).df
    return by_cell(pair.groupBy("x", "y").agg(F.sum("z.re").alias("re"), F.sum("z.im").alias("im")), 4)


@add("pixfun_polynomial", f"WITH {E} SELECT item, round(1 + 0.5 * value + 0.01 * value * value, 6) AS value FROM e")
def _(spark, sf):
    return rounded(tables.event_cube(spark, sf).with_bands({"value": pixel.polynomial(F.col("value"), [1, 0.5, 0.01])}).df.select("item", "value"))


@add("pixfun_reclassify", f"WITH {E} SELECT item, CASE WHEN cls = 0 THEN 10 WHEN cls >= 1 AND cls < 4 THEN 20 ELSE 99 END AS cls FROM e")
def _(spark, sf):
    cube = tables.event_cube(spark, sf).with_bands({"cls": pixel.reclassify(F.col("cls"), {0: 10, (1, 4): 20}, 99)})
    return cube.df.select("item", "cls")


# ---------------------------------------------------------------- reducers

#: Cube with gaps: red is missing for returned lines, and all bands for a few.
G = L + """,
h AS (SELECT item, t, x, y, CASE WHEN skip THEN NULL ELSE blue END AS blue, CASE WHEN skip OR (l_returnflag = 'R' AND y < 5) THEN NULL ELSE red END AS red,
  CASE WHEN skip THEN NULL ELSE nir END AS nir FROM (SELECT *, item.a % 37 = 0 AS skip FROM l))"""


def _gaps(spark, sf):
    line = tables.table(spark, sf, "lineitem")
    df = line.select(
        F.struct("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("item"),
        F.col("l_shipdate").alias("t"), (F.col("l_suppkey") % 10).alias("x"), F.floor(F.col("l_suppkey") / 10).alias("y"),
        F.col("l_quantity").alias("blue"), (F.col("l_discount") * 100).alias("red"), (F.col("l_tax") * 1000).alias("nir"),
        "l_returnflag", (F.col("l_orderkey") % 37 == 0).alias("skip"),
    )
    df = df.withColumn("red", F.when(~((F.col("l_returnflag") == "R") & (F.col("y") < 5)), F.col("red")))
    df = df.select("item", "t", "x", "y", *(F.when(~F.col("skip"), F.col(b)).alias(b) for b in ("blue", "red", "nir")))
    return rasters.from_table(df, ["blue", "red", "nir"])


NAMES = ("blue", "red", "nir")


def _sum_sql(term: str) -> str:
    """Sum over the complete bands of a term in {a} and {c}; what is undefined adds nothing."""
    return "(" + " + ".join(f"CASE WHEN f_{b} THEN coalesce({term.format(a=b, c=f'c_{b}')}, 0) ELSE 0 END" for b in NAMES) + ")"


def _each_sql(pick: str, term: str) -> str:
    return f"{pick}(" + ", ".join(f"CASE WHEN f_{b} THEN {term.format(a=b, c=f'c_{b}')} END" for b in NAMES) + ")"


def _log_sql(v: str) -> str:
    return f"ln(CASE WHEN {v} > 0 THEN {v} END)"


GAP, LESS, MORE, PLUS = "abs({a} - {c})", "least({a}, {c})", "greatest({a}, {c})", "({a} + {c})"
SQUARE, QUOTIENT = "({a} - {c}) * ({a} - {c})", "({a} / nullif({c}, 0))"


def _over_sql(top: str, bottom: str) -> str:
    return f"{_sum_sql(top)} / nullif({_sum_sql(bottom)}, 0)"


ROOTS = _sum_sql("sqrt({a} * {c})")
#: The distances in SQL, over the complete bands.
XOIDS = {
    "euclidean": f"sqrt({_sum_sql(SQUARE)})",
    "minkowski": f"sqrt({_sum_sql(SQUARE)})",
    "manhattan": _sum_sql(GAP),
    "minimum": _each_sql("least", GAP),
    "maximum": _each_sql("greatest", GAP),
    "canberra": _sum_sql(f"{GAP} / nullif({PLUS}, 0)"),
    "chi_square": _sum_sql(f"{SQUARE} / nullif({PLUS}, 0)"),
    "wave_hedges": _sum_sql(f"{GAP} / nullif({MORE}, 0)"),
    "harmonic_mean": "2 * " + _sum_sql(f"{{a}} * {{c}} / nullif({PLUS}, 0)"),
    "hellinger": f"sqrt({_sum_sql('(sqrt({a}) - sqrt({c})) * (sqrt({a}) - sqrt({c}))')}) / sqrt(2)",
    "bhattacharyya": "-" + _log_sql(ROOTS),
    "jeffries_matusita": f"sqrt(CASE WHEN 2 - 2 * {ROOTS} >= 0 THEN 2 - 2 * {ROOTS} END)",
    "kullback_leibler": _sum_sql("({a} - {c}) * " + _log_sql(QUOTIENT)),
    "itakura_saito": _sum_sql(f"{QUOTIENT} - {_log_sql(QUOTIENT)} - 1"),
    "jensen_shannon": _sum_sql(f"{{a}} * {_log_sql(f'(2 * {{a}} / nullif({PLUS}, 0))')} + {{c}} * {_log_sql(f'(2 * {{c}} / nullif({PLUS}, 0))')}"),
    "gower": f"{_sum_sql(GAP)} / nullif({_sum_sql('1')}, 0)",
    "motyka": _over_sql(LESS, PLUS),
    "kulczynski": _over_sql(GAP, LESS),
    "soergel": _over_sql(GAP, MORE),
    "sorensen": _over_sql(GAP, PLUS),
    "cosine": f"{_sum_sql('{a} * {c}')} / nullif(sqrt({_sum_sql('{a} * {a}')}) * sqrt({_sum_sql('{c} * {c}')}), 0)",
}


def _xoid_sql(centre: str, far: str) -> str:
    """Closest row to a centre over the complete bands, filled by the centre; rows equal in distance by time and item."""
    cs = ", ".join(f"{centre.format(b)} AS c_{b}, count({b}) = count(*) AS f_{b}" for b in NAMES)
    picked = ", ".join(f"round(CASE WHEN n > 1 THEN coalesce({b}, c_{b}) ELSE {b} END, 5) AS {b}" for b in NAMES)
    return f"""WITH {G}, u AS (SELECT * FROM h WHERE coalesce(blue, red, nir) IS NOT NULL),
s AS (SELECT x, y, count(*) AS n, {cs} FROM u GROUP BY x, y),
d AS (SELECT u.*, s.* EXCLUDE (x, y), round({far}, 9) AS far FROM u JOIN s USING (x, y)),
r AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY far, t, item) AS rn FROM d)
SELECT x, y, {picked} FROM r WHERE rn = 1"""


MEDIAN, Q40 = "quantile_cont({}, 0.5)", "quantile_cont({}, 0.4)"


def _medoid(name: str) -> None:
    @add(f"reduce_medoid_{name}", _xoid_sql(MEDIAN, XOIDS[name]))
    def _(spark, sf):
        return by_cell(reducers.medoid(_gaps(spark, sf), name), 5)


for _name in DISTANCES:
    _medoid(_name)


@add("reduce_quantoid", _xoid_sql(Q40, XOIDS["euclidean"]))
def _(spark, sf):
    return by_cell(reducers.quantoid(_gaps(spark, sf), 0.4), 5)


@add("reduce_medoid_embedding", """WITH p AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings),
m AS (SELECT label, k, quantile_cont(v, 0.5) AS c FROM p GROUP BY label, k),
d AS (SELECT label, vec_id, round(sqrt(sum((v - c) * (v - c))), 7) AS far FROM p JOIN m USING (label, k) GROUP BY label, vec_id)
SELECT label, arg_min(vec_id, (far, vec_id)) AS vec_id FROM d GROUP BY label""")
def _(spark, sf):
    p = tables.table(spark, sf, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("k", "v")).withColumn("v", F.col("v").cast("double"))
    m = p.groupBy("label", "k").agg(F.median("v").alias("c"))
    gap = F.col("v") - F.col("c")
    d = p.join(m, ["label", "k"]).groupBy("label", "vec_id").agg(F.round(F.sqrt(F.sum(gap * gap)), 7).alias("far"))
    return d.groupBy("label").agg(F.min_by("vec_id", F.struct("far", "vec_id")).alias("vec_id"))


def _weiszfeld_sql(rounds: int) -> str:
    steps = ["z0 AS (SELECT x, y, quantile_cont(blue, 0.5) AS a, quantile_cont(red, 0.5) AS b, quantile_cont(nir, 0.5) AS c FROM k GROUP BY x, y)"]
    for i in range(rounds):
        w = "1 / greatest(sqrt((blue - a) * (blue - a) + (red - b) * (red - b) + (nir - c) * (nir - c)), 1e-8)"
        steps.append(f"z{i + 1} AS (SELECT x, y, sum(w * blue) / sum(w) AS a, sum(w * red) / sum(w) AS b, sum(w * nir) / sum(w) AS c FROM (SELECT k.*, {w} AS w FROM k JOIN z{i} USING (x, y)) GROUP BY x, y)")
    return f"WITH {G}, k AS (SELECT * FROM h WHERE blue IS NOT NULL AND red IS NOT NULL AND nir IS NOT NULL), {', '.join(steps)} SELECT x, y, round(a, 4) AS blue, round(b, 4) AS red, round(c, 4) AS nir FROM z{rounds}"


@add("reduce_geomedian_5_rounds", _weiszfeld_sql(5))
def _(spark, sf):
    return by_cell(reducers.geomedian_fixed(_gaps(spark, sf), 5), 4)


@add("reduce_geomedian")
def _(spark, sf):
    return by_cell(reducers.geomedian(_gaps(spark, sf)), 5)


@add("reduce_geomedian_weiszfeld")
def _(spark, sf):
    return by_cell(reducers.geomedian(_gaps(spark, sf), weiszfeld=True), 5)


@add("reduce_geomedoid")
def _(spark, sf):
    return by_cell(reducers.geomedoid(_gaps(spark, sf)), 5)


@add("reduce_user_function", f"WITH {G}, u AS (SELECT * FROM h WHERE coalesce(blue, red, nir) IS NOT NULL) SELECT x, y, round(max(blue), 6) AS blue, round(max(red), 6) AS red, round(max(nir), 6) AS nir FROM u GROUP BY x, y")
def _(spark, sf):
    import numpy as np

    return by_cell(reducers.reduce_with(_gaps(spark, sf), lambda m: np.nanmax(m, axis=0)))


# ---------------------------------------------------------------- series


def _hampel_sql(k: int, t0: float, impute: bool = False) -> str:
    filtered = f"""WITH {M}, v AS (SELECT *, list(value) OVER w AS win FROM m WHERE value IS NOT NULL
  WINDOW w AS (PARTITION BY x, y ORDER BY t, item ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)),
c AS (SELECT *, list_sort(win)[{k + 1}] AS x0 FROM v),
s AS (SELECT *, 1.4826 * list_sort(list_transform(win, lambda q: abs(q - x0)))[{k + 1}] AS s FROM c),
f AS (SELECT item, t, x, y, CASE WHEN len(win) = {2 * k + 1} AND abs(value - x0) > {t0} * s THEN x0 ELSE value END AS value FROM s
  UNION ALL SELECT item, t, x, y, NULL FROM m WHERE value IS NULL)"""
    if not impute:
        return f"{filtered} SELECT item, round(value, 6) AS value FROM f"
    return f"{filtered} SELECT item, round(last_value(value IGNORE NULLS) OVER (PARTITION BY x, y ORDER BY t, item ROWS UNBOUNDED PRECEDING), 6) AS value FROM f"


def _hampel(name: str, k: int, t0: float, impute: bool) -> None:
    @add(name, _hampel_sql(k, t0, impute))
    def _(spark, sf):
        cube = series.hampel(bands.subset(masked(spark, sf), ["value"]), k, t0, impute)
        return rounded(cube.df.select("item", "value"))


_hampel("hampel_k1_t0", 1, 0.0, False)
_hampel("hampel_k1_t3", 1, 3.0, False)
_hampel("hampel_k2_t3", 2, 3.0, False)
_hampel("hampel_k3_t1", 3, 1.0, False)
_hampel("hampel_impute", 2, 3.0, True)


@add("locf", f"WITH {M} SELECT item, last_value(value IGNORE NULLS) OVER (PARTITION BY x, y ORDER BY t, item ROWS UNBOUNDED PRECEDING) AS value FROM m")
def _(spark, sf):
    return series.carry_forward(bands.subset(masked(spark, sf), ["value"])).df.select("item", "value")


@add("moving_mean", f"WITH {M} SELECT item, round(CASE WHEN count(*) OVER w = 5 THEN avg(value) OVER w END, 6) AS value FROM m WINDOW w AS (PARTITION BY x, y ORDER BY t, item ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def _(spark, sf):
    return rounded(series.moving_mean(bands.subset(masked(spark, sf), ["value"]), 5).df.select("item", "value"))


@add("series_user_function", f"WITH {M} SELECT item, round(value - avg(value) OVER (PARTITION BY x, y), 5) + 0.0 AS value FROM m")
def _(spark, sf):
    import numpy as np

    return rounded(series.apply_series(bands.subset(masked(spark, sf), ["value"]), lambda v: v - np.nanmean(v)).df.select("item", "value"), 5)


# ---------------------------------------------------------------- grids

BINS = {
    "average": "avg(value)", "rms": "sqrt(avg(value * value))", "max": "max(value)", "min": "min(value)", "sum": "sum(value)",
    "med": "quantile_cont(value, 0.5)", "q1": "quantile_cont(value, 0.25)", "q3": "quantile_cont(value, 0.75)",
}


def _coarse(name: str) -> None:
    @add(f"warp_{name}", f"WITH {GRID} SELECT x // 4 AS x, y // 4 AS y, round({BINS[name]}, 5) AS value FROM g GROUP BY 1, 2")
    def _(spark, sf):
        return by_cell(grids.coarsen(bands.subset(_image(spark, sf), ["value"]), 4, name).df.select("x", "y", "value"), 5)


for _name in BINS:
    _coarse(_name)


@add("warp_mode", f"WITH {E}, k AS (SELECT x // 4 AS x, y // 4 AS y, cls AS v, count(*) AS n FROM e GROUP BY 1, 2, 3) SELECT x, y, v::INTEGER AS cls FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY n DESC, v) AS rn FROM k) WHERE rn = 1")
def _(spark, sf):
    cube = tables.event_cube(spark, sf)
    cube = replace(bands.subset(cube, ["cls"]), df=cube.df.select(F.lit(1).alias("item"), F.lit(1).alias("t"), "x", "y", "cls"))
    return by_cell(grids.coarsen(cube, 4, "average").df.select("x", "y", "cls"))


CELLS = "z AS (SELECT i.i AS x, j.j AS y, (i.i + 0.5) * 1.7 AS cx, (j.j + 0.5) * 1.7 AS cy FROM range(8) i(i), range(5) j(j))"


@add("warp_near", f"WITH {GRID}, {CELLS} SELECT z.x, z.y, round(g.value, 6) AS value FROM z LEFT JOIN g ON g.x = floor(cx) AND g.y = floor(cy)")
def _(spark, sf):
    return by_cell(grids.warp(bands.subset(_image(spark, sf), ["value"]), 8, 5, 1.7, "near").df.select("x", "y", "value"))


def _kernel_sql(reach: int, weight: str) -> str:
    reach = -(-reach * 17 // 10)  # kernels widen with target cells of 1.7 source cells
    wx, wy = weight.replace("{d}", "((cx - 0.5 - sx) / 1.7)"), weight.replace("{d}", "((cy - 0.5 - sy) / 1.7)")
    return f"""WITH {GRID}, {CELLS}, n AS (SELECT z.*, floor(cx - 0.5) + i.i AS sx, floor(cy - 0.5) + j.j AS sy FROM z, range({1 - reach}, {reach + 1}) i(i), range({1 - reach}, {reach + 1}) j(j)),
w AS (SELECT n.x, n.y, ({wx}) * ({wy}) AS w, g.value AS v FROM n LEFT JOIN g ON g.x = sx AND g.y = sy)
SELECT x, y, round(sum(w * v) / nullif(sum(w) FILTER (WHERE v IS NOT NULL), 0), 5) AS value FROM w GROUP BY x, y"""


KERNEL_SQL = {
    "bilinear": (1, "greatest(0, 1 - abs({d}))"),
    "cubic": (2, "CASE WHEN abs({d}) <= 1 THEN 1.5 * abs({d}) ** 3 - 2.5 * {d} * {d} + 1 WHEN abs({d}) < 2 THEN -0.5 * abs({d}) ** 3 + 2.5 * {d} * {d} - 4 * abs({d}) + 2 ELSE 0 END"),
    "cubicspline": (2, "CASE WHEN abs({d}) <= 1 THEN 2.0 / 3 - {d} * {d} + abs({d}) ** 3 / 2 WHEN abs({d}) < 2 THEN (2 - abs({d})) ** 3 / 6 ELSE 0 END"),
    "lanczos": (3, "CASE WHEN {d} = 0 THEN 1 WHEN abs({d}) < 3 THEN sin(pi() * {d}) / (pi() * {d}) * sin(pi() * {d} / 3) / (pi() * {d} / 3) ELSE 0 END"),
}


def _kernel(name: str) -> None:
    @add(f"warp_{name}", _kernel_sql(*KERNEL_SQL[name]))
    def _(spark, sf):
        return by_cell(grids.warp(bands.subset(_image(spark, sf), ["value"]), 8, 5, 1.7, name).df.select("x", "y", "value"), 5)


for _name in KERNEL_SQL:
    _kernel(_name)



OVERLAP = f"""WITH {GRID}, o AS (SELECT tx.i AS x, ty.j AS y, (least(g.x + 1, (tx.i + 1) * 1.7) - greatest(g.x, tx.i * 1.7)) * (least(g.y + 1, (ty.j + 1) * 1.7) - greatest(g.y, ty.j * 1.7)) AS w, value AS v, qa
  FROM g, range(8) tx(i), range(5) ty(j) WHERE least(g.x + 1, (tx.i + 1) * 1.7) - greatest(g.x, tx.i * 1.7) > 1e-9 AND least(g.y + 1, (ty.j + 1) * 1.7) - greatest(g.y, ty.j * 1.7) > 1e-9)"""
OVERLAPS = {
    "average": "sum(v * w) / sum(w) FILTER (WHERE v IS NOT NULL)", "sum": "sum(v * w)", "rms": "sqrt(sum(v * v * w) / sum(w) FILTER (WHERE v IS NOT NULL))", "min": "min(v)", "max": "max(v)",
}


def _overlap(name: str) -> None:
    @add(f"warp_overlap_{name}", f"{OVERLAP} SELECT x, y, round({OVERLAPS[name]}, 5) AS value FROM o GROUP BY x, y")
    def _(spark, sf):
        return by_cell(grids.overlap(bands.subset(_image(spark, sf), ["value"]), 8, 5, 1.7, name).df.select("x", "y", "value"), 5)


for _name in OVERLAPS:
    _overlap(_name)


@add("warp_overlap_mode", f"{OVERLAP}, k AS (SELECT x, y, qa % 3 AS v, round(sum(w), 9) AS w FROM o GROUP BY 1, 2, 3) SELECT x, y, v AS cls FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY w DESC, v) AS rn FROM k) WHERE rn = 1")
def _(spark, sf):
    cube = _image(spark, sf).with_bands({"cls": F.col("qa") % 3}, mask_band="cls")
    return by_cell(grids.overlap(cube, 8, 5, 1.7, "mode").df.select("x", "y", "cls"))


@add("warp_whole_numbers_near", f"WITH {GRID}, {CELLS} SELECT z.x, z.y, g.qa FROM z LEFT JOIN g ON g.x = floor(cx) AND g.y = floor(cy)")
def _(spark, sf):
    return by_cell(grids.warp(bands.subset(_image(spark, sf), ["qa"]), 8, 5, 1.7, "bilinear").df.select("x", "y", "qa"))


BACK = "asin(sqrt(ex * ex + ny * ny) / (2 * 6371008.8)) * 2"


@add("warp_reproject", f"""WITH {GRID}, z AS (SELECT i.i AS x, j.j AS y, -350000 + (i.i + 0.5) * 100000.0 AS ex, 350000 - (j.j + 0.5) * 100000.0 AS ny FROM range(7) i(i), range(7) j(j)),
r AS (SELECT *, sqrt(ex * ex + ny * ny) AS rho, {BACK} AS c FROM z),
q AS (SELECT x, y, CASE WHEN rho = 0 THEN 45 ELSE degrees(asin(cos(c) * sin(radians(45)) + ny * sin(c) * cos(radians(45)) / rho)) END AS lat,
  10 + degrees(atan2(ex * sin(c), rho * cos(radians(45)) * cos(c) - ny * sin(radians(45)) * sin(c))) AS lon FROM r)
SELECT q.x, q.y, round(g.value, 6) AS value FROM q LEFT JOIN g ON g.x = floor(lon - 2.5) AND g.y = floor(50 - lat)""")
def _(spark, sf):
    source, target = GridSpec("EPSG:4326", 2.5, 40, 17.5, 50, 1, 1), GridSpec("laea", -350000, -350000, 350000, 350000, 100000, 100000)
    return by_cell(grids.reproject(bands.subset(_image(spark, sf), ["value"]), source, target, "laea", 10, 45).df.select("x", "y", "value"))

# ---------------------------------------------------------------- sets


@add("concat_collections", f"WITH {E} SELECT item, value FROM e WHERE cls < 2 UNION ALL SELECT item, value * 2 FROM e WHERE cls > 0")
def _(spark, sf):
    cube = bands.subset(tables.event_cube(spark, sf), ["value", "cls"])
    a = replace(cube, df=cube.df.filter("cls < 2"))
    b = replace(cube, df=cube.df.filter("cls > 0").withColumn("value", F.col("value") * 2))
    return sets.concat(a, b).df.select("item", "value")


@add("harmonize_union", f"WITH {E} SELECT item, value, qa, NULL::INTEGER AS cls FROM e WHERE cls < 2 UNION ALL SELECT item, value, NULL, cls FROM e WHERE cls >= 2")
def _(spark, sf):
    cube = tables.event_cube(spark, sf)
    a = bands.subset(replace(cube, df=cube.df.filter("cls < 2")), ["value", "qa"])
    b = bands.subset(replace(cube, df=cube.df.filter("cls >= 2")), ["value", "cls"])
    return sets.harmonize(a, b).df.select("item", "value", "qa", "cls")


@add("item_pick", f"WITH {E} SELECT item, value FROM e ORDER BY t, item LIMIT 1 OFFSET 6")
def _(spark, sf):
    return tables.event_cube(spark, sf).select_items(7).df.select("item", "value")


# ---------------------------------------------------------------- rendering


@add("stretch_percentile", f"""WITH {GRID}, q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.98) AS hi FROM g)
SELECT x, y, round(least(1.0, greatest(0.0, (value - lo) / (hi - lo))), 6) AS value FROM g, q""")
def _(spark, sf):
    return by_cell(rendering.stretch(_image(spark, sf).df.select("x", "y", "value"), ["value"]))


@add("stretch_min_max", f"WITH {GRID} SELECT x, y, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS value FROM g")
def _(spark, sf):
    return by_cell(rendering.min_max(_image(spark, sf).df.select("x", "y", "value"), ["value"]))


@add("stretch_limits", f"WITH {GRID} SELECT x, y, round(least(1.0, greatest(0.0, (value - 20) / 60)), 6) AS value FROM g")
def _(spark, sf):
    return by_cell(rendering.stretch(_image(spark, sf).df.select("x", "y", "value"), ["value"], limits={"value": (20, 80)}))


@add("tone_gamma", f"WITH {GRID} SELECT x, y, round(pow(value / 500, 1 / 1.3), 6) AS r, round(pow(value / 500, 1 / 1.1), 6) AS g, round(value / 500, 6) AS b FROM g")
def _(spark, sf):
    v = F.col("value") / 500
    df = _image(spark, sf).df.select("x", "y", v.alias("r"), v.alias("g"), v.alias("b"))
    return by_cell(rendering.gamma(df, ["r", "g", "b"]))


@add("histeq_band", f"WITH {E} SELECT item, round(cume_dist() OVER (ORDER BY qa), 9) AS qa FROM e")
def _(spark, sf):
    return rounded(rendering.equalize(tables.event_cube(spark, sf).df.select("item", "qa"), "qa"), 9)


@add("histeq_joint", f"WITH {E}, a AS (SELECT v, cume_dist() OVER (ORDER BY v) AS c FROM (SELECT qa AS v FROM e UNION ALL SELECT cls FROM e)), d AS (SELECT v, max(c) AS c FROM a GROUP BY v) SELECT item, round(p.c, 9) AS qa, round(q.c, 9) AS cls FROM e JOIN d p ON p.v = qa JOIN d q ON q.v = cls")
def _(spark, sf):
    return rounded(rendering.equalize_jointly(tables.event_cube(spark, sf).df.select("item", "qa", "cls"), ["qa", "cls"]), 9)


@add("legend_continuous", f"WITH {E} SELECT count(DISTINCT qa) AS n_values, min(qa) AS low, max(qa) AS high, quantile_cont(qa, 0.25) AS q1, quantile_cont(qa, 0.75) AS q3, count(DISTINCT qa) < 12 AS discrete FROM e")
def _(spark, sf):
    return rendering.legend(tables.event_cube(spark, sf).df, "qa")


@add("legend_discrete", f"WITH {E} SELECT cls, count(*) AS n FROM e GROUP BY cls")
def _(spark, sf):
    return rendering.legend_entries(tables.event_cube(spark, sf).df, "cls")


@add("colour_table", f"WITH {E} SELECT item, CASE cls WHEN 0 THEN '#112233ff' WHEN 3 THEN '#445566ff' ELSE '#00000000' END AS rgba FROM e")
def _(spark, sf):
    table = spark.createDataFrame([(0, "#112233ff"), (3, "#445566ff")], "value int, rgba string")
    return rendering.colours(tables.event_cube(spark, sf).df.select("item", "cls"), "cls", table, "#00000000").select("item", "rgba")


def _drawn(spark, sf):
    """The mean value of each cell; some lie on the border of two levels, where the last bit of a sum decides."""
    return composites.ordered_mean(tables.event_cube(spark, sf), ["value"])


_LEVEL = "lower(lpad(printf('%X', floor(least(1.0, greatest(0.0, ({} - 20) / 60)) * 255 + 0.5)::INTEGER), 2, '0'))"


@add("plot_grey", f"WITH {GRID} SELECT x, y, coalesce('#' || repeat({_LEVEL.format('value')}, 3) || 'ff', '#00000000') AS rgba FROM g")
def _(spark, sf):
    return rendering.rendered(_drawn(spark, sf), ["value"], limits={"value": (20, 80)}).select("x", "y", "rgba")


@add("plot_rgb", f"""WITH {GRID} SELECT x, y, coalesce('#' || {_LEVEL.format('value')} || {_LEVEL.format('(value / 2)')} || {_LEVEL.format('(100 - value)')} || 'ff', '#00000000') AS rgba FROM g""")
def _(spark, sf):
    v = F.col("value")
    df = _drawn(spark, sf).select("x", "y", v.alias("r"), (v / 2).alias("g"), (100 - v).alias("b"))
    return rendering.rendered(df, ["r", "g", "b"], limits=dict.fromkeys("rgb", (20, 80))).select("x", "y", "rgba")


@add("plot_flip", f"WITH {GRID} SELECT x, 9 - y AS y, round(value, 6) AS value FROM g")
def _(spark, sf):
    return by_cell(rendering.flipped(_image(spark, sf).df.select("x", "y", "value"), "y", 10))


# ---------------------------------------------------------------- sinks and tiles


@add("median_date", f"""WITH {E}, d AS (SELECT x, y, list_sort(list(DISTINCT epoch_us(t))) AS m FROM e GROUP BY x, y)
SELECT x, y, CASE WHEN len(m) = 1 THEN strftime(make_timestamp(m[1]), '%Y-%m-%dT%H:%M:%SZ') ELSE 'median date: ' || strftime(make_timestamp(floor(m[(len(m) - 1) // 2 + 1] / 2.0 + m[len(m) // 2 + 1] / 2.0)::BIGINT), '%Y-%m-%d') END AS date FROM d""")
def _(spark, sf):
    return tables.event_cube(spark, sf).df.groupBy("x", "y").agg(sinks.median_date(F.col("t")).alias("date"))


@add("output_file_names", f"""WITH {C}, s AS (SELECT pos, coalesce(strftime(datetime, '%Y-%m-%d_%H-%M-%S'), '') AS stem FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY pos) - 1 AS n FROM s)
SELECT pos, stem || CASE WHEN n > 0 THEN '_' || n ELSE '' END || '.tif' AS file FROM n""")
def _(spark, sf):
    items = tables.catalog(spark, sf).select(F.col("_pos").alias("pos"), F.col("datetime").cast("timestamp").alias("t"))
    return sinks.file_names(items, "t", by="pos").select("pos", "file")


@add("sink_nodata", f"WITH {M} SELECT item, coalesce(value, -9999.0) AS value FROM m")
def _(spark, sf):
    return sinks.to_nodata(bands.set_nodata(bands.subset(masked(spark, sf), ["value"]), -9999.0)).select("item", "value")


@add("source_read", "SELECT o_orderkey, o_orderstatus, 'orders.parquet' AS item FROM orders")
def _(spark, sf):
    return rasters.read(spark, f"{sf}/orders.parquet", ["o_orderstatus", "o_orderkey"])


@add("asset_need", f"WITH {C} SELECT DISTINCT 'B02' AS name FROM c")
def _(spark, sf):
    items = tables.catalog(spark, sf)
    catalog.need_assets(items, ["B02"])
    return items.select(F.explode(F.map_keys("assets")).alias("name")).filter("name = 'B02'").distinct()


@add("tile_index", "SELECT (i % 20) * 512 AS x_off, (i // 20) * 512 AS y_off, least(512, 10000 - (i % 20) * 512) AS x_size, least(512, 10000 - (i // 20) * 512) AS y_size, 1::BIGINT AS band FROM range(400) r(i)")
def _(spark, sf):
    return tiles.tile_table(spark, 10000, 10000, *tiles.tile_size(10000, 10000, 512, 512, 1000))


@add("tile_index_strips", "SELECT 0::BIGINT AS x_off, i * 512 AS y_off, 10000::BIGINT AS x_size, least(512, 10000 - i * 512) AS y_size, b + 1 AS band FROM range(20) r(i), range(2) s(b)")
def _(spark, sf):
    return tiles.tile_table(spark, 10000, 10000, *tiles.tile_size(10000, 10000, 285, 512, 20), bands=2)


@add("array_to_cells", "SELECT (i // 6 + 1)::INTEGER AS band, (i % 3)::INTEGER AS x, (i // 3 % 2)::INTEGER AS y, CASE WHEN i IN (2, 5) THEN 255.0 ELSE i + 1.0 END::DOUBLE AS value FROM range(12) r(i)")
def _(spark, sf):
    values = [None if i in (2, 5) else float(i + 1) for i in range(12)]
    return rasters.from_array(spark, values, 3, 2, pixel_type="Byte")[0]


@add("tiled_partition_mean", f"WITH {E} SELECT x // 5 AS tile_x, y // 5 AS tile_y, round(avg(value), 6) AS value FROM e GROUP BY 1, 2")
def _(spark, sf):
    df = tiles.with_tiles(tables.event_cube(spark, sf).df, "x", "y", 5)
    return rounded(df.groupBy("tile_x", "tile_y").agg(F.avg("value").alias("value")))

