"""Reading observations: tables of cells, arrays in memory, headers.

Sentinel values become NULL here, once; NaN does too.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LengthMismatch, OutOfRange, need, need_bands
from ..model import BandMeta, Cube, GridSpec, default_nodata


def present(df: DataFrame, band: str, nodata: float | None = None) -> Column:
    """The band with NULL for the sentinel and, in floating-point bands, for NaN; whole numbers keep their type."""
    value = F.col(band)
    kind = df.schema[band].dataType
    if kind.typeName() in ("float", "double"):
        value = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return (value if nodata is None else F.nullif(value, F.lit(nodata).cast(kind))).alias(band)


def from_table(
    df: DataFrame, bands, item="item", time="t", cell=("x", "y"), nodata: dict | float | None = None, grid: GridSpec | None = None,
    mask_band: str | None = None, aligned: bool = True,
) -> Cube:
    """A cube over a table; only the named columns are read."""
    need_bands(df.columns, [item, time, *cell, *bands])
    sentinel = {b: (nodata.get(b) if isinstance(nodata, dict) else nodata) for b in bands}
    kept = [F.col(b) if b == mask_band else present(df, b, sentinel[b]) for b in bands]
    meta = {b: BandMeta(nodata=sentinel[b]) for b in bands}
    return Cube(df.select(item, time, *cell, *kept), tuple(bands), item, time, tuple(cell), meta, grid, mask_band, aligned)


def read(spark: SparkSession, paths, bands=None, fmt: str = "parquet", **options) -> DataFrame:
    """Files of cells as one table; ``item`` is the file's name where the table has none.

    ``bands`` keeps these columns, in the order of the file, so the scan reads no others.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.format(fmt).options(**options).load(paths)
    if bands is not None:
        need_bands(df.columns, bands)
        fixed = [c for c in df.columns if c in ("item", "t", "x", "y")]
        df = df.select(*fixed, *[c for c in df.columns if c in set(bands)])
    return df if "item" in df.columns else df.withColumn("item", F.col("_metadata.file_name"))


def from_array(
    spark: SparkSession, values, xsize: int | None = None, ysize: int | None = None, box=None, srs: str = "", pixel_type: str = "Float32",
    nodata: float | None = None, nbands: int | None = None,
) -> tuple[DataFrame, GridSpec]:
    """(band, x, y, value) rows of an array in memory, and its grid.

    A flat sequence needs ``xsize`` and ``ysize``.  Of nested sequences the first
    axis is x, the second y, a third the bands.  Missing bands up to ``nbands`` are
    NULL.  NULL values take the pixel type's default nodata unless one is given.
    """
    def depth(v) -> int:
        return 1 + depth(v[0]) if isinstance(v, (list, tuple)) and v else 0

    axes = depth(values)
    if axes == 1:
        need(xsize is not None and ysize is not None, LengthMismatch, "a flat sequence needs xsize and ysize")
        flat = list(values)
        need(len(flat) % (xsize * ysize) == 0, LengthMismatch, "the values do not fill whole bands")
        bands = len(flat) // (xsize * ysize)
    elif axes in (2, 3):
        xsize, ysize = len(values), len(values[0])
        bands = 1 if axes == 2 else len(values[0][0])
        flat = [
            (values[x][y] if axes == 2 else values[x][y][b]) for b in range(bands) for y in range(ysize) for x in range(xsize)
        ]
    else:
        raise LengthMismatch("not an array of one to three axes")
    total = max(bands, nbands or bands)
    flat = [None if v is None else float(v) for v in flat] + [None] * ((total - bands) * xsize * ysize)
    fill = nodata if nodata is not None else default_nodata(pixel_type)
    grid = GridSpec(srs, *(box or (0.0, 0.0, float(xsize), float(ysize))), 1, 1)
    x0, y0, x1, y1 = grid.xmin, grid.ymin, grid.xmax, grid.ymax
    grid = GridSpec(srs, x0, y0, x1, y1, (x1 - x0) / xsize, (y1 - y0) / ysize)
    df = spark.createDataFrame([(flat,)], "v array<double>").select(F.posexplode("v").alias("pos", "value"))
    size = xsize * ysize
    value = F.col("value") if fill is None else F.coalesce("value", F.lit(float(fill)))
    return df.select(
        (F.floor(F.col("pos") / size) + 1).cast("int").alias("band"),
        (F.col("pos") % xsize).cast("int").alias("x"),
        (F.floor(F.col("pos") / xsize) % ysize).cast("int").alias("y"),
        value.alias("value"),
    ), grid


def header(text: Column) -> Column:
    """A ``k=v,k=v`` string as a map."""
    return F.expr(f"str_to_map({text}, ',', '=')") if isinstance(text, str) else F.str_to_map(text, F.lit(","), F.lit("="))


def system_of(df: DataFrame, x: str = "x") -> str | None:
    """The reference system that a sink noted with the cells' place; None where it noted none."""
    return df.schema[x].metadata.get("srs")


def box_of(df: DataFrame, x: str, y: str, extend: float = 0.0) -> DataFrame:
    """Extent of point columns as one row, optionally extended."""
    need(extend >= 0, OutOfRange, "extend must not be negative")
    return df.agg(
        (F.min(x) - extend).alias("xmin"), (F.min(y) - extend).alias("ymin"), (F.max(x) + extend).alias("xmax"), (F.max(y) + extend).alias("ymax")
    )


def summary(items: DataFrame, box: Iterable[str] = ("xmin", "ymin", "xmax", "ymax")) -> DataFrame:
    """What a collection of items is: count, union box, finest cell, reference systems, aligned or not."""
    x0, y0, x1, y1 = box
    geometry = F.struct("srs", x0, y0, x1, y1, "xres", "yres")
    return items.agg(
        F.count("*").alias("n_items"),
        F.min(x0).alias("xmin"), F.min(y0).alias("ymin"), F.max(x1).alias("xmax"), F.max(y1).alias("ymax"),
        F.min("xres").alias("xres"), F.min("yres").alias("yres"),
        F.array_sort(F.collect_set("srs")).alias("srs"),
        (F.count_distinct(geometry) == 1).alias("aligned"),
    )
