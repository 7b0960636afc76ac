"""The cube: a lazy table of observations with the little that the driver knows about it.

Rows are observations ``(item, t, x, y, band...)``: one column per band, NULL for a
missing value.  What a raster file keeps in its header (nodata, scale, offset, unit
of the mask, grid) is a small immutable description next to the DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import LengthMismatch, NotAligned, OutOfRange, TypeMismatch, need, need_bands

#: Pixel types by name, their default nodata value and the column type that holds them.
PIXEL_TYPES = {
    "Byte": (255, T.ShortType()),
    "Int8": (-128, T.ByteType()),
    "UInt16": (65535, T.IntegerType()),
    "Int16": (-32768, T.ShortType()),
    "UInt32": (4294967295, T.LongType()),
    "Int32": (-2147483648, T.IntegerType()),
    "Float32": (None, T.FloatType()),
    "Float64": (None, T.DoubleType()),
    "CInt16": (-32768, T.StructType().add("re", "double").add("im", "double")),
    "CInt32": (-2147483648, T.StructType().add("re", "double").add("im", "double")),
    "CFloat32": (None, T.StructType().add("re", "double").add("im", "double")),
    "CFloat64": (None, T.StructType().add("re", "double").add("im", "double")),
}


def default_nodata(pixel_type: str):
    """Default nodata value of a pixel type; 0 for an unknown one, None where NaN stands for it."""
    return PIXEL_TYPES.get(pixel_type, (0, None))[0]


@dataclass(frozen=True)
class BandMeta:
    """Annotations of one band: they change no value until an operator applies them."""

    scale: float = 1.0
    offset: float = 0.0
    nodata: float | None = None
    pixel_type: str = "Float64"
    description: str | None = None


@dataclass(frozen=True)
class GridSpec:
    """A north-up grid: reference system, extent and cell size."""

    srs: str
    xmin: float
    ymin: float
    xmax: float
    ymax: float
    xres: float
    yres: float

    def __post_init__(self):
        need(self.xmin < self.xmax and self.ymin < self.ymax, OutOfRange, "the extent is empty")
        need(self.xres > 0 and self.yres > 0, OutOfRange, "cell sizes must be positive")

    @property
    def nx(self) -> int:
        return round((self.xmax - self.xmin) / self.xres)

    @property
    def ny(self) -> int:
        return round((self.ymax - self.ymin) / self.yres)

    @property
    def geotransform(self) -> tuple[float, ...]:
        return (self.xmin, (self.xmax - self.xmin) / self.nx, 0.0, self.ymax, 0.0, -(self.ymax - self.ymin) / self.ny)

    def col(self, x: Column) -> Column:
        return F.floor((x - self.xmin) / self.xres).cast("long")

    def row(self, y: Column) -> Column:
        return F.floor((F.lit(self.ymax) - y) / self.yres).cast("long")

    def snapped(self) -> GridSpec:
        """Extent moved outwards to multiples of the cell size (target-aligned pixels)."""
        from math import ceil, floor

        def out(v, r, f):
            return f(v / r) * r

        return replace(
            self, xmin=out(self.xmin, self.xres, floor), ymin=out(self.ymin, self.yres, floor),
            xmax=out(self.xmax, self.xres, ceil), ymax=out(self.ymax, self.yres, ceil),
        )


@dataclass(frozen=True)
class Cube:
    """A time series of images as one table."""

    df: DataFrame
    bands: tuple[str, ...]
    item: str = "item"
    time: str = "t"
    cell: tuple[str, str] = ("x", "y")
    meta: dict[str, BandMeta] = field(default_factory=dict)
    grid: GridSpec | None = None
    mask_band: str | None = None
    aligned: bool = True
    notes: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        need(isinstance(self.df, DataFrame), TypeMismatch, "df must be a DataFrame")
        need_bands(self.df.columns, [self.item, self.time, *self.cell, *self.bands])
        need(len(set(self.bands)) == len(self.bands), LengthMismatch, "band names repeat")

    @property
    def keys(self) -> list[str]:
        return [self.item, self.time, *self.cell]

    def of(self, band: str) -> BandMeta:
        return self.meta.get(band, BandMeta())

    def with_bands(self, columns: dict[str, Column], meta: dict[str, BandMeta] | None = None, **changes) -> Cube:
        """The same observations with other bands."""
        df = self.df.select(*self.keys, *(c.alias(n) for n, c in columns.items()))
        kept = {n: self.of(n) for n in columns if n in self.bands} if meta is None else meta
        return replace(self, df=df, bands=tuple(columns), meta=kept, **changes)

    def need_aligned(self) -> None:
        need(self.aligned, NotAligned, "items must share one grid first: warp the cube")

    def stack(self) -> Cube:
        """A stack is the same rows; it promises one reference system, so cells are comparable."""
        self.need_aligned()
        return self

    def select_items(self, number: int) -> Cube:
        """Observations of the n-th item in order of time (1-based)."""
        need(number >= 1, OutOfRange, "items are numbered from 1")
        order = self.df.select(self.item, self.time).distinct().groupBy(self.item).agg(F.min(self.time).alias("_t"))
        chosen = order.orderBy(F.asc_nulls_last("_t"), self.item).offset(number - 1).limit(1).select(self.item)
        return replace(self, df=self.df.join(chosen, self.item, "left_semi"))

    def describe(self) -> str:
        """A summary for people, without running anything."""
        grid = f"{self.grid.nx} x {self.grid.ny} cells, {self.grid.srs}" if self.grid else "no grid"
        lines = [f"cube of {len(self.bands)} bands ({grid}{'' if self.aligned else ', not aligned'})"]
        for b in self.bands:
            m = self.of(b)
            lines.append(f"  {b}: nodata {m.nodata}, scale {m.scale:g}, offset {m.offset:g}")
        return "\n".join(lines)
