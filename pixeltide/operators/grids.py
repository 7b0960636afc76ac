"""Regridding: binning to coarser cells, and interpolation from neighbours.

Coordinates of source cells are column and row numbers of the source grid; a target
grid is given by its own cells in source units, so everything is arithmetic and
equi-joins on integers.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NotAligned, OutOfRange, need
from ..functions import pixel
from ..functions.geometry import INVERSE
from ..model import Cube, GridSpec

#: Resampling by aggregation: what a target cell makes of the source cells in it.
BINNED: dict[str, Callable[[Column], Column]] = {
    "average": F.avg, "rms": lambda v: F.sqrt(F.avg(v * v)), "mode": pixel.mode, "max": F.max, "min": F.min, "sum": F.sum,
    "med": F.median, "q1": lambda v: F.percentile(v, F.lit(0.25)), "q3": lambda v: F.percentile(v, F.lit(0.75)),
}


def _cubic(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a <= 1, 1.5 * a * a * a - 2.5 * a * a + 1).when(a < 2, -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2).otherwise(0.0)


def _spline(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a <= 1, 2.0 / 3 - a * a + a * a * a / 2).when(a < 2, (2 - a) * (2 - a) * (2 - a) / 6).otherwise(0.0)


def _sinc(d: Column) -> Column:
    x = d * math.pi
    return F.when(d == 0, F.lit(1.0)).otherwise(F.sin(x) / F.nullif(x, F.lit(0.0)))


#: Interpolation kernels: reach in cells, and weight at a distance along one axis.
KERNELS: dict[str, tuple[int, Callable[[Column], Column]]] = {
    "bilinear": (1, lambda d: F.greatest(F.lit(0.0), 1 - F.abs(d))),
    "cubic": (2, _cubic),
    "cubicspline": (2, _spline),
    "lanczos": (3, lambda d: F.when(F.abs(d) < 3, _sinc(d) * _sinc(d / 3)).otherwise(0.0)),
}


def to_cells(df: DataFrame, grid: GridSpec, x: str, y: str) -> DataFrame:
    """Adds column and row numbers of map coordinates on a grid."""
    return df.withColumns({"col": grid.col(F.col(x)), "row": grid.row(F.col(y))})


def coarsen(cube: Cube, factor: int, method: str | dict[str, str] = "average", origin: tuple[int, int] = (0, 0)) -> Cube:
    """Target cells of ``factor`` by ``factor`` source cells, per item; one method, or one per band.

    Cells nest, so overlap weights are all one.  Partial aggregates combine before
    the one exchange, on item and target cell.
    """
    need(factor >= 1, OutOfRange, "the factor is at least 1")
    x, y = cube.cell
    how = {b: method if isinstance(method, str) else method.get(b, "average") for b in cube.bands}
    need(set(how.values()) <= set(BINNED), OutOfRange, f"unknown method in {sorted(set(how.values()))}")
    if cube.mask_band in how:  # classes are not averaged
        how[cube.mask_band] = "mode"
    binned = cube.df.withColumns({x: F.floor((F.col(x) - origin[0]) / factor), y: F.floor((F.col(y) - origin[1]) / factor)})
    df = binned.groupBy(*cube.keys).agg(*(BINNED[how[b]](F.col(b)).alias(b) for b in cube.bands))
    return replace(cube, df=df, aligned=True)


def overlap(cube: Cube, nx: int, ny: int, step: float, method: str = "average", x0: float = 0.0, y0: float = 0.0) -> Cube:
    """Target cells of any size, from the source cells that they overlap, weighted by the part of a source cell inside.

    average, sum, rms and mode weigh; min and max take all cells that overlap.  A source
    cell goes to the few target cells that it meets, so partial aggregates combine before
    the one exchange.
    """
    need(nx >= 1 and ny >= 1 and step > 0, OutOfRange, "the target grid is empty")
    need(method in WEIGHTED, OutOfRange, f"unknown method {method}")
    x, y = cube.cell
    parts = cube.df
    for name, low, n in ((x, x0, nx), (y, y0, ny)):
        first, last = F.floor((F.col(name) - low) / step), F.ceil((F.col(name) + 1 - low) / step) - 1
        parts = parts.withColumn(f"_{name}", F.explode(F.sequence(first, last))).filter(F.col(f"_{name}").between(0, n - 1))
        start = low + F.col(f"_{name}") * step
        parts = parts.withColumn(f"_w_{name}", F.least(F.col(name) + 1, start + step) - F.greatest(F.col(name), start))
    weight = F.col(f"_w_{x}") * F.col(f"_w_{y}")
    keys = [F.col(cube.item), F.col(cube.time), F.col(f"_{x}").alias(x), F.col(f"_{y}").alias(y)]
    parts = parts.filter(weight > 1e-12).select(*keys, weight.alias("_w"), *cube.bands)
    if method == "mode":
        df = parts.select(*cube.keys).distinct()
        for b in cube.bands:
            summed = parts.filter(F.col(b).isNotNull()).groupBy(*cube.keys, b).agg(F.sum("_w").alias("_w"))
            best = summed.groupBy(*cube.keys).agg(F.max_by(b, F.struct(F.round("_w", 9), -F.col(b))).alias(b))
            df = df.join(best, cube.keys, "left")
        return replace(cube, df=df.select(*cube.keys, *cube.bands), aligned=True)
    df = parts.groupBy(*cube.keys).agg(*(WEIGHTED[method](F.col(b), F.col("_w")).alias(b) for b in cube.bands))
    return replace(cube, df=df, aligned=True)


def _weighted_mean(v: Column, w: Column) -> Column:
    return F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))


#: Resampling by overlap: value and weight of the source cells.
WEIGHTED: dict[str, Callable[[Column, Column], Column] | None] = {
    "average": _weighted_mean, "sum": lambda v, w: F.sum(v * w), "rms": lambda v, w: F.sqrt(_weighted_mean(v * v, w)),
    "min": lambda v, w: F.min(v), "max": lambda v, w: F.max(v), "mode": None,
}


def targets(cube: Cube, nx: int, ny: int, step: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Every item with every cell of a target grid, and the cell's centre in source units.

    The grid is generated where it is needed, from a sequence for each item.
    """
    items = cube.df.select(cube.item, cube.time).distinct()
    cells = items.withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    return cells.withColumns({"_cx": F.lit(x0) + (F.col("_x") + 0.5) * step, "_cy": F.lit(y0) + (F.col("_y") + 0.5) * step})


def warp(cube: Cube, nx: int, ny: int, step: float, method: str = "bilinear", x0: float = 0.0, y0: float = 0.0) -> Cube:
    """Values on a target grid of nx by ny cells of ``step`` source cells, from (x0, y0) in source units.

    ``near`` joins the source cell under the target's centre; the kernels join their
    neighbours and weigh the present ones.  Where target cells are larger than source
    cells the kernels widen with them.  Bands of whole numbers are always ``near``.
    Cells without any value come out NULL.
    """
    need(nx >= 1 and ny >= 1 and step > 0, OutOfRange, "the target grid is empty")
    return resample(cube, targets(cube, nx, ny, step, x0, y0), method, max(1.0, step))


def reproject(cube: Cube, source: GridSpec, target: GridSpec, kind: str, lon0: float, lat0: float, method: str = "near") -> Cube:
    """Values of a longitude-latitude grid on a grid of a projection (laea or aeqd around a centre).

    Each target cell's centre goes back to longitude and latitude, and from there to
    source cells.
    """
    need(kind in INVERSE, OutOfRange, f"a projection is one of {sorted(INVERSE)}")
    cells = targets(cube, target.nx, target.ny, 1.0)
    east = target.xmin + (F.col("_x") + 0.5) * target.xres
    north = target.ymax - (F.col("_y") + 0.5) * target.yres
    lon, lat = INVERSE[kind](east, north, lon0, lat0)
    placed = cells.withColumns({"_cx": (lon - source.xmin) / source.xres, "_cy": (source.ymax - lat) / source.yres})
    return replace(resample(cube, placed, method), grid=target)


def resample(cube: Cube, target: DataFrame, method: str, widen: float = 1.0) -> Cube:
    """Values at places (``_cx``, ``_cy``) in source units of target cells (``_x``, ``_y``) of each item."""
    x, y = cube.cell
    source = cube.df.select(cube.item, cube.time, F.col(x).cast("long").alias("_sx"), F.col(y).cast("long").alias("_sy"), *cube.bands)
    on = [cube.item, cube.time, "_sx", "_sy"]
    if method == "near":
        near = target.withColumns({"_sx": F.floor("_cx"), "_sy": F.floor("_cy")})
        df = near.join(source, on, "left").select(cube.item, cube.time, F.col("_x").alias(x), F.col("_y").alias(y), *cube.bands)
        return replace(cube, df=df, aligned=True)
    need(method in KERNELS, OutOfRange, f"unknown method {method}")
    reach, weight = KERNELS[method]
    reach = math.ceil(reach * widen)
    steps = F.sequence(F.lit(1 - reach), F.lit(reach))
    around = target.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).withColumns(
        {"_sx": F.floor(F.col("_cx") - 0.5) + F.col("_i"), "_sy": F.floor(F.col("_cy") - 0.5) + F.col("_j")}
    )
    w = weight((F.col("_cx") - 0.5 - F.col("_sx")) / widen) * weight((F.col("_cy") - 0.5 - F.col("_sy")) / widen)
    found = around.withColumn("_w", w).join(source, on, "left")
    under = (F.col("_sx") == F.floor("_cx")) & (F.col("_sy") == F.floor("_cy"))
    whole = {b for b in cube.bands if cube.df.schema[b].dataType.typeName() in ("byte", "short", "integer", "long")}
    mean = {b: F.max(F.when(under, F.col(b))) if b in whole else _weighted_mean(F.col(b), F.col("_w")) for b in cube.bands}
    df = found.groupBy(cube.item, cube.time, "_x", "_y").agg(*(v.alias(b) for b, v in mean.items()))
    df = df.select(cube.item, cube.time, F.col("_x").alias(x), F.col("_y").alias(y), *cube.bands)
    return replace(cube, df=df, aligned=True)


def snapped_extent(df: DataFrame, res: float, box=("xmin", "ymin", "xmax", "ymax")) -> DataFrame:
    """Extents moved outwards to multiples of the cell size."""
    need(res > 0, OutOfRange, "the cell size must be positive")
    x0, y0, x1, y1 = box
    down, up = (lambda c: F.floor(F.col(c) / res) * res), (lambda c: F.ceil(F.col(c) / res) * res)
    return df.withColumns({x0: down(x0), y0: down(y0), x1: up(x1), y1: up(y1)})


def need_one_system(df: DataFrame, srs: str = "srs") -> None:
    """Raises if items are in more than one reference system."""
    need(df.select(srs).distinct().limit(2).count() == 1, NotAligned, "items are in several reference systems")


def shrink_for_display(cube: Cube, xsize: int, ysize: int, most: int = 25_000_000) -> Cube:
    """Nearest-cell sampling to at most ``most`` cells."""
    if xsize * ysize <= most:
        return cube
    step = math.sqrt(xsize * ysize / most)
    return warp(cube, max(1, int(xsize / step)), max(1, int(ysize / step)), step, "near")
