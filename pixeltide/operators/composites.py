"""Composites: one value per cell and band out of a time series."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import OutOfRange, TypeMismatch, need
from ..functions import pixel
from ..model import Cube
from .bands import _chosen


def composite(cube: Cube, function: str | Callable = "median", bands=None, **options) -> DataFrame:
    """(x, y, band...) with each band aggregated over time.

    All rows take part and invalid values are NULL, so a cell without a valid value
    stays, as NULL.  One hash exchange on the cell; partial aggregates where the
    function has them.
    """
    cube.need_aligned()
    if isinstance(function, str):
        need(function in pixel.AGGREGATES, OutOfRange, f"unknown pixel function {function}")
        function = pixel.AGGREGATES[function]
    return cube.df.groupBy(*cube.cell).agg(*(function(F.col(b), **options).alias(b) for b in _chosen(cube, bands)))


def ordered_mean(cube: Cube, bands=None) -> DataFrame:
    """The mean over time with values added in order of the items, so it is the same to the last bit however rows are dealt.

    One exchange and sort on the cell, without partial aggregates; running means need no more than a row at a time.
    """
    cube.need_aligned()
    means, order = {}, {}
    for b in _chosen(cube, bands):
        # rows of one item, if it has several, by their values
        place = F.struct(F.col(cube.item), F.col(b))
        upto = Window.partitionBy(*cube.cell).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        means[f"_m_{b}"], order[b] = F.avg(b).over(upto), place
    return cube.df.withColumns(means).groupBy(*cube.cell).agg(*(F.max_by(f"_m_{b}", place).alias(b) for b, place in order.items()))


def quantiles(cube: Cube, probabilities, bands=None) -> DataFrame:
    """Several quantiles of each band in one pass: columns ``band_q25`` and so on."""
    out = []
    for b in _chosen(cube, bands):
        out += [F.percentile(b, F.lit(float(p))).alias(f"{b}_q{round(p * 100):02d}") for p in probabilities]
    return cube.df.groupBy(*cube.cell).agg(*out)


def mosaic(cube: Cube, first: bool = False) -> DataFrame:
    """The latest (or earliest) valid value of each band: a stack without a pixel function."""
    cube.need_aligned()
    pick = pixel.first_valid if first else pixel.last_valid
    return cube.df.groupBy(*cube.cell).agg(*(pick(F.col(b), F.col(cube.time), F.col(cube.item)).alias(b) for b in cube.bands))


def arg_extreme(cube: Cube, band: str, index: str, largest: bool = True) -> DataFrame:
    """The integer column ``index`` of the row with the extreme value."""
    pick = pixel.argmax if largest else pixel.argmin
    return cube.df.groupBy(*cube.cell).agg(pick(F.col(band), F.col(index)).alias(index))


def interpolated(cube: Cube, t0: float, dt: float, t: float, bands=None, how: str = "linear") -> DataFrame:
    """Each band at ``t``, the items in order of time standing for t0, t0 + dt, ..."""
    need(dt != 0, OutOfRange, "dt must not be 0")
    out = []
    for b in _chosen(cube, bands):
        ordered = F.array_sort(F.collect_list(F.struct(F.col(cube.time), F.col(cube.item), F.col(b).alias("v"))))
        out.append(pixel.interpolate(F.transform(ordered, lambda e: e["v"]), t0, dt, t, how).alias(b))
    return cube.df.groupBy(*cube.cell).agg(*out)


def apply_rowwise(cube: Cube, function: str, bands=None, **options) -> Cube:
    """A row-wise pixel function on each chosen band."""
    need(function in pixel.ROWWISE, OutOfRange, f"unknown pixel function {function}")
    chosen = _chosen(cube, bands)
    if function == "scale" and not options:
        from .bands import apply_scale

        return apply_scale(cube, chosen)
    return cube.with_bands({b: pixel.ROWWISE[function](F.col(b), **options) if b in chosen else F.col(b) for b in cube.bands})


def composite_with(cube: Cube, function: Callable[[pd.Series], float], bands=None) -> DataFrame:
    """A user's Series-to-number function as an Arrow grouped aggregate; a cell's values must fit in memory."""
    need(callable(function), TypeMismatch, "not a function")

    @F.pandas_udf("double")
    def run(v: pd.Series) -> float:
        return function(v)

    return cube.df.groupBy(*cube.cell).agg(*(run(F.col(b)).alias(b) for b in _chosen(cube, bands)))
