"""Time-series filters that keep every row: Hampel, carry forward, moving mean, user functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import OutOfRange, TypeMismatch, need
from ..model import Cube
from .bands import _chosen

# Fixed value: turns a median absolute deviation into a standard deviation.
MAD = 1.4826


def _order(cube: Cube) -> list[Column]:
    return [F.asc_nulls_last(cube.time), F.asc(cube.item)]


def hampel(cube: Cube, k: int = 1, t0: float = 3.0, impute: bool = False, bands=None) -> Cube:
    """Replaces outliers by the median of the 2k+1 valid values around them.

    The series is its valid values in order of time; the k first and last stay.  A
    value goes if it lies more than t0 scaled median deviations off; windows always
    hold original values.  ``impute`` then carries values forward into gaps.

    Missing values sort behind the valid ones of their cell.  Rows are dealt by cell
    once, which serves the windows of all bands and of the imputation.
    """
    need(isinstance(k, int) and k >= 1, OutOfRange, "k is a whole number from 1")
    need(t0 >= 0, OutOfRange, "t0 must not be negative")
    need(isinstance(impute, bool), TypeMismatch, "impute is true or false")
    chosen = _chosen(cube, bands)
    df = cube.df.repartition(*cube.cell)
    for b in chosen:
        spec = Window.partitionBy(*cube.cell, F.col(b).isNull()).orderBy(*_order(cube))
        df = df.withColumn("_w", F.array_sort(F.collect_list(b).over(spec.rowsBetween(-k, k))))
        df = df.withColumn("_x0", F.get("_w", F.lit(k)))
        spread = F.get(F.array_sort(F.transform("_w", lambda v: F.abs(v - F.col("_x0")))), F.lit(k)) * MAD
        replaced = F.when(
            F.col(b).isNotNull() & (F.size("_w") == 2 * k + 1) & (F.abs(F.col(b) - F.col("_x0")) > t0 * spread), F.col("_x0")
        ).otherwise(F.col(b))
        df = df.withColumn("_v", replaced).drop(b, "_w", "_x0").withColumnRenamed("_v", b)
    out = replace(cube, df=df.select(*cube.keys, *cube.bands))
    return carry_forward(out, chosen) if impute else out


def carry_forward(cube: Cube, bands=None) -> Cube:
    """A gap takes the last valid value before it; gaps at the start stay."""
    chosen = _chosen(cube, bands)
    spec = Window.partitionBy(*cube.cell).orderBy(*_order(cube)).rowsBetween(Window.unboundedPreceding, 0)
    return cube.with_bands({b: F.last(b, True).over(spec) if b in chosen else F.col(b) for b in cube.bands})


def moving_mean(cube: Cube, width: int = 5, bands=None) -> Cube:
    """Centred mean of ``width`` rows, gaps skipped; missing where the window leaves the series."""
    need(width >= 1 and width % 2 == 1, OutOfRange, "the width is odd")
    chosen = _chosen(cube, bands)
    half = width // 2
    spec = Window.partitionBy(*cube.cell).orderBy(*_order(cube)).rowsBetween(-half, half)
    whole = F.count("*").over(spec) == width
    return cube.with_bands({b: F.when(whole, F.avg(b).over(spec)) if b in chosen else F.col(b) for b in cube.bands})


def apply_series(cube: Cube, function: Callable[[np.ndarray], np.ndarray], bands=None) -> Cube:
    """A user's function on each cell's series of each band (same length in and out), as a grouped Arrow map."""
    need(callable(function), TypeMismatch, "not a function")
    chosen = _chosen(cube, bands)
    place = F.row_number().over(Window.partitionBy(*cube.cell).orderBy(*_order(cube)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k").drop(columns="_k")
        for b in chosen:
            out = np.asarray(function(pdf[b].to_numpy(float)), float)
            if len(out) != len(pdf):
                raise ValueError("the function must keep the length of the series")
            pdf[b] = out
        return pdf

    schema = T.StructType(
        [cube.df.schema[c] for c in cube.keys] + [T.StructField(b, T.DoubleType() if b in chosen else cube.df.schema[b].dataType) for b in cube.bands]
    )
    df = cube.df.select(*cube.keys, *cube.bands, place.alias("_k")).groupBy(*cube.cell).applyInPandas(run, schema)
    clean = [F.nanvl(b, F.lit(None).cast("double")).alias(b) if b in chosen else F.col(b) for b in cube.bands]
    return replace(cube, df=df.select(*cube.keys, *clean))
