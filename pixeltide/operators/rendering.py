"""Statistics that a renderer needs: stretches, tone curves, legends, colour tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import OutOfRange, need

# Exponents of the tone curve for red, green and blue.
GAMMA = (1.3, 1.1, 1.0)
#: From this number of distinct values a legend is continuous.
DISCRETE = 12


def clean(v: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    """Infinities become missing; scale and offset apply."""
    v = F.nanvl(v.cast("double"), F.lit(None).cast("double"))
    return F.when(F.abs(v) != float("inf"), v) * scale + offset


def _ranked(counts: DataFrame, value: str, parts: int = 200) -> DataFrame:
    """(value, n) rows with the number of values up to each (``_upto``) and of all (``_all``).

    Values fall into at most ``parts`` ranges between approximate quantiles; running
    sums are taken within a range, and the ranges' totals, a table of ``parts`` rows,
    give what lies before it.  So no task sees all values.
    """
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    edges = counts.agg(F.percentile_approx(F.col(value).cast("double"), shares, F.lit(10_000)).alias("_edges"))
    placed = counts.join(F.broadcast(edges))  # one row of fixed size
    placed = placed.withColumn("_part", F.size(F.filter(F.array_distinct("_edges"), lambda e: e < F.col(value)))).drop("_edges")
    totals = placed.groupBy("_part").agg(F.sum("n").alias("_n"))
    one = Window.partitionBy(F.lit(1))
    before = totals.select(
        "_part", (F.sum("_n").over(one.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"), F.sum("_n").over(one).alias("_all")
    )
    running = F.sum("n").over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_run", running).join(F.broadcast(before), "_part").select(value, "n", (F.col("_run") + F.col("_before")).alias("_upto"), "_all")


def _quantiles(df: DataFrame, band: str, shares: dict[str, float]) -> DataFrame:
    """One row with exact, linearly interpolated quantiles of a band, by name, and the number of its distinct values."""
    counts = df.filter(F.col(band).isNotNull()).groupBy(F.col(band).cast("double").alias("_v")).agg(F.count("*").alias("n"))
    ranked = _ranked(counts, "_v")
    out = []
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("_all") - 1)
        low, high = (F.min(F.when(F.col("_upto") >= at + 1, F.col("_v"))) for at in (F.floor(place), F.ceil(place)))
        part = F.first(place - F.floor(place))
        out.append((low + (high - low) * part).alias(name))
    return ranked.agg(*out, F.count("*").alias("_distinct"))


def stretch(df: DataFrame, bands, low: float = 0.01, high: float = 0.98, limits: dict | None = None) -> DataFrame:
    """Each band from 0 to 1 between two of its quantiles (or given limits), clamped.

    The limits are one row of fixed size, so broadcasting them is bounded.
    """
    need(0 <= low < high <= 1, OutOfRange, "quantiles out of order")
    joined, ends = df, {}
    for b in bands:
        if limits is not None:
            ends[b] = (F.lit(float(limits[b][0])), F.lit(float(limits[b][1])))
        else:
            joined = joined.join(F.broadcast(_quantiles(df, b, {f"_lo_{b}": low, f"_hi_{b}": high}).drop("_distinct")))
            ends[b] = (F.col(f"_lo_{b}"), F.col(f"_hi_{b}"))
    out = {}
    for b, (lo, hi) in ends.items():
        share = F.try_divide(F.col(b) - lo, hi - lo)
        out[b] = F.when(share.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))
    return joined.select(*(out[c].alias(c) if c in out else F.col(c) for c in df.columns))


def min_max(df: DataFrame, bands) -> DataFrame:
    row = df.agg(*(F.min(b).alias(f"_lo_{b}") for b in bands), *(F.max(b).alias(f"_hi_{b}") for b in bands))
    joined = df.join(F.broadcast(row))  # one row of fixed size
    out = {b: F.try_divide(F.col(b) - F.col(f"_lo_{b}"), F.col(f"_hi_{b}") - F.col(f"_lo_{b}")) for b in bands}
    return joined.select(*(out[c].alias(c) if c in out else F.col(c) for c in df.columns))


def gamma(df: DataFrame, bands, exponents=GAMMA) -> DataFrame:
    return df.withColumns({b: F.pow(F.col(b), F.lit(1.0 / g)) for b, g in zip(bands, exponents, strict=True)})


def _ecdf(counts: DataFrame, value: str) -> DataFrame:
    """Empirical distribution at each distinct value of (value, n) rows."""
    return _ranked(counts, value).select(value, (F.col("_upto") / F.col("_all")).alias("ecdf"))


def equalize(df: DataFrame, band: str) -> DataFrame:
    """Value replaced by its empirical distribution.

    Distinct values are counted before the ordered pass, so that pass sees each value once.
    """
    counts = df.filter(F.col(band).isNotNull()).groupBy(band).agg(F.count("*").alias("n"))
    table = _ecdf(counts, band).select(F.col(band).alias("_v"), "ecdf")
    joined = df.join(table, F.col(band) == F.col("_v"), "left")
    return joined.select(*(F.col("ecdf").alias(c) if c == band else F.col(c) for c in df.columns))


def equalize_jointly(df: DataFrame, bands) -> DataFrame:
    """One distribution over the values of all bands."""
    long = df.select(F.explode(F.array(*bands)).alias("_v")).filter("_v is not null")
    table = _ecdf(long.groupBy("_v").agg(F.count("*").alias("n")), "_v")
    out = df
    for b in bands:
        t = table.select(F.col("_v").alias(f"_v_{b}"), F.col("ecdf").alias(f"_e_{b}"))
        out = out.join(t, F.col(b) == F.col(f"_v_{b}"), "left")
    return out.select(*(F.col(f"_e_{c}").alias(c) if c in bands else F.col(c) for c in df.columns))


def legend(df: DataFrame, value: str) -> DataFrame:
    """One row: distinct values, extremes, quartiles, and whether the legend is discrete."""
    ends = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    found = _quantiles(df, value, {"q1": 0.25, "q3": 0.75}).withColumnRenamed("_distinct", "n_values")
    # two tables of one row
    return found.join(F.broadcast(ends)).select("n_values", "low", "high", "q1", "q3", (F.col("n_values") < DISCRETE).alias("discrete"))


def legend_entries(df: DataFrame, value: str) -> DataFrame:
    """Values of a discrete legend with their counts."""
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).orderBy(value)


def label_digits(values) -> int:
    """Decimals that tell neighbouring labels apart: as many as the smallest step between them needs."""
    finite = sorted({float(v) for v in values if v is not None and math.isfinite(v)})
    if all(v.is_integer() for v in finite):
        return 0
    # a single label shows three figures
    step = min((b - a for a, b in zip(finite, finite[1:], strict=False)), default=abs(finite[0]) / 100)
    return min(15, max(0, math.ceil(-math.log10(step))))


def colours(df: DataFrame, value: str, table: DataFrame, missing: str) -> DataFrame:
    """Adds ``rgba`` from a colour table (value, rgba).

    The planner broadcasts the table when its size allows and joins by exchange otherwise.
    """
    t = table.select(F.col("value").alias("_key"), F.col("rgba").alias("_rgba"))
    joined = df.join(t, F.col(value) == F.col("_key"), "left")
    return joined.select(*df.columns, F.coalesce("_rgba", F.lit(missing)).alias("rgba"))


def rendered(df: DataFrame, bands, low: float = 0.01, high: float = 0.98, limits: dict | None = None, missing: str = "#00000000") -> DataFrame:
    """Adds ``rgba``: one band in greys, three as red, green and blue, stretched like ``stretch``.

    A cell that lacks a band is ``missing``.  Drawing itself is left to the caller: after
    ``grids.shrink_for_display`` the table has a bounded number of rows.
    """
    need(len(bands) in (1, 3), OutOfRange, "one band or three")
    shown = [f"_c{i}" for i in range(len(bands))]
    levels = stretch(
        df.withColumns({s: F.col(b).cast("double") for s, b in zip(shown, bands, strict=True)}), shown, low, high,
        None if limits is None else {s: limits[b] for s, b in zip(shown, bands, strict=True)},
    )
    pairs = [F.lpad(F.hex(F.floor(F.col(s) * 255 + 0.5).cast("long")), 2, "0") for s in shown]
    text = F.lower(F.concat(F.lit("#"), *(pairs * (3 // len(bands))), F.lit("ff")))
    return levels.select(*df.columns, F.coalesce(text, F.lit(missing)).alias("rgba"))


def flipped(df: DataFrame, y: str, ny: int) -> DataFrame:
    """South-up rows turned north-up."""
    return df.withColumn(y, F.lit(ny - 1) - F.col(y))
