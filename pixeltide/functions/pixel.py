"""Pixel functions: named aggregates over time and named row-wise functions.

An aggregate takes a Column and gives the Column that aggregates it; missing values
are skipped and a cell without any valid value gives NULL.  Everything but user code
is a built-in expression, so map-side combining and code generation apply.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import OutOfRange, need

Aggregate = Callable[..., Column]


def median(v: Column) -> Column:
    return F.median(v)


def mean(v: Column) -> Column:
    return F.avg(v)


def geometric_mean(v: Column) -> Column:
    """Of the positive values only."""
    return F.exp(F.avg(F.when(v > 0, F.ln(v))))


def quantile(v: Column, q: float = 0.5) -> Column:
    """Linear interpolation between order statistics."""
    need(0 <= q <= 1, OutOfRange, "a quantile is between 0 and 1")
    return F.percentile(v, F.lit(float(q)))


def mean_db(v: Column) -> Column:
    """Mean of intensities, in decibels."""
    m = F.avg(v)
    return F.when(m > 0, 10 * F.log10(m))


def minimum(v: Column, propagate: bool = False) -> Column:
    """``propagate``: one missing value makes the result missing."""
    return F.when(F.count("*") == F.count(v), F.min(v)) if propagate else F.min(v)


def maximum(v: Column, propagate: bool = False) -> Column:
    return F.when(F.count("*") == F.count(v), F.max(v)) if propagate else F.max(v)


def total(v: Column) -> Column:
    return F.sum(v)


def product(v: Column) -> Column:
    """By magnitudes and signs, so that partial results combine."""
    negative = F.sum(F.when(v < 0, 1).otherwise(0)) % 2
    size = F.exp(F.sum(F.ln(F.nullif(F.abs(v), F.lit(0.0)))))
    zero = F.max(F.when(v == 0, 1).otherwise(0)) == 1
    return F.when(F.count(v) > 0, F.when(zero, F.lit(0.0)).otherwise(F.when(negative == 1, -size).otherwise(size)))


def harmonic_mean(v: Column) -> Column:
    """Zero as soon as one value is, whose reciprocal has no bound."""
    zero = F.max(F.when(v == 0, 1).otherwise(0)) == 1
    return F.when(zero, F.lit(0.0)).otherwise(F.try_divide(F.count(v).cast("double"), F.sum(1 / F.nullif(v, F.lit(0.0)))))


def mode(v: Column) -> Column:
    """The most frequent value, the smallest of equally frequent ones."""
    return F.mode(v, True)


def count_valid(v: Column) -> Column:
    return F.count(v)


def last_valid(v: Column, t: Column, tie: Column) -> Column:
    """The latest valid value (images laid over each other in order of time)."""
    return F.max_by(v, F.when(v.isNotNull(), F.struct(t, tie)))


def first_valid(v: Column, t: Column, tie: Column) -> Column:
    return F.min_by(v, F.when(v.isNotNull(), F.struct(t, tie)))


def argmax(v: Column, index: Column) -> Column:
    """Index of the largest value, the first of equal ones."""
    return F.max_by(index, F.when(v.isNotNull(), F.struct(v, -index)))


def argmin(v: Column, index: Column) -> Column:
    return F.min_by(index, F.when(v.isNotNull(), F.struct(v, index)))


#: Aggregates over time, by name.
AGGREGATES: dict[str, Aggregate] = {
    "median": median, "mean": mean, "geometric_mean": geometric_mean, "quantile": quantile, "mean_db": mean_db, "min": minimum,
    "max": maximum, "sum": total, "mul": product, "harmonic_mean": harmonic_mean, "mode": mode, "count": count_valid,
}


def register(name: str, function: Aggregate) -> None:
    """Adds a user's aggregate under a name of its own; later composites find it there."""
    need(callable(function) and name not in AGGREGATES, OutOfRange, f"{name} is taken, or not a function is given")
    AGGREGATES[name] = function


def interpolate(values: Column, t0: float, dt: float, t: float, how: str = "linear") -> Column:
    """Value at ``t`` of an array of values at t0, t0 + dt, ...; beyond the ends the nearest segment goes on."""
    n = F.size(values)
    at = (t - t0) / dt
    i = F.greatest(F.lit(0), F.least(F.lit(int(at // 1)), n - 2))
    a, b, w = F.get(values, i), F.get(values, i + 1), F.lit(float(at)) - i
    if how == "linear":
        return F.when(n > 1, a + (b - a) * w).otherwise(F.get(values, F.lit(0)))
    need(how == "exp", OutOfRange, "linear or exp")
    return F.when((n > 1) & (a > 0) & (b > 0), a * F.pow(b / a, w))


def _power_of_ten(v: Column, divisor: float) -> Column:
    return F.pow(F.lit(10.0), v / divisor)


#: Row-wise functions of one band, by name; out of their domain the result is missing.
ROWWISE: dict[str, Callable[..., Column]] = {
    "sqrt": lambda v: F.when(v >= 0, F.sqrt(v)),
    "log10": lambda v: F.when(v > 0, F.log10(v)),
    "dB": lambda v, fact=20.0: F.when(v > 0, fact * F.log10(v)),
    "exp": lambda v, base=2.718281828459045, fact=1.0: F.pow(F.lit(float(base)), v * fact),
    "pow": lambda v, power=1.0: F.pow(v, F.lit(float(power))),
    "inv": lambda v, k=1.0: F.try_divide(F.lit(float(k)), v),
    "dB2amp": lambda v: _power_of_ten(v, 20.0),
    "dB2pow": lambda v: _power_of_ten(v, 10.0),
    "intensity": lambda v: v * v,
    "scale": lambda v, scale=1.0, offset=0.0: v * scale + offset,
    "replace_nodata": lambda v, to=0.0: F.coalesce(v, F.lit(float(to))),
    "mod": lambda v: F.abs(v),
    "real": lambda v: v,
    "imag": lambda v: F.when(v.isNotNull(), F.lit(0.0)),
    "conj": lambda v: v,
    "phase": lambda v: F.when(v < 0, F.lit(3.141592653589793)).when(v >= 0, F.lit(0.0)),
}


def polynomial(v: Column, coefficients) -> Column:
    """a0 + a1 v + a2 v**2 + ..., by Horner's rule."""
    out = F.lit(0.0)
    for a in reversed(list(coefficients)):
        out = out * v + float(a)
    return out


def reclassify(v: Column, mapping: dict, default: float | None = None) -> Column:
    """New values for old ones; a key may be a number or a (low, high) range, low included."""
    out = None
    for key, to in mapping.items():
        hit = (v >= key[0]) & (v < key[1]) if isinstance(key, tuple) else v == key
        out = F.when(hit, F.lit(to)) if out is None else out.when(hit, F.lit(to))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


#: Functions of two bands, by name.
PAIRWISE: dict[str, Callable[[Column, Column], Column]] = {
    "diff": lambda a, b: a - b,
    "div": F.try_divide,
    "norm_diff": lambda a, b: F.try_divide(a - b, a + b),
    "complex": lambda a, b: F.struct(a.alias("re"), b.alias("im")),
}
