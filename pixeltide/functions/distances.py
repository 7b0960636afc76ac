"""Distances between an observation and a centre, as sums of built-in expressions over the bands.

``a`` and ``c`` are equally long lists of columns; a NULL term (a band that does not
take part) adds nothing.  Divisions and logarithms outside their domain add nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def _sum(terms: Sequence[Column]) -> Column:
    """Sum of the terms that are present; NULL if none is."""
    some = F.coalesce(*terms)
    return F.when(some.isNotNull(), reduce(lambda x, y: x + y, (F.coalesce(t, F.lit(0.0)) for t in terms)))


def _over(terms: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    return lambda a, c: _sum([terms(x, y) for x, y in zip(a, c, strict=True)])


def _ln(v: Column) -> Column:
    return F.ln(F.when(v > 0, v))


def _root(v: Column) -> Column:
    return F.sqrt(F.when(v >= 0, v))


def _gap(x: Column, y: Column) -> Column:
    return F.abs(x - y)


def _ratio(top: Callable[[Column, Column], Column], bottom: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    return lambda a, c: F.try_divide(_over(top)(a, c), _over(bottom)(a, c))


def minkowski(a, c, p: float = 2.0) -> Column:
    return F.pow(_sum([F.pow(_gap(x, y), F.lit(float(p))) for x, y in zip(a, c, strict=True)]), F.lit(1.0 / p))


def cosine(a, c) -> Column:
    dot = _sum([x * y for x, y in zip(a, c, strict=True)])
    both = [F.when(y.isNotNull(), x) for x, y in zip(a, c, strict=True)]
    return F.try_divide(dot, F.sqrt(_sum([x * x for x in both])) * F.sqrt(_sum([y * y for y in c])))


def gower(a, c) -> Column:
    n = reduce(lambda x, y: x + y, (F.when((x - y).isNotNull(), 1).otherwise(0) for x, y in zip(a, c, strict=True)))
    return F.try_divide(_over(_gap)(a, c), n)


def _fold(pick) -> Callable[..., Column]:
    return lambda a, c: pick(*(_gap(x, y) for x, y in zip(a, c, strict=True))) if len(a) > 1 else _gap(a[0], c[0])


#: Distances by name.
DISTANCES: dict[str, Callable[..., Column]] = {
    "euclidean": lambda a, c: F.sqrt(_over(lambda x, y: (x - y) * (x - y))(a, c)),
    "manhattan": _over(_gap),
    "minimum": _fold(F.least),
    "maximum": _fold(F.greatest),
    "minkowski": minkowski,
    "bhattacharyya": lambda a, c: -_ln(_over(lambda x, y: _root(x * y))(a, c)),
    "hellinger": lambda a, c: F.sqrt(_over(lambda x, y: F.pow(_root(x) - _root(y), F.lit(2.0)))(a, c)) / F.sqrt(F.lit(2.0)),
    "kullback_leibler": _over(lambda x, y: (x - y) * _ln(F.try_divide(x, y))),
    "jensen_shannon": _over(lambda x, y: x * _ln(F.try_divide(2 * x, x + y)) + y * _ln(F.try_divide(2 * y, x + y))),
    "chi_square": _over(lambda x, y: F.try_divide((x - y) * (x - y), x + y)),
    "canberra": _over(lambda x, y: F.try_divide(_gap(x, y), x + y)),
    "cosine": cosine,
    "wave_hedges": _over(lambda x, y: F.try_divide(_gap(x, y), F.when((x - y).isNotNull(), F.greatest(x, y)))),
    "motyka": _ratio(lambda x, y: F.when((x - y).isNotNull(), F.least(x, y)), lambda x, y: x + y),
    "harmonic_mean": lambda a, c: 2 * _over(lambda x, y: F.try_divide(x * y, x + y))(a, c),
    "jeffries_matusita": lambda a, c: _root(2 - 2 * _over(lambda x, y: _root(x * y))(a, c)),
    "gower": gower,
    "kulczynski": _ratio(_gap, lambda x, y: F.when((x - y).isNotNull(), F.least(x, y))),
    "itakura_saito": _over(lambda x, y: F.try_divide(x, y) - _ln(F.try_divide(x, y)) - 1),
    "soergel": _ratio(_gap, lambda x, y: F.when((x - y).isNotNull(), F.greatest(x, y))),
    "sorensen": _ratio(_gap, lambda x, y: x + y),
}
