"""Joining collections end to end."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from ..errors import LengthMismatch, TypeMismatch, need
from ..model import Cube


def concat(*cubes: Cube) -> Cube:
    """All observations of all cubes, bands by place, repeated items kept; aligned only if all are."""
    need(len(cubes) > 0 and all(isinstance(c, Cube) for c in cubes), TypeMismatch, "cubes are needed")
    first = cubes[0]
    need(all(len(c.bands) == len(first.bands) for c in cubes), LengthMismatch, "the cubes differ in the number of bands")
    df = reduce(lambda a, b: a.union(b), (c.df.select(*c.keys, *c.bands) for c in cubes))
    return replace(first, df=df, aligned=all(c.aligned for c in cubes) and len({c.grid for c in cubes}) == 1)


def harmonize(*cubes: Cube) -> Cube:
    """All observations, bands by name; a band that a cube lacks is missing there."""
    need(len(cubes) > 0, TypeMismatch, "cubes are needed")
    names = list(dict.fromkeys(b for c in cubes for b in c.bands))
    same = [c.df.select(*(F.col(k).alias(n) for k, n in zip(c.keys, cubes[0].keys, strict=True)), *c.bands) for c in cubes]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), same)
    meta = {b: next(c.of(b) for c in cubes if b in c.bands) for b in names}
    return replace(cubes[0], df=df.select(*cubes[0].keys, *names), bands=tuple(names), meta=meta, aligned=all(c.aligned for c in cubes))


def in_order(cube: Cube):
    """Rows by time, missing times last, then item and cell."""
    return cube.df.orderBy(F.asc_nulls_last(cube.time), cube.item, *cube.cell)
