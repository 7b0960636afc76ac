"""Masking: a mask band decides which observations of the other bands are valid."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..errors import BandMissing, OutOfRange, TypeMismatch, need, need_bands
from ..model import BandMeta, Cube


def int_mask(band: Column, invalid) -> Column:
    """1 where the value is not among ``invalid``, else 0."""
    return F.when(band.isin(list(invalid)), 0).otherwise(1)


def bit_mask(band: Column, bits) -> Column:
    """0 where any of the bit positions is set, else 1."""
    wanted = sum(1 << b for b in set(bits))
    return F.when(band.cast("long").bitwiseAND(F.lit(wanted).cast("long")) != 0, 0).otherwise(1)


def bit_mask_by_remainder(band: Column, bits) -> Column:
    """The same by remainders: bit b is set where the value modulo 2**(b+1) reaches 2**b."""
    any_set = F.lit(False)
    for b in bits:
        any_set = any_set | (F.pmod(band.cast("long"), F.lit(1 << (b + 1)).cast("long")) >= (1 << b))
    return F.when(any_set, 0).otherwise(1)


def dilated(cube: Cube, bad: Column, size: int, name: str = "_bad") -> Cube:
    """Adds ``name``: ``bad`` grown by ``size`` cells in all eight directions, over the whole image.

    A square is the maximum along x of the maximum along y, so two range windows do
    it; each is partitioned by item and one axis, never by item alone.
    """
    x, y = cube.cell
    df = cube.df.withColumn(name, bad.cast("int"))
    for across, along in ((y, x), (x, y)):
        near = Window.partitionBy(cube.item, across).orderBy(along).rangeBetween(-size, size)
        df = df.withColumn(name, F.max(name).over(near))
    return replace(cube, df=df)


def set_mask(
    cube: Cube, mask_band: str, values, build: Callable[[Column, list], Column] = int_mask, buffer: int = 0, drop_mask: bool = True,
) -> Cube:
    """Nulls every data band where the mask band is invalid, or within ``buffer`` cells of such a cell.

    A cell without a mask value counts as valid unless NULL is what the builder rejects.
    """
    need_bands(cube.bands, [mask_band])
    need(buffer >= 0, OutOfRange, "the buffer must not be negative")
    valid = F.coalesce(build(F.col(mask_band), list(values)), F.lit(1)) > 0
    data = [b for b in cube.bands if b != mask_band]
    need(bool(data), BandMissing, "no band is left to mask")
    if buffer:
        cube = dilated(cube, ~valid, buffer)
        valid = F.col("_bad") == 0
    out = replace(cube, mask_band=None if drop_mask else mask_band)
    columns = {b: F.when(valid, F.col(b)) for b in data}
    if not drop_mask:
        columns = {b: columns.get(b, F.col(b)) for b in cube.bands}
    return out.with_bands(columns)


def apply_mask_table(cube: Cube, mask, valid: str = "valid") -> Cube:
    """Masks by a separate table of (item, x, y, valid); cells that it lacks are valid."""
    on = [cube.item, *cube.cell]
    joined = replace(cube, df=cube.df.join(mask.select(*on, F.col(valid).alias("_valid")), on, "left"))
    return joined.with_bands({b: F.when(F.coalesce("_valid", F.lit(True)), F.col(b)) for b in cube.bands})


class MaskFunction:
    """A mask computed from several bands: a function of Series, with its bands in order and the new band's name."""

    def __init__(self, function: Callable[..., pd.Series], required: tuple[str, ...], name: str, description: str = ""):
        need(callable(function), TypeMismatch, "not a function")
        self.function, self.required, self.name, self.description = function, tuple(required), name, description


def create_mask(cube: Cube, function: MaskFunction, **inbands: str) -> Cube:
    """Adds the band ``function.name``; ``inbands`` says which band is which of the required ones."""
    missing = [r for r in function.required if r not in inbands]
    need(not missing, BandMissing, f"no band is given for {missing}")
    need_bands(cube.bands, inbands.values())
    run = function.function
    in_arrow = F.pandas_udf(lambda *s: run(*s).astype("float64"), "double")
    value = in_arrow(*(F.col(inbands[r]) for r in function.required))
    columns = {b: F.col(b) for b in cube.bands} | {function.name: value}
    meta = {b: cube.of(b) for b in cube.bands} | {function.name: BandMeta()}
    return cube.with_bands(columns, meta, mask_band=function.name)


def brightness_mask(bright: float = 0.3, name: str = "cloud") -> MaskFunction:
    """A documented stand-in for a learned cloud model: 1 (cloud) where red, green and near infrared are all bright."""

    def run(red: pd.Series, green: pd.Series, nir: pd.Series) -> pd.Series:
        return ((red > bright) & (green > bright) & (nir > bright)).astype(float)

    return MaskFunction(run, ("red", "green", "nir"), name, "bright in red, green and near infrared")


def window(cube: Cube, xmin=None, xmax=None, ymin=None, ymax=None) -> Cube:
    """Cells inside a range of coordinates; the predicates reach the scan."""
    df = cube.df
    for name, low, high in ((cube.cell[0], xmin, xmax), (cube.cell[1], ymin, ymax)):
        if low is not None:
            df = df.filter(F.col(name) >= low)
        if high is not None:
            df = df.filter(F.col(name) <= high)
    return replace(cube, df=df)
