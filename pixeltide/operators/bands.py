"""Band structure and annotations: rename, move, add, scale, nodata, derived bands."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BandMissing, LengthMismatch, OutOfRange, need, need_bands
from ..model import BandMeta, Cube


def _chosen(cube: Cube, bands) -> tuple[str, ...]:
    if bands is None:
        return cube.bands
    chosen = tuple(cube.bands[b - 1] if isinstance(b, int) else b for b in ([bands] if isinstance(bands, (str, int)) else bands))
    need_bands(cube.bands, chosen)
    return chosen


def _each(values, bands: tuple[str, ...], all_bands: tuple[str, ...]) -> dict[str, float]:
    """One value for every chosen band: a number, one per chosen band, or one per band of the cube."""
    if isinstance(values, (int, float)) or values is None:
        return dict.fromkeys(bands, values)
    values = list(values)
    if len(values) == len(bands):
        return dict(zip(bands, values, strict=True))
    need(len(values) == len(all_bands), LengthMismatch, "give one value, one per chosen band, or one per band")
    return {b: v for b, v in zip(all_bands, values, strict=True) if b in bands}


def rename(cube: Cube, names) -> Cube:
    """New names for all bands, in order."""
    need(len(names) == len(cube.bands), LengthMismatch, "one name for each band is needed")
    new = dict(zip(names, cube.bands, strict=True))
    mask = dict(zip(cube.bands, names, strict=True)).get(cube.mask_band)
    return cube.with_bands({n: F.col(o) for n, o in new.items()}, {n: cube.of(o) for n, o in new.items()}, mask_band=mask)


def move(cube: Cube, band: int, after: int) -> Cube:
    """Moves a band (1-based) behind the band that is now at ``after``; 0 puts it first."""
    n = len(cube.bands)
    need(1 <= band <= n, OutOfRange, "no such band")
    need(0 <= after <= n, OutOfRange, "no such place")
    need(band != after, OutOfRange, "a band cannot follow itself")
    order = [b for b in cube.bands if b != cube.bands[band - 1]]
    at = 0 if after == 0 else order.index(cube.bands[after - 1]) + 1
    order.insert(at, cube.bands[band - 1])
    return cube.with_bands({b: F.col(b) for b in order})


def add_empty(cube: Cube, after: int, name: str, scale: float | None = None) -> Cube:
    """Adds a band without any value behind the band at ``after``; its scale is the first band's by default."""
    need(0 <= after <= len(cube.bands), OutOfRange, "no such place")
    need(name not in cube.bands, LengthMismatch, "the band name is taken")
    order = list(cube.bands)
    order.insert(after, name)
    first = cube.of(cube.bands[0])
    meta = {b: cube.of(b) for b in cube.bands} | {name: BandMeta(scale=first.scale if scale is None else scale, nodata=first.nodata)}
    return cube.with_bands({b: F.lit(None).cast("double") if b == name else F.col(b) for b in order}, meta)


def set_scale(cube: Cube, scale, offset=0.0, bands=None) -> Cube:
    """Annotates scale and offset; values stay as they are."""
    chosen = _chosen(cube, bands)
    scales, offsets = _each(scale, chosen, cube.bands), _each(offset, chosen, cube.bands)
    meta = {b: replace(cube.of(b), scale=scales[b], offset=offsets[b]) if b in chosen else cube.of(b) for b in cube.bands}
    return replace(cube, meta=meta)


def drop_scale(cube: Cube) -> Cube:
    return set_scale(cube, 1.0, 0.0)


def set_nodata(cube: Cube, nodatavalue, nodata=None, bands=None) -> Cube:
    """Band nodata (what a sink writes for NULL) and source nodata (what becomes NULL now)."""
    chosen = _chosen(cube, bands)
    out = _each(nodatavalue, chosen, cube.bands)
    source = out if nodata is None else _each(nodata, chosen, cube.bands)
    meta = {b: replace(cube.of(b), nodata=out[b]) if b in chosen else cube.of(b) for b in cube.bands}
    columns = {b: F.nullif(F.col(b), F.lit(source[b])) if b in chosen and source[b] is not None else F.col(b) for b in cube.bands}
    return cube.with_bands(columns, meta)


def drop_nodata(cube: Cube) -> Cube:
    return replace(cube, meta={b: replace(cube.of(b), nodata=None) for b in cube.bands})


def set_descriptions(cube: Cube, texts) -> Cube:
    """A description for each band; a sink writes it as field metadata."""
    need(len(texts) == len(cube.bands), LengthMismatch, "one description per band")
    return replace(cube, meta={b: replace(cube.of(b), description=t) for b, t in zip(cube.bands, texts, strict=True)})


def set_notes(cube: Cube, **notes: str | None) -> Cube:
    """Named notes about the whole cube, kept in its plan; None takes a note away."""
    return replace(cube, notes={k: v for k, v in (cube.notes | notes).items() if v is not None})


def scaled(cube: Cube, band: str) -> Column:
    """The band's value after its own scale and offset."""
    m = cube.of(band)
    value = F.col(band)
    value = value if m.scale == 1.0 else value * F.lit(m.scale)
    return value if m.offset == 0.0 else value + F.lit(m.offset)


def apply_scale(cube: Cube, bands=None) -> Cube:
    chosen = _chosen(cube, bands)
    columns = {b: scaled(cube, b) if b in chosen else F.col(b) for b in cube.bands}
    return cube.with_bands(columns, {b: replace(cube.of(b), scale=1.0, offset=0.0) if b in chosen else cube.of(b) for b in cube.bands})


def subset(cube: Cube, bands) -> Cube:
    """Only these bands, in the order of the cube."""
    chosen = set(_chosen(cube, bands))
    return cube.with_bands({b: F.col(b) for b in cube.bands if b in chosen})


def collapse(cube: Cube, name: str = "values") -> Cube:
    """All bands as one array band."""
    return cube.with_bands({name: F.array(*cube.bands)}, {})


_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
# Functions that a formula may use.
FUNCTIONS = "abs sqrt exp ln log log10 log2 pow power least greatest sin cos tan floor ceil round min max if when case then else end and or not null".split()


def derive(cube: Cube, **formulas: str) -> Cube:
    """Replaces the bands by formulas over them; each band enters with its own scale and offset.

    Division by zero gives a missing value.  Names are taken from the parsed text,
    so a band name inside another is no trap.
    """
    columns = {}
    for name, text in formulas.items():
        used = {w for w in _NAME.findall(text) if w.lower() not in FUNCTIONS}
        need(bool(used & set(cube.bands)), BandMissing, f"{name}: no band in {text!r}")
        need_bands(cube.bands, sorted(used))
        replaced = _NAME.sub(lambda m: m[0] if m[0] not in used else _scaled_text(cube, m[0]), text)
        columns[name] = F.expr(f"cast({_safe_division(replaced)} as double)")
    return cube.with_bands(columns, {n: BandMeta() for n in columns})


def _scaled_text(cube: Cube, band: str) -> str:
    m = cube.of(band)
    if m.scale == 1.0 and m.offset == 0.0:
        return f"`{band}`"
    return f"(`{band}` * {m.scale!r}D + {m.offset!r}D)"


def _safe_division(text: str) -> str:
    """Wraps every divisor so that zero becomes NULL instead of an error."""
    out, i = [], 0
    while i < len(text):
        if text[i] != "/":
            out.append(text[i])
            i += 1
            continue
        i += 1
        while i < len(text) and text[i] == " ":
            i += 1
        start, depth = i, 0
        while i < len(text):
            c = text[i]
            if c == "(":
                depth += 1
            elif c == ")":
                if depth == 0:
                    break
                depth -= 1
            elif depth == 0 and c in "+-*/,<>= " and i > start:
                break
            i += 1
        out.append(f"/ nullif({_safe_division(text[start:i])}, 0)")
    return "".join(out)


# Formulas of the usual spectral indices, by generic band names.
INDICES = {
    "ndvi": "(nir - red) / (nir + red)",
    "ndti": "(red - green) / (red + green)",
    "evi": "2.5 * (nir - red) / (nir + 6.0 * red - 7.5 * blue + 1.0)",
    "evi2": "2.5 * (nir - red) / (nir + 2.4 * red + 1.0)",
    "vgnirbi": "(green - nir) / (green + nir)",
}


def index_formula(name: str, **bands: str) -> str:
    """Formula of an index with the cube's band names put in (``nir="B08"``)."""
    return _NAME.sub(lambda m: bands.get(m[0], m[0]), INDICES[name])
