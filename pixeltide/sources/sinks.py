"""Writing cubes and composites: NULL becomes nodata here, once; headers travel as field metadata."""

from __future__ import annotations

import json
import warnings
from dataclasses import asdict, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import OutOfRange, need
from ..model import BandMeta, Cube, GridSpec
from .folders import Folder

FORMATS = ("parquet", "orc", "csv", "json")


def to_nodata(cube: Cube) -> DataFrame:
    """Rows as they are stored: NULL replaced by each band's own nodata value."""
    out = []
    for b in cube.bands:
        m = cube.of(b)
        value = F.col(b) if m.nodata is None else F.coalesce(F.col(b), F.lit(float(m.nodata)))
        out.append(value.alias(b, metadata={k: v for k, v in asdict(m).items() if v is not None}))
    srs = {"srs": cube.grid.srs} if cube.grid else {}
    place = [F.col(c).alias(c, metadata=srs) for c in cube.cell]
    return cube.df.select(cube.item, cube.time, *place, *out)


def write(cube: Cube, path: str, fmt: str = "parquet", mode: str = "error", by_item: bool = False, tile: int | None = None, **options) -> None:
    """Writes the cube, one folder per item or per tile if wanted; every task writes its own files."""
    need(fmt in FORMATS, OutOfRange, f"not a format: {fmt}")
    df = to_nodata(cube)
    parts = []
    if tile:
        from ..operators.tiles import with_tiles

        df, parts = with_tiles(df, *cube.cell, tile), ["tile_x", "tile_y"]
    elif by_item:
        parts = [cube.item]
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*parts) if parts else writer).save(path)


def recollect(spark: SparkSession, cube: Cube, path: str, fmt: str = "parquet", mode: str = "error", **options) -> Cube:
    """Writes the cube and reads it back: a later plan starts at the files.

    With ``mode="overwrite"`` an older copy goes, unless the cube itself reads from it.
    """
    here = path.split("://")[-1].split("file:")[-1].rstrip("/")
    own = any(f"{here}/" in f for f in cube.df.inputFiles()) if mode == "overwrite" else False
    need(not own, OutOfRange, "the cube reads from the path that it would overwrite")
    write(cube, path, fmt, mode, **options)
    df = spark.read.format(fmt).load(path)
    values = [F.col(b) if cube.of(b).nodata is None else F.nullif(F.col(b), F.lit(float(cube.of(b).nodata))).alias(b) for b in cube.bands]
    return replace(cube, df=df.select(*cube.keys, *values))


def describe_json(cube: Cube, sources: dict[str, str] | None = None) -> str:
    """A cube's description as text, to be kept beside its files."""
    return json.dumps(
        {
            "bands": list(cube.bands), "keys": cube.keys, "meta": {b: asdict(cube.of(b)) for b in cube.bands},
            "grid": asdict(cube.grid) if cube.grid else None, "mask_band": cube.mask_band, "aligned": cube.aligned, "notes": cube.notes, "sources": sources or {},
        },
        sort_keys=True,
    )


def from_json(spark: SparkSession, text: str, path: str, fmt: str = "parquet") -> Cube:
    """The cube that ``describe_json`` described, over files at ``path``."""
    d = json.loads(text)
    item, time, x, y = d["keys"]
    df = spark.read.format(fmt).load(path)
    meta = {b: BandMeta(**m) for b, m in d["meta"].items()}
    df = df.select(*d["keys"], *(F.col(b) if meta[b].nodata is None else F.nullif(F.col(b), F.lit(float(meta[b].nodata))).alias(b) for b in d["bands"]))
    return Cube(df, tuple(d["bands"]), item, time, (x, y), meta, GridSpec(**d["grid"]) if d["grid"] else None, d["mask_band"], d["aligned"], d.get("notes", {}))


def median_date(times: Column) -> Column:
    """Aggregate: ``median date: YYYY-MM-DD`` of the distinct times, or the one time as it is."""
    micros = F.array_sort(F.collect_set(F.unix_micros(times.cast("timestamp"))))
    n = F.size(micros)
    low, high = F.get(micros, F.floor((n - 1) / 2).cast("int")), F.get(micros, F.floor(n / 2).cast("int"))
    middle = F.timestamp_micros(F.expr("0L") + F.floor(low / 2 + high / 2).cast("long"))
    one = F.date_format(F.timestamp_micros(low), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(n == 1, one).otherwise(F.concat(F.lit("median date: "), F.date_format(middle, "yyyy-MM-dd")))


def file_names(items: DataFrame, time: str, extension: str = ".tif", by: str = "item") -> DataFrame:
    """Adds ``file``: the time as a name, numbered where it repeats; a missing time has an empty name."""
    stem = F.coalesce(F.date_format(time, "yyyy-MM-dd_HH-mm-ss"), F.lit(""))
    named = items.withColumn("_stem", stem)
    number = F.row_number().over(Window.partitionBy("_stem").orderBy(by)) - 1
    named = named.withColumn("_n", number)
    name = F.concat("_stem", F.when(F.col("_n") > 0, F.concat(F.lit("_"), F.col("_n").cast("string"))).otherwise(F.lit("")), F.lit(extension))
    return named.withColumn("file", name).drop("_stem", "_n")


# Writer options by purpose.
OPTIONS = {
    "default": {"compression": "zstd"},
    "small": {"compression": "zstd", "parquet.block.size": str(256 << 20)},
    "fast": {"compression": "snappy"},
}


def writer_options(purpose: str = "default", **more: str) -> dict[str, str]:
    """Options for ``write``: a named set, with single ones replaced."""
    need(purpose in OPTIONS, OutOfRange, f"unknown purpose {purpose}")
    return OPTIONS[purpose] | more


def save(cube: Cube, path: str, bundle: bool = True, sources: dict[str, str] | None = None, mode: str = "error") -> None:
    """Saves a cube as a folder: its description and, in a bundle, its rows.

    Without ``bundle`` only the description and the addresses of its sources are kept.
    """
    need(bundle or bool(sources), OutOfRange, "without a bundle the sources must be named")
    if bundle:
        write(cube, f"{path}/rows", "parquet", mode, **writer_options())
    text = describe_json(cube, sources)
    cube.df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/plan")


def gather(spark: SparkSession, path: str, target: str) -> list[tuple[str, str, str]]:
    """Copies a saved cube and all that it was saved from into one folder that can move.

    Sources are followed through saved cubes to any depth, each once.  They are
    copied by folder below ``target/sources`` under names of their own; addresses of other stores
    stay as they are (one warning for all), and missing ones are left out with a
    warning each.  Returns (address, name or "", state) of every source.  Only
    descriptions pass through the driver: the store copies the files.
    """
    root, found, names, todo = Folder(spark, path), [], set(), []
    need(root.exists("plan"), OutOfRange, f"no saved cube at {path}")
    kept, seen = Folder(spark, target), {path.rstrip("/")}
    need(not kept.exists(), OutOfRange, f"{target} exists")
    root.copy(target)
    todo += sorted(_sources(spark, path).values())
    while todo:
        address = todo.pop(0).rstrip("/")
        if address in seen:
            continue
        seen.add(address)
        if "://" in address and not address.startswith("file:"):
            found.append((address, "", "remote"))
            continue
        source = Folder(spark, address)
        if not source.exists():
            warnings.warn(f"source {address} is missing and left out", stacklevel=2)
            found.append((address, "", "missing"))
            continue
        stem, number = address.rsplit("/", 1)[-1], 0
        while (name := f"{stem}_{number}" if number else stem) in names:
            number += 1
        names.add(name)
        source.copy(f"{target.rstrip('/')}/sources/{name}")
        found.append((address, name, "copied"))
        if source.exists("plan"):
            todo += sorted(_sources(spark, address).values())
    if any(state == "remote" for _, _, state in found):
        warnings.warn("sources in other stores are kept by their addresses", stacklevel=2)
    return found


def _plan_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(f"{path.rstrip('/')}/plan").collect())  # one description


def _sources(spark: SparkSession, path: str) -> dict[str, str]:
    return json.loads(_plan_text(spark, path))["sources"]


def load(spark: SparkSession, path: str, rows: str | None = None) -> Cube:
    """The cube that ``save`` kept; ``rows`` names its files where they are not in the bundle."""
    return from_json(spark, _plan_text(spark, path), rows or f"{path}/rows")
