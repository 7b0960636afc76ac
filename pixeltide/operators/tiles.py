"""Tiles: the regular cutting of an image, as numbers and as a table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import OutOfRange, need


def tile_size(xsize: int, ysize: int, block_x: int, block_y: int, nsplits: int) -> tuple[int, int]:
    """Tiles of the fewest whole blocks with which at most ``nsplits`` tiles cover the image.

    Blocks are first put side by side; only tiles as wide as the image grow downwards.
    """
    need(min(xsize, ysize, block_x, block_y, nsplits) >= 1, OutOfRange, "sizes are positive")
    blocks = 1
    while True:
        wide = min(xsize, block_x * blocks)
        high = block_y * (max(1, block_x * blocks // xsize) if wide == xsize else 1)
        high = min(ysize, high)
        if math.ceil(xsize / wide) * math.ceil(ysize / high) <= nsplits or (wide, high) == (xsize, ysize):
            return wide, high
        blocks += 1


def tile_table(spark: SparkSession, xsize: int, ysize: int, tile_x: int, tile_y: int, bands: int = 1) -> DataFrame:
    """(x_off, y_off, x_size, y_size, band) of every tile."""
    nx, ny = math.ceil(xsize / tile_x), math.ceil(ysize / tile_y)
    n = F.col("id")
    return spark.range(nx * ny * bands).select(
        (n % nx * tile_x).alias("x_off"),
        (F.floor(n / nx) % ny * tile_y).alias("y_off"),
        F.least(F.lit(tile_x), xsize - n % nx * tile_x).cast("long").alias("x_size"),
        F.least(F.lit(tile_y), ysize - F.floor(n / nx) % ny * tile_y).cast("long").alias("y_size"),
        (F.floor(n / (nx * ny)) + 1).alias("band"),
    )


def chunks(total_bytes: float, available: float, workers: int, share: float = 0.6) -> int:
    """Number of chunks so that ``workers`` of them fit in a share of the memory."""
    need(total_bytes >= 0 and available > 0 and workers >= 1, OutOfRange, "sizes are positive")
    return max(1, math.ceil(total_bytes / (available * share))) * workers


def with_tiles(df: DataFrame, x: str, y: str, tile: int) -> DataFrame:
    """Adds tile numbers; laid out by them, a file serves a window and a cell's rows meet without a shuffle."""
    need(tile >= 1, OutOfRange, "the tile size is positive")
    return df.withColumns({"tile_x": F.floor(F.col(x) / tile), "tile_y": F.floor(F.col(y) / tile)})
