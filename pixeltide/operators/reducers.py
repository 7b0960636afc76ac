"""Reducers over all bands jointly: one observation vector per cell.

Rows whose bands are all missing take no part; a cell with one row left keeps it as
it is; a cell with none gives NULLs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import OutOfRange, TypeMismatch, need
from ..functions.distances import DISTANCES
from ..model import Cube

#: Digits to which distances are rounded, so that ties do not hang on the last bit.
DIGITS = 9
#: Values of whole cells that the averaged steps take as one block; a longer cell is a block of its own.
BLOCK = 8_000_000


def _facts(cube: Cube) -> dict[str, Column]:
    """Aggregates of a cell: the number of usable rows, and for each band whether it is complete."""
    used = F.coalesce(*cube.bands).isNotNull()
    n = F.count(F.when(used, 1))
    return {"_n": n} | {f"_full_{b}": F.count(b) == n for b in cube.bands}


def _with_centres(cube: Cube, centre: Callable[[Column], Column]) -> DataFrame:
    """The cube's rows with their cell's centre and facts, over one exchange by cell."""
    whole = Window.partitionBy(*cube.cell)
    used = F.coalesce(*cube.bands).isNotNull()
    n = F.count(F.when(used, 1)).over(whole)
    facts = {"_n": n} | {f"_full_{b}": F.count(b).over(whole) == n for b in cube.bands}
    return cube.df.withColumns(facts | {f"_c_{b}": centre(F.col(b)).over(whole) for b in cube.bands})


def _closest(cube: Cube, joined: DataFrame, distance: str, impute: bool, options: dict) -> DataFrame:
    """The usable row of least distance to its cell's centre over the complete bands; the earliest of equal ones."""
    need(distance in DISTANCES, OutOfRange, f"unknown distance {distance}")
    a = [F.when(F.col(f"_full_{b}"), F.col(b)) for b in cube.bands]
    c = [F.when(F.col(f"_full_{b}"), F.col(f"_c_{b}")) for b in cube.bands]
    far = F.round(DISTANCES[distance](a, c, **options), DIGITS)
    used = F.coalesce(*cube.bands).isNotNull()
    # rows without a distance come last, in order of time
    order = F.when(used, F.struct(far.isNull(), far, F.col(cube.time), F.col(cube.item)))
    best = F.min_by(F.struct(*cube.bands), order)
    fill = {b: F.first(f"_c_{b}").alias(f"_c_{b}") for b in cube.bands}
    picked = joined.groupBy(*cube.cell).agg(best.alias("_b"), F.first("_n").alias("_n"), *fill.values())
    value = {b: F.col("_b")[b] for b in cube.bands}
    if impute:
        value = {b: F.when(F.col("_n") > 1, F.coalesce(v, F.col(f"_c_{b}"))).otherwise(v) for b, v in value.items()}
    return picked.select(*cube.cell, *(v.alias(b) for b, v in value.items()))


def medoid(cube: Cube, distance: str = "euclidean", impute: bool = True, **options) -> DataFrame:
    """The observation closest to the band medians."""
    cube.need_aligned()
    return _closest(cube, _with_centres(cube, F.median), distance, impute, options)


def quantoid(cube: Cube, probability: float = 0.4, distance: str = "euclidean", impute: bool = True, **options) -> DataFrame:
    """The observation closest to the band quantiles."""
    need(0 <= probability <= 1, OutOfRange, "a probability is between 0 and 1")
    cube.need_aligned()
    return _closest(cube, _with_centres(cube, lambda v: F.percentile(v, F.lit(float(probability)))), distance, impute, options)


def geometric_median(matrix: np.ndarray, rounds: int = 200, epsilon: float = 1e-8) -> np.ndarray:
    """Weiszfeld's iteration with missing values: distances over the present bands, scaled to all of them."""
    have = ~np.isnan(matrix)
    centre = np.nanmedian(matrix, axis=0) if len(matrix) else np.full(matrix.shape[1], np.nan)
    if len(matrix) < 2:
        return matrix[0] if len(matrix) else centre
    filled = np.where(have, matrix, 0.0)
    share = matrix.shape[1] / np.maximum(have.sum(1), 1)
    for _ in range(rounds):
        gap = np.where(have, matrix - np.where(np.isnan(centre), 0.0, centre), 0.0)
        weight = 1 / np.maximum(np.sqrt((gap**2).sum(1) * share), epsilon)
        total = (weight[:, None] * have).sum(0)
        new = np.where(total > 0, (weight[:, None] * filled).sum(0) / np.where(total > 0, total, 1), np.nan)
        if np.nanmax(np.abs(new - centre), initial=0) < epsilon:
            return new
        centre = new
    return centre


def averaged_median(matrix: np.ndarray, nstart: int = 10, gamma: float = 10.0, alpha: float = 0.65, epsilon: float = 1e-8) -> np.ndarray:
    """Geometric median by averaged stochastic gradient steps over the rows in their order.

    Step k goes gamma * sqrt(bands) / k**alpha towards its row, over the row's present
    bands; the estimate is the running mean of the steps' places.  It starts at the band
    medians and passes over the rows ``nstart`` times, each time from the last estimate.
    """
    have = ~np.isnan(matrix)
    mean = np.where(have.any(0), np.nanmedian(np.where(have.any(0), matrix, 0.0), axis=0), np.nan)
    if len(matrix) < 2:
        return matrix[0] if len(matrix) else mean
    length = gamma * np.sqrt(matrix.shape[1])
    for _ in range(nstart):
        at, mean = mean.copy(), mean.copy()
        for k in range(1, len(matrix)):
            gap = np.where(have[k], matrix[k] - at, 0.0)
            far = float(np.sqrt(np.nansum(gap * gap)))
            if far > epsilon:
                at = at + np.nan_to_num(gap) * (length / ((k + 1) ** alpha * far))
            mean = mean + (at - mean) / (k + 1)
    return mean


def averaged_medians(values: np.ndarray, sizes: np.ndarray, nstart: int = 10, gamma: float = 10.0, alpha: float = 0.65, epsilon: float = 1e-8) -> np.ndarray:
    """``averaged_median`` of many cells at once: step k of all cells that have a row k is one array operation.

    ``values`` has the rows of one cell after those of the other, ``sizes`` the number of each; out comes a row for each.
    """
    cells, bands = len(sizes), values.shape[1]
    owner = np.repeat(np.arange(cells), sizes)
    present = ~np.isnan(values)
    mean = np.full((bands, cells), np.nan)
    for b in range(bands):
        v, at = values[present[:, b], b], owner[present[:, b]]
        v, n = v[np.lexsort((v, at))], np.bincount(at, minlength=cells)
        first, some = np.cumsum(n) - n, n > 0
        low, high = (first + (n - 1) // 2)[some], (first + n // 2)[some]
        mean[b, some] = np.where(low == high, v[low], (v[low] + v[high]) / 2)
    # the longest cells come first, so those with a row k are the first so many; rows k of all lie side by side, by band
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty(cells, int)
    rank[order] = np.arange(cells)
    width = cells - np.searchsorted(sizes[order][::-1], np.arange(sizes.max(initial=0)), side="right")
    begin = (np.cumsum(width) - width) * bands
    k = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole, rows = bool(present.all()), np.zeros(values.size)
    have = None if whole else np.zeros(values.size)
    for b in range(bands):
        to = begin[k] + b * width[k] + rank[owner]
        rows[to] = np.where(present[:, b], values[:, b], 0.0)
        if not whole:
            have[to] = present[:, b]
    unknown = np.isnan(mean[:, order])
    mean = np.where(unknown, 0.0, mean[:, order])
    length, runs = gamma * np.sqrt(bands), [*zip(range(1, len(width)), width[1:].tolist(), begin[1:].tolist(), strict=True)]
    with np.errstate(all="ignore"):
        for _ in range(nstart):
            at, m, n = mean.copy(), mean.copy(), cells
            for k, now, first in runs:
                if k == 1 or now != n:
                    # the cells that end here have their mean; the others go on side by side
                    mean[:, :n] = m.reshape(bands, n)
                    at, m, n = at.reshape(bands, n)[:, :now].ravel(), mean[:, :now].ravel(), now
                    gap, square, far = np.empty_like(m), np.empty_like(m), np.empty(n)
                    gaps, squares = gap.reshape(bands, n), square.reshape(bands, n)
                np.subtract(rows[first : first + n * bands], at, out=gap)
                if not whole:
                    np.multiply(gap, have[first : first + n * bands], out=gap)
                np.multiply(gap, gap, out=square)
                np.sqrt(np.add.reduce(squares, axis=0, out=far), out=far)
                still = far <= epsilon if np.minimum.reduce(far) <= epsilon else None
                np.divide(length, np.multiply(far, (k + 1) ** alpha, out=far), out=far)
                if still is not None:
                    far[still] = 0.0
                np.multiply(gaps, far, out=gaps)
                np.add(at, gap, out=at)
                np.divide(np.subtract(at, m, out=gap), k + 1.0, out=gap)
                np.add(m, gap, out=m)
            mean[:, :n] = m.reshape(bands, n)
    out = np.empty((cells, bands))
    out[order] = np.where(unknown, np.nan, mean).T
    # infinite values have rules of their own there
    for c in np.unique(owner[np.isinf(values).any(1)]):
        out[c] = averaged_median(values[owner == c], nstart, gamma, alpha, epsilon)
    return out


def complete_median(matrix: np.ndarray, rounds: int = 200, epsilon: float = 1e-8, impute: bool = True, fill: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Weiszfeld's iteration on the complete bands; the others come from ``fill`` of all bands, or stay missing."""
    gaps = np.isnan(matrix).any(0)
    out = np.full(matrix.shape[1], np.nan)
    if not gaps.all():
        out[~gaps] = geometric_median(matrix[:, ~gaps], rounds, epsilon)
    if impute and gaps.any():
        out[gaps] = (fill or averaged_median)(matrix)[gaps]
    return out


def reduce_with(cube: Cube, reducer: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A user's matrix-to-vector reducer per cell (rows in order of time, columns bands), as a grouped Arrow map.

    The rows of one cell meet in one task: their number is the length of its time
    series, which the data model bounds by the number of items.
    """
    need(callable(reducer), TypeMismatch, "not a function")
    cube.need_aligned()
    bands, cell = list(cube.bands), list(cube.cell)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("_k")[bands].to_numpy(float)
        rows = rows[~np.isnan(rows).all(axis=1)]
        out = rows[0] if len(rows) == 1 else reducer(rows) if len(rows) else np.full(len(bands), np.nan)
        frame = pd.DataFrame([[*pdf.iloc[0][cell], *(None if np.isnan(v) else float(v) for v in out)]], columns=cell + bands)
        return frame

    # the place is found over the same partitioning as the groups: one exchange serves both
    return _placed(cube).groupBy(*cell).applyInPandas(run, _vectors(cube))


def _placed(cube: Cube, *first: Column) -> DataFrame:
    """The cube's cells and bands, with each row's place ``_k`` in its cell in order of time, from 1.

    ``first``: functions of the cell by which the sort begins.
    """
    place = F.row_number().over(Window.partitionBy(*first, *cube.cell).orderBy(F.asc_nulls_last(cube.time), cube.item))
    return cube.df.select(*cube.cell, place.alias("_k"), *(F.col(b).cast("double").alias(b) for b in cube.bands))


def _vectors(cube: Cube) -> T.StructType:
    return T.StructType([cube.df.schema[c] for c in cube.cell] + [T.StructField(b, T.DoubleType()) for b in cube.bands])


def _reduce_blocks(cube: Cube, reducer: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """A reducer of many cells at once (rows of all, number of rows of each), over blocks of whole cells.

    The rows leave the window in order of cell and place, so a cell begins where the place is 1.
    """
    cube.need_aligned()
    bands, cell, limit = list(cube.bands), list(cube.cell), BLOCK

    def reduced(block: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(block)
        starts = np.flatnonzero(table["_k"].to_numpy() == 1)
        values = np.column_stack([table[b].to_numpy() for b in bands])
        used = ~np.isnan(values).all(1)
        sizes = np.add.reduceat(used.astype(int), starts)
        out = reducer(values[used], sizes)
        columns = [table[c].take(pa.array(starts)).combine_chunks() for c in cell] + [pa.array(v, pa.float64(), from_pandas=True) for v in out.T]
        return pa.RecordBatch.from_arrays(columns, names=cell + bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            starts = np.flatnonzero(batch["_k"].to_numpy() == 1) if n * len(bands) >= limit else ()
            if len(starts):
                cut = int(starts[-1])
                yield reduced([*held, batch.slice(0, cut)])
                held, n, batch = [], 0, batch.slice(cut)
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if held:
            yield reduced(held)

    # a hash tells most cells apart at once where their coordinates have few values
    return _placed(cube, F.xxhash64(*cube.cell)).mapInArrow(run, _vectors(cube))


def geomedian(
    cube: Cube, weiszfeld: bool = False, rounds: int = 100, nstart: int = 10, gamma: float = 10.0, alpha: float = 0.65, epsilon: float = 1e-8,
    impute: bool = True,
) -> DataFrame:
    """The geometric median of the observations: by averaged stochastic steps, which take gaps as they are, or by
    Weiszfeld's iteration on the complete bands, with the others from the former if ``impute``."""
    need(nstart >= 1 and rounds >= 1 and gamma > 0 and 0.5 < alpha <= 1, OutOfRange, "nstart and rounds from 1, gamma above 0, alpha above 0.5 to 1")

    def averaged(m: np.ndarray) -> np.ndarray:
        return averaged_median(m, nstart, gamma, alpha, epsilon)

    if weiszfeld:
        return reduce_with(cube, lambda m: complete_median(m, rounds, epsilon, impute, averaged))
    return _reduce_blocks(cube, lambda values, sizes: averaged_medians(values, sizes, nstart, gamma, alpha, epsilon))


def geomedian_fixed(cube: Cube, rounds: int = 5) -> DataFrame:
    """A fixed number of Weiszfeld rounds, in SQL only: complete rows, started at the band medians.

    Per cell all usable rows become one array, so the rounds are array folds without
    further shuffles.
    """
    need(rounds >= 1, OutOfRange, "at least one round")
    cube.need_aligned()
    complete = F.when(~F.greatest(*(F.col(b).isNull().cast("int") for b in cube.bands)).cast("boolean") if len(cube.bands) > 1 else F.col(cube.bands[0]).isNotNull(),
                      F.array(*(F.col(b).cast("double") for b in cube.bands)))
    full = cube.df.withColumn("_v", complete)
    k = len(cube.bands)
    start = F.array(*(F.median(F.get("_v", i)) for i in range(k)))
    out = full.groupBy(*cube.cell).agg(F.collect_list("_v").alias("_m"), start.alias("_z"))
    for _ in range(rounds):

        def weight(r):
            return 1 / F.greatest(F.sqrt(sum(((F.get(r, i) - F.get("_z", i)) * (F.get(r, i) - F.get("_z", i)) for i in range(k)), F.lit(0.0))), F.lit(1e-8))

        out = out.withColumn("_w", F.transform("_m", weight))
        sums = F.aggregate(
            F.zip_with("_m", "_w", lambda r, w: F.struct(r.alias("r"), w.alias("w"))),
            F.array_repeat(F.lit(0.0), k + 1),
            lambda acc, e: F.array(*(F.get(acc, i) + e["w"] * F.get(e["r"], i) for i in range(k)), F.get(acc, k) + e["w"]),
        )
        out = out.withColumn("_s", sums).withColumn("_z", F.array(*(F.try_divide(F.get("_s", i), F.get("_s", k)) for i in range(k))))
    return out.select(*cube.cell, *(F.get("_z", i).alias(b) for i, b in enumerate(cube.bands)))


def geomedoid(cube: Cube, distance: str = "euclidean", impute: bool = True, rounds: int = 200, **options) -> DataFrame:
    """The observation closest to the geometric median of the complete bands; gaps take the median of the others."""

    def centre(m: np.ndarray) -> np.ndarray:
        gaps = np.isnan(m).any(0)
        out = np.empty(m.shape[1])
        for part in (gaps, ~gaps):
            if part.any():
                out[part] = geometric_median(m[:, part], rounds)
        return out

    centres = reduce_with(cube, centre).withColumnsRenamed({b: f"_c_{b}" for b in cube.bands})
    facts = cube.df.groupBy(*cube.cell).agg(*(v.alias(name) for name, v in _facts(cube).items()))
    return _closest(cube, cube.df.join(facts.join(centres, list(cube.cell)), list(cube.cell)), distance, impute, options)
