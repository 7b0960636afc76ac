"""Optional streaming forms: composites kept up to date, and gaps filled as observations arrive.

The batch operators are the main path.  A stream of observations can keep the
composites whose aggregates Spark maintains incrementally, per event-time window,
and can carry values forward with one small state per cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import OutOfRange, need
from ..functions import pixel

#: Aggregates with a state of constant size.
INCREMENTAL = ("mean", "min", "max", "sum", "count", "geometric_mean", "mean_db", "harmonic_mean")


def composite(stream: DataFrame, bands, cell, time: str, every: str, late: str, function: str = "mean") -> DataFrame:
    """Composite of each event-time window; rows later than ``late`` are dropped with their window's state."""
    need(function in INCREMENTAL, OutOfRange, f"{function} needs all values of a window")
    windowed = stream.withWatermark(time, late).groupBy(F.window(time, every), *cell)
    out = windowed.agg(*(pixel.AGGREGATES[function](F.col(b)).alias(b) for b in bands))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *cell, *bands)


def carry_forward(stream: DataFrame, band: str, cell, time: str) -> DataFrame:
    """Each row with the last valid value of its cell in place of a missing one.

    Rows are taken in order of time within a micro-batch; the state is one value.
    """
    names = [*cell, time, band]
    schema = stream.select(*names).schema

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for pdf in frames:
            pdf = pdf.sort_values(time, kind="stable")
            filled = pdf[band].astype(float)
            if last is not None and len(filled) and pd.isna(filled.iloc[0]):
                filled.iloc[0] = last
            filled = filled.ffill()
            if filled.notna().any():
                last = float(filled.dropna().iloc[-1])
            yield pdf.assign(**{band: filled})[names]
        if last is not None:
            state.update((last,))

    return stream.select(*names).groupBy(*cell).applyInPandasWithState(run, schema, "last double", "append", GroupStateTimeout.NoTimeout)
