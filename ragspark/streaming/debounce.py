"""Streaming debounce, latest-wins and consecutive-duplicate suppression.

Event time comes from the rows; the watermark that closes a quiet period is the caller's choice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DecimalType, FractionalType, IntegralType, StructField, StructType

from ragspark.functions import text as T


def debounce_stream(inputs: DataFrame, keys: list[str], time_col: str, order: list[str], wait: str = "300 milliseconds",
                    watermark: str = "0 seconds", text_col: str | None = None) -> DataFrame:
    """Latest input of every quiet period, emitted once the watermark passes its end.

    With ``text_col``, adds ``action``: CLEAR for blank text, FIRE otherwise.

    A session window with the wait as its gap is the debounce: a new input within the gap extends the
    session, and ``max_by`` keeps the last one.  State is one row per open session.
    """
    rest = [c for c in inputs.columns if c not in keys]
    window = F.session_window(time_col, wait)
    fired = (
        inputs.withWatermark(time_col, watermark).groupBy(*keys, window.alias("_quiet"))
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
    )
    if text_col is None:
        return fired
    return fired.withColumn("action", F.when(T.is_blank(F.col(text_col)), "CLEAR").otherwise("FIRE"))


def keep_latest_stream(frames: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key as an updating table (output mode ``update`` or ``complete``)."""
    rest = [c for c in frames.columns if c not in keys]
    return frames.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def drop_repeats_stream(events: DataFrame, key: str, order: str, same: str) -> DataFrame:
    """Rows whose ``same`` value differs from the row before; state is the last value of each key.

    Null equals null.  The state has the column's own type, so values compare alike within and across triggers.
    """
    schema: StructType = events.schema
    kind = schema[same].dataType

    def plain_value(v):
        if pd.isna(v):
            return None
        if isinstance(kind, IntegralType):
            return int(v)
        return float(v) if isinstance(kind, FractionalType) and not isinstance(kind, DecimalType) else v

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        if len(rows):
            values = [plain_value(v) for v in rows[same]]
            new = [a != b for a, b in zip(values[1:], values)]
            first = not state.exists or state.get[0] != values[0]
            state.update((values[-1],))
            yield rows[[first, *new]]

    return events.groupBy(key).applyInPandasWithState(
        step, schema, StructType([StructField("last", kind)]), "append", GroupStateTimeout.NoTimeout
    )
