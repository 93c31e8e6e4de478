"""Ordered computations that survive a hot key.

A plain window over ``partitionBy(key)`` sends every row of a key to one task.  ``scan`` instead
works in two levels: a window inside ``(key, bucket)``, and a window over one summary row per
bucket that carries the value in from earlier buckets.  Summaries are built with map-side
aggregation, so a key that holds a third of all rows is spread over its buckets.  Results are the
same as those of the plain window.  A scan along the same keys and bucket as the one before it does
not move its rows again.

Buckets must follow the order: ``bucket`` is non-decreasing along ``order`` within a key (a time
or sequence range).  Where one range may hold very many rows of a key, ``by_count`` makes buckets of
bounded size.  Keys must not be null.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.sources.tables import written


@dataclass(frozen=True)
class Ordering:
    """Partition keys, total order inside a key, and the bucket column that splits a key."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    bucket: str = "_bucket"

    @property
    def group(self) -> list[str]:
        return [*self.keys, self.bucket]


@dataclass(frozen=True)
class Running:
    """One running value: ``sum``, ``max``, ``min`` or ``last`` non-null, with or without this row."""

    how: str
    value: Column
    inclusive: bool = True


def range_bucket(value: Column, width: int) -> Column:
    """Bucket of an integer order value (milliseconds, sequence number)."""
    return F.floor(value.cast("bigint") / F.lit(width)).cast("bigint")


def by_count(df: DataFrame, keys: list[str], order: list[str], block_rows_log2: int = 16) -> tuple[DataFrame, Ordering]:
    """Buckets of at most ``2 ** block_rows_log2`` rows, whatever the order column holds (a busy day, equal times).

    Rows are range-partitioned and sorted by (keys, order) and written once.  ``order`` should decide ties.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(ranges, *keys, *order).sortWithinPartitions(*keys, *order)
    # written once: bounds drawn a second time would give other buckets
    rows = written(placed.withColumn("_at", F.monotonically_increasing_id()), "blocks")
    return rows.select(*df.columns, F.shiftright("_at", block_rows_log2).alias("_block_no")), Ordering(tuple(keys), tuple(order), "_block_no")


def scan(df: DataFrame, by: Ordering, values: Mapping[str, Running], reverse: bool = False) -> DataFrame:
    """Add running values along the order; ``reverse`` runs from the end (so ``last`` means next)."""
    inner_order = [F.col(c).desc() if reverse else F.col(c).asc() for c in by.order]
    bucket_order = F.col(by.bucket).desc() if reverse else F.col(by.bucket).asc()
    inside = Window.partitionBy(*by.group).orderBy(*inner_order)
    across = Window.partitionBy(*by.keys).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)

    base = df.select("*", *[r.value.alias(f"_v_{name}") for name, r in values.items()])
    carried = base.groupBy(*by.group).agg(
        *[_summary(r.how, f"_v_{name}", by.order, reverse).alias(f"_s_{name}") for name, r in values.items()]
    ).select(
        *by.group, *[_running(r.how, F.col(f"_s_{name}")).over(across).alias(f"_c_{name}") for name, r in values.items()]
    )
    local = base.select(
        *df.columns,
        *[
            _running(r.how, F.col(f"_v_{name}"))
            .over(inside.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1))
            .alias(f"_l_{name}")
            for name, r in values.items()
        ],
    )
    return local.join(carried, by.group, "left").select(
        *df.columns,
        *[_combine(r.how, F.col(f"_c_{name}"), F.col(f"_l_{name}")).alias(name) for name, r in values.items()],
    )


def _running(how: str, v: Column) -> Column:
    return {"sum": F.sum, "max": F.max, "min": F.min}[how](v) if how != "last" else F.last(v, ignorenulls=True)


def _summary(how: str, name: str, order: tuple[str, ...], reverse: bool) -> Column:
    v = F.col(name)
    if how != "last":
        return _running(how, v)
    key = F.when(v.isNotNull(), F.struct(*order))
    return F.min_by(v, key) if reverse else F.max_by(v, key)


def _combine(how: str, carried: Column, local: Column) -> Column:
    if how == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if how == "max":
        return F.greatest(carried, local)
    if how == "min":
        return F.least(carried, local)
    return F.coalesce(local, carried)


def with_index(df: DataFrame, by: Ordering, name: str = "seq") -> DataFrame:
    """One-based position inside the key, without sorting a key in one task."""
    return scan(df, by, {name: Running("sum", F.lit(1).cast("bigint"))})


def with_place(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """One-based place of every row in the order of the whole table, without a key to split it by.

    Rows are range-partitioned by sampled bounds and sorted, written with their position inside the range, and get
    the rows of the ranges before theirs added: one number a range.  Ties should be decided by ``order``.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: bounds drawn a second time would give other ranges
    rows = written(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    range_of = F.shiftright("_at", 33)
    sizes = rows.groupBy(range_of.alias("_range")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))  # at most ``ranges`` rows
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(starts), range_of == F.col("_range")).select(*df.columns, (F.col("_before") + inside + 1).alias(name))


def with_halo(df: DataFrame, index: str, block_rows: int, before: int) -> DataFrame:
    """Split dense positions into blocks and copy the ``before`` rows ahead of each block into it.

    Adds ``_block`` and ``_halo``; windows over ``(key, _block)`` reaching at most ``before`` rows
    back are then exact for the rows where ``_halo`` is false.
    """
    if not 0 <= before < block_rows:
        raise ValueError("before must be smaller than block_rows")
    block = range_bucket(F.col(index), block_rows)
    copies = F.when(
        F.pmod(F.col(index), F.lit(block_rows)) >= block_rows - before, F.array(block, block + 1)
    ).otherwise(F.array(block))
    return df.withColumn("_block", F.explode(copies)).withColumn("_halo", F.col("_block") != block)
