"""Snapshots of a keyed table that tell which of their buckets differ, so that equal buckets are not read.

A snapshot is a folder: rows under ``_part=`` folders by the hash of their key, and one header row with the number of
rows and two sums of row digests for every part.  The header is written last, so a folder without one is not yet a
snapshot.  Sums do not depend on the order of rows, and are built with map-side aggregation.

Keys must be unique and not null; columns must be comparable (no maps).  Equality of parts goes by 96 bits.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

PART = "_part"


@dataclass(frozen=True)
class Snapshot:
    """A written snapshot; ``digests`` maps the parts that hold rows to (rows, sum, sum), at most ``parts`` entries."""

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    parts: int
    digests: dict[int, tuple]

    def read(self, parts: Sequence[int] | None = None) -> DataFrame:
        """Its rows, or those of some parts; other parts' folders are pruned."""
        rows = self.spark.read.schema(_stored(self.schema)).parquet(f"{self.path}/rows")
        return (rows if parts is None else rows.where(F.col(PART).isin(list(parts)))).select(*self.schema.names)


def _stored(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(PART, IntegerType())])


def _digest(columns: Sequence[str]) -> tuple[Column, Column]:
    # hashes skip nulls, so their places are hashed too
    values = [v for c in columns for v in (F.col(c), F.col(c).isNull())]
    return F.xxhash64(*values).cast("decimal(20,0)"), F.hash(*values).cast("decimal(20,0)")


def write_snapshot(rows: DataFrame, path: str, keys: Sequence[str], parts: int = 256) -> Snapshot:
    """Write ``rows`` as a snapshot under a new path.  More parts mean less to read after a small change."""
    if PART in rows.columns:
        raise ValueError(f"column {PART} is taken")
    spark, names = rows.sparkSession, sorted(rows.columns)
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    rows.withColumn(PART, part).repartition(PART).write.partitionBy(PART).parquet(f"{path}/rows")
    long_sum, short_sum = _digest(names)
    stored = spark.read.schema(_stored(rows.schema)).parquet(f"{path}/rows")
    sums = stored.groupBy(PART).agg(F.count("*").alias("n"), F.sum(long_sum).alias("a"), F.sum(short_sum).alias("b"))
    header = sums.agg(F.collect_list(F.struct(PART, "n", "a", "b")).alias("digests"))  # at most ``parts`` entries
    header.select(
        "digests", F.lit(rows.schema.json()).alias("schema"), F.array(*map(F.lit, keys)).alias("keys"), F.lit(parts).alias("parts"),
    ).write.parquet(f"{path}/header")
    return read_snapshot(spark, path)


def read_snapshot(spark: SparkSession, path: str) -> Snapshot:
    head = spark.read.parquet(f"{path}/header").first()
    digests = {d[PART]: (d.n, d.a, d.b) for d in head.digests}
    return Snapshot(spark, path, StructType.fromJson(json.loads(head.schema)), tuple(head["keys"]), head.parts, digests)


def differing(old: Snapshot, new: Snapshot) -> list[int]:
    """Parts whose rows are not the same in both."""
    shape = [(s.parts, s.keys, sorted((f.name, f.dataType.simpleString()) for f in s.schema)) for s in (old, new)]
    if shape[0] != shape[1]:
        raise ValueError("snapshots differ in keys, columns or parts")
    return sorted(p for p in old.digests.keys() | new.digests.keys() if old.digests.get(p) != new.digests.get(p))


def changes(old: Snapshot, new: Snapshot) -> DataFrame:
    """Rows that differ: keys, ``change`` (ADDED, REMOVED or CHANGED) and the whole rows ``before`` and ``after``.

    Reads the differing parts alone, none if the snapshots are equal.
    """
    parts, keys = differing(old, new), list(old.keys)
    names = old.schema.names
    before, after = (s.read(parts).select(*keys, F.struct(*names).alias(side)) for s, side in ((old, "before"), (new, "after")))
    change = (
        F.when(F.col("before").isNull(), "ADDED").when(F.col("after").isNull(), "REMOVED")
        .when(~F.col("before").eqNullSafe(F.col("after")), "CHANGED")
    )
    both = before.join(after, keys, "full").select(*keys, change.alias("change"), "before", "after")
    return both.where(F.col("change").isNotNull())


def feed(versions: Sequence[Snapshot]) -> DataFrame:
    """What changed at each version after the first: the rows of ``changes`` with ``version``, from 1."""
    steps = [changes(a, b).withColumn("version", F.lit(i)) for i, (a, b) in enumerate(zip(versions, versions[1:]), 1)]
    if not steps:
        raise ValueError("a feed needs two versions")
    return reduce(DataFrame.unionByName, steps)
