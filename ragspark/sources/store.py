"""Tables laid out by the same buckets of documents, rewritten bucket by bucket.

A table is a folder ``<table>/run=<run>/bucket=<b>``.  A run writes the buckets it touches into folders of its own and
then appends one file to the log, ``(version, table, bucket, run)``.  That file says which run holds which
bucket from then on, so the new buckets of all tables are seen at once or, if the run dies before, not at all:
folders that no log row names are never read.  A bucket is rewritten as a whole; untouched ones keep
their files.  One writer at a time.

The driver holds one log row per table and bucket, whatever the data; the number of buckets is fixed when the store
is made.  Folders of replaced runs stay for readers that opened them; the owner of the store clears them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark import schemas

TABLES = {"catalog": schemas.DOCUMENTS, "chunks": schemas.CHUNKS, "offsets": schemas.OFFSETS}
LOG = "version long, table string, bucket int, run string"
ORDINALS = 4096  # rows of one document that share a file at most


class BucketStore:
    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, str] = TABLES, key: str = "document_id"):
        self.spark, self.root, self.tables, self.key = spark, root.rstrip("/"), dict(tables), key
        self.buckets = self._log().where("version = 0").first()["bucket"]

    @classmethod
    def create(cls, spark: SparkSession, root: str, buckets: int = 256, tables: Mapping[str, str] = TABLES,
               key: str = "document_id") -> BucketStore:
        """A new store of empty tables; fails if there is one."""
        if buckets <= 0:
            raise ValueError("buckets must be positive")
        first = spark.createDataFrame([(0, None, buckets, None)], LOG)
        first.coalesce(1).write.mode("error").json(f"{root.rstrip('/')}/log")
        return cls(spark, root, tables, key)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets that the rows' keys fall into: at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def versions(self) -> dict[tuple[str, int], tuple[int, str | None]]:
        """(version, run) of every written (table, bucket); a run of None left the bucket empty."""
        newest = self._log().where("version > 0").groupBy("table", "bucket").agg(
            F.max(F.struct("version", "run")).alias("last"))
        return {(r["table"], r["bucket"]): (r["last"]["version"], r["last"]["run"]) for r in newest.collect()}

    def read(self, table: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets, as of the newest version."""
        only = None if buckets is None else set(buckets)
        paths = [
            f"{self.root}/{table}/run={run}/bucket={b}" for (name, b), (_, run) in sorted(self.versions().items())
            if name == table and run is not None and (only is None or b in only)
        ]
        if not paths:
            return self.spark.createDataFrame([], self.tables[table])
        schema = f"{self.tables[table]}, run string, bucket int"
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths).drop("run", "bucket")

    def begin(self) -> Run:
        return Run(self)

    def _log(self) -> DataFrame:
        return self.spark.read.schema(LOG).json(f"{self.root}/log")


class Run:
    """One rewrite of some buckets: ``stage`` the new rows of tables, then ``publish`` them together."""

    def __init__(self, store: BucketStore):
        self.store, self.id, self.staged = store, uuid.uuid4().hex, []

    def stage(self, table: str, rows: DataFrame) -> DataFrame:
        """Write the rows that the touched buckets shall hold, and read them again."""
        store = self.store
        path = f"{store.root}/{table}/run={self.id}"
        placed = rows.withColumn("bucket", store.bucket())
        keys = ["bucket"]
        if "ordinal" in rows.columns:  # a large document is not one file
            placed, keys = placed.withColumn("_spread", F.floor(F.col("ordinal") / ORDINALS)), ["bucket", "_spread"]
        placed.repartition(*keys).drop("_spread").write.partitionBy("bucket").parquet(path)
        self.staged.append(table)
        return self._written(table).drop("bucket")

    def keep(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows the run needs more than once, written beside its tables."""
        path = f"{self.store.root}/work/run={self.id}/{name}"
        rows.write.parquet(path)
        return self.store.spark.read.schema(rows.schema).parquet(path)

    def publish(self, buckets: Iterable[int]) -> int:
        """Make the staged tables the content of ``buckets``, which they replace whole; returns the version."""
        buckets = set(buckets)
        version = 1 + max((v for v, _ in self.store.versions().values()), default=0)
        rows = []
        for table in self.staged:
            filled = {r[0] for r in self._written(table).select("bucket").distinct().collect()}
            if filled - buckets:
                raise ValueError(f"rows of {table} lie in buckets that the run does not replace: {sorted(filled - buckets)[:5]}")
            rows += [(version, table, b, self.id if b in filled else None) for b in sorted(buckets)]
        log = self.store.spark.createDataFrame(rows, LOG)
        log.coalesce(1).write.mode("append").json(f"{self.store.root}/log")  # one file, renamed into place
        return version

    def _written(self, table: str) -> DataFrame:
        schema = f"{self.store.tables[table]}, bucket int"
        return self.store.spark.read.schema(schema).parquet(f"{self.store.root}/{table}/run={self.id}")
