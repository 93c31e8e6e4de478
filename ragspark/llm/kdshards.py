"""K-d tree sharding by size, with DataFrame operations only.

Points are groups of equal texts, weighted by bytes, so that copies share a shard.  A group heavier than
1/``SPLIT`` of a shard is dealt by document hash into parts below that weight; there are at most
``SPLIT`` times as many such groups as shards, which bounds the list that is broadcast.

The tree cuts all nodes of a level at once.  A node that stands for k shards takes the metadata dimension
(size, language, source) along which its points spread widest, and is cut at the weighted quantile
(k // 2) / k; with equal halves that is the median.  The quantile comes from histograms of the node's
range, refined inside the bin that holds it until that bin weighs little; only bin sums reach the
driver.  Every dimension carries the group's hash as its fraction, so ties have an order that keeps
groups whole.

Slots are gapless within a shard: rows are numbered within hash buckets of the shard and the buckets'
counts give the offsets, so no shard is sorted in one task.

Edge cases: a null text has size 1 and the checksum of no bytes; null language or source is a value of
its own; null and repeated ids are allowed; an empty table gives no rows; with fewer groups than shards
some shards stay empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.llm.shared import cut, text_or_null

SPLIT = 32
CELLS = 1 << 20
DIMENSIONS = ("_c0", "_c1", "_c2")
SPLITS = T.StructType([
    T.StructField("_at", T.IntegerType()), T.StructField("_dim", T.IntegerType()),
    T.StructField("_low", T.DoubleType()), T.StructField("_high", T.DoubleType()),
])


def code(column: Column) -> Column:
    """A category as one of ``CELLS`` cells; null is a category too."""
    return F.pmod(F.xxhash64(F.isnull(column), column.cast("string")), F.lit(CELLS))


def rows_of(docs: DataFrame) -> DataFrame:
    """Per document: id, size, checksum, two group hashes, and the cells of its metadata."""
    text = F.coalesce(text_or_null(docs), F.lit(""))
    absent = F.isnull(docs["text"])
    size = (F.octet_length(text) + 1).cast("long")
    extra = {c: docs[c] if c in docs.columns else F.lit(None) for c in ("lang", "source")}
    return docs.select(
        docs["doc_id"].alias("_doc"), size.alias("_size"), F.crc32(text.cast("binary")).alias("_crc"),
        F.xxhash64(F.lit(1), absent, text).alias("_g1"), F.xxhash64(F.lit(2), absent, text).alias("_g2"),
        F.floor(F.log2(size.cast("double")) * (CELLS / 64)).cast("long").alias("_c0"),
        code(extra["lang"]).alias("_c1"), code(extra["source"]).alias("_c2"),
    )


def weighted_points(rows: DataFrame) -> DataFrame:
    """One row per group, or per salted part of a group: weight and coordinates."""
    fraction = F.shiftrightunsigned(F.xxhash64("_g1", "_g2", "_salt"), 32).cast("double") / float(1 << 32)
    return rows.groupBy("_g1", "_g2", "_salt").agg(
        F.sum("_size").alias("_w"), *[F.min(c).alias(c) for c in DIMENSIONS]
    ).select("_g1", "_g2", "_salt", "_w", *[(F.col(c) + fraction).alias(c) for c in DIMENSIONS])


def salted(rows: DataFrame, limit: float) -> DataFrame:
    heavy = rows.groupBy("_g1", "_g2").agg(F.sum("_size").alias("_gw")).where(F.col("_gw") > limit)
    heavy = heavy.select(F.col("_g1").alias("_h1"), F.col("_g2").alias("_h2"), F.ceil(F.col("_gw") / limit).cast("int").alias("_parts"))
    # at most total / limit rows: SPLIT times the number of shards
    both = rows.join(F.broadcast(heavy), (F.col("_g1") == F.col("_h1")) & (F.col("_g2") == F.col("_h2")), "left")
    salt = F.pmod(F.xxhash64("_doc"), F.coalesce("_parts", F.lit(1))).cast("int")
    return both.select(*rows.columns, salt.alias("_salt"))


def value(dim: Column) -> Column:
    return F.element_at(F.array(*DIMENSIONS), dim + 1)


def placed(points: DataFrame, splits: list[tuple[int, int, float, float]]) -> DataFrame:
    """Points of the nodes in ``splits`` with the value along their node's dimension, ``_v``."""
    table = points.sparkSession.createDataFrame(splits, SPLITS)
    return points.join(F.broadcast(table), F.col("_node") == F.col("_at")).withColumn("_v", value(F.col("_dim")))


def cut_values(points: DataFrame, nodes: dict[int, int]) -> dict[int, tuple[int, float]]:
    """Dimension and threshold of every node (id to number of shards); values up to it go left."""
    bounds = [F.min(c).alias(f"l{c}") for c in DIMENSIONS] + [F.max(c).alias(f"h{c}") for c in DIMENSIONS]
    stats = {r["_node"]: r for r in points.groupBy("_node").agg(F.sum("_w").alias("w"), *bounds).collect()}
    open_: dict[int, dict] = {}
    for node, r in stats.items():
        if nodes.get(node, 1) > 1:
            widths = [math.floor(r[f"h{c}"]) - math.floor(r[f"l{c}"]) for c in DIMENSIONS]
            dim = widths.index(max(widths))
            open_[node] = {"dim": dim, "low": r[f"l{DIMENSIONS[dim]}"], "high": r[f"h{DIMENSIONS[dim]}"], "below": 0,
                           "goal": r["w"] * (nodes[node] // 2) / nodes[node], "fine": r["w"] / nodes[node] / 2048}
    done: dict[int, tuple[int, float]] = {}
    while open_:
        bins = max(16, min(1024, (1 << 17) // len(open_)))
        part = placed(points, [(n, x["dim"], float(x["low"]), float(x["high"])) for n, x in open_.items()])
        inside = part.where((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
        step = F.least(F.floor((F.col("_v") - F.col("_low")) * bins / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-300))), F.lit(bins - 1))
        sums = inside.groupBy("_node", step.alias("_bin")).agg(F.sum("_w").alias("w"), F.min("_v").alias("low"), F.max("_v").alias("high")).collect()
        for node, x in list(open_.items()):
            below = x["below"]
            for r in sorted((r for r in sums if r["_node"] == node), key=lambda r: r["low"]):
                if below + r["w"] < x["goal"]:
                    below += r["w"]
                    x["last"] = r["high"]
                    continue
                if r["w"] <= x["fine"] or r["low"] == r["high"]:
                    after = below + r["w"] - x["goal"] <= x["goal"] - below
                    done[node] = (x["dim"], r["high"] if after else x.get("last", r["low"] - 1.0))
                    del open_[node]
                else:
                    x |= {"low": r["low"], "high": r["high"], "below": below}
                break
            else:
                done[node] = (x["dim"], x["high"])
                del open_[node]
    return done


def kd_assignments(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Per document: ``_doc, _size, _crc, _shard, _g1``; give the number of shards or their target bytes."""
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    rows = cut(rows_of(docs))
    total = rows.agg(F.sum("_size")).first()[0] or 0
    count = shards or max(1, math.ceil(total / target_bytes))
    rows = salted(rows, max(1.0, total / count / SPLIT))
    points = cut(weighted_points(rows).withColumn("_node", F.lit(0)))
    nodes = {0: count}
    while any(k > 1 for k in nodes.values()):
        found = cut_values(points, nodes)
        splits = [(n, d, t, float(nodes[n] // 2)) for n, (d, t) in found.items()]
        table = points.sparkSession.createDataFrame(splits, SPLITS)
        right = F.when(value(F.col("_dim")) > F.col("_low"), F.col("_high").cast("int")).otherwise(0)
        joined = points.join(F.broadcast(table), F.col("_node") == F.col("_at"), "left")
        points = cut(joined.withColumn("_node", F.col("_node") + F.coalesce(right, F.lit(0))).select(*points.columns))
        nodes = {m: k for n, c in nodes.items() for m, k in ([(n, c // 2), (n + c // 2, c - c // 2)] if c > 1 else [(n, c)])}
    keys = points.select(F.col("_g1").alias("_p1"), F.col("_g2").alias("_p2"), F.col("_salt").alias("_p3"), F.col("_node").alias("_shard"))
    same = (F.col("_g1") == F.col("_p1")) & (F.col("_g2") == F.col("_p2")) & (F.col("_salt") == F.col("_p3"))
    return rows.join(keys, same).select("_doc", "_size", "_crc", "_shard", "_g1")


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row of ``docs``; slots are gapless per shard."""
    placed_rows = cut(kd_assignments(docs, shards, target_bytes))
    buckets = max(64, placed_rows.count() // 50_000)
    placed_rows = placed_rows.withColumn("_bucket", F.pmod(F.xxhash64("_doc", "_g1"), F.lit(buckets)).cast("int"))
    counts = placed_rows.groupBy("_shard", "_bucket").agg(F.count("*").alias("_n"))
    offsets = counts.selectExpr(
        "_shard AS _s", "_bucket AS _b", "sum(_n) OVER (PARTITION BY _shard ORDER BY _bucket) - _n AS _offset")
    numbered = placed_rows.selectExpr(
        "*", "row_number() OVER (PARTITION BY _shard, _bucket ORDER BY _doc, _g1) AS _row")
    return numbered.join(offsets, (F.col("_shard") == F.col("_s")) & (F.col("_bucket") == F.col("_b"))).select(
        F.col("_doc").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"), (F.col("_offset") + F.col("_row") - 1).cast("long").alias("slot"))
