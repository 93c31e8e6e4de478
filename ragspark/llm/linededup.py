"""Line dedup: lines that many documents share, found by range-partitioned line hashes.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; the key is known by its
128-bit hash.  Rows are one per document and distinct key, with the positions of its lines.  They are
range-partitioned by (hash, document) and sorted, so a key that a third of all lines carry spreads
over as many partitions as it fills.  Each partition streams its rows; a group that touches a
partition's edge takes its count from a small table of edge groups (two per partition).  The result is
a compressed bitmap of kept lines per document that loses any; text is not shuffled for the search.

Edge cases: null or empty text is one empty line, which has no key and stays.  A document is a row; rows
equal in id and text are one document and each gets the same bitmap.  Rows that share an id but not
the text are different documents.  Null ids are allowed.  Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.llm.kernel import SPACE
from ragspark.llm.shared import cut, partitions, text_or_null

ROWS = "_h1 long, _h2 long, _id string, _d1 long, _d2 long, _lines int, _at binary"
EDGES = "h1 long, h2 long, part int, n long, open boolean"


def identity(docs: DataFrame) -> list[Column]:
    """128 bits that stand for the document: its id and text."""
    doc_id, text = docs["doc_id"].cast("string"), text_or_null(docs)
    flags = F.isnull(doc_id).cast("int") + 2 * F.isnull(text).cast("int")
    return [F.xxhash64(F.lit(1), flags, doc_id, text).alias("_d1"), F.xxhash64(F.lit(2), flags, text, doc_id).alias("_d2")]


def key_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, d1, d2 = (batch.column(i).to_pylist() for i in range(3))
            texts = batch.column(3).cast(pa.binary())
            out: list[tuple] = []
            size = 0
            for i in range(batch.num_rows):
                lines = (texts[i].as_py() or b"").split(b"\n")
                at: dict[bytes, list[int]] = {}
                for n, line in enumerate(lines):
                    line = line.strip(SPACE)
                    if line and (min_chars <= 1 or len(line.decode("utf-8", "replace")) >= min_chars):
                        at.setdefault(xxhash.xxh3_128_digest(line.lower()), []).append(n)
                for key, places in at.items():
                    out.append((key, i, len(lines), np.array(places, "<u4").tobytes()))
                    size += 4 * len(places)
                if len(out) > 200_000 or size > 16 << 20:
                    yield packed(out, ids, d1, d2)
                    out, size = [], 0
            if out:
                yield packed(out, ids, d1, d2)

    def packed(out, ids, d1, d2) -> pa.RecordBatch:
        keys = np.frombuffer(b"".join(x[0] for x in out), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([ids[x[1]] for x in out], pa.string()),
             pa.array([d1[x[1]] for x in out], pa.int64()), pa.array([d2[x[1]] for x in out], pa.int64()),
             pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.binary())],
            names=["_h1", "_h2", "_id", "_d1", "_d2", "_lines", "_at"],
        )

    return run


def arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("_h1", "_h2", "_d1", "_d2")}


def fresh(a: dict[str, np.ndarray], names: tuple[str, ...], last: tuple | None) -> np.ndarray:
    """Rows that differ from the row before in any of the columns; ``last`` is the row before the first."""
    new = np.ones(len(a["_h1"]), bool)
    if len(new):
        same = np.logical_and.reduce([a[c][1:] == a[c][:-1] for c in names])
        new[1:] = ~same
        new[0] = last is None or last != tuple(int(a[c][0]) for c in names)
    return new


KEY, ROW = ("_h1", "_h2"), ("_h1", "_h2", "_d1", "_d2")


def edge_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in the first and the last group of this partition; ``open`` marks the last."""
    first: list | None = None
    key: tuple | None = None
    row: tuple | None = None
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        a = arrays(batch)
        start, whole = fresh(a, KEY, key), fresh(a, ROW, row)
        at = np.flatnonzero(start)
        if len(at) == 0:
            n += int(whole.sum())
        else:
            if key is not None and first is None:
                first = [*key, n + int(whole[: at[0]].sum())]
            elif key is None and len(at) > 1:
                first = [int(a["_h1"][0]), int(a["_h2"][0]), int(whole[: at[1]].sum())]
            n = int(whole[at[-1] :].sum())
        key, row = (tuple(int(a[c][-1]) for c in names) for names in (KEY, ROW))
    part = TaskContext.get().partitionId()
    found = ([(*first[:2], part, first[2], False)] if first else []) + ([(*key, part, n, True)] if key else [])
    yield pa.RecordBatch.from_pylist(
        [dict(zip(("h1", "h2", "part", "n", "open"), x)) for x in found],
        pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("open", pa.bool_())]),
    )


def drop_rows(edges: list[tuple[int, int, int, int]], min_docs: int, keep_first: bool):
    """Stream a sorted partition and yield the lines that go, per (hash, document) row.

    A group's documents are held back only until ``min_docs`` of them have been seen.
    """
    totals: dict[tuple[int, int], int] = {}
    start: dict[tuple[int, int], int] = {}
    for h1, h2, part, n in edges:
        totals[h1, h2] = totals.get((h1, h2), 0) + n
        start[h1, h2] = min(part, start.get((h1, h2), part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: pa.Table | None = None
        row: tuple | None = None
        seen: tuple[int, int] | None = None  # a group whose first document has gone by
        for batch in batches:
            a = arrays(batch)
            keep = fresh(a, ROW, row)
            if batch.num_rows:
                row = tuple(int(a[c][-1]) for c in ROW)
            rows = pa.Table.from_batches([batch]).filter(pa.array(keep))
            held = rows if held is None else pa.concat_tables([held, rows])
            if not held.num_rows:
                continue
            out, held, seen = decided(held, part, seen, final=False)
            yield from out
        if held is not None and held.num_rows:
            yield from decided(held, part, seen, final=True)[0]

    def decided(rows: pa.Table, part: int, seen, final: bool):
        a = {c: rows.column(c).to_numpy() for c in KEY}
        new = fresh(a, KEY, None)
        at = np.append(np.flatnonzero(new), rows.num_rows)
        sizes = np.diff(at)
        go = np.repeat(sizes >= min_docs, sizes)
        head = new.copy()
        for k in {0, len(sizes) - 1}:  # only groups at the ends can be parts of larger ones
            key = (int(a["_h1"][at[k]]), int(a["_h2"][at[k]]))
            if key in totals:
                go[at[k] : at[k + 1]] = totals[key] >= min_docs
                head[at[k]] &= start[key] == part
            if seen is not None and key == seen:
                go[at[k] : at[k + 1]] = True
                head[at[k]] = False
        last = (int(a["_h1"][at[-2]]), int(a["_h2"][at[-2]]))
        tail = at[-2]
        if final or last in totals or go[tail]:
            end = rows.num_rows
            seen = last if go[tail] else None
        else:
            end, seen = tail, None
        take = np.flatnonzero(go[:end])
        out = []
        if len(take):
            picked = rows.take(pa.array(take)).select(["_d1", "_d2", "_lines", "_at"])
            if keep_first:
                first = head[take]
                places = [x[4:] if f else x for x, f in zip(picked.column("_at").to_pylist(), first)]
                picked = picked.set_column(3, "_at", pa.array(places, pa.binary()))
            out = picked.combine_chunks().to_batches()
        return out, rows.slice(end), seen

    return run


def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, gone = [], []
        for n, parts in zip(batch.column("_lines").to_pylist(), batch.column("_parts").to_pylist()):
            keep = np.ones(n, bool)
            keep[np.frombuffer(b"".join(parts), "<u4")] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            gone.append(int(n - keep.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_d1"), batch.column("_d2"), pa.array(gone, pa.int64()), pa.array(maps, pa.binary())],
            names=["_d1", "_d2", "n_dropped", "keep_bitmap"],
        )


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``_d1, _d2, n_dropped, keep_bitmap`` of every document that loses lines.

    A key of at least ``min_chars`` code points that ``min_docs`` documents hold loses all its lines, or
    with ``keep_first`` all but the first line of its first document.  ``keep_bitmap`` is the zlib form
    of packed bits, one per line.  (_d1, _d2) is ``identity(docs)``.
    """
    spark = docs.sparkSession
    source = docs.select(docs["doc_id"].cast("string").alias("_id"), *identity(docs), text_or_null(docs).alias("_text"))
    order = ("_h1", "_h2", "_id", "_d1", "_d2")
    rows = cut(
        source.mapInArrow(key_rows(min_chars), ROWS).repartitionByRange(partitions(spark), *order)
        .sortWithinPartitions(*order)
    )
    narrow = rows.select(*ROW)
    edges = [(r.h1, r.h2, r.part, r.n) for r in narrow.mapInArrow(edge_groups, EDGES).collect()]
    gone = rows.mapInArrow(drop_rows(edges, min_docs, keep_first), "_d1 long, _d2 long, _lines int, _at binary")
    per_doc = gone.groupBy("_d1", "_d2").agg(F.max("_lines").alias("_lines"), F.collect_list("_at").alias("_parts"))
    return per_doc.mapInArrow(bitmaps, "_d1 long, _d2 long, n_dropped long, keep_bitmap binary")


def kept_text(text: bytes | None, bitmap: bytes | None) -> bytes | None:
    if bitmap is None:
        return text
    lines = (text or b"").split(b"\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    return b"\n".join([x for x, k in zip(lines, keep) if k])


def attached(docs: DataFrame, maps: DataFrame, *columns: Column) -> DataFrame:
    """``docs`` with the bitmaps beside them under working names, plus ``columns``."""
    mine = docs.select(F.struct("*").alias("_doc"), text_or_null(docs).alias("_text"), *identity(docs))
    theirs = maps.select(F.col("_d1").alias("_e1"), F.col("_d2").alias("_e2"), F.col("n_dropped").alias("_gone"), "keep_bitmap")
    return mine.join(theirs, (F.col("_d1") == F.col("_e1")) & (F.col("_d2") == F.col("_e2")), "left")


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``docs`` with the text less its dropped lines; the other columns as they were.

    ``n_chars``, where there is such a column, is counted anew.  A null text stays null.
    """
    joined = attached(docs, keep_bitmaps(docs, min_docs, min_chars, keep_first))

    @F.pandas_udf(T.StringType())
    def apply(text, bitmap):
        return pd.Series([None if t is None else kept_text(t.encode(), b).decode() for t, b in zip(text, bitmap)])

    text = F.when(F.col("keep_bitmap").isNull(), F.col("_text")).otherwise(apply("_text", "keep_bitmap"))
    named = joined.withColumn("_kept", text)
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("_kept").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("keep_bitmap").isNull(), F.col("_doc.n_chars")).otherwise(F.char_length("_kept")).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"_doc.`{c}`").alias(c))
    return named.select(*out)


def line_report(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row: the digest of ``keep_bitmaps``."""
    joined = attached(docs, keep_bitmaps(docs, min_docs, min_chars))

    @F.pandas_udf(T.StringType())
    def digest(text, bitmap):
        return pd.Series([hashlib.sha256(kept_text(t.encode(), b)).hexdigest() for t, b in zip(text, bitmap)])

    text = F.coalesce(F.col("_text"), F.lit(""))
    whole = F.sha2(text.cast("binary"), 256)
    return joined.select(
        F.col("_doc.doc_id").alias("doc_id"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce("_gone", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("keep_bitmap").isNull(), whole).otherwise(digest(text, F.col("keep_bitmap"))).alias("kept_sha256"),
    )
