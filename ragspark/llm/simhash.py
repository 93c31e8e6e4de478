"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at most three bits apart meet at a middle one bit from one of them and at most two
from the other.  Fingerprints three bits apart differ in parity, so the odd one alone emits variants
two bits away; and of any three positions two lie in the same half of the word, so pairs of
positions within a half suffice.  An even fingerprint emits 65 variants and an odd one 1 057.

Variants that meet prove a link: all singles at a middle are within two bits of each other, and an odd
fingerprint's pair variant lies within three bits of any even single there.  One link per member to
the first of its middle therefore loses no connection, and no group is expanded into pairs.

The shuffle key of a variant is its fold (xor of slices of ``bits`` bits).  All variants of one
fingerprint with the same fold are sent once, as the fingerprint, and written out again inside the
bucket, so a row stands for some fifty variants.  ``bits`` grows with the logarithm of the number of
distinct fingerprints and a bucket holds about as many at any size.  A bucket verifies its links and
returns a spanning forest of them; the links of all buckets go to ``components``.

Edge cases: null and empty texts and texts of white space have fingerprint zero and are linked like any
other.  Repeated rows and ties give the same fingerprint and component.  Null ids do not become the
component id unless the component has no other id.  Extra columns are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.components import components
from ragspark.llm.shared import cut, text_or_null

RADIUS = 3
PIECE = 1 << 16  # shingles hashed at a time


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the XXH64 of word shingles, repeats included; no words give zero."""
    parts = text.lower().split()
    if not parts:
        return 0
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(words, len(parts))
    a, b = starts[: len(parts) - width + 1].tolist(), ends[width - 1 :].tolist()
    line = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(a), PIECE):
        h = np.array([digest(line[s:e], seed) for s, e in zip(a[i : i + PIECE], b[i : i + PIECE])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(a), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            found = [fingerprint(x.as_py() or b"", words) for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.int64())], names=["_doc", "_key", "_fp"])

    return run


def fold(x, bits: int):
    """Xor of the word's slices of ``bits`` bits; linear, so a variant's fold is a fold of its mask away."""
    out = x
    for shift in range(bits, 64, bits):
        out = out ^ (x >> np.uint64(shift))
    return out & np.uint64((1 << bits) - 1)


def fold_column(x: Column, bits: int) -> Column:
    out = x
    for shift in range(bits, 64, bits):
        out = out.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return out.bitwiseAND(F.lit((1 << bits) - 1))


def masks() -> tuple[np.ndarray, np.ndarray]:
    """Masks of at most one bit, and of two bits within the same half."""
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    pairs = [bit[i] | bit[j] for h in (0, 32) for i in range(h, h + 32) for j in range(i + 1, h + 32)]
    return np.concatenate((np.zeros(1, np.uint64), bit)), np.array(pairs, np.uint64)


def by_fold(m: np.ndarray, bits: int) -> dict[int, np.ndarray]:
    f = fold(m, bits)
    return {int(v): m[f == v] for v in np.unique(f)}


def links_in_bucket(x: np.ndarray, bucket: int, bits: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of fingerprints whose variants meet in this bucket: a forest, as (node, root)."""
    one, two = (by_fold(m, bits) for m in masks())
    away = fold(x, bits) ^ np.uint64(bucket)
    odd = (np.bitwise_count(x) & 1).astype(bool)

    def variants(rows: np.ndarray, table: dict[int, np.ndarray]):
        """Pieces of (variant, owner) in bounded numbers."""
        for value, m in table.items():
            own = rows[away[rows] == value]
            for i in range(0, len(own), max(1, most // len(m))):
                part = own[i : i + max(1, most // len(m))]
                yield (x[part][:, None] ^ m[None, :]).ravel(), np.repeat(part, len(m))

    singles = list(variants(np.arange(len(x)), one))
    if not singles:
        return x[:0], x[:0]
    middle, owner = (np.concatenate(c) for c in zip(*singles))
    order = np.lexsort((odd[owner], middle))  # even owners first at each middle
    middle, owner = middle[order], owner[order]
    head = np.concatenate(([True], middle[1:] != middle[:-1]))
    first = owner[np.flatnonzero(head)[np.cumsum(head) - 1]]
    found = [(owner[owner != first], first[owner != first])]
    goal = head & ~odd[owner]
    spot, host = middle[goal], owner[goal]
    if len(spot):
        seen = np.zeros(1 << 20, bool)
        probe = lambda v: (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
        seen[probe(spot)] = True
        for v, own in variants(np.flatnonzero(odd), two):
            maybe = np.flatnonzero(seen[probe(v)])
            v, own = v[maybe], own[maybe]
            at = np.minimum(np.searchsorted(spot, v), len(spot) - 1)
            hit = spot[at] == v
            found.append((own[hit], host[at[hit]]))
    a, b = (np.concatenate(c) for c in zip(*found))
    near = np.bitwise_count(x[a] ^ x[b]) <= RADIUS
    return forest(x, a[near], b[near])


def forest(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as links (a, b), as one link per member to its root."""
    if not len(a):
        return x[:0], x[:0]
    pairs = np.unique(np.minimum(a, b) * np.int64(len(x)) + np.maximum(a, b))
    a, b = pairs // len(x), pairs % len(x)
    label = np.arange(len(x))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            break
    at = np.flatnonzero(label != np.arange(len(x)))
    return x[at], x[label[at]]


def meet(bits: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        x = np.unique(rows.column("fp").to_numpy()).view(np.uint64)
        a, b = links_in_bucket(x, key[0].as_py(), bits)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return run


def fingerprint_links(fingerprints: DataFrame, count: int) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that keep all their connections."""
    bits = min(30, max(6, math.ceil(math.log2(max(count, 1) * 561 / 2**20))))
    one, two = (sorted(by_fold(m, bits)) for m in masks())
    odd = F.bit_count("fp") % 2 == 1
    wide = F.when(odd, F.lit(sorted({*one, *two}))).otherwise(F.lit(one))
    sent = fingerprints.select("fp", F.explode(wide.cast("array<bigint>")).alias("away"))
    sent = sent.select("fp", fold_column(F.col("fp"), bits).bitwiseXOR(F.col("away")).alias("bucket"))
    return sent.groupBy("bucket").applyInArrow(meet(bits), "a long, b long")


def row_key(docs: DataFrame) -> Column:
    """The same for rows with equal id and text."""
    return F.xxhash64(docs["doc_id"], text_or_null(docs))


def grouped(docs: DataFrame, words: int) -> DataFrame:
    """``_doc, _key, _fp, class, root`` per row: ``class`` names the component, ``root`` is its smallest id."""
    rows = docs.select(docs["doc_id"].alias("_doc"), row_key(docs).alias("_key"), text_or_null(docs).alias("_text"))
    kind = rows.schema["_doc"].dataType.simpleString()
    pairs = cut(rows.mapInArrow(fingerprint_batches(words), f"_doc {kind}, _key long, _fp long"))
    nodes = cut(pairs.groupBy(F.col("_fp").alias("fp")).agg(F.min("_doc").alias("least")))
    labels = components(fingerprint_links(nodes.select("fp"), nodes.count()))
    label = F.coalesce("label", "fp")
    classed = nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", label.alias("class"))
    roots = classed.groupBy("class").agg(F.min("least").alias("root"))
    classed = classed.join(roots, "class").select("fp", "class", "root")
    return pairs.join(classed, F.col("_fp") == F.col("fp"))


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row: fingerprints at most three bits apart are linked.

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the smallest doc_id reachable.
    """
    return grouped(docs, words).select(
        F.col("_doc").alias("doc_id"), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), F.col("root").alias("component_id"))


def one_per_group(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row of ``docs`` for each component: the smallest id, null last, of equal ids the smallest hash of (id, text).

    Rows of different components stay whatever their ids: none is lost by a null or repeated id.
    """
    first = F.min(F.struct(F.col("_doc").isNull().alias("none"), "_doc", "_key"))
    chosen = grouped(docs, words).groupBy("class").agg(first.alias("first")).select(F.col("first._key").alias("_chosen"))
    rows = docs.select(F.struct("*").alias("_doc"), row_key(docs).alias("_key"))
    kept = rows.join(chosen, F.col("_key") == F.col("_chosen"), "left_semi")
    return kept.dropDuplicates(["_key"]).select("_doc.*")
