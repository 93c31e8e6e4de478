"""Byte-level BPE encoding and decoding through one global table of distinct words.

1. A task splits its texts into words by the tokenizer's pattern.  The distinct words of a block of documents leave
   pre-aggregated: one row for each bucket of word hashes, with the block's words of that bucket, packed.
2. Words meet by bucket.  The rows of a bucket are read in parts of at most ``PART`` bytes of words; each distinct word
   of a part is encoded once, and every row gets the ids of its words, packed, in their order.  A bucket is one part unless
   it is larger; no table of all words is held anywhere, and a task has one Python worker.
3. The ids go back to their blocks, in the order of the block's words.
4. The documents, split again, send the places of their words in that order; they meet the ids by block, and a
   document's ids are read off by the positions of its words.
5. Decoding looks the ids up in the token-byte table, which the rank file bounds.

Words of one length are merged together: the pair of lowest rank of every word (the first of equals) is joined
until no pair of a word is a token.  Pairs are looked up in hash tables of all splits of all tokens into two
tokens, built once by the driver.  Text without characters above U+FFFF is split by the standard library, with the
classes of the tiktoken library written out.  Words over ``LONG`` bytes go through a heap each, by the same rule.
A word that is itself a token is that token.

Edge cases: null and empty texts have no tokens; a very long document is a block of its own and so bounds the
memory of its task; repeated rows and repeated ids are encoded row by row; extra columns stay out.  The documents are
split twice, which costs less than a second copy of them on disk: they must give the same rows in the same order when a
partition is read again, as files do (write other tables first); a check sum of every block raises an error otherwise.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm import kernel
from ragspark.llm.shared import opened, partitions, sent, text_or_null

LONG = 48
BLOCK = 16 << 20  # bytes of text whose words are numbered together
PART = 4 << 20  # bytes of words of a bucket that are encoded together
WORDS = 1 << 15  # distinct words encoded at a time
NONE = np.int32(2**31 - 1)
KINDS = (r"\p{L}", r"\p{N}", r"\s")
SLICE = 1 << 18  # ids decoded at a time


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, which are their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """All splits of a token into two tokens, hashed, and the bytes of every token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.size = max(ranks.values()) + 1
        pairs = [(ranks[t[:i]] * self.size + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
                 if t[:i] in ranks and t[i:] in ranks]
        keys, made = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.empty(0, np.int64),) * 2
        self.keys, self.made = keys, made.astype(np.int32)
        self.levels = self.slots()
        by_id = [b""] * self.size
        for t, r in ranks.items():
            by_id[r] = t
        self.sizes = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.sizes)[:-1]))
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def slots(self) -> list[tuple[np.uint64, np.ndarray, np.ndarray]]:
        """Hash tables (shift, keys, tokens): a pair is in the first of them in which no earlier pair has its slot."""
        levels, left = [], np.arange(len(self.keys))
        while len(left):
            bits = int(4 * len(left)).bit_length()
            shift = np.uint64(64 - bits)
            slot = self.slot(self.keys[left], len(levels), shift)
            _, first = np.unique(slot, return_index=True)
            keys, made = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE)
            keys[slot[first]], made[slot[first]] = self.keys[left[first]], self.made[left[first]]
            levels.append((shift, keys, made))
            left = np.delete(left, first)
        return levels

    @staticmethod
    def slot(keys: np.ndarray, level: int, shift: np.uint64) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * level)) >> shift).view(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair makes, which is its rank too; ``NONE`` without one."""
        key = (left.astype(np.int64) * self.size + right).ravel()
        out = np.full(len(key), NONE)
        rest, asked = None, key
        for level, (shift, keys, made) in enumerate(self.levels):
            slot = self.slot(asked, level, shift)
            there = keys[slot]
            found = np.where(there == asked, made[slot], NONE)
            if rest is None:
                out = found
            else:
                out[rest] = found
            on = np.flatnonzero((there != asked) & (there >= 0))  # an empty slot ends the search
            if not len(on):
                break
            rest, asked = (on if rest is None else rest[on]), asked[on]
        return out.reshape(left.shape)

    def merge_equal(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length (n x L bytes): (ids n x L from the left, counts)."""
        n, size = words.shape
        ids = self.single[words]
        counts = np.full(n, size)
        if size < 2:
            return ids, counts
        pair = np.full((n, size), NONE)
        pair[:, :-1] = self.joined(ids[:, :-1], ids[:, 1:])
        done, own, steps = np.empty_like(ids), np.arange(n), np.arange(size)
        while len(own):
            at = pair.argmin(axis=1)
            best = pair[np.arange(len(own)), at]
            go = best < NONE
            if not go.all():
                done[own[~go]] = ids[~go]
                own, ids, pair, at, best = own[go], ids[go], pair[go], at[go], best[go]
            row = np.arange(len(own))
            moved = np.minimum(steps + (steps > at[:, None]), size - 1)  # everything after the pair goes one to the left
            moved += row[:, None] * size
            ids, pair = ids.ravel()[moved], pair.ravel()[moved]
            ids[row, at] = best
            counts[own] -= 1
            last = counts[own] - 1
            pair[row, last] = NONE
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < last)
            rows, spot = np.concatenate((before, after)), np.concatenate((at[before] - 1, at[after]))
            pair[rows, spot] = self.joined(ids[rows, spot], ids[rows, spot + 1])
        return done, counts

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges over one word, with a heap of pairs."""
        ids = self.single[np.frombuffer(word, np.uint8)]
        first = self.joined(ids[:-1], ids[1:])
        heap = [(int(first[i]), i) for i in np.flatnonzero(first < NONE).tolist()]
        heapq.heapify(heap)
        ids = ids.tolist()
        end = len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        rank = first.tolist() + [int(NONE)]
        size, ranks = self.size, self.pair_ranks()

        def look(i: int) -> None:
            j = after[i]
            rank[i] = ranks.get(ids[i] * size + ids[j], int(NONE)) if j < end else int(NONE)
            if rank[i] < NONE:
                heapq.heappush(heap, (rank[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            j = after[i]
            ids[i], ids[j], rank[j] = r, -1, -1
            after[i] = after[j]
            if after[j] < end:
                before[after[j]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return [x for x in ids if x >= 0]

    def pair_ranks(self) -> dict[int, int]:
        if not hasattr(self, "_pairs"):
            self._pairs = dict(zip(self.keys.tolist(), self.made.tolist()))
        return self._pairs

    def encode_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many ids each word has)."""
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        counts = (whole >= 0).astype(np.int64)
        made: list[tuple[np.ndarray, np.ndarray]] = [(np.flatnonzero(whole >= 0), whole[whole >= 0])]
        for i in np.flatnonzero((whole < 0) & (sizes > LONG)).tolist():
            ids = np.array(self.merge_long(words[i]), np.int64)
            counts[i] = len(ids)
            made.append((np.array([i]), ids))
        rest = np.flatnonzero((whole < 0) & (sizes <= LONG))
        rest = rest[np.argsort(sizes[rest], kind="stable")]
        cuts = np.flatnonzero(np.diff(sizes[rest], prepend=-1)).tolist()
        for x, y in zip(cuts, [*cuts[1:], len(rest)]):
            size = int(sizes[rest[x]])
            step = (1 << 20) // max(size, 1)
            for k in range(x, y, step):
                rows = rest[k : min(k + step, y)]
                ids, n = self.merge_equal(raw[starts[rows][:, None] + np.arange(size)])
                counts[rows] = n
                made.append((rows, ids[np.arange(size) < n[:, None]]))
        place = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for rows, ids in made:
            flat[kernel.ragged(place[rows], counts[rows])] = ids
        return flat, counts

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of every word."""
        flat, counts = self.encode_flat(words)
        return np.split(flat, np.cumsum(counts)[:-1]) if words else []

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """The bytes of the tokens, a slice at a time."""
        for i in range(0, len(ids), SLICE):
            part = ids[i : i + SLICE]
            yield self.bytes[kernel.ragged(self.starts[part], self.sizes[part])].tobytes()


@functools.cache
def library_classes() -> dict[str, list[int]]:
    """The letters, numbers and white space of the tiktoken library, as code points."""
    import tiktoken

    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    single = {bytes([b]): b for b in range(256)}
    out = {}
    for kind in KINDS:
        there = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks=single, special_tokens={})
        out[kind] = list(map(ord, bytes(there.encode_ordinary(every)).decode()))
    return out


def class_differences() -> dict[int, str]:
    """Characters that the splitting here and in the tiktoken library put in different classes, as stand-ins of the latter's.

    The two follow different versions of Unicode; classes are letters, numbers, white space and the rest.
    """
    import regex

    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    kind_there, kind_here = {}, {}
    for kind, there in library_classes().items():
        kind_there.update(dict.fromkeys(there, kind))
        kind_here.update(dict.fromkeys(map(ord, regex.findall(kind, every)), kind))
    stand_in = {r"\p{L}": "\u3042", r"\p{N}": "\u0660", r"\s": "\u00a0", None: "\u00a1"}
    return {c: stand_in[kind_there.get(c)] for c in {*kind_there, *kind_here} if kind_there.get(c) != kind_here.get(c)}


def plain_pattern(pattern: str) -> str | None:
    """``pattern`` for the standard library, with the tiktoken library's classes below U+10000 written out.

    None for a pattern with more than classes, groups, look-ahead and repeats.  The standard library takes half the time.
    """
    ranges = {}
    for kind, members in library_classes().items():
        code = np.array([c for c in members if c < 0x10000])
        cut = np.flatnonzero(np.diff(code, prepend=-2) != 1)
        ranges[kind] = "".join(f"\\u{code[x]:04x}-\\u{code[y]:04x}" for x, y in zip(cut, [*(cut[1:] - 1), len(code) - 1]))
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|\(\?.|\[\^?\]|\{\D|[?*+}]\+|&&|\|\||--|~~|.", pattern, re.S):
        if part in ranges:
            out.append(ranges[part] if inside else f"[{ranges[part]}]")
        elif part == r"\S" and not inside:
            out.append(f"[^{ranges[chr(92) + 's']}]")
        elif part in (r"\r", r"\n", r"\t", "(?:", "(?!", "(?=") or len(part) == 1 and (part not in "[(" or not inside and part == "["):
            inside = part == "[" or inside and part != "]"
            out.append(part)
        else:
            return None
    return "".join(out)


def splitter(pattern: str, differences: dict[int, str], plain: str | None = None):
    """A function from a text to its words; ``plain``: see ``plain_pattern``."""
    import regex

    compiled = regex.compile(pattern)
    quick = re.compile(plain).findall if plain else None
    odd = np.zeros(0x110000, bool)
    odd[list(differences)] = True

    def words(text: str) -> list[str]:
        if quick and (text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text)):
            return quick(text)
        if not differences or text.isascii() or not odd[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return compiled.findall(text)
        return [text[m.start() : m.end()] for m in compiled.finditer(text.translate(differences))]

    return words


def packed_numbers(x: np.ndarray) -> bytes:
    """32-bit numbers, byte plane by byte plane, compressed."""
    return zlib.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def blocks_of(batches: Iterator[pa.RecordBatch], most: int):
    """(batch, first row, texts, block number, check sum) of every block; the numbers are the same at every reading.

    The batches have ``doc, part, text``; the part is a column because a task of a union has another number.
    """
    number = None
    for batch in batches:
        if number is None and batch.num_rows:
            number = batch.column(1)[0].as_py() << 32
        for i, _, texts in kernel.text_blocks(batch.column(2), most):
            check = 0
            for text in texts:
                check = zlib.crc32(text, check)
            yield batch, i, texts, number, check
            number += 1


def by_bucket(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of a block's distinct words by bucket, and their buckets; a word's place is its rank in this order."""
    own = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % buckets
    return np.argsort(own, kind="stable"), own


def word_batches(words_in: tuple[str, dict[int, str], str | None], block: int, buckets: int):
    """Texts to one row for each block and bucket: the block's distinct words of that bucket, packed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = splitter(*words_in)
        for _, _, texts, number, check in blocks_of(batches, block):
            seen: dict[str, None] = {}
            for text in texts:
                seen.update(dict.fromkeys(words_of(text.decode())))
            words = [w.encode() for w in seen]
            order, own = by_bucket(words, buckets)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            cuts = np.append(np.flatnonzero(np.diff(own[order], prepend=-1)), len(order))
            rows = [
                (int(own[order[x]]), number, check, x, packed_numbers(sizes[order[x:y]]),
                 zlib.compress(b"".join([words[i] for i in order[x:y].tolist()]), 1))
                for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            for k in range(0, len(rows), 1 << 12):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows[k : k + (1 << 12)]), types)],
                    names=["bucket", "block", "check", "place", "sizes", "words"])

    return run


class Numbered(dict):
    """Gives every new key the next number."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def document_batches(words_in: tuple[str, dict[int, str], str | None], block: int, buckets: int):
    """Documents to the places of their words, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = splitter(*words_in)
        for batch, i, texts, number, check in blocks_of(batches, block):
            seen = Numbered()
            found = []
            for text in texts:
                words = words_of(text.decode())
                found.append(np.fromiter(map(seen.__getitem__, words), np.uint32, len(words)))
            order, _ = by_bucket([w.encode() for w in seen], buckets)
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            n = len(texts)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, number)), pa.array(np.full(n, check)), batch.column(0).slice(i, n), pa.array(np.arange(n, dtype=np.int32)),
                pa.array([packed_numbers(place[x]) for x in found], pa.binary())], names=["block", "check", "doc", "place", "packed"])

    return run


def unpacked_rows(batches: Iterator[pa.RecordBatch]):
    """(block, check sum, place, sizes, bytes of the words) of every row."""
    for batch in batches:
        for i in range(batch.num_rows):
            _, block, check, place, sizes, words = (c[i].as_py() for c in batch.columns)
            yield block, check, place, numbers(sizes), zlib.decompress(words)


def parts_of(rows, most: int):
    """Lists of neighbouring rows of at most ``most`` bytes of words together, or one row."""
    part, size = [], 0
    for row in rows:
        if part and size + len(row[4]) > most:
            yield part
            part, size = [], 0
        part.append(row)
        size += len(row[4])
    if part:
        yield part


def encode_words(shared, most: int):
    """Rows of one bucket: each distinct word of a part is encoded once, and its ids joined to all rows of the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges: Merges = opened(shared)
        for part in parts_of(unpacked_rows(batches), most):
            ends = np.concatenate((np.zeros(1, np.int64), *(sizes for _, _, _, sizes, _ in part))).cumsum(dtype=np.int64)
            raw = b"".join([words for _, _, _, _, words in part])
            column = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
            runs = column.dictionary_encode()
            found = [merges.encode_flat(runs.dictionary.slice(i, WORDS).to_pylist()) for i in range(0, len(runs.dictionary), WORDS)]
            flat, counts = (np.concatenate(x) for x in zip(*found))
            starts, own = np.cumsum(counts) - counts, runs.indices.to_numpy()
            rows, x = [], 0
            for block, check, place, sizes, _ in part:
                word = own[x : x + len(sizes)]
                x += len(sizes)
                ids = flat[kernel.ragged(starts[word], counts[word])]
                rows.append((block, check, place, packed_numbers(counts[word]), packed_numbers(ids)))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["block", "check", "place", "sizes", "packed"])

    return run


def reassemble(shared):
    """Rows sorted by block, documents after words: ids of every document, by the places of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges: Merges = opened(shared)
        block, flat, starts, counts = None, None, None, None
        parts: list[tuple[int, np.ndarray, np.ndarray]] = []
        checks: set[int] = set()

        def of_words() -> None:
            nonlocal flat, starts, counts, parts
            counts = np.concatenate([np.empty(0, np.int64), *(numbers(c).astype(np.int64) for _, c, _ in parts)])
            if [p for p, _, _ in parts] != np.concatenate(([0], np.cumsum([len(numbers(c)) for _, c, _ in parts])))[: len(parts)].tolist():
                raise RuntimeError("words of a block are missing: the documents gave other rows when they were read again")
            flat = np.concatenate([np.empty(0, np.uint32), *(numbers(x) for _, _, x in parts)])
            starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))[:-1]
            parts = []

        def result(doc: pa.Array, out: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(x) for _, x in out]))).astype(np.int32)
            decoded = []
            for _, x in out:
                digest = hashlib.sha256()
                for piece in merges.decode(x):
                    digest.update(piece)
                decoded.append(digest.hexdigest())
            return pa.RecordBatch.from_arrays([
                doc.take(pa.array([i for i, _ in out])),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x for _, x in out]).astype(np.int32))),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for _, x in out], pa.string()),
                pa.array(decoded, pa.string())], names=["doc_id", "ids", "ids_sha256", "decoded_sha256"])

        for batch in batches:
            out: list[tuple[int, np.ndarray]] = []
            size = 0
            columns = (batch.column(c).to_pylist() for c in ("block", "check", "place", "sizes", "packed"))
            for i, (number, check, place, sizes, packed) in enumerate(zip(*columns)):
                if number != block:
                    block, parts, flat, checks = number, [], None, set()
                checks.add(check)
                if len(checks) > 1:
                    raise RuntimeError("the documents gave other texts when they were read again")
                if sizes is not None:
                    parts.append((place, sizes, packed))
                    continue
                if flat is None:
                    of_words()
                words = numbers(packed)
                if len(words) and words.max() >= len(counts):
                    raise RuntimeError("words of a block are missing: the documents gave other rows when they were read again")
                ids = flat[kernel.ragged(starts[words], counts[words])]
                out.append((i, ids))
                size += len(ids)
                if size > SLICE:
                    yield result(batch.column("doc"), out)
                    out, size = [], 0
            if out:
                yield result(batch.column("doc"), out)

    return run


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block: int = BLOCK) -> DataFrame:
    """``doc_id, ids, ids_sha256, decoded_sha256`` of every row.

    ``ids_sha256`` is over the ids as little-endian 32-bit words, ``decoded_sha256`` over the bytes that the ids decode to.
    """
    spark = docs.sparkSession
    shared, buckets = sent(spark.sparkContext, Merges(ranks)), partitions(spark)
    words_in = pattern, class_differences(), plain_pattern(pattern)
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select(docs["doc_id"].alias("doc"), F.spark_partition_id().alias("part"), text_or_null(docs).alias("text"))
    words = read.mapInArrow(
        word_batches(words_in, block, buckets), "bucket int, block long, check long, place int, sizes binary, words binary")
    ids = (
        words.repartitionById(buckets, F.col("bucket"))
        .mapInArrow(encode_words(shared, PART), "block long, check long, place int, sizes binary, packed binary")
    )
    documents = read.mapInArrow(
        document_batches(words_in, block, buckets), f"block long, check long, doc {kind}, place int, packed binary")
    blocks = ids.withColumn("doc", F.lit(None).cast(kind)).unionByName(documents.withColumn("sizes", F.lit(None).cast("binary")))
    blocks = blocks.repartition(buckets, "block").sortWithinPartitions("block", F.col("sizes").isNull(), "place")
    return blocks.mapInArrow(reassemble(shared), f"doc_id {kind}, ids array<int>, ids_sha256 string, decoded_sha256 string")


def decode_documents(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``doc_id, decoded`` (bytes) from ``doc_id, ids``; ids beyond the table raise."""
    shared = sent(encoded.sparkSession.sparkContext, Merges(ranks))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges: Merges = opened(shared)
        for batch in batches:
            column = batch.column(1)
            raw = [b"".join(merges.decode(x.values.to_numpy(zero_copy_only=False))) if x.is_valid else None for x in column]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(encoded["doc_id"], encoded["ids"]).mapInArrow(run, f"doc_id {kind}, decoded binary")
