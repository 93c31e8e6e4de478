"""Benchmark decontamination with an FM-index per shard of training text.

The phrases are the windows of 13 words of every benchmark item (a shorter item is one window).  A
shard is a block of documents of one partition.  Its words become symbols of the phrases' vocabulary;
a word foreign to every phrase ends a run, and runs shorter than the shortest phrase cannot hold one.
Over the runs the shard builds a suffix array, its Burrows-Wheeler transform as a wavelet matrix, and
suffix positions sampled at every eighth symbol of a run.  All phrases are searched backwards at once,
occurrences are located by stepping to a sample, and their word ranges are merged per document.

Documents are only mapped: no shuffle, and a hot passage costs its own occurrences.  Phrases travel in
blocks of bounded size (``PHRASE_BYTES``), one pass over the documents for each block.

Edge cases: a null text has no words; an item without words or with a null id is no phrase; repeated
items count once per id; repeated rows are reported each; an empty benchmark hits nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm import kernel
from ragspark.llm.kernel import SpanHash
from ragspark.llm.shared import opened, sent, text_or_null
from ragspark.llm.suffixes import suffix_array

PHRASE_BYTES = 16 << 20
SHARD = 2 << 20
SAMPLE = 8
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
STATE = "_id string, _text string, _words long, _ranges binary, _items array<string>"
FOUND = "_words long, _hit long, _items array<string>, _spans array<struct<start:int,end:int>>"


def word_bytes() -> np.ndarray:
    """Bytes of the word pattern after lower-casing."""
    return ~kernel.byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


class Phrases:
    """Distinct windows of a block of items, over their vocabulary (symbols from 1)."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            words = WORD.findall(text.lower())
            for i in range(max(1, len(words) - width + 1) if words else 0):
                found.setdefault(tuple(words[i : i + width]), set()).add(item)
        self.windows = list(found)
        self.items = [sorted(x) for x in found.values()]
        vocabulary = sorted({w for x in self.windows for w in x})
        if vocabulary:
            buf, bounds = kernel.joined(vocabulary)
            for seed in range(7, 99):
                self.seed, self.hashes = seed, SpanHash(seed)(buf, bounds[:-1], bounds[1:] - 1)
                if len(np.unique(self.hashes)) == len(vocabulary):
                    break
            order = np.argsort(self.hashes)
            self.hashes = self.hashes[order]
            vocabulary = [vocabulary[i] for i in order]
            self.sizes = np.array([len(w) for w in vocabulary])
        symbol = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.alphabet = len(vocabulary) + 1
        self.lengths = np.array([len(x) for x in self.windows], np.int64)
        self.symbols = np.zeros((len(self.windows), width), np.int64)
        for i, x in enumerate(self.windows):
            self.symbols[i, : len(x)] = [symbol[w] for w in x]


class FMIndex:
    """Full-text index of runs of symbols from 1 to ``alphabet`` - 1; matches stay within a run."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, alphabet: int):
        n = len(text)
        ends = np.append(starts[1:], n)
        sa = suffix_array(text, np.repeat(ends, ends - starts))
        opens = np.zeros(n + 1, bool)
        opens[starts] = True
        bwt = np.where(opens[sa], 0, text[sa - 1])
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet))))
        # the suffixes of one symbol that end a run come first in its block and have no row to step from
        self.skip = self.first[:-1] + np.bincount(text[ends - 1], minlength=alphabet)
        offset = np.arange(n) - np.repeat(starts, ends - starts)
        self.sampled = offset[sa] % SAMPLE == 0
        self.sample = np.where(self.sampled, sa, -1)
        self.bwt = bwt
        self.levels: list[tuple[np.ndarray, int]] = []
        self.depth = max(1, int(alphabet - 1).bit_length())
        for bit in range(self.depth - 1, -1, -1):
            ones = (bwt >> bit) & 1
            count = np.zeros(n + 1, np.int64)
            np.cumsum(ones, out=count[1:])
            self.levels.append((count, n - int(count[-1])))
            bwt = np.concatenate((bwt[ones == 0], bwt[ones == 1]))

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``row`` rows, down the wavelet levels."""
        low, high = np.zeros_like(row), row
        for level, (count, zeros) in enumerate(self.levels):
            one = ((symbol >> (self.depth - 1 - level)) & 1).astype(bool)
            low = np.where(one, zeros + count[low], low - count[low])
            high = np.where(one, zeros + count[high], high - count[high])
        return high - low

    def search(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [lo, hi) of all patterns, by backward search."""
        lo, hi = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        last = symbols[np.arange(len(lengths)), lengths - 1]
        lo[:], hi[:] = self.first[last], self.first[last + 1]
        for back in range(2, symbols.shape[1] + 1):
            at = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(at):
                break
            c = symbols[at, lengths[at] - back]
            lo[at], hi[at] = self.skip[c] + self.rank(c, lo[at]), self.skip[c] + self.rank(c, hi[at])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back until a sampled suffix."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        away = np.flatnonzero(~self.sampled[rows])
        while len(away):
            c = self.bwt[rows[away]]
            rows[away] = self.skip[c] + self.rank(c, rows[away])
            steps[away] += 1
            away = away[~self.sampled[rows[away]]]
        return self.sample[rows] + steps


def occurrences(phrases: Phrases, symbol: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of every occurrence among a shard's words (symbol 0: foreign)."""
    none = np.empty(0, np.int64)
    known = symbol > 0
    if not known.any():
        return none, none
    joins = np.concatenate(([False], known[1:] & known[:-1] & (document[1:] == document[:-1])))
    run = np.cumsum(known & ~joins) - 1
    length = np.bincount(run[known])
    stay = known.copy()
    stay[known] = (length >= phrases.lengths.min())[run[known]]
    word = np.flatnonzero(stay)
    if not len(word):
        return none, none
    starts = np.flatnonzero(np.concatenate(([True], run[word][1:] != run[word][:-1])))
    index = FMIndex(symbol[word], starts, phrases.alphabet)
    lo, hi = index.search(phrases.symbols, phrases.lengths)
    hit = np.flatnonzero(lo < hi)
    rows = kernel.ragged(lo[hit], hi[hit] - lo[hit])
    return word[index.locate(rows)], np.repeat(hit, hi[hit] - lo[hit])


def shard_hits(phrases: Phrases, hasher: SpanHash, member: np.ndarray, texts: list[bytes]):
    """Per document: words, merged word ranges (m x 2), items; and the byte spans of all words."""
    buf, bounds = kernel.joined(texts)
    starts, ends = kernel.spans(member[buf])
    cuts = np.searchsorted(starts, bounds)
    counts = np.diff(cuts)
    document = np.repeat(np.arange(len(texts)), counts)
    symbol = np.zeros(len(starts), np.int64)
    if len(starts):
        h = hasher(buf, starts, ends)
        seen = np.zeros(1 << 20, bool)
        seen[phrases.hashes >> np.uint64(44)] = True
        maybe = np.flatnonzero(seen[h >> np.uint64(44)])
        at = np.minimum(np.searchsorted(phrases.hashes, h[maybe]), len(phrases.hashes) - 1)
        same = (phrases.hashes[at] == h[maybe]) & (phrases.sizes[at] == (ends - starts)[maybe])
        symbol[maybe[same]] = at[same] + 1
    word, phrase = occurrences(phrases, symbol, document)
    hit = kernel.covered(len(starts), word, word + phrases.lengths[phrase]) if len(word) else np.zeros(0, bool)
    ranges: dict[int, np.ndarray] = {}
    items: dict[int, set[str]] = {}
    if len(word):
        # a document's range must not run on into the next one's
        edge = np.zeros(len(starts), bool)
        edge[cuts[:-1][counts > 0]] = True
        begin = np.flatnonzero(hit & np.concatenate(([True], ~hit[:-1])) | hit & edge)
        stop = np.flatnonzero(hit & np.concatenate((~hit[1:], [True])) | hit & np.append(edge[1:], True)) + 1
        for d in np.unique(document[begin]):
            mine = document[begin] == d if len(begin) < 64 else slice(*np.searchsorted(begin, cuts[d : d + 2]))
            ranges[int(d)] = np.stack((begin[mine], stop[mine]), 1) - cuts[d]
        for d, p in np.unique(np.stack((document[word], phrase), 1), axis=0):
            items.setdefault(int(d), set()).update(phrases.items[p])
    return counts, ranges, items, (buf, bounds, starts, ends, cuts)


def union_ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    r = np.concatenate((a, b))
    r = r[np.argsort(r[:, 0], kind="stable")]
    reach = np.maximum.accumulate(r[:, 1])
    begin = np.concatenate(([True], r[1:, 0] > reach[:-1]))
    return np.stack((r[begin, 0], reach[np.append(np.flatnonzero(begin)[1:] - 1, len(r) - 1)]), 1)


def char_spans(where: tuple, d: int, ranges: np.ndarray) -> list[dict[str, int]]:
    """Word ranges of document d as code point spans of its text."""
    buf, bounds, starts, ends, cuts = where
    lead = np.zeros(bounds[d + 1] - bounds[d] + 1, np.int64)
    np.cumsum((buf[bounds[d] : bounds[d + 1]] & 0xC0) != 0x80, out=lead[1:])
    a, b = starts[cuts[d] + ranges[:, 0]] - bounds[d], ends[cuts[d] + ranges[:, 1] - 1] - bounds[d]
    return [{"start": int(s), "end": int(e)} for s, e in zip(lead[a], lead[b])]


def search_pass(shared, last: bool):
    """One pass over documents in ``STATE`` columns with one block of phrases, merging what earlier ones found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = opened(shared)
        hasher, member = SpanHash(phrases.seed), word_bytes()
        for batch in batches:
            for i, j, texts in kernel.text_blocks(batch.column("_text"), SHARD):
                counts, ranges, items, where = shard_hits(phrases, hasher, member, [x.lower() for x in texts])
                part = batch.slice(i, j - i)
                merged, names, spans, hits = [], [], [], []
                for d, (old, known) in enumerate(zip(part.column("_ranges").to_pylist(), part.column("_items").to_pylist())):
                    new = ranges.get(d)
                    before = np.frombuffer(old, "<i8").reshape(-1, 2) if old else None
                    now = new if before is None else before if new is None else union_ranges(before, new)
                    merged.append(None if now is None else now.astype("<i8").tobytes())
                    names.append(sorted({*(known or ()), *items.get(d, ())}))
                    hits.append(0 if now is None else int((now[:, 1] - now[:, 0]).sum()))
                    spans.append([] if now is None or not last else char_spans(where, d, now))
                words = pa.array(counts, pa.int64())
                listed = pa.array(names, pa.list_(pa.string()))
                if last:
                    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("_id"), words, pa.array(hits, pa.int64()), listed, pa.array(spans, kind)],
                        names=["_id", "_words", "_hit", "_items", "_spans"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [part.column("_id"), part.column("_text"), words, pa.array(merged, pa.binary()), listed],
                        names=["_id", "_text", "_words", "_ranges", "_items"])

    return run


def phrase_blocks(benchmark: DataFrame, width: int) -> list[Phrases]:
    """Windows of all items, in blocks of about ``PHRASE_BYTES`` of item text."""
    items = benchmark.select(benchmark["item_id"].cast("string").alias("item"), text_or_null(benchmark).alias("text")).where(
        "item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = math.ceil(size / PHRASE_BYTES)
    out = []
    for k in range(n):
        mine = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        block = Phrases([(r.item, r.text.encode()) for r in mine.toLocalIterator()], width)
        if block.windows:
            out.append(block)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans`` of every row of ``docs``.

    A word is hit if it lies in an occurrence of a window of ``width`` words of an item; ``items`` are the
    ids of items with an occurring window, sorted as strings; ``spans`` are the merged hit ranges in code
    points, half open, for removal.
    """
    blocks = phrase_blocks(benchmark, width)
    kind = docs.schema["doc_id"].dataType.simpleString()
    state = docs.select(
        docs["doc_id"].alias("_id"), text_or_null(docs).alias("_text"), F.lit(0).cast("long").alias("_words"),
        F.lit(None).cast("binary").alias("_ranges"), F.array().cast("array<string>").alias("_items"))
    for k, block in enumerate(blocks or [None]):
        if block is None:
            lowered = F.regexp_replace(F.lower("_text"), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "a")
            none = F.array().cast("array<struct<start:int,end:int>>")
            count = F.coalesce(F.length(F.regexp_replace(lowered, "[^a]", "")), F.lit(0)).cast("long")
            return state.select(F.col("_id").alias("doc_id"), count.alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
                                F.col("_items").alias("items"), none.alias("spans"))
        last = k == len(blocks) - 1
        schema = f"_id {kind}, {FOUND}" if last else STATE.replace("_id string", f"_id {kind}")
        state = state.mapInArrow(search_pass(sent(docs.sparkSession.sparkContext, block), last), schema)
    return state.select(F.col("_id").alias("doc_id"), F.col("_words").alias("n_words"), F.col("_hit").alias("n_hit"),
                        F.col("_items").alias("items"), F.col("_spans").alias("spans"))


def contaminated(n_hit="n_hit", n_words="n_words"):
    """At least one hit word, and hit words a twentieth of all or more."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def without_spans(text, spans):
    """``text`` without the ranges ``spans`` (start and end in code points, ordered, disjoint)."""
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text)))
    return F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a)), "")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """``docs`` without the contaminated documents, and without the hit spans of the others.

    Rows are joined back by (id, text), so rows that share an id are judged each by its own text.  A document that
    loses spans has its ``n_chars`` counted anew, if there is such a column; the others are unchanged.
    """
    text = text_or_null(docs)
    key = F.xxhash64(docs["doc_id"], text)
    tagged = docs.select(F.struct("*").alias("_doc"), key.alias("_key"))
    flat = docs.select(key.alias("doc_id"), text.alias("text"))
    hit = contamination(flat, benchmark, width).where("n_hit > 0").select(
        F.col("doc_id").alias("_key"), contaminated().alias("_bad"), F.col("spans").alias("_spans")).dropDuplicates(["_key"])
    left = without_spans(F.col("_doc.text").cast("string"), F.col("_spans"))
    mended = F.col("_doc").withField("text", left.cast(docs.schema["text"].dataType))
    if "n_chars" in docs.columns:
        mended = mended.withField("n_chars", F.char_length(left).cast(docs.schema["n_chars"].dataType))
    kept = tagged.join(hit, "_key", "left").where("_bad is null or not _bad")
    return kept.select(F.when(F.col("_spans").isNull(), F.col("_doc")).otherwise(mended).alias("_doc")).select("_doc.*")
