"""Quality rules on repeated text, from suffix arrays over the words of every document.

A block of documents gets one suffix array over word hashes, by prefix doubling of unresolved suffixes
only.  The ranks after 8 words say which 8-word windows recur.  Neighbours in the suffix array with a
common prefix of ``min_words`` or more form the longest-common-prefix intervals; each member of an
interval spans a maximal repeated substring, the union of all spans is the covered part of the
document, and the longest common prefix is its longest repeat.

Words are runs of ``[^\\x20\\x09-\\x0D]``, compared by 64-bit hash.  Documents are only mapped.

Edge cases: null and empty texts have no words (and fail the minimum); repeated rows are each reported;
very long texts are a block of their own; extra columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm import kernel
from ragspark.llm.kernel import SpanHash
from ragspark.llm.shared import text_or_null
from ragspark.llm.suffixes import common_prefix, suffix_array

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")
WINDOW_LEVEL = 3  # windows of 2^3 words


def repeats(words: np.ndarray, counts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: lies in an 8-word window found twice; lies in a repeat of ``min_words``; longest repeat from here."""
    n = len(words)
    ends = np.repeat(np.cumsum(counts), counts)
    document = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    levels: list[np.ndarray] = []
    sa = suffix_array(words ^ kernel.mix(document + np.uint64(1)), ends, levels)
    none = np.zeros(n, bool)
    longest = np.zeros(n, np.int64)
    window = none
    if len(levels) > WINDOW_LEVEL:
        rank = levels[WINDOW_LEVEL][sa]
        same = rank[1:] == rank[:-1]
        at = sa[np.append(same, False) | np.append(False, same)]
        window = kernel.covered(n, at, at + (1 << WINDOW_LEVEL)) if len(at) else none
    base = min_words.bit_length() - 1
    if len(levels) <= base:
        return window, none, longest
    rank = levels[base][sa]
    pair = np.flatnonzero(rank[1:] == rank[:-1])
    i, j = sa[pair], sa[pair + 1]
    common = common_prefix(i, j, levels, ends)
    i, j, common = (x[common >= min_words] for x in (i, j, common))
    at = np.concatenate((i, j))
    np.maximum.at(longest, at, np.concatenate((common, common)))
    at = np.flatnonzero(longest)
    return window, kernel.covered(n, at, at + longest[at]) if len(at) else none, longest


def block_counts(texts: list[bytes], hasher: SpanHash, tables: tuple, min_words: int) -> list[np.ndarray]:
    letter, symbol = tables
    buf, bounds = kernel.joined(texts)
    member = letter[buf]
    starts, ends = kernel.spans(member)
    counts = np.diff(np.searchsorted(starts, bounds))
    lead = member & ((buf & 0xC0) != 0x80)
    chars = np.add.reduceat(lead, bounds[:-1], dtype=np.int64)
    symbols = np.add.reduceat(symbol[buf], bounds[:-1], dtype=np.int64)

    stop = np.flatnonzero(buf == 10)
    begin = np.concatenate((np.zeros(1, np.int64), stop[:-1] + 1))
    full = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop = begin[full], stop[full]
    home = np.searchsorted(bounds, begin, "right") - 1
    key = hasher(buf, begin, stop) ^ kernel.mix(home.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    again = order[1:][key[order][1:] == key[order][:-1]]
    lines = np.bincount(home[again], minlength=len(texts))

    window, covered, longest = repeats(hasher(buf, starts, ends), counts, min_words)
    position = np.arange(len(starts))
    cuts = np.concatenate(([0], np.cumsum(counts)))
    top = np.zeros(len(texts), np.int64)
    if len(starts):
        has = counts > 0
        top[has] = np.maximum.reduceat(longest, cuts[:-1][has])
    return [counts, chars, symbols, lines, kernel.per_item(window, position, cuts), kernel.per_item(covered, position, cuts), top]


def count_batches(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        symbol = np.zeros(256, np.bool_)
        symbol[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
        for batch in batches:
            found = [block_counts(texts, hasher, (kernel.not_space(), symbol), min_words)
                     for _, _, texts in kernel.text_blocks(batch.column("_text"))]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), *(pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found))],
                    names=["_id", *COUNTS])

    return run


def repetition_report(docs: DataFrame, min_words: int = 5, max_covered: int = 40, max_longest: int = 100) -> DataFrame:
    """``doc_id``, the counts and the verdict of every row of ``docs``.

    ``base_failed``: fewer than 20 words, or over 30 % of them in 8-word windows found twice or more.
    ``kept``: not base_failed, at most ``max_covered`` percent of the words in repeats of at least
    ``min_words`` words, and no repeat of more than ``max_longest`` words.
    """
    if min_words < 1:
        raise ValueError("min_words must be positive")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS)
    counted = docs.select(docs["doc_id"].alias("_id"), text_or_null(docs).alias("_text")).mapInArrow(count_batches(min_words), schema)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    good = (100 * F.col("n_covered") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return counted.select(F.col("_id").alias("doc_id"), *COUNTS, failed.alias("base_failed"), (~failed & good).alias("kept"))
