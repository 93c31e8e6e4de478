"""WordPiece ids by greedy longest match, all distinct words of a block at once.

The vocabulary is kept as sorted hashes of its pieces, one list for each length, heads and continuations apart.
Words are one array of code points with running polynomial hashes, so the hash of any stretch is a difference.
In each round every unfinished word probes the lengths from the longest down, and those that match move on
together: the number of numpy steps follows the longest word (at most ``MAX_WORD``), not the number of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions import text as T
from ragspark.operators.chunking import WINDOW_LENGTH, id_windows, window_rows
from ragspark.operators.embedding import token_blocks

UNKNOWN, PADDING, START, END = "[UNK]", "[PAD]", "[CLS]", "[SEP]"
UNKNOWN_ID, MAX_WORD = 100, 100  # fixed values
MAX_VOCABULARY = 1_000_000


PIECE = 1 << 20  # code points hashed together


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Pieces:
    """Sorted hashes of a vocabulary's pieces by length, and the longest match of many words."""

    BASE = 0xA0761D6478BD642F  # odd, so it has an inverse

    def __init__(self, vocabulary: dict[str, int], unknown: int):
        self.unknown = unknown
        powers = np.full(PIECE + MAX_WORD + 1, self.BASE, np.uint64)
        back = np.full(PIECE + MAX_WORD + 1, pow(self.BASE, -1, 2**64), np.uint64)
        powers[0] = back[0] = 1
        self.power, self.inverse = np.cumprod(powers), np.cumprod(back)
        self.heads = self._by_length(vocabulary)
        self.tails = self._by_length({t[2:]: i for t, i in vocabulary.items() if t.startswith("##")})

    def _by_length(self, pieces: dict[str, int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        sizes: dict[int, list[str]] = {}
        for piece in pieces:
            if 0 < len(piece) <= MAX_WORD:
                sizes.setdefault(len(piece), []).append(piece)
        out = []
        for size in sorted(sizes, reverse=True):
            hashes = []
            for i in range(0, len(sizes[size]), PIECE // size):
                part = sizes[size][i : i + PIECE // size]
                hashes.append(self._hash(self._running("".join(part)), np.arange(len(part)) * size, size))
            keys, ids = np.concatenate(hashes), np.array([pieces[x] for x in sizes[size]], np.int32)
            order = np.argsort(keys)
            out.append((size, keys[order], ids[order]))
        return out

    def _running(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_mixed(points + np.uint64(1)) * self.power[: len(points)], out=total[1:])
        return total

    def _hash(self, running: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
        return (running[start + size] - running[start]) * self.inverse[start]

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each has; a miss makes the whole word unknown, as does its length."""
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        owner, ids = [np.flatnonzero(sizes > MAX_WORD)], []
        ids.append(np.full(len(owner[0]), self.unknown, np.int32))
        rows = np.flatnonzero((sizes > 0) & (sizes <= MAX_WORD))
        text = words.take(pa.array(rows)).to_pylist()
        ends = np.cumsum(sizes[rows])
        low = 0
        while low < len(rows):
            done = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + PIECE, "right")))
            w, found = self._match("".join(text[low:high]), ends[low:high] - sizes[rows[low:high]] - done, ends[low:high] - done)
            owner.append(rows[low + w])
            ids.append(found)
            low = high
        owner, ids = np.concatenate(owner), np.concatenate(ids)
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _match(self, text: str, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, id) of every piece, the pieces of a word in order."""
        running, at = self._running(text), at.copy()
        active, table = np.arange(len(at)), self.heads
        missed = np.zeros(len(at), bool)
        words, ids = [], []
        while len(active):
            left = end[active] - at[active]
            got, step = np.full(len(active), -1, np.int64), np.zeros(len(active), np.int64)
            open_ = np.arange(len(active))
            for size, keys, found in table:
                fits = open_[left[open_] >= size]
                if not len(fits):
                    continue
                h = self._hash(running, at[active[fits]], size)
                place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[place] == h
                got[fits[hit]], step[fits[hit]] = found[place[hit]], size
                open_ = open_[step[open_] == 0]
            good = step > 0
            missed[active[~good]] = True
            words.append(active[good])
            ids.append(got[good].astype(np.int32))
            at[active] += step
            active, table = active[good & (step < left)], self.tails
        word, found = np.concatenate(words), np.concatenate(ids)
        whole = ~missed[word]
        lost = np.flatnonzero(missed)
        return np.concatenate((word[whole], lost)), np.concatenate((found[whole], np.full(len(lost), self.unknown, np.int32)))


def _ids_of(words: pa.ListArray, pieces: Pieces) -> pa.Array:
    """Ids of each text: the pieces of its words, in order."""
    encoded = pc.list_flatten(words).dictionary_encode()
    ids, counts = pieces.encode(encoded.dictionary)
    bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
    per_word = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())).take(encoded.indices)
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts[encoded.indices.to_numpy(zero_copy_only=False)])))
    stops = words.offsets.to_numpy() - words.offsets[0].as_py()
    return pa.ListArray.from_arrays(pa.array(ends[stops], pa.int32()), pc.list_flatten(per_word))


class WordPiece:
    """Token ids and framed windows for a vocabulary (token -> id, at most ``MAX_VOCABULARY`` entries)."""

    def __init__(self, spark: SparkSession, vocabulary: dict[str, int]):
        if START not in vocabulary or END not in vocabulary:
            raise ValueError("vocabulary is incomplete")
        if len(vocabulary) > MAX_VOCABULARY:
            raise ValueError("vocabulary is too large to share with every executor")
        self.vocabulary = vocabulary
        self._shared = spark.sparkContext.broadcast(vocabulary)

    @classmethod
    def from_table(cls, vocabulary: DataFrame) -> WordPiece:
        """From rows ``token, id``; a table beyond ``MAX_VOCABULARY`` is refused before it is gathered."""
        rows = vocabulary.select("token", F.col("id").cast("int")).limit(MAX_VOCABULARY + 1).toArrow()
        return cls(vocabulary.sparkSession, dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())))

    def ids(self, text: Column) -> Column:
        shared, unknown = self._shared, self.vocabulary.get(UNKNOWN, UNKNOWN_ID)
        ready: list[Pieces] = []  # built once a task

        @F.arrow_udf("array<int>")
        def encode(words: pa.Array) -> pa.Array:
            if not ready:
                ready.append(Pieces(shared.value, unknown))
            return pa.concat_arrays([_ids_of(part, ready[0]) for part in token_blocks(words)])

        return encode(T.pretokens(text))

    def windows(self, df: DataFrame, text_col: str = "text", out: str = "windows", max_length: int = WINDOW_LENGTH) -> DataFrame:
        """Add the framed windows of each text."""
        v = self.vocabulary
        framed = id_windows(F.col("_ids"), v[START], v[END], v.get(PADDING, 0), max_length)
        return df.withColumn("_ids", self.ids(F.col(text_col))).withColumn(out, framed).drop("_ids")

    def window_rows(self, df: DataFrame, text_col: str = "text", max_length: int = WINDOW_LENGTH) -> DataFrame:
        """One row per framed window of each text."""
        v = self.vocabulary
        encoded = df.withColumn("_ids", self.ids(F.col(text_col)))
        return window_rows(encoded, "_ids", v[START], v[END], v.get(PADDING, 0), max_length)
