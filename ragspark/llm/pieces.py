"""SentencePiece encoding and decoding with a batched Viterbi search in numpy.

A text is escaped as the model file prescribes: one space in front, spaces as U+2581.  No piece crosses
from other characters to a space, so a text falls into units (spaces and what follows them), and each
distinct unit of a block is encoded once.  Units of equal byte length advance together: for every start
the hash of each substring is extended by one byte, probed in the sorted hashes of the pieces, and the
best score at its end is raised with its piece as the backpointer.  Bytes that no piece covers fall back
to byte pieces, at a score below any other path.

The result is the segmentation of highest total score under the scores of the model file; of equal
scores the one whose last piece is longest.  For a model trained by merging that need not be the
merge order's segmentation.  Decoding joins the pieces and takes the leading space away; it gives back
every text exactly, U+2581 in the text included, which is encoded by bytes.

Edge cases: null text gives null, empty text no pieces; repeated rows are each encoded; units too long
for batching (over ``LONG`` bytes) are searched one by one by the same rule; extra columns stay out.
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

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONG = 64
BLOCK = 2 << 20
SLICE = 1 << 18  # pieces decoded at a time
SLAB = 1 << 16
FALLBACK = -1e6  # per byte; scores of pieces are above -1e5
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)


def read_pieces(path: str) -> list[tuple[bytes, float, bool]]:
    """(bytes, score, is a byte piece) of every id; control and unknown pieces are empty."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            out.append((b"", 0.0, False))
        elif model.is_byte(i):
            out.append((bytes([int(piece[3:5], 16)]), FALLBACK, True))
        else:
            # the mark becomes a plain space; a space of the text is the only source of it
            out.append((piece.replace("▁", " ").encode(), float(model.get_score(i)), False))
    return out


class Vocabulary:
    def __init__(self, pieces: list[tuple[bytes, float, bool]]):
        rng = np.random.default_rng(11)
        self.value = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.byte_id = np.full(256, -1, np.int64)
        keys, ids, scores = [], [], []
        for i, (raw, score, is_byte) in enumerate(pieces):
            if is_byte:
                self.byte_id[raw[0]] = i
            elif raw:
                keys.append(self.hash(raw))
                ids.append(i)
                scores.append(score)
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte fallback")
        order = np.argsort(np.array(keys, np.uint64))
        self.keys, self.ids = np.array(keys, np.uint64)[order], np.array(ids)[order]
        self.scores = np.array(scores)[order]
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces share a hash")
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.slot(self.keys)] = True
        self.longest = max((len(raw) for raw, _, b in pieces if not b), default=1)
        self.sizes = np.array([len(raw) for raw, _, _ in pieces], np.int64)
        self.starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.sizes)[:-1]))
        self.bytes = np.frombuffer(b"".join(raw for raw, _, _ in pieces), np.uint8)

    def hash(self, raw: bytes) -> int:
        h = 0
        for b in raw:
            h = (h * int(HASH_BASE) + int(self.value[b])) % 2**64
        return h

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(42)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces, and where in the sorted keys."""
        maybe = np.flatnonzero(self.seen[self.slot(h)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        good = self.keys[at] == h[maybe]
        return maybe[good], at[good]

    def viterbi(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of equal-length units (n x L bytes), as (ids n x L from the right, counts)."""
        n, size = units.shape
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((size + 1, n), np.int32)
        step = np.ones((size + 1, n), np.int32)
        column = np.ascontiguousarray(units.T)
        value = self.value[column]
        for s in range(size):
            here = best[s]
            score = here + FALLBACK
            better = score > best[s + 1]
            best[s + 1][better] = score[better]
            back[s + 1][better] = self.byte_id[column[s][better]]
            step[s + 1][better] = 1
            h = np.zeros(n, np.uint64)
            for e in range(s + 1, min(size, s + self.longest) + 1):
                h = h * HASH_BASE + value[e - 1]
                rows, at = self.find(h)
                if len(rows):
                    score = here[rows] + self.scores[at]
                    up = score > best[e][rows]
                    rows, at = rows[up], at[up]
                    best[e][rows] = score[up]
                    back[e][rows] = self.ids[at]
                    step[e][rows] = e - s
        ids = np.zeros((n, size), np.int32)
        counts = np.zeros(n, np.int64)
        end = np.full(n, size)
        alive = np.arange(n)
        while len(alive):
            e = end[alive]
            ids[alive, counts[alive]] = back[e, alive]
            counts[alive] += 1
            end[alive] = e - step[e, alive]
            alive = alive[end[alive] > 0]
        return ids, counts

    def viterbi_long(self, unit: np.ndarray) -> np.ndarray:
        """The same search over one long unit, slab by slab; the substrings of a slab are probed a length at a time."""
        size = len(unit)
        best = np.zeros(size + 1)
        back, step = np.zeros(size + 1, np.int32), np.ones(size + 1, np.int64)
        ends: dict[int, list[tuple[int, int]]] = {}
        for low in range(0, size, SLAB):
            value = self.value[unit[low : low + SLAB + self.longest]]
            h = np.zeros(min(SLAB, size - low), np.uint64)
            for k in range(1, min(size - low, self.longest) + 1):
                h = h[: len(value) - k + 1] * HASH_BASE + value[k - 1 : k - 1 + len(h[: len(value) - k + 1])]
                rows, at = self.find(h)
                for s, a in zip((rows + low).tolist(), at.tolist()):
                    ends.setdefault(s + k, []).append((s, a))
            for e in range(low + 1, min(low + SLAB, size) + 1):
                top, start, piece = best[e - 1] + FALLBACK, e - 1, self.byte_id[unit[e - 1]]
                for s, a in sorted(ends.pop(e, ())):
                    score = best[s] + self.scores[a]
                    if score > top:
                        top, start, piece = score, s, self.ids[a]
                best[e], back[e], step[e] = top, piece, e - start
        out, e = [], size
        while e:
            out.append(back[e])
            e -= step[e]
        return np.array(out, np.int32)

    def encode_units(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all units: flat ids, and each unit's offset and count."""
        sizes = ends - starts
        counts = np.zeros(len(starts), np.int64)
        offsets = np.zeros(len(starts), np.int64)
        flat: list[np.ndarray] = []
        total = 0
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            step = max(1, (1 << 20) // int(size)) if size <= LONG else 1
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                if size <= LONG:
                    ids, n = self.viterbi(buf[starts[part][:, None] + np.arange(size)])
                    at = np.arange(ids.shape[1])
                    turned = np.take_along_axis(ids, np.maximum(n[:, None] - 1 - at, 0), 1)
                    flat.append(turned[at < n[:, None]])
                else:
                    ids = self.viterbi_long(buf[starts[part[0]] : ends[part[0]]])
                    n = np.array([len(ids)])
                    flat.append(ids[::-1])
                counts[part] = n
                offsets[part] = total + np.concatenate(([0], np.cumsum(n)[:-1]))
                total += int(n.sum())
        return np.concatenate(flat) if flat else np.empty(0, np.int32), offsets, counts


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.hasher = SpanHash(13)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of every text."""
        raw = [b" " + x if x else b"" for x in texts]
        bounds = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(x) for x in raw], out=bounds[1:])
        buf = np.frombuffer(b"".join(raw), np.uint8)
        if not len(buf):
            return np.empty(0, np.int32), np.zeros(len(raw), np.int64)
        space = buf == 32
        begin = space & np.concatenate(([True], ~space[:-1]))
        begin[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(buf))
        _, one, inverse = np.unique(self.hasher(buf, starts, ends), return_index=True, return_inverse=True)
        flat, offsets, counts = self.v.encode_units(buf, starts[one], ends[one])
        ids = flat[kernel.ragged(offsets[inverse], counts[inverse])]
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts[inverse])))
        cuts = np.searchsorted(starts, bounds)
        return ids, total[cuts[1:]] - total[cuts[:-1]]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Texts of consecutive runs of ids."""
        sizes = self.v.sizes[ids]
        raw = b"".join(
            self.v.bytes[kernel.ragged(self.v.starts[ids[i : i + SLICE]], sizes[i : i + SLICE])].tobytes()
            for i in range(0, len(ids), SLICE))
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
        cuts = total[np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))].tolist()
        return [raw[a + 1 : b] if b > a else b"" for a, b in zip(cuts, cuts[1:])]


def encode_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Vocabulary(shared.value))
        for batch in batches:
            column = batch.column(1)
            for i, j, texts in kernel.text_blocks(column, BLOCK):
                ids, counts = codec.encode(texts)
                back = codec.decode(ids, counts)
                null = np.asarray(column.slice(i, j - i).is_null())
                same = [None if n else a == b for a, b, n in zip(texts, back, null)]
                offsets = np.concatenate((np.zeros(1, np.int32), np.cumsum(counts, dtype=np.int32)))
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), lists, pa.array(same, pa.bool_())],
                    names=["_id", "n_pieces", "ids", "round_trip"])

    return run


def decode_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Vocabulary(shared.value))
        for batch in batches:
            lists = batch.column(1)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = codec.decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
            out = pa.array([None if n else t.decode("utf-8", "replace") for t, n in zip(texts, lists.is_null().to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["_id", "text"])

    return run


def encode_pieces(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, n_pieces, ids, round_trip`` of every row; ``round_trip``: decoding gives the text back.

    The driver reads the model file and sends its pieces to the executors; the file bounds their size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_pieces(model))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(docs["doc_id"].alias("_id"), text_or_null(docs).alias("_text")).mapInArrow(
        encode_batches(shared), f"_id {kind}, n_pieces long, ids array<int>, round_trip boolean"
    ).select(F.col("_id").alias("doc_id"), "n_pieces", "ids", "round_trip")


def decode_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_pieces(model))
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select(encoded["doc_id"].alias("_id"), "ids").mapInArrow(
        decode_batches(shared), f"_id {kind}, text string").select(F.col("_id").alias("doc_id"), "text")
