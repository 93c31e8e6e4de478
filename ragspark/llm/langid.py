"""Language ID with a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word (A-Z lower-cased; a word longer than ``WIDTH`` bytes continues as
another sequence) forwards and backwards and labels every position with a distribution over the
languages.  A document's probabilities are the mean over all positions of its words that hold a letter.
Equal words of a block are read once and counted as often as they occur, so no position is left out.

Training is numpy back-propagation through time on the driver, over a bounded sample: about
``docs_per_language`` documents of each language, a stretch of ``SAMPLE_CHARS`` characters of each.
Documents whose crc32(doc_id) is divisible by 5 are never learned from.

Edge cases: null text, or text without a letter, is ``und`` with score 0; rows with null lang are not
learned from but predicted; without any learnable row all are ``und``; ties go to the language that sorts
first; repeated rows are each predicted; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.llm import kernel
from ragspark.llm.kernel import SpanHash
from ragspark.llm.shared import held_out, opened, sent, text_or_null

WIDTH = 32
BLOCK = 2 << 20
SAMPLE_CHARS = 2000
SURE = 200  # bytes of words from which on a text is judged sharply
MAX_LANGUAGES = 512
LETTER = r"\p{L}"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGRU:
    """Two gated recurrent layers over bytes and a softmax over both states at every position."""

    def __init__(self, labels: int, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)

        def draw(*shape: int) -> np.ndarray:
            return rng.normal(0, 0.3, shape).astype(np.float32)

        self.hidden = hidden
        self.p = {"bias": np.zeros(labels, np.float32)}
        for d in ("ahead", "back"):
            self.p |= {f"in_{d}": draw(256, 3 * hidden), f"rec_{d}": draw(hidden, 3 * hidden), f"out_{d}": draw(hidden, labels)}

    def states(self, units: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
        """States after every byte of equal-length units (n x L); gates go to ``tape`` for training."""
        n, size = units.shape
        k = self.hidden
        table, rec = self.p[f"in_{d}"], self.p[f"rec_{d}"]
        h = np.zeros((n, k), np.float32)
        out = np.empty((size, n, k), np.float32)
        for t in range(size) if d == "ahead" else range(size - 1, -1, -1):
            x, r = table[units[:, t]], h @ rec
            gates = sigmoid(x[:, : 2 * k] + r[:, : 2 * k])
            z, reset = gates[:, :k], gates[:, k:]
            new = np.tanh(x[:, 2 * k :] + reset * r[:, 2 * k :])
            if tape is not None:
                tape.append((t, h, z, reset, new, r[:, 2 * k :]))
            h = new + z * (h - new)
            out[t] = h
        return out

    def probabilities(self, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
        score = ahead @ self.p["out_ahead"] + back @ self.p["out_back"] + self.p["bias"]
        score -= score.max(-1, keepdims=True)
        np.exp(score, out=score)
        return score / score.sum(-1, keepdims=True)

    def label(self, units: np.ndarray) -> np.ndarray:
        """Probabilities at every position, L x n x labels."""
        return self.probabilities(self.states(units, "ahead"), self.states(units, "back"))

    def gradients(self, units: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for units whose every position has the label ``target``."""
        n, size = units.shape
        k = self.hidden
        tapes = {"ahead": [], "back": []}
        out = {d: self.states(units, d, tape) for d, tape in tapes.items()}
        prob = self.probabilities(out["ahead"], out["back"])
        loss = float(-np.log(prob[:, np.arange(n), target] + 1e-9).mean())
        slope = prob
        slope[:, np.arange(n), target] -= 1
        slope /= n * size
        grad = {"bias": slope.sum((0, 1))}
        hot = np.eye(256, dtype=np.float32)
        for d, tape in tapes.items():
            rec = self.p[f"rec_{d}"]
            grad[f"out_{d}"] = np.einsum("tnk,tnl->kl", out[d], slope)
            into, g_in, g_rec = slope @ self.p[f"out_{d}"].T, np.zeros_like(self.p[f"in_{d}"]), np.zeros_like(rec)
            dh = np.zeros((n, k), np.float32)
            for t, h, z, reset, new, r_new in reversed(tape):
                dh = dh + into[t]
                d_new = dh * (1 - z) * (1 - new * new)
                d_z = dh * (h - new) * z * (1 - z)
                d_reset = d_new * r_new * reset * (1 - reset)
                d_r = np.concatenate((d_z, d_reset, d_new * reset), 1)
                g_in += hot[units[:, t]].T @ np.concatenate((d_z, d_reset, d_new), 1)
                g_rec += h.T @ d_r
                dh = dh * z + d_r @ rec.T
            grad[f"in_{d}"], grad[f"rec_{d}"] = g_in, g_rec
        return loss, grad

    def fit(self, words: list[bytes], target: np.ndarray, steps: int = 400, batch: int = 1024, rate: float = 0.02, seed: int = 3) -> None:
        """Adam over random batches of words of equal length."""
        rng = np.random.default_rng(seed)
        size = np.array([len(w) for w in words])
        by_size = {int(n): np.flatnonzero(size == n) for n in np.unique(size)}
        flat = {n: np.frombuffer(b"".join(words[i] for i in rows), np.uint8).reshape(-1, n) for n, rows in by_size.items()}
        sizes = np.array(list(by_size))
        share = np.array([len(by_size[int(n)]) for n in sizes], float)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            n = int(rng.choice(sizes, p=share / share.sum()))
            pick = rng.integers(0, len(by_size[n]), min(batch, len(by_size[n])))
            _, grad = self.gradients(flat[n][pick], target[by_size[n][pick]])
            pace = rate * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                self.p[k] -= (pace * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)


def word_units(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that hold a letter byte, cut at ``WIDTH`` bytes: starts and ends."""
    starts, ends = kernel.spans(kernel.not_space()[buf])
    letter = kernel.byte_set((0x61, 0x7A), (0x80, 0xFF))[buf]
    held = np.logical_or.reduceat(letter, starts) if len(starts) else np.zeros(0, bool)
    starts, ends = starts[held], ends[held]
    pieces = (ends - starts + WIDTH - 1) // WIDTH
    first = np.repeat(starts, pieces)
    nth = kernel.ragged(np.zeros(len(pieces), np.int64), pieces)
    begin = first + nth * WIDTH
    return begin, np.minimum(begin + WIDTH, np.repeat(ends, pieces))


def pooled(net: BiGRU, hasher: SpanHash, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Mean probabilities over all positions of every text, zeros where no word holds a letter; the number of positions."""
    buf, bounds = kernel.joined([x.lower() for x in texts])
    starts, ends = word_units(buf, bounds)
    labels = len(net.p["bias"])
    if not len(starts):
        return np.zeros((len(texts), labels)), np.zeros(len(texts), np.int64)
    _, one, inverse = np.unique(hasher(buf, starts, ends), return_index=True, return_inverse=True)
    sums = np.zeros((len(one), labels), np.float32)
    size = (ends - starts)[one]
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        for i in range(0, len(rows), 4096):
            part = rows[i : i + 4096]
            sums[part] = net.label(buf[starts[one[part]][:, None] + np.arange(n)]).sum(0)
    cuts = np.searchsorted(starts, bounds)
    out = np.zeros((len(texts), labels))
    has = np.flatnonzero(cuts[1:] > cuts[:-1])
    out[has] = np.add.reduceat(sums[inverse], cuts[has], axis=0, dtype=np.float64)
    length = np.zeros(len(texts), np.int64)
    length[has] = np.add.reduceat(ends - starts, cuts[has])
    out[has] /= length[has, None]
    return out, length


def predict_batches(shared):
    """``row, text, letters`` (the text has a letter) to ``row, lang, score, positions``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, net, _ = opened(shared)
        hasher = SpanHash()
        for batch in batches:
            for i, j, texts in kernel.text_blocks(batch.column(1), BLOCK):
                rows = batch.slice(i, j - i)
                prob, length = pooled(net, hasher, texts)
                best = prob.argmax(1)
                found = prob[np.arange(len(prob)), best]
                known = np.asarray(rows.column(2).fill_null(False)) & (found > 0)
                lang = [names[b] if k else "und" for b, k in zip(best, known)]
                score = np.clip(np.where(known, found, 0.0), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(length, pa.int64())],
                    names=["row", "lang", "score", "positions"])

    return run


def train(docs: DataFrame, docs_per_language: int = 500, hidden: int = 16) -> tuple[list[str], BiGRU, float] | None:
    """A network fitted to a bounded sample of the rows that may be learned from; None without such rows.

    The third value is the score that a text of a learned language reaches: half way from chance to the score that all
    but a hundredth of the sample have.  At most 8 000 documents in all are taken, chosen by a hash of their id.
    """
    rows = docs.select(docs["doc_id"].alias("_id"), text_or_null(docs).alias("_text"), docs["lang"].cast("string").alias("_lang")).where(
        ~held_out(F.col("_id")) & F.col("_lang").isNotNull() & F.col("_text").rlike(LETTER))
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if not counts:
        return None
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(counts)
    want = max(1, min(docs_per_language, 8000 // len(names)))
    spark = docs.sparkSession
    share = F.broadcast(spark.createDataFrame([(n, float(min(1.0, want / counts[n]))) for n in names], "_name string, _share double"))
    ticket = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 30))
    room = F.greatest(F.lit(1), F.char_length("_text") - SAMPLE_CHARS + 1)
    start = (F.pmod(F.xxhash64("_id", F.lit("place")), room) + 1).cast("int")
    taken = rows.join(share, F.col("_lang") == F.col("_name")).where(ticket < F.col("_share") * (1 << 30)).select(
        "_lang", ticket.alias("_ticket"), F.substring(F.col("_text"), start, F.lit(SAMPLE_CHARS)).alias("_text"))
    sample = taken.orderBy("_ticket", "_text").limit(2 * want * len(names)).collect()
    words, target, whole = [], [], []
    for r in sample:
        raw = r["_text"].encode().lower()
        buf, bounds = kernel.joined([raw])
        starts, ends = word_units(buf, bounds)
        words += [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        target += [names.index(r["_lang"])] * len(starts)
        whole.append(raw)
    net, chance = BiGRU(len(names), hidden), 1 / len(names)
    if not words:
        return names, net, chance
    net.fit(words, np.array(target))
    reached, length = pooled(net, SpanHash(), whole)
    reached = reached.max(1)[length > 0]
    return names, net, chance + 0.5 * max(0.0, float(np.quantile(reached, 0.01)) - chance)


def judged(docs: DataFrame, model: tuple[list[str], BiGRU, float] | None) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``), ``lang``, ``score`` and ``positions`` (bytes of words with a letter)."""
    text = text_or_null(docs)
    rows = docs.select(F.struct("*").alias("row"), text.alias("text"), F.coalesce(text.rlike(LETTER), F.lit(False)).alias("letters"))
    if model is None:
        return rows.select("row", F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("positions"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("positions", T.LongType())])
    return rows.mapInArrow(predict_batches(sent(docs.sparkSession.sparkContext, model)), schema)


def with_language(docs: DataFrame, docs_per_language: int = 500) -> DataFrame:
    """``docs`` with ``_lang`` and ``_score`` beside its columns (which should not have these names)."""
    found = judged(docs, train(docs, docs_per_language))
    return found.select("row.*", F.col("lang").alias("_lang"), F.col("score").alias("_score"))


def language_report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    found = judged(docs.select("doc_id", "text", "lang"), train(docs))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def accepted(docs: DataFrame, sure: int = SURE) -> DataFrame:
    """``docs`` without rows that have no language or are of none of the learned ones.

    A text has to reach the score that ``train`` derives from the learned rows; for one of fewer than ``sure`` bytes
    of words the demand falls in proportion, down to chance.  With one learned language nothing but texts
    without a letter can be told apart.
    """
    model = train(docs)
    chance, least = (1 / len(model[0]), model[2]) if model else (0.0, 0.0)
    demand = F.lit(chance) + F.lit(least - chance) * F.least(F.lit(1.0), F.col("positions") / F.lit(float(sure)))
    return judged(docs, model).where((F.col("lang") != "und") & (F.col("score") >= demand)).select("row.*")
