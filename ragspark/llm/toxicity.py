"""Toxicity by a linear-chain conditional random field over words.

A chain is a line of a document; its states are clean and toxic.  A word's features are itself and its
first 4, 5 and 6 bytes (A-Z lower-cased), hashed into ``BUCKETS`` weights, so inflected forms share evidence.
Token labels come from document labels: a feature whose share of toxic documents exceeds its share of
clean ones by far marks its words as toxic in toxic documents; every word of a clean document is clean.
The chain weights maximise the conditional likelihood of those token labels.

Forward and backward messages of a two-state chain are odds, so all lines of a block advance together,
one multiplication-division per word.  Marginals give toxic spans (at least one half).  A document is judged
by its worst stretch: of all runs of ``WINDOW`` words the one with the largest sum of marginals, whose sum
and largest marginal enter a logistic fit.  Length alone does not raise a score: clean documents joined
score as the worst of them does.

The fit uses a bounded sample of labelled rows: about ``docs_per_class`` documents of either label (three
times as many in all at most), chosen by hash of their id from rows whose crc32(doc_id) is not divisible by 5.
Token labels and the logistic fit read these documents whole, in tasks.  Chains for the gradient are stretches
of ``CHUNK`` words spread over the whole text, the last words included: at most ``chains_per_doc`` of a
document chosen by hash, and of those without a toxic mark one in ``1 / UNMARKED``.  The score is weighted back
to the true share of labels.  Scoring covers whole texts of all rows.

Edge cases: null and empty texts have no words and get the score of a document without evidence; null
labels are not learned from; a document with differing labels counts as its largest; repeated rows enter the
sample once; without rows of both labels every score is the share of toxic rows, or 0; repeated rows are each
scored; extra columns stay out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm import kernel
from ragspark.llm.decontaminate import word_bytes
from ragspark.llm.kernel import SpanHash
from ragspark.llm.shared import cut, held_out, opened, sent, text_or_null

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
CHUNK = 64  # words of a training chain
WINDOW = 64  # words of the stretch that a document is judged by
UNMARKED = 0.15  # share of the chains without a mark that are learned from


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: SpanHash) -> np.ndarray:
    """Buckets of every word: itself, then its prefixes (a shorter word repeats itself)."""
    salt = kernel.mix(np.arange(1, len(PREFIXES) + 2, dtype=np.uint64))
    columns = [hasher(buf, starts, ends) ^ salt[0]]
    for k, size in enumerate(PREFIXES):
        cut = np.minimum(ends, starts + size)
        columns.append(hasher(buf, starts, cut) ^ salt[k + 1])
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.stack([(kernel.mix(c) >> shift).astype(np.int32) for c in columns], 1)


def odds_steps(lines: np.ndarray, lengths: np.ndarray):
    """Positions of the t-th words of all lines that have one, longest lines first."""
    order = np.argsort(-lengths, kind="stable")
    start, size = lines[order], lengths[order]
    below = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    return start, size, below


def marginal_odds(emission: np.ndarray, lines: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Odds of the toxic state at every word; ``emission`` are odds, ``move[i, j]`` factors from i to j."""
    out = np.zeros(len(emission))
    start, size, below = odds_steps(lines, lengths)
    if not len(size):
        return out
    (c00, c01), (c10, c11) = move
    ahead = np.empty(len(emission))
    message = np.ones(0)
    for t, n in enumerate(below):
        at = start[:n] + t
        if t == 0:
            message = emission[at]
        else:
            before = message[:n]
            message = emission[at] * (c01 + c11 * before) / (c00 + c10 * before)
        ahead[at] = message
    back = np.ones(len(size))
    for t in range(len(below) - 1, -1, -1):
        n = below[t]
        at = start[:n] + t
        more = below[t + 1] if t + 1 < len(below) else 0
        if more:
            after = emission[start[:more] + t + 1] * back[:more]
            back[:more] = (c10 + c11 * after) / (c00 + c01 * after)
        out[at] = ahead[at] * back[:n]
    return out


def slopes(score: np.ndarray, label: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the log-likelihood of ``label`` by every word's score (n x T) and by ``move`` (logarithms, 2 x 2)."""
    e, c = np.exp(score), np.exp(move)
    ahead, back = e.copy(), np.ones_like(e)
    for t in range(1, e.shape[1]):
        ahead[:, t] = e[:, t] * (c[0, 1] + c[1, 1] * ahead[:, t - 1]) / (c[0, 0] + c[1, 0] * ahead[:, t - 1])
    for t in range(e.shape[1] - 2, -1, -1):
        after = e[:, t + 1] * back[:, t + 1]
        back[:, t] = (c[1, 0] + c[1, 1] * after) / (c[0, 0] + c[0, 1] * after)
    odds = ahead * back
    left, right = ahead[:, :-1], e[:, 1:] * back[:, 1:]
    joint = np.ones_like(left) * c[0, 0], c[0, 1] * right, c[1, 0] * left, c[1, 1] * left * right
    whole = sum(joint)
    pairs = np.array([(x / whole).sum() for x in joint]).reshape(2, 2)
    seen = np.array([((label[:, :-1] == i) & (label[:, 1:] == j)).sum() for i in (0, 1) for j in (0, 1)]).reshape(2, 2)
    return label - odds / (1 + odds), seen - pairs


class CRF:
    """Weights of features and moves; the clean state's weights are zero."""

    def __init__(self):
        self.weight = np.zeros(BUCKETS, np.float32)
        self.bias = -4.0
        self.move = np.zeros((2, 2))
        self.scale = (0.0, 0.0, 0.0)

    def emission(self, f: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(self.bias + self.weight[f].sum(1, dtype=np.float64), -30, 30))

    def marginals(self, f: np.ndarray, lines: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        odds = marginal_odds(self.emission(f), lines, lengths, np.exp(self.move))
        return odds / (1 + odds)

    def fit(self, f: np.ndarray, label: np.ndarray, rounds: int = 60, rate: float = 0.5, decay: float = 1e-4) -> None:
        """Adagrad on the mean conditional log-likelihood of chains of ``CHUNK`` words (n x CHUNK x features)."""
        n = len(f)
        flat = f.reshape(-1, f.shape[-1])
        known, where = np.unique(flat, return_inverse=True)
        where = where.reshape(flat.shape).astype(np.int32)
        w, b, m = np.zeros(len(known)), self.bias, self.move.copy()
        g2, gb2, gm2 = np.full(len(known), 1e-6), 1e-6, np.full((2, 2), 1e-6)
        for _ in range(rounds):
            slope, gm = slopes(np.clip(b + w[where].sum(1), -30, 30).reshape(n, CHUNK), label, m)
            slope = slope.ravel()
            gw = np.zeros(len(known))
            for k in range(where.shape[1]):
                gw += np.bincount(where[:, k], slope, len(known))
            gb = slope.sum()
            gw, gm, gb = gw / n - decay * w, gm / n, gb / n
            g2, gm2, gb2 = g2 + gw * gw, gm2 + gm * gm, gb2 + gb * gb
            w += rate * gw / np.sqrt(g2)
            m += 0.2 * rate * gm / np.sqrt(gm2)
            m[0, 0] = 0.0
            b += 0.2 * rate * gb / np.sqrt(gb2)
        self.weight[known] = w
        self.bias, self.move = float(b), m

    def calibrate(self, top: np.ndarray, mass: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        """Logistic fit of document labels by Newton steps, with a small ridge."""
        x = np.stack((np.ones(len(top)), top, np.log1p(mass)), 1)
        a = np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 1e-2, 1e-2])
            a += np.linalg.solve(h, x.T @ (weight * (label - p)) - np.array([0, 1e-2, 1e-2]) * a)
        self.scale = tuple(a)

    def score(self, top: np.ndarray, mass: np.ndarray) -> np.ndarray:
        a = self.scale
        return 1 / (1 + np.exp(-np.clip(a[0] + a[1] * top + a[2] * np.log1p(mass), -30, 30)))


def words_of(texts: list[bytes], member: np.ndarray):
    """Words of a block, its lines (runs of words without a newline between) and the documents' cuts."""
    buf, bounds = kernel.joined([x.lower() for x in texts])
    starts, ends = kernel.spans(member[buf])
    cuts = np.searchsorted(starts, bounds)
    newlines = np.concatenate((np.zeros(1, np.int64), np.cumsum(buf == 10)))
    row = newlines[starts]
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(starts) else starts
    return buf, bounds, starts, ends, cuts, first, np.diff(np.append(first, len(starts)))


def worst_stretch(p: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every document's run of ``WINDOW`` words with the largest sum of marginals: largest marginal and sum."""
    n = len(cuts) - 1
    top, mass = np.zeros(n), np.zeros(n)
    total = np.concatenate((np.zeros(1), np.cumsum(p)))
    ends = np.minimum(np.arange(len(p)) + WINDOW, np.repeat(cuts[1:], np.diff(cuts)))
    sums = total[ends] - total[:-1]
    for d in np.flatnonzero(cuts[1:] > cuts[:-1]):
        at = cuts[d] + int(sums[cuts[d] : cuts[d + 1]].argmax())
        top[d], mass[d] = p[at : ends[at]].max(), sums[at]
    return top, np.maximum(mass, 0)


def block_marginals(crf: CRF, texts: list[bytes], hasher: SpanHash, member: np.ndarray):
    buf, bounds, starts, ends, cuts, lines, lengths = words_of(texts, member)
    return crf.marginals(features(buf, starts, ends, hasher), lines, lengths), buf, bounds, starts, ends, cuts


def held_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each feature that a document holds."""
    hasher, member = SpanHash(), word_bytes()
    for batch in batches:
        for toxic, raw in zip(batch.column("_toxic").to_pylist(), batch.column("_text").cast(pa.binary())):
            buf, _, starts, ends, *_ = words_of([raw.as_py() or b""], member)
            found = np.unique(features(buf, starts, ends, hasher))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), toxic, np.int32)), pa.array(found)], names=["toxic", "feature"])


def chain_batches(shared, chains_per_doc: int):
    """Training chains of sampled documents: features and tags of ``CHUNK`` words each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(BUCKETS, bool)
        marks[opened(shared)] = True
        hasher, member = SpanHash(), word_bytes()
        for batch in batches:
            out = []
            for toxic, raw in zip(batch.column("_toxic").to_pylist(), batch.column("_text").cast(pa.binary())):
                text = raw.as_py() or b""
                buf, _, starts, ends, *_ = words_of([text], member)
                f = features(buf, starts, ends, hasher)
                if not len(f):
                    continue
                m = marks[f].any(1) & (toxic == 1)
                if len(f) < CHUNK:
                    f, m = np.resize(f, (CHUNK, f.shape[1])), np.resize(m, CHUNK)
                first = np.unique(np.minimum(np.arange(0, len(f), CHUNK), len(f) - CHUNK))
                marked = np.array([m[i : i + CHUNK].any() for i in first])
                rng = np.random.default_rng([zlib.crc32(text), len(text)])
                first = first[marked | (rng.random(len(first)) < UNMARKED)]
                for i in np.sort(rng.permutation(first)[:chains_per_doc]):
                    out.append((f[i : i + CHUNK].astype("<i4").tobytes(), m[i : i + CHUNK].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["features", "tags"])

    return run


def stretch_batches(shared):
    """What the logistic fit reads of every sampled document; the same as in scoring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf: CRF = opened(shared)
        hasher, member = SpanHash(), word_bytes()
        for batch in batches:
            for i, j, part in kernel.text_blocks(batch.column("_text"), 4 << 20):
                p, *_, cuts = block_marginals(crf, part, hasher, member)
                top, mass = worst_stretch(p, cuts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_toxic").slice(i, j - i), pa.array(top), pa.array(mass)], names=["toxic", "top", "mass"])

    return run


def labelled_sample(docs: DataFrame, marked: DataFrame, counts: dict[int, int], docs_per_class: int) -> DataFrame:
    """``_toxic, _text`` of the sampled documents, written once; the bound holds whatever repeats."""
    ticket = F.pmod(F.xxhash64("_id", F.lit("toxicity")), F.lit(1 << 30))
    share = F.when(F.col("_toxic") == 1, docs_per_class / counts[1]).otherwise(docs_per_class / counts[0])
    chosen = marked.where(ticket < share * (1 << 30)).orderBy(ticket, "_id").limit(3 * docs_per_class)
    rows = docs.select(docs["doc_id"].alias("_doc"), text_or_null(docs).alias("_text")).join(
        F.broadcast(chosen), F.col("_doc") == F.col("_id")).withColumn("_hash", F.xxhash64(F.coalesce("_text", F.lit(""))))
    rows = cut(rows.select("_id", "_hash", "_toxic", "_text"))
    keys = rows.select("_id", "_hash").distinct().orderBy("_hash", "_id").limit(3 * docs_per_class)
    return rows.join(F.broadcast(keys), ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"]).select("_toxic", "_text")


def train(docs: DataFrame, labels: DataFrame, docs_per_class: int = 2500, chains_per_doc: int = 24) -> tuple[CRF | None, float]:
    """A fitted model, or None with the share of toxic rows if one label is missing."""
    context = docs.sparkSession.sparkContext
    marked = labels.select(labels["doc_id"].alias("_id"), labels["toxic"].cast("int").alias("_toxic")).where(
        "_id is not null and _toxic in (0, 1)").where(~held_out(F.col("_id")))
    marked = marked.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    counts = {r["_toxic"]: r["n"] for r in marked.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    if len(counts) < 2:
        return None, share
    sample = cut(labelled_sample(docs, marked, counts, docs_per_class))
    size = {r["_toxic"]: r["n"] for r in sample.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return None, share
    # words of toxic documents with a feature that toxic documents hold far more often than clean ones
    held = sample.mapInArrow(held_features, "toxic int, feature int").groupBy("feature").agg(
        F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
    often = held.where((F.col("bad") >= 5) & ((F.col("bad") + 0.5) / (size[1] + 1) >= 12 * (F.col("good") + 0.5) / (size[0] + 1)))
    marks = np.sort(often.select("feature").toArrow().column("feature").to_numpy())
    chains = sample.mapInArrow(chain_batches(sent(context, marks), chains_per_doc), "features binary, tags binary").toArrow()
    if not chains.num_rows:
        return None, share
    chains = chains.sort_by([("features", "ascending"), ("tags", "ascending")])  # the same order whatever the tasks' order
    f = np.frombuffer(b"".join(chains.column("features").to_pylist()), "<i4").reshape(-1, CHUNK, len(PREFIXES) + 1)
    tags = np.frombuffer(b"".join(chains.column("tags").to_pylist()), bool).reshape(-1, CHUNK)
    del chains
    crf = CRF()
    crf.fit(f, tags)
    del f, tags
    seen = sample.mapInArrow(stretch_batches(sent(context, crf)), "toxic int, top double, mass double").toArrow()
    seen = seen.sort_by([(c, "ascending") for c in ("toxic", "top", "mass")])
    toxic = seen.column("toxic").to_numpy() == 1
    weight = np.where(toxic, counts[1] / toxic.sum(), counts[0] / (~toxic).sum()) / total * len(toxic)
    crf.calibrate(seen.column("top").to_numpy(), seen.column("mass").to_numpy(), toxic.astype(float), weight)
    return crf, share


def score_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf: CRF = opened(shared)
        hasher, member = SpanHash(), word_bytes()
        for batch in batches:
            for i, j, part in kernel.text_blocks(batch.column("_text"), 4 << 20):
                p, buf, bounds, starts, ends, cuts = block_marginals(crf, part, hasher, member)
                top, mass = worst_stretch(p, cuts)
                spans: list[list] = [[] for _ in part]
                for d in np.unique(np.searchsorted(cuts, np.flatnonzero(p >= 0.5), "right") - 1):
                    at = np.arange(cuts[d], cuts[d + 1])[p[cuts[d] : cuts[d + 1]] >= 0.5]
                    lead = np.concatenate(([0], np.cumsum((buf[bounds[d] : bounds[d + 1]] & 0xC0) != 0x80)))
                    run_start = np.concatenate(([True], at[1:] != at[:-1] + 1))
                    a = lead[starts[at[run_start]] - bounds[d]]
                    b = lead[ends[at[np.append(run_start[1:], True)]] - bounds[d]]
                    spans[d] = [{"start": int(x), "end": int(y)} for x, y in zip(a, b)]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(i, j - i), pa.array(crf.score(top, mass)), pa.array(spans, kind)],
                    names=["_id", "_score", "_spans"])

    return run


def toxicity_report(docs: DataFrame, labels: DataFrame, docs_per_class: int = 2500) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans``; spans are offending words in code points, half open."""
    crf, share = train(docs, labels, docs_per_class)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(docs["doc_id"].alias("_id"), text_or_null(docs).alias("_text"))
    span_type = "array<struct<start:int,end:int>>"
    if crf is None:
        scored = rows.select("_id", F.lit(float(share)).alias("_score"), F.array().cast(span_type).alias("_spans"))
    else:
        shared = sent(docs.sparkSession.sparkContext, crf)
        scored = rows.mapInArrow(score_batches(shared), f"_id {kind}, _score double, _spans {span_type}")
    return scored.select(
        F.col("_id").alias("doc_id"), held_out(F.col("_id")).alias("held_out"), F.col("_score").alias("score"),
        F.when(F.col("_score") >= 0.5, 1).otherwise(0).alias("predicted"), F.col("_spans").alias("spans"))
