"""Language-model scoring by cross-entropy difference (target against background).

Both models are bigram models with Witten-Bell smoothing over one vocabulary: all words of all documents
(runs of ``[^\\x20\\x09-\\x0D]``, A-Z lower-cased), one symbol for any other word, and a start symbol.  The
background counts every document, the target the documents of the target set.  A document's score is its
mean loss per word under the target less the mean loss under the background; the lower, the more it
resembles the target.  A document is left out of the models it is scored by: its own counts of words, pairs and
followers are taken off, in each model that holds it, so target documents are not known by heart.  The number of
word kinds stays that of all documents.

No table of the model is held in one place.  Documents are dealt into buckets of some megabytes of text by
hash, and keys of the model into slots by hash.  A bucket asks each slot once for all of its distinct
(previous, word) pairs there, with its own counts; the slot adds up what all buckets hold and answers in
the order of the request.  Words are asked for in the same way in a second round, with their counts as
word and as previous word and the number of distinct followers (a pair is counted by the first bucket that
holds it).  Each bucket then scores its documents from the answers.  A frequent pair or word is one
entry per bucket, so no key is hot, and buckets and slots grow with the corpus while their sizes do not.  The rows
that carry requests are buckets times slots until a slot gets less than one key of a bucket, so their number, not
their content, grows with the square of the corpus up to there (README).  Text is shuffled once.

Edge cases: null and empty texts have no words, score 0; a null or missing label is not target; with no
target document at all the target model is uniform; repeated rows count and score each (all rows of one id
are in one bucket); extra columns stay out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm import kernel
from ragspark.llm.kernel import SpanHash
from ragspark.llm.shared import partitions, text_or_null

BLOCK = 16 << 20
BUCKET, SLOT = 4 << 20, 8 << 20  # bytes of text that a bucket and a slot stand for
LOW = 5  # bytes of a step that are sent as they are
START, OTHER = 0, 1  # stand among the word hashes
ASKED = "_slot int, _bucket int, keys binary, n binary"
PAIRS = "_bucket int, _slot int, n binary"
WORDS = PAIRS + ", kinds long, background long, target long"


def block_words(texts: list[bytes], hasher: SpanHash) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block and the documents' cuts among them."""
    buf, bounds = kernel.joined([x.lower() for x in texts])
    starts, ends = kernel.spans(kernel.not_space()[buf])
    return hasher(buf, starts, ends), np.searchsorted(starts, bounds)


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = SpanHash()
    for batch in batches:
        for _, _, texts in kernel.text_blocks(batch.column("_text"), BLOCK):
            words, n = np.unique(block_words(texts, hasher)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])


def packed(*columns: np.ndarray) -> bytes:
    """Whole numbers by byte planes, so that the many zeros pack well."""
    planes = np.stack(columns).astype("<i8").reshape(-1, 1).view(np.uint8).T
    return zlib.compress(planes.tobytes(), 1)


def unpacked(data: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(columns, -1)


def sealed(keys: np.ndarray) -> bytes:
    """Ascending hashes by their steps, of which only the upper bytes pack."""
    planes = np.diff(keys, prepend=np.uint64(0)).astype("<u8").reshape(-1, 1).view(np.uint8).T
    return planes[:LOW].tobytes() + zlib.compress(planes[LOW:].tobytes(), 1)


def unsealed(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(data[: LOW * n] + zlib.decompress(data[LOW * n :]), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def added(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, n, minlength=size).astype(np.int64)


class Bucket:
    """Documents of a bucket and their distinct (previous, word) pairs, in the order of the pairs' hashes.

    Nothing but the order of the documents depends on the order in which the rows come.
    """

    def __init__(self, rows: pa.Table, shared):
        rows = rows.combine_chunks()
        mark = rows.column("_mark")
        chosen = rows.filter(mark).column("_id").combine_chunks()
        rows = rows.filter(pc.invert(mark)).combine_chunks()
        self.ids = rows.column("_id")
        words, self.cuts = block_words([x.as_py().encode() if x.is_valid else b"" for x in rows.column("_text")], hasher())
        if shared is not None:
            words = np.where(np.isin(words, shared.value), words, np.uint64(OTHER))
        self.n = np.diff(self.cuts)
        target = np.asarray(pc.is_in(self.ids, value_set=chosen)).astype(np.int64)
        before = np.concatenate((np.zeros(1, np.uint64), words[:-1])) if len(words) else words
        before[self.cuts[:-1][self.n > 0]] = START
        self.keys, first, self.at, self.background = np.unique(
            kernel.mix(kernel.mix(before) + words), return_index=True, return_inverse=True, return_counts=True)
        self.members = np.ones(len(target), np.int64), target
        self.target = added(self.at, np.repeat(target, self.n), len(self.keys))
        self.words, at = np.unique(np.concatenate((before[first], words[first])), return_inverse=True)
        self.before, self.word = at[: len(first)], at[len(first) :]

    def answers(self, rows: pa.Table, keys: np.ndarray, slots: int, columns: int) -> np.ndarray:
        """The answers of all slots in the order of ``keys``."""
        bounds = dealt(keys, slots)
        out = np.full((columns, len(keys)), -1, np.int64)
        for slot, data in zip(rows.column("_slot").to_pylist(), rows.column("n")):
            out[:, bounds[slot] : bounds[slot + 1]] = unpacked(data.as_py(), columns)
        if (out < 0).any():
            raise ValueError("a slot gave no answer")
        return out


    def own_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, Within, Within]:
        """Each document's distinct pairs: document, pair, how often; and the document's words and previous words."""
        size = len(self.keys)
        code, times = np.unique(np.repeat(np.arange(len(self.n)), self.n) * size + self.at, return_counts=True)
        doc, pair = code // size, code % size
        return doc, pair, times, Within(doc, self.word[pair]), Within(doc, self.before[pair])


class Within:
    """Sums over the entries that share a document and a key."""

    def __init__(self, doc: np.ndarray, key: np.ndarray):
        self.at = np.unique(doc * (int(key.max(initial=0)) + 1) + key, return_inverse=True)[1]

    def sums(self, n: np.ndarray) -> np.ndarray:
        return added(self.at, n, len(self.at))[self.at]


HASHER: list[SpanHash] = []


def hasher() -> SpanHash:
    if not HASHER:
        HASHER.append(SpanHash())
    return HASHER[0]


def dealt(keys: np.ndarray, slots: int) -> np.ndarray:
    """Where each slot, a range of hashes, starts among ascending keys; steps are the shorter the more keys a bucket has."""
    slot = (keys >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)
    return np.searchsorted(slot, np.arange(slots + 1, dtype=np.uint64))


def request(bucket: int, slots: int, keys: np.ndarray, *columns: np.ndarray) -> pa.Table:
    bounds = dealt(keys, slots)
    used = np.flatnonzero(np.diff(bounds))
    parts = [slice(bounds[s], bounds[s + 1]) for s in used]
    return pa.table({
        "_slot": pa.array(used, pa.int32()), "_bucket": pa.array([bucket] * len(used), pa.int32()),
        "keys": pa.array([sealed(keys[p]) for p in parts], pa.binary()),
        "n": pa.array([packed(*(c[p] for c in columns)) for p in parts], pa.binary())})


def requested(rows: pa.Table, columns: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A slot's requests by bucket, with the keys and numbers of all and where each one starts."""
    rows = rows.sort_by("_bucket")
    n = [unpacked(x.as_py(), columns) for x in rows.column("n")]
    keys = [unsealed(x.as_py(), c.shape[1]) for x, c in zip(rows.column("keys"), n)]
    return rows, np.concatenate(keys), np.concatenate(n, axis=1), np.cumsum([0, *map(len, keys)])


def answer(rows: pa.Table, bounds: np.ndarray, *columns: np.ndarray) -> dict[str, pa.Array]:
    return {
        "_bucket": rows.column("_bucket"), "_slot": rows.column("_slot"),
        "n": pa.array([packed(*(c[i:j] for c in columns)) for i, j in zip(bounds, bounds[1:])], pa.binary())}


def ask_pairs(shared, slots: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        b = Bucket(rows, shared)
        return request(key[0].as_py(), slots, b.keys, b.background, b.target)

    return run


def count_pairs(rows: pa.Table) -> pa.Table:
    """How often each pair is held in background and target."""
    rows, keys, n, bounds = requested(rows, 2)
    found, at = np.unique(keys, return_inverse=True)
    return pa.table(answer(rows, bounds, *(added(at, x, len(found))[at] for x in n)))


def head_pairs(rows: pa.Table) -> pa.Table:
    """Whether this bucket is the first to hold the pair in background and in target."""
    rows, keys, n, bounds = requested(rows, 2)
    out = np.zeros(n.shape, np.int64)
    for head, mine in zip(out, n):
        held = np.flatnonzero(mine)
        head[held[np.unique(keys[held], return_index=True)[1]]] = 1
    return pa.table(answer(rows, bounds, *out))


def ask_words(shared, slots: int):
    def run(key: tuple, rows: pa.Table, pairs: pa.Table) -> pa.Table:
        b = Bucket(rows, shared)
        heads = b.answers(pairs, b.keys, slots, 2)
        size, columns = len(b.words), []
        for n, head in zip((b.background, b.target), heads):
            columns += [added(b.word, n, size), added(b.before, n, size), added(b.before, head, size)]
        return request(key[0].as_py(), slots, b.words, *columns)

    return run


def answer_words(rows: pa.Table) -> pa.Table:
    """Per word its count, its count as previous word and its distinct followers, in background and target.

    The first row also has the slot's number of words and its counts of all words.
    """
    rows, keys, n, bounds = requested(rows, 6)
    found, at = np.unique(keys, return_inverse=True)
    totals = np.stack([added(at, x, len(found)) for x in n])
    sums = (int(((totals[0] > 0) & (found != OTHER)).sum()), int(totals[0].sum()), int(totals[3].sum()))
    rest = [0] * (rows.num_rows - 1)
    return pa.table(answer(rows, bounds, *totals[:, at]) | {
        c: pa.array([s, *rest], pa.int64()) for c, s in zip(("kinds", "background", "target"), sums)})


def losses(pair: np.ndarray, word: np.ndarray, left: np.ndarray, followers: np.ndarray, total, kinds: int) -> np.ndarray:
    """-ln P(word | previous) of every pair, Witten-Bell over a unigram model with one added to each count.

    ``pair``, ``word`` and ``left`` are the counts of the pair, its word and its previous word; ``kinds`` has
    one more than the words, for any other.
    """
    unigram = (word + 1) / (total + kinds)
    weight = left + followers
    return -np.log(np.where(weight > 0, (pair + followers * unigram) / np.maximum(weight, 1), unigram))


def score(shared, slots: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        b = Bucket(rows, shared)
        means = [np.zeros(len(b.n)) for _ in range(2)]
        if len(b.keys):
            of_words = answers.column("_of_words")
            words = answers.filter(of_words)
            pair = b.answers(answers.filter(pc.invert(of_words)), b.keys, slots, 2)
            word = b.answers(words, b.words, slots, 6)
            kinds = words.column("kinds")[0].as_py() + 1
            doc, p, times, of_word, of_before = b.own_counts()
            for k, name in enumerate(("background", "target")):
                count, left, followers = word[3 * k : 3 * k + 3]
                w, v, member = b.word[p], b.before[p], b.members[k][doc]
                own = times * member
                alone = (own > 0) & (pair[k][p] == own)  # pairs that no other document of the model holds
                loss = losses(
                    pair[k][p] - own, count[w] - of_word.sums(times) * member, left[v] - of_before.sums(times) * member,
                    followers[v] - of_before.sums(alone), words.column(name)[0].as_py() - b.n[doc] * member, kinds)
                means[k] = np.bincount(doc, loss * times, len(b.n)) / np.maximum(b.n, 1)
        background, target = means
        return pa.table({"_id": b.ids, "_n": pa.array(b.n, pa.int64()), "_target": pa.array(target), "_background": pa.array(background)})

    return run


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_bucket")


def cross_entropy_difference(docs: DataFrame, target: DataFrame, vocabulary: int | None = None) -> DataFrame:
    """``doc_id, n_words, target_loss, background_loss, score`` of every row of ``docs``.

    ``target`` holds the ids of the target documents in ``doc_id``.  Losses are nats per word, to six digits.
    With ``vocabulary``, only its ``vocabulary - 2`` most frequent words (ties by hash) are told apart, all others
    are one symbol.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].alias("_id"), text_or_null(docs).alias("_text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = None
    if vocabulary is not None:
        counted = rows.select("_text").mapInArrow(word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        top = counted.orderBy(F.desc("n"), "word").limit(vocabulary - 2).select("word").toArrow().column("word").to_numpy()
        shared = spark.sparkContext.broadcast(np.sort(top.view(np.uint64)))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets, slots = max(2 * partitions(spark), size // BUCKET + 1), max(partitions(spark), size // SLOT + 1)
    chosen = target.select(target["doc_id"].cast(kind).alias("_id")).where("_id is not null").distinct()
    # the target's ids go to the buckets as rows without text
    name = F.col("_id").cast("string")
    held = rows.select(bucket_of(F.coalesce(name, "_text", F.lit("")), buckets), "_id", "_text", F.lit(False).alias("_mark")).unionAll(
        chosen.select(bucket_of(name, buckets), "_id", F.lit(None).cast("string").alias("_text"), F.lit(True).alias("_mark")))
    held = held.groupBy("_bucket")
    asked = held.applyInArrow(ask_pairs(shared, slots), ASKED).groupBy("_slot")
    heads, pairs = (asked.applyInArrow(f, PAIRS) for f in (head_pairs, count_pairs))
    words = held.cogroup(heads.groupBy("_bucket")).applyInArrow(ask_words(shared, slots), ASKED).groupBy("_slot").applyInArrow(answer_words, WORDS)
    sums = words.agg(*(F.sum(c).alias(c) for c in ("kinds", "background", "target")))
    nothing = [F.lit(None).cast("long").alias(c) for c in sums.columns]
    answers = pairs.select("*", *nothing, F.lit(False).alias("_of_words")).unionAll(
        words.select("_bucket", "_slot", "n").crossJoin(F.broadcast(sums)).select("*", F.lit(True).alias("_of_words")))
    scored = held.cogroup(answers.groupBy("_bucket")).applyInArrow(
        score(shared, slots), f"_id {kind}, _n long, _target double, _background double")
    return scored.select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_words"), F.round("_target", 6).alias("target_loss"),
        F.round("_background", 6).alias("background_loss"), F.round(F.col("_target") - F.col("_background"), 6).alias("score"))
