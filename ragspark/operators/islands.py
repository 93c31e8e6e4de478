"""Voice segmentation by islands: where an utterance ends follows from where it starts, for all frames at once.

After a reset, the next utterance begins at the first frame that ends a long enough run of speech, and ends at the
first long enough silence or full sample count after it.  Both are sorted searches in run lengths and prefix sums, so a
block of frames tells the reset after every reset without replaying a state.  What a block does to the state it
is entered with is a small map; the maps are followed from block to block, and each block then finds its utterances
from its own entry.  A stream that never pauses thus fills many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ragspark.functions import fixed as X
from ragspark.operators.ordered import Ordering, with_halo

_RING = X.PRE_ROLL_FRAMES
_HALO = X.TRAILING_SILENCE_FRAMES + _RING
_NO_TIME = -(1 << 61)
_FRAMES = "FRAMES"


@dataclass(frozen=True)
class _Entry:
    """State before a block: ``idle`` frames since the last reset (at most the ring), or -1 inside an utterance that
    began at ``start`` and holds ``held`` samples."""

    idle: int = 0
    held: int = 0
    start: int = 0


class _Block:
    """Frames of one block with those just before it; positions count from the first of the latter."""

    def __init__(self, table: pa.Table) -> None:
        rows = table.sort_by("_i").combine_chunks()
        self.first = rows.column("_i")[0].as_py()
        self.own = int(np.count_nonzero(rows.column("_halo").to_numpy()))
        self.n = rows.num_rows
        self.time = rows.column("_t").to_numpy()
        self.sums = np.concatenate(([0], np.cumsum(rows.column("_n").to_numpy(), dtype=np.int64)))
        speech = rows.column("_speech").to_numpy().astype(bool)
        at = np.arange(self.n)
        talk = at - np.maximum.accumulate(np.where(speech, -1, at))
        quiet = at - np.maximum.accumulate(np.where(speech, at, -1))
        self.starts = np.flatnonzero(talk >= X.MIN_SPEECH_FRAMES)
        self.ends = np.flatnonzero(quiet >= X.TRAILING_SILENCE_FRAMES)

    def silence_after(self, at):
        """First end of a long silence behind ``at``, or ``n``."""
        return np.append(self.ends, self.n)[np.searchsorted(self.ends, at, "right")]

    def full_after(self, at, samples):
        """First frame behind ``at`` by which the prefix sum reaches ``samples``, or ``n``."""
        return np.minimum(self.n, np.maximum(at + 1, np.searchsorted(self.sums[1:], samples)))

    def after_reset(self, reset):
        """Per reset: the frame that opens the next utterance (``n``: none), the frame before its ring, its end."""
        lo = np.maximum(reset + X.MIN_SPEECH_FRAMES, self.own)
        opens = np.append(self.starts, self.n)[np.searchsorted(self.starts, lo)]
        before = np.minimum(self.n - 1, np.maximum(reset, opens - _RING))
        full = self.full_after(opens, self.sums[before + 1] + X.MAX_UTTERANCE_SAMPLES)
        return opens, before, np.minimum(self.silence_after(opens), full)

    def exits(self, reset, opens, before):
        """State behind the block of resets whose utterance, if any, does not end in it: idle, held, start."""
        inside = opens < self.n
        return (
            np.where(inside, -1, np.minimum(_RING, self.n - 1 - reset)),
            np.where(inside, self.sums[self.n] - self.sums[before + 1], 0),
            np.where(inside, self.first + before + 1, 0),
        )

    def entry_reset(self, idle):
        return np.maximum(-1, self.own - 1 - idle)


def _map(block: _Block) -> dict:
    """What the block makes of its entry: the state behind it after each idle entry, after the first silence that
    ends an utterance carried in, and after each frame at which one may be full (``upto`` samples in the block)."""
    own, n = block.own, block.n
    rows = np.arange(own, n)
    opens, before, ends = block.after_reset(rows)
    last = np.where(ends < n, ends, rows) - own  # the last reset of the block, by pointer doubling
    while True:
        further = last[last]
        if (further == last).all():
            break
        last = further

    idle = block.entry_reset(np.arange(_RING + 1))
    i_opens, i_before, i_ends = block.after_reset(idle)
    stays = i_ends == n
    silence = int(block.silence_after(own - 1))
    full = last[: silence - own]  # a full utterance ends before the silence
    cuts = np.flatnonzero(np.append(full[1:] != full[:-1], True)) if len(full) else np.zeros(0, np.int64)
    via = np.concatenate((last[np.minimum(i_ends, n - 1) - own], last[[min(silence, n - 1) - own]], full[cuts]))
    found = block.exits(rows[via], opens[via], before[via])
    straight = block.exits(idle, i_opens, i_before)
    for some, those in zip(found, straight):
        some[: _RING + 1][stays] = those[stays]
    return {
        "upto": block.sums[own + 1 + cuts] - block.sums[own], "idle": found[0], "held": found[1], "start": found[2],
        "total": int(block.sums[n] - block.sums[own]), "silent": silence < n,
    }


def _follow(entry: _Entry, upto: np.ndarray, states: tuple[np.ndarray, ...], total: int, silent: bool) -> _Entry:
    if entry.idle >= 0:
        at = entry.idle
    else:
        at = int(np.searchsorted(upto, X.MAX_UTTERANCE_SAMPLES - entry.held))
        if at < len(upto):
            at += _RING + 2
        elif silent:
            at = _RING + 1
        else:
            return _Entry(-1, entry.held + total, entry.start)
    return _Entry(*(int(s[at]) for s in states))


def _partials(time: np.ndarray, held: np.ndarray, last: int) -> tuple[list[int], int]:
    """Positions of partial results among frames, and the time of the newest one."""
    out, at, look = [], int(np.searchsorted(held, X.PARTIAL_MIN_SAMPLES)), 64
    while at < len(time):
        due = np.flatnonzero(time[at:at + look] - last >= X.PARTIAL_INTERVAL_MS)
        if len(due):
            out.append(at + int(due[0]))
            at, last, look = out[-1] + 1, int(time[out[-1]]), 64
        else:
            at, look = at + look, 2 * look
    return out, last


def _found(block: _Block, entry: _Entry) -> list[tuple]:
    """Rows of the utterances that touch the block: kind, start, end, samples, reason, times, sums.

    One that lies inside it gives its results.  Of one that crosses an edge the block gives its frames, ``FRAMES``, from
    which the results follow once all blocks are together, and the end if it ends here.
    """
    rows: list[tuple] = []

    def utterance(opens: int, start: int, offset: int, end: int, silent: bool) -> None:
        """``offset`` plus the prefix sum is what the utterance holds; ``opens`` is before the block if carried in."""
        carried, stop = opens < block.own, min(end, block.n - 1) + 1
        at = block.own if carried else opens + 1
        held = offset + block.sums[at + 1: stop + 1]
        time = block.time[at:stop]
        if carried or end == block.n:
            # the opening frame only sets the clock
            clock = None if carried else int(block.time[opens])
            so_far = int(held[-1]) if len(held) else int(offset + block.sums[stop])
            rows.append((_FRAMES, start, block.first + stop - 1, so_far, None, clock, time, held))
        else:
            for i in _partials(time, held, int(block.time[opens]))[0]:
                rows.append(("PARTIAL", start, block.first + at + i, int(held[i]), "CADENCE", None, None, None))
        if end < block.n:
            samples = int(offset + block.sums[end + 1])
            rows.append(("FINAL", start, block.first + end, samples, "SILENCE" if silent else "MAX_LENGTH", None, None, None))

    reset = int(block.entry_reset(max(entry.idle, 0)))
    if entry.idle < 0:
        offset = entry.held - int(block.sums[block.own])
        silence = int(block.silence_after(block.own - 1))
        reset = min(silence, int(block.full_after(block.own - 1, X.MAX_UTTERANCE_SAMPLES - offset)))
        utterance(-1, entry.start, offset, reset, silence == reset)
    while reset < block.n:
        opens, before, end = (int(v) for v in block.after_reset(reset))
        if opens == block.n:
            break
        utterance(opens, block.first + before + 1, -int(block.sums[before + 1]), end, int(block.silence_after(opens)) == end)
        reset = end
    return rows


def utterances(frames: DataFrame, by: Ordering, speech: Column, samples: Column, time_ms: Column, index: str = "seq",
               block_rows: int = 65_536) -> DataFrame:
    """Voice-activity segments and partial-result points per key: ``kind, start_seq, end_seq, n_frames, n_samples, reason``.

    ``frames`` must have a dense one-based ``index`` and keys that are not null.  A frame with null ``speech`` is silent,
    one with null or negative ``samples`` has none, and one with null ``time_ms`` tells no partial result.  An utterance
    still open at the end of its key ends there.

    Frames are shuffled once, in blocks of ``block_rows`` (over 43) by key and index.  Between blocks only the maps of
    their states travel, a few hundred numbers each; frames travel a second time only of utterances that cross an edge.
    """
    keys = list(by.keys)
    base = frames.select(
        *keys, F.col(index).cast("bigint").alias("_i"), F.coalesce(speech, F.lit(False)).cast("tinyint").alias("_speech"),
        F.greatest(F.coalesce(samples.cast("bigint"), F.lit(0)), F.lit(0)).alias("_n"),
        F.coalesce(time_ms.cast("bigint"), F.lit(_NO_TIME)).alias("_t"),
    )
    blocks = with_halo(base, "_i", block_rows, _HALO).withColumn("_halo", F.col("_halo").cast("tinyint"))
    # a halo without a block behind it belongs to the end of the key
    fields = frames.select(*keys).schema
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    keyed = [pa.field(f.name, to_arrow_type(f.dataType)) for f in fields]
    n_keys = len(keys)

    lists = [(c, pa.list_(pa.int64())) for c in ("upto", "idle", "held", "start")]
    map_schema = pa.schema([*keyed, ("_block", pa.int64()), *lists, ("total", pa.int64()), ("silent", pa.bool_())])

    def maps_of(table: pa.Table) -> pa.Table:
        block = _Block(table)
        if block.own == block.n:
            return map_schema.empty_table()
        first = table.slice(0, 1)
        told = _map(block)
        return pa.table([*[first.column(k) for k in [*keys, "_block"]], *[pa.array([told[f.name]], f.type) for f in list(map_schema)[n_keys + 1:]]],
                        schema=map_schema)

    numbers = "upto array<bigint>, idle array<bigint>, held array<bigint>, start array<bigint>, total bigint, silent boolean"
    maps = blocks.groupBy(*keys, "_block").applyInArrow(maps_of, f"{named}, _block bigint, {numbers}")

    entry_schema = pa.schema([*keyed, ("_block", pa.int64()), ("idle", pa.int64()), ("held", pa.int64()), ("start", pa.int64())])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, entry = None, _Entry()
        for batch in batches:
            entries = []
            for i in range(batch.num_rows):
                key = tuple(c[i].as_py() for c in batch.columns[:n_keys])
                if key != current:
                    current, entry = key, _Entry()
                entries.append(entry)
                upto, *states = (batch.column(c)[i].values.to_numpy() for c in ("upto", "idle", "held", "start"))
                entry = _follow(entry, upto, states, batch.column("total")[i].as_py(), batch.column("silent")[i].as_py())
            told = [pa.array([getattr(e, f) for e in entries], pa.int64()) for f in ("idle", "held", "start")]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n_keys + 1], *told], schema=entry_schema)

    entries = maps.repartition(*keys).sortWithinPartitions(*keys, "_block").mapInArrow(
        follow, f"{named}, _block bigint, idle bigint, held bigint, start bigint")

    found_schema = pa.schema([
        *keyed, ("kind", pa.string()), ("start_seq", pa.int64()), ("end_seq", pa.int64()), ("n_samples", pa.int64()),
        ("reason", pa.string()), ("clock", pa.int64()), ("times", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64())),
    ])

    def find(table: pa.Table, entry: pa.Table) -> pa.Table:
        if not entry.num_rows:
            return found_schema.empty_table()
        state = _Entry(*(entry.column(c)[0].as_py() for c in ("idle", "held", "start")))
        rows = _found(_Block(table), state)
        key = [pa.array([table.column(k)[0].as_py()] * len(rows), f.type) for k, f in zip(keys, keyed)]
        values = list(zip(*rows)) or [[]] * 8
        return pa.table([*key, *[pa.array(list(v), f.type) for v, f in zip(values, list(found_schema)[n_keys:])]], schema=found_schema)

    found = blocks.groupBy(*keys, "_block").cogroup(entries.groupBy(*keys, "_block")).applyInArrow(
        find, f"{named}, kind string, start_seq bigint, end_seq bigint, n_samples bigint, reason string, clock bigint, "
              "times array<bigint>, sums array<bigint>")
    # frames come before the end they lead to
    placed = found.repartition(*keys, "start_seq").sortWithinPartitions(*keys, "start_seq", "end_seq", F.col("kind") != _FRAMES)

    out_schema = pa.schema([
        *keyed, ("kind", pa.string()), ("start_seq", pa.int64()), ("end_seq", pa.int64()), ("n_frames", pa.int32()),
        ("n_samples", pa.int32()), ("reason", pa.string()),
    ])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, clock, open_end = None, _NO_TIME, None
        out: list[tuple] = []

        def row(kind: str, end: int, samples: int, reason: str) -> None:
            if kind == "PARTIAL" or samples >= X.MIN_UTTERANCE_SAMPLES:
                out.append((*current[:-1], kind, current[-1], end, end - current[-1] + 1, samples, reason))

        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in [*keys, "start_seq", "kind", "end_seq", "n_samples", "reason", "clock"]]
            for i, values in enumerate(zip(*plain)):
                who, (kind, end, samples, reason, opened) = values[: n_keys + 1], values[n_keys + 1:]
                if who != current:
                    if open_end:
                        row("FINAL", *open_end, "END_OF_STREAM")
                    current, open_end = who, None
                if kind != _FRAMES:
                    row(kind, end, samples, reason)
                    open_end = None if kind == "FINAL" else open_end
                    continue
                clock = clock if opened is None else opened
                times, sums = (batch.column(c)[i].values.to_numpy() for c in ("times", "sums"))
                shown, clock = _partials(times, sums, clock)
                for at in shown:
                    row("PARTIAL", end - len(times) + 1 + at, int(sums[at]), "CADENCE")
                open_end = (end, samples)
            if out:
                yield _batch(out, out_schema)
                out.clear()
        if open_end:
            row("FINAL", *open_end, "END_OF_STREAM")
            yield from [_batch(out, out_schema)] if out else []

    return placed.mapInArrow(
        gather, f"{named}, kind string, start_seq bigint, end_seq bigint, n_frames int, n_samples int, reason string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
