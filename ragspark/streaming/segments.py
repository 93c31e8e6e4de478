"""Streaming voice-activity segmentation: the batch state machine kept as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ragspark.operators.segmentation import SpeechSegmenter

_STATE = (
    "ring_seq array<bigint>, ring_n array<int>, last bigint, speech_run int, silence_run int, in_speech boolean, "
    "start bigint, frames int, samples int, last_partial bigint"
)
_COLUMNS = ["kind", "start_seq", "end_seq", "n_frames", "n_samples", "reason"]


def _load(values: tuple) -> SpeechSegmenter:
    machine = SpeechSegmenter()
    seqs, counts, machine.last, *rest = values
    machine.ring = [(int(s), int(n)) for s, n in zip(seqs, counts)]
    for name, value in zip(SpeechSegmenter.FIELDS, rest):
        setattr(machine, name, value)
    return machine


def _save(machine: SpeechSegmenter) -> tuple:
    return (
        [s for s, _ in machine.ring], [n for _, n in machine.ring], machine.last,
        *[getattr(machine, name) for name in SpeechSegmenter.FIELDS],
    )


def utterances_stream(frames: DataFrame, key: str = "stream_id", idle_ms: int | None = 60_000) -> DataFrame:
    """Segments of ``frames(stream_id, seq, speech, n_samples, time_ms)`` as they close.

    Frames of a trigger are put in sequence order; a stream idle for ``idle_ms`` is flushed and forgotten.
    Without ``idle_ms`` streams never end, and the query can run once over what is available.
    """
    dtype = frames.schema[key].dataType.simpleString()

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = _load(state.get) if state.exists else SpeechSegmenter()
        if state.hasTimedOut:
            out = machine.flush()
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
            out = []
            for seq, speech, n, now in zip(rows["seq"], rows["speech"], rows["n_samples"], rows["time_ms"]):
                out += machine.push(int(seq), bool(speech), int(n), int(now))
            state.update(_save(machine))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        if out:
            result = pd.DataFrame(out, columns=_COLUMNS)
            result.insert(0, key, group[0])
            yield result

    return frames.groupBy(key).applyInPandasWithState(
        step, f"{key} {dtype}, kind string, start_seq bigint, end_seq bigint, n_frames int, n_samples int, reason string",
        _STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )
