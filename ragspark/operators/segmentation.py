"""Constant-size voice-activity state, shared by the batch and the streaming form."""

from __future__ import annotations

from ragspark.functions import fixed as X


class SpeechSegmenter:
    """Feed frames in order; yields ``(kind, start, end, frames, samples, reason)`` tuples.

    Only positions and counters are kept.  The pre-roll holds (position, samples) of at most eight frames.
    """

    FIELDS = ("speech_run", "silence_run", "in_speech", "start", "frames", "samples", "last_partial")

    def __init__(self) -> None:
        self.ring: list[tuple[int, int]] = []
        self.last = 0
        self._reset()

    def _reset(self) -> None:
        self.speech_run = self.silence_run = self.start = self.frames = self.samples = self.last_partial = 0
        self.in_speech = False
        self.ring = []

    def push(self, seq: int, speech: bool, samples: int, now_ms: int) -> list[tuple]:
        self.last = seq
        if not self.in_speech:
            self.ring = [*self.ring, (seq, samples)][-X.PRE_ROLL_FRAMES:]
            self.speech_run = self.speech_run + 1 if speech else 0
            if self.speech_run >= X.MIN_SPEECH_FRAMES:
                self.in_speech, self.silence_run, self.last_partial = True, 0, now_ms
                self.start, self.frames = self.ring[0][0], len(self.ring)
                self.samples = sum(n for _, n in self.ring)
                self.ring = []
            return []
        out = []
        self.frames += 1
        self.samples += samples
        self.silence_run = 0 if speech else self.silence_run + 1
        if self.samples >= X.PARTIAL_MIN_SAMPLES and now_ms - self.last_partial >= X.PARTIAL_INTERVAL_MS:
            out.append(self._row("PARTIAL", "CADENCE"))
            self.last_partial = now_ms
        if self.silence_run >= X.TRAILING_SILENCE_FRAMES:
            out += self._finish("SILENCE")
        elif self.samples >= X.MAX_UTTERANCE_SAMPLES:
            out += self._finish("MAX_LENGTH")
        return out

    def flush(self) -> list[tuple]:
        """End of stream: an open utterance ends here."""
        return self._finish("END_OF_STREAM") if self.in_speech else []

    def _row(self, kind: str, reason: str) -> tuple:
        return (kind, self.start, self.last, self.frames, self.samples, reason)

    def _finish(self, reason: str) -> list[tuple]:
        out = [self._row("FINAL", reason)] if self.samples >= X.MIN_UTTERANCE_SAMPLES else []
        self._reset()
        return out
