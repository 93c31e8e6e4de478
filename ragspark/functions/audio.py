"""PCM16 expressions.  The loudness and the transcription scales differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the segmentation contract (16 kHz mono).
SAMPLE_RATE = 16_000
FRAME_SAMPLES = 320
SPEECH_RMS = 0.018
RMS_SCALE = 32_767.0
PCM_SCALE = 32_768.0


def rms(samples: Column) -> Column:
    """Root mean square of samples / 32767 as float32; 0 for an empty frame."""
    total = F.aggregate(
        samples, F.lit(0.0),
        lambda acc, s: acc + (s.cast("double") / RMS_SCALE) * (s.cast("double") / RMS_SCALE),
    )
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(0.0).cast("float")


def is_speech(loudness: Column) -> Column:
    return loudness.cast("float") >= F.lit(SPEECH_RMS).cast("float")


def pcm_to_float(samples: Column) -> Column:
    return F.transform(samples, lambda s: (s.cast("double") / PCM_SCALE).cast("float"))


def read_state(read: Column) -> Column:
    return F.when(read > 0, "DATA").when(read == 0, "EMPTY").otherwise("TERMINAL")
