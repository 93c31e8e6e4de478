"""Vector blobs, vocabularies and manifests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark import schemas

MANIFEST_VERSION = 1


def to_blob(vector: Column) -> Column:
    """Little-endian float32 bytes of a vector; a null component becomes NaN."""

    @F.arrow_udf("binary")
    def pack(vectors: pa.Array) -> pa.Array:
        values = pc.fill_null(pc.list_flatten(vectors).cast(pa.float32()), float("nan"))
        lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
        offsets = np.concatenate([[0], np.cumsum(lengths) * 4]).astype(np.int32)
        data = values.to_numpy(zero_copy_only=False).astype("<f4").tobytes()
        blobs = pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return pc.if_else(vectors.is_valid(), blobs, pa.scalar(None, pa.binary()))

    return pack(vector)


def from_blob(blob: Column, dimensions: int) -> Column:
    """Vector of a little-endian blob; null when the length is wrong."""

    @F.arrow_udf("array<float>")
    def unpack(blobs: pa.Array) -> pa.Array:
        right = pc.fill_null(pc.equal(pc.binary_length(blobs), dimensions * 4), False).to_numpy(zero_copy_only=False)
        usable = blobs.filter(pa.array(right))
        if not len(usable):
            return pa.nulls(len(blobs), pa.list_(pa.float32()))
        start = usable.offset and np.frombuffer(usable.buffers()[1], np.int32)[usable.offset]
        data = np.frombuffer(usable.buffers()[2], np.uint8)[start:start + len(usable) * dimensions * 4]
        offsets = pa.array(np.arange(0, (len(usable) + 1) * dimensions, dimensions, dtype=np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(data.view("<f4").astype(np.float32)))
        return lists.take(pa.array(np.cumsum(right) - 1, mask=~right))

    return unpack(blob)


def vocabulary_from_lines(lines: list[str]) -> dict[str, int]:
    """Token to id: the line number, the last one for a repeated token."""
    return {token: i for i, token in enumerate(lines)}


def read_vocabulary(spark: SparkSession, path: str, limit: int = 1_000_000, max_bytes: int = 64 << 20) -> dict[str, int]:
    """A vocabulary file, read whole because line order is its meaning.

    Refused above ``max_bytes``, before its content is read, and above ``limit`` lines.
    """
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    if size is not None and size > max_bytes:
        raise ValueError("vocabulary is too large to share with every executor")
    text = spark.read.text(path, wholetext=True).first()["value"]
    lines = text.removesuffix("\n").split("\n")
    if len(lines) > limit:
        raise ValueError("vocabulary is too large to share with every executor")
    return vocabulary_from_lines([line.removesuffix("\r") for line in lines])


_NAMES = {"displayName": "display_name", "sizeBytes": "size_bytes", "storageKind": "storage_kind", "mimeType": "mime_type"}
_DEFAULTS = {"format": "binary", "mimeType": "application/octet-stream"}


def manifest_rows(payloads: DataFrame, body: str) -> DataFrame:
    """Artifact rows from manifest JSON bodies, in snake case, with ``manifest_error``.

    The error is null, or the first of: unknown key, unsupported schema version, duplicate id.
    """
    fields = [f.split()[0] for f in schemas.ARTIFACT.split(", ")]
    raw = F.from_json(F.col(body), "schemaVersion int, artifacts array<string>")
    keys = F.flatten(F.transform(raw["artifacts"], F.json_object_keys))
    unknown = F.size(F.array_except(keys, F.array(*[F.lit(f) for f in fields]))) > 0
    unknown_top = F.size(F.array_except(F.json_object_keys(F.col(body)), F.array(F.lit("schemaVersion"), F.lit("artifacts")))) > 0
    parsed = payloads.select(F.from_json(F.col(body), schemas.MANIFEST).alias("m"), (unknown | unknown_top).alias("_unknown"))
    ids = F.transform("m.artifacts", lambda x: x["id"])
    error = (
        F.when(F.col("_unknown"), "unknown key")
        .when(~F.col("m.schemaVersion").eqNullSafe(F.lit(MANIFEST_VERSION)), "unsupported schema version")
        .when(F.size(F.array_distinct(ids)) != F.size(ids), "duplicate id")
    )
    rows = parsed.select(error.alias("manifest_error"), F.explode("m.artifacts").alias("a")).select("manifest_error", "a.*")
    return rows.select(
        *[
            (F.coalesce(c, F.lit(_DEFAULTS[c])) if c in _DEFAULTS else F.col(c)).alias(_NAMES.get(c, c))
            for c in fields
        ],
        "manifest_error",
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Artifact rows of a manifest file; an unknown key, another version or a duplicate id fails the read."""
    rows = manifest_rows(spark.read.text(path, wholetext=True), "value")
    checked = F.when(F.col("manifest_error").isNull(), F.col("id")).otherwise(
        F.raise_error(F.concat(F.lit("manifest: "), F.col("manifest_error")))
    )
    return rows.withColumn("id", checked).drop("manifest_error")
