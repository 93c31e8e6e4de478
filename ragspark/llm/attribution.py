"""Token counts by section: whole documents are encoded once and tokens attributed by their offsets.

A document is encoded as one string, so no token differs from what training will see.  Byte-level tokens
join back to the text, hence their byte lengths give every token's span; spans are joined to the ordered
sections by binary search.  A token that crosses a boundary goes wholly to one section, by ``rule``:

* ``start``: the section of its first byte,
* ``end``: the section of its last byte,
* ``majority``: the section with most of its bytes, the earlier one of equals.

So the sections' counts always add up to the document's.  A section is a line with its newline; text
after the last newline is a section too.

Edge cases: null and empty texts have no tokens and no sections; repeated rows are each reported; a very
long text is encoded whole; extra columns are not touched.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.shared import text_or_null

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# the public splitting pattern of this vocabulary
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "end", "majority")
SECTIONS = "array<struct<start:int,end:int,tokens:int>>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("sections", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def attribute(ends: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens per section and the number that cross a boundary.

    ``ends`` are the token ends in bytes, the first token starts at 0; ``starts`` are the section starts.
    """
    begin = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    crossing = np.flatnonzero(first != last)
    owner = last if rule == "end" else first
    if rule == "majority":
        owner = first.copy()
        for t in crossing:
            edges = np.concatenate(([begin[t]], starts[first[t] + 1 : last[t] + 1], [ends[t]]))
            owner[t] = first[t] + int(np.argmax(np.diff(edges)))
    return np.bincount(owner, minlength=len(starts)), len(crossing)


def section_batches(shared, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        encode = encoder(ranks)
        size = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        for batch in batches:
            texts = batch.column(1)
            total, crossed, offsets, parts = [], [], [0], []
            for x in texts:
                text = x.as_py() or ""
                raw = np.frombuffer(text.encode(), np.uint8)
                if not len(raw):
                    total.append(0)
                    crossed.append(0)
                    offsets.append(offsets[-1])
                    continue
                ends = np.cumsum(size[np.array(encode.encode_ordinary(text), np.int64)])
                starts = np.concatenate((np.zeros(1, np.int64), np.flatnonzero(raw[:-1] == 10) + 1))
                counts, crossing = attribute(ends, starts, rule)
                lead = np.add.reduceat((raw & 0xC0) != 0x80, starts, dtype=np.int64)
                chars = np.cumsum(lead)
                parts.append(np.stack((chars - lead, chars, counts)).astype(np.int32))
                total.append(len(ends))
                crossed.append(crossing)
                offsets.append(offsets[-1] + len(starts))
            flat = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int32)
            struct = pa.StructArray.from_arrays([pa.array(c) for c in flat], names=["start", "end", "tokens"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(crossed, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)],
                names=["_id", "n_tokens", "n_crossing", "sections"])

    return run


def section_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "majority") -> DataFrame:
    """``doc_id, n_tokens, n_crossing, sections`` of every row of ``docs``.

    ``sections`` lists the lines in order with their code point range and token count.  The vocabulary is
    read by the driver and sent to the executors; its size is fixed by the file.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(docs["doc_id"].alias("_id"), text_or_null(docs).alias("_text")).mapInArrow(
        section_batches(shared, rule), f"_id {kind}, n_tokens long, n_crossing long, sections {SECTIONS}"
    ).select(F.col("_id").alias("doc_id"), "n_tokens", "n_crossing", "sections")
