"""Document files: listing, guards, and text of TXT and DOCX files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions import fixed as X
from ragspark.functions import text as T

DEFAULT_NAME = "document.txt"
DOCX_ENTRY = "word/document.xml"
XML_TEXT_CHARS = 1024 * 1024
PAGE_CHARS = 4 * 1024 * 1024
# Tokens never cross a run or page boundary; a newline between parts keeps them apart.
PART_SEPARATOR = "\n"


def list_files(spark: SparkSession, path: str | list[str], mime_of: Column | None = None) -> DataFrame:
    """Supported files under a folder, recursively: identity, name, size, type and time, without content.

    Only metadata columns are read.  Sort by ``source_uri`` where an order is shown.
    """
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.col("path").alias("source_uri"), "length", "modificationTime"
    )
    name = F.coalesce(F.element_at(F.split("source_uri", "/"), -1), F.lit(DEFAULT_NAME))
    zero = F.lit(0).cast("bigint")
    listed = meta.select(
        T.name_uuid(F.col("source_uri")).alias("document_id"), "source_uri", name.alias("display_name"),
        F.greatest(F.coalesce("length", zero), zero).alias("size_bytes"),
        F.coalesce(mime_of if mime_of is not None else F.lit(""), F.lit("")).alias("mime_type"),
        F.greatest(F.coalesce(F.unix_millis("modificationTime"), zero), zero).alias("modified_ms"),
    )
    return listed.where(T.is_supported_document(F.col("display_name"), F.col("mime_type")))


def read_contents(spark: SparkSession, path: str | list[str], limit: int = X.DOCUMENT_BYTES) -> DataFrame:
    """``source_uri, content`` of files within the size limit; the length test is pushed to the scan."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .where(F.col("length") <= limit).select(F.col("path").alias("source_uri"), "content")
    )


UNREADABLE = "Document content could not be read"


class _Runs:
    """Parser target collecting character data between markup events, in document order."""

    def __init__(self) -> None:
        self.runs: list[str] = []
        self.open: list[str] = []

    def _cut(self) -> None:
        text = "".join(self.open)
        if len(text) > XML_TEXT_CHARS:
            raise OSError("DOCX text event exceeds bounded memory limit")
        if text:
            self.runs.append(text)
        self.open = []

    def start(self, tag: str, attributes: dict) -> None:
        self._cut()

    def end(self, tag: str) -> None:
        self._cut()

    def data(self, text: str) -> None:
        self.open.append(text)

    def close(self) -> list[str]:
        self._cut()
        return self.runs


def docx_text(content: bytes) -> str:
    """Text runs of the main document part; every run is tokenised on its own."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        if DOCX_ENTRY not in archive.namelist():
            return ""
        parser = ElementTree.XMLParser(target=_Runs())
        with archive.open(DOCX_ENTRY) as part:
            for block in iter(lambda: part.read(64 * 1024), b""):
                parser.feed(block)
        return PART_SEPARATOR.join(parser.close())


def extract_text(
    files: DataFrame, contents: DataFrame, pdf_pages: Callable[[bytes], Iterator[str]] | None = None,
) -> DataFrame:
    """``document_id, text, error`` of listed files, one row each.

    A file without content (over the size limit, or gone since it was listed) gives an error row.  TXT is
    decoded in the JVM, bad bytes replaced.  DOCX, and PDF when a page reader is given, run in Arrow batches; without
    a reader a PDF gives an error row, never invented text.
    """
    fmt = T.document_format(F.col("display_name"), F.col("mime_type"))
    rows = files.select("document_id", "source_uri", fmt.alias("format"), "size_bytes").join(contents, "source_uri", "left")
    reason = F.when(F.col("size_bytes") > X.DOCUMENT_BYTES, X.DOCUMENT_TOO_LARGE).otherwise(UNREADABLE)
    absent = rows.where("content IS NULL").select("document_id", F.lit(None).cast("string").alias("text"), reason.alias("error"))
    rows = rows.where("content IS NOT NULL")
    plain = rows.where("format = 'TXT'").select(
        "document_id", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.lit(None).cast("string").alias("error")
    )
    packed = rows.where("format IN ('DOCX', 'PDF')").select("document_id", "format", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for kind, content in zip(batch.column("format").to_pylist(), batch.column("content").to_pylist()):
                text, error = None, None
                try:
                    if kind == "DOCX":
                        text = docx_text(content)
                    elif pdf_pages is None:
                        error = "PDF reader is not available"
                    else:
                        text = PART_SEPARATOR.join(_bounded(pdf_pages(content)))
                except Exception as problem:  # one bad file must not fail the folder
                    error = str(problem) or type(problem).__name__
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays(
                [batch.column("document_id"), pa.array(texts, pa.string()), pa.array(errors, pa.string())],
                names=["document_id", "text", "error"],
            )

    return plain.unionByName(absent).unionByName(packed.mapInArrow(read, "document_id string, text string, error string"))


def _bounded(pages: Iterator[str]) -> Iterator[str]:
    for page in pages:
        if len(page) > PAGE_CHARS:
            raise OSError("PDF page exceeds bounded memory limit")
        yield page


def file_digests(contents: DataFrame) -> DataFrame:
    """Lowercase SHA-256 of each file."""
    return contents.select("source_uri", F.sha2("content", 256).alias("sha256"))
