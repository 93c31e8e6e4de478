"""String expressions.  Everything here is a native Column; nothing leaves the JVM.

Lengths and prefixes count code points.  They equal UTF-16 units for text inside the basic
multilingual plane.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set of the document tokeniser.  All Unicode separators, TAB..CR
# and the four information separators; U+0085 is deliberately not in it.
WHITESPACE_CLASS = r"\p{Z}\x09-\x0D\x1C-\x1F"
WHITESPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f " + "".join(
    chr(c) for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
# The whitespace of regular expressions on the JVM (ASCII only).
REGEX_SPACE = r"[ \t\n\x0B\f\r]+"
HTML_TAG = r"<[^>]*>"
MAX_TOKEN_LENGTH = 16_384
PRETOKEN_PATTERN = r"\p{L}+|\p{N}+|[^\p{L}\p{N} \t\n\x0B\f\r]"

# Supported document types, in dispatch order.
TEXT_MIME = "text/plain"
PDF_MIME = "application/pdf"
DOCX_MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
DOCUMENT_FORMATS = (("TXT", TEXT_MIME, ".txt"), ("PDF", PDF_MIME, ".pdf"), ("DOCX", DOCX_MIME, ".docx"))


def token_pattern(max_token_length: int = MAX_TOKEN_LENGTH) -> str:
    """A maximal run of non-whitespace, cut every ``max_token_length`` characters."""
    if max_token_length <= 0:
        raise ValueError("max_token_length must be positive")
    return f"[^{WHITESPACE_CLASS}]{{1,{max_token_length}}}"


def tokens(text: Column, max_token_length: int = MAX_TOKEN_LENGTH) -> Column:
    """Whitespace tokens in order; long runs are split, never dropped."""
    return F.regexp_extract_all(text, F.lit(token_pattern(max_token_length)), F.lit(0))


def token_count(text: Column, max_token_length: int = MAX_TOKEN_LENGTH) -> Column:
    """Number of tokens, without building them."""
    return F.regexp_count(text, F.lit(token_pattern(max_token_length)))


def pretokens(text: Column) -> Column:
    """Lowercased letter runs, number runs and single symbols."""
    return F.regexp_extract_all(F.lower(text), F.lit(PRETOKEN_PATTERN), F.lit(0))


def trim_all(text: Column) -> Column:
    """Trim the tokeniser's whitespace set (``trim`` alone removes only U+0020)."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def is_blank(text: Column) -> Column:
    return trim_all(text) == F.lit("")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, REGEX_SPACE, " ")


def strip_tags(text: Column) -> Column:
    """Markup to space, whitespace runs to one space, trimmed."""
    return trim_all(collapse_spaces(F.regexp_replace(text, HTML_TAG, " ")))


def take_chars(text: Column, n: int | Column) -> Column:
    return F.substring(text, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def compact_error(text: Column, limit: int = 160) -> Column:
    return take_chars(trim_all(collapse_spaces(text)), limit)


def stable_id(text: Column) -> Column:
    """First 12 bytes of SHA-256, as 24 hex digits."""
    return F.substring(F.sha2(text, 256), 1, 24)


def name_uuid(text: Column) -> Column:
    """Name-based (MD5, version 3) UUID of the UTF-8 bytes."""
    h = F.md5(text)
    variant = F.substring(
        F.lit("89ab"), (F.instr(F.lit("0123456789abcdef"), F.substring(h, 17, 1)) - 1) % 4 + 1, F.lit(1)
    )
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3),
        F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def prompt_cache_key(schema: str, fingerprint: Column, prompt: Column) -> Column:
    """SHA-256 of schema, model fingerprint (absent = empty) and prompt, joined by NUL."""
    nul = F.lit("\u0000")
    return F.sha2(F.concat(F.lit(schema), nul, F.coalesce(fingerprint, F.lit("")), nul, prompt), 256)


def document_format(name: Column, mime: Column) -> Column:
    """TXT / PDF / DOCX by MIME type or suffix; null when unsupported."""
    expr = F.lit(None).cast("string")
    for label, mime_type, suffix in reversed(DOCUMENT_FORMATS):
        expr = F.when((mime == mime_type) | F.lower(name).endswith(suffix), F.lit(label)).otherwise(expr)
    return expr


def is_supported_document(name: Column, mime: Column) -> Column:
    return document_format(name, mime).isNotNull()


def format_bytes(n: Column) -> Column:
    """Decimal units, one decimal rounded half up, a trailing ``.0`` removed, negatives as zero.

    Integer arithmetic keeps the rounding exact at any size.
    """
    v = F.greatest(n.cast("bigint"), F.lit(0).cast("bigint"))

    def scaled(unit: int, label: str) -> Column:
        tenths = _int_div(v + F.lit(unit // 20), unit // 10)
        whole, part = _int_div(tenths, 10).cast("string"), tenths % 10
        number = F.when(part == 0, whole).otherwise(F.concat(whole, F.lit("."), part.cast("string")))
        return F.concat(number, F.lit(label))

    return (
        F.when(v < 1_000, F.concat(v.cast("string"), F.lit(" B")))
        .when(v < 1_000_000, scaled(1_000, " KB"))
        .when(v < 1_000_000_000, scaled(1_000_000, " MB"))
        .otherwise(scaled(1_000_000_000, " GB"))
    )


def _int_div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def percent(done: Column, total: Column) -> Column:
    """Whole percent, truncated and clamped to 0..100; 0 when the total is not positive."""
    ratio = F.try_divide(done.cast("double"), total.cast("double")) * 100.0
    return F.when(total > 0, F.least(F.greatest(ratio.cast("bigint"), F.lit(0)), F.lit(100)).cast("int")).otherwise(0)


def fraction(done: Column, total: Column) -> Column:
    ratio = F.try_divide(done.cast("double"), total.cast("double"))
    return F.when(total > 0, F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


INVALID_NAME_CHARS = r"[^A-Za-z0-9._-]"
MAX_NAME_LENGTH = 180


def safe_file_name(value: Column, fallback: Column) -> Column:
    """URL-decode, keep the last path segment, replace unsafe characters, cap, trim dots and spaces."""
    decoded = F.coalesce(F.try_url_decode(value), value)
    segment = F.element_at(F.split(F.element_at(F.split(decoded, "/"), -1), r"\\"), -1)
    cleaned = F.btrim(
        take_chars(F.regexp_replace(trim_all(segment), INVALID_NAME_CHARS, "_"), MAX_NAME_LENGTH), F.lit(". ")
    )
    spare = take_chars(F.regexp_replace(fallback, INVALID_NAME_CHARS, "_"), MAX_NAME_LENGTH)
    return F.when(F.coalesce(cleaned, F.lit("")) != "", cleaned).otherwise(spare)


def file_extension(name: Column) -> Column:
    """Lowercase alphanumerics after the last dot, at most 12, ``bin`` when there are none."""
    raw = F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1)).otherwise("bin")
    ext = take_chars(F.regexp_replace(F.lower(raw), "[^a-z0-9]", ""), 12)
    return F.when(ext == "", F.lit("bin")).otherwise(ext)


def language_tag(tag: Column, auto_is_null: bool = False) -> Column:
    """Trimmed lowercase tag; blank (and, for speech, ``auto``) becomes null."""
    t = F.lower(trim_all(tag))
    empty = (t == "") | (t == "auto") if auto_is_null else t == ""
    return F.when(~empty, t)


CONTENT_RANGE = r"^bytes\s+(\d+)-(\d+)/(\d+)$"


def content_range(value: Column) -> Column:
    """``struct<start,end_inclusive,total>`` of a full match, else null (wildcards, overflow)."""
    split = F.split(F.regexp_replace(trim_all(value), CONTENT_RANGE, "$1,$2,$3"), ",")

    def parsed(parts: Column) -> Column:
        numbers = [F.get(parts, i).try_cast("bigint") for i in range(3)]
        ok = (F.size(parts) == 3) & numbers[0].isNotNull() & numbers[1].isNotNull() & numbers[2].isNotNull()
        return F.when(ok, F.struct(*[n.alias(name) for n, name in zip(numbers, ("start", "end_inclusive", "total"))]))

    # the lambda binds the split, so the pattern runs once
    return F.when(value.contains("bytes"), F.transform(F.array(split), parsed)[0])


def file_token(uri: Column, size: Column, modified_ms: Column) -> Column:
    """Checkpoint identity of a file: ``uri|size|mtime`` with negatives as zero."""
    zero = F.lit(0).cast("bigint")
    return F.concat_ws(
        "|", uri, F.greatest(size.cast("bigint"), zero).cast("string"),
        F.greatest(modified_ms.cast("bigint"), zero).cast("string"),
    )


def nocase_key(name: Column) -> Column:
    """ASCII-only case folding, the order of a NOCASE collation."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def provider_label(provider: Column, score: Column) -> Column:
    """Provider name, followed by the score to two decimals when there is one."""
    return F.concat(provider, F.when(score.isNull(), F.lit("")).otherwise(
        F.format_string(" \u00b7 %.2f", score.cast("double"))
    ))


def language_pair_label(source: Column, target: Column) -> Column:
    return F.concat(source, F.lit(" \u2192 "), target)
