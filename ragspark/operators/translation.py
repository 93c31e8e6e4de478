"""Translation guards, language lists and layout blocks around a pluggable translator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions import fixed as X
from ragspark.functions import text as T
from ragspark.operators.ordered import with_place

# How results are labelled, including one no path produces any more.
PROVIDERS = ("ML_KIT_PLAY_SERVICES", "LOCAL_OPUS_ONNX", "UNAVAILABLE")


def provider_kind(stored: Column) -> Column:
    """Stored provider name; anything unknown reads as UNAVAILABLE."""
    return F.when(stored.isin(*PROVIDERS), stored).otherwise("UNAVAILABLE")


def language_options(rows: DataFrame, tag: str, display: str | None = None) -> DataFrame:
    """Distinct normalised tags with a display name (the tag itself when there is none)."""
    t = T.language_tag(F.col(tag))
    name = F.lit(None).cast("string") if display is None else F.col(display)
    named = rows.select(t.alias("tag"), name.alias("_name")).where(F.col("tag").isNotNull())
    best = named.groupBy("tag").agg(F.min(F.when(~T.is_blank(F.col("_name")), F.col("_name"))).alias("_name"))
    return best.select("tag", F.coalesce("_name", "tag").alias("display_name"))


def sorted_options(options: DataFrame) -> DataFrame:
    """Options with their ``place`` in caseless order of the display name, then the tag."""
    return with_place(options.withColumn("_key", F.lower("display_name")), "_key", "tag").drop("_key")


def matches_language(query: Column, name: Column, tag: Column) -> Column:
    """Autocomplete: the trimmed lowercase query is part of the name or tag; a blank one matches all."""
    q = F.lower(T.trim_all(query))
    return (q == "") | F.contains(F.lower(name), q) | F.contains(F.lower(tag), q)


def default_language(options: DataFrame, preferred: str, exclude: str | None = None) -> DataFrame:
    """The preferred tag when offered, else the first by name that is not ``exclude``."""
    rows = options if exclude is None else options.where(F.col("tag") != exclude)
    return rows.orderBy(F.when(F.col("tag") == preferred, 0).otherwise(1), F.lower("display_name"), "tag").limit(1)


def valid_pairs(requests: DataFrame, supported: DataFrame, source: str, target: str) -> DataFrame:
    """Requests with normalised tags and ``pair_ok``: both are supported languages.

    A handful of tags holds most requests, so a shuffle by tag would send a whole language's texts to one task.  The
    distinct supported tags, a short list of languages, are broadcast instead; requests stay where they are.
    """
    tags = supported.select(T.language_tag(F.col("tag")).alias("_tag")).where("_tag IS NOT NULL").distinct()
    norm = requests.withColumn("source_tag", T.language_tag(F.col(source))).withColumn("target_tag", T.language_tag(F.col(target)))
    s = tags.select(F.col("_tag").alias("source_tag"), F.lit(True).alias("_s"))
    t = tags.select(F.col("_tag").alias("target_tag"), F.lit(True).alias("_t"))
    joined = norm.join(F.broadcast(s), "source_tag", "left").join(F.broadcast(t), "target_tag", "left")
    ok = F.coalesce(F.col("_s") & F.col("_t"), F.lit(False))
    return joined.select(*requests.columns, "source_tag", "target_tag", ok.alias("pair_ok"))


def translation_action(text: Column, source_tag: Column, target_tag: Column, pair_ok: Column, ready: Column) -> Column:
    """What a request needs: REJECT, EMPTY, IDENTITY, NOT_READY or TRANSLATE."""
    return (
        F.when(~pair_ok, "REJECT").when(T.is_blank(text), "EMPTY").when(source_tag == target_tag, "IDENTITY")
        .when(~ready, "NOT_READY").otherwise("TRANSLATE")
    )


def translate(requests: DataFrame, translator: Callable[[Column], Column], text: str = "text", action: str = "action") -> DataFrame:
    """Results for guarded requests; only TRANSLATE rows reach the translator."""
    result = (
        F.when(F.col(action) == "EMPTY", F.lit("")).when(F.col(action) == "IDENTITY", F.col(text))
        .when(F.col(action) == "TRANSLATE", translator(F.col(text)))
    )
    error = F.when(F.col(action) == "REJECT", F.lit(X.UNSUPPORTED_PAIR))
    return requests.withColumn("translated", result).withColumn("error", error)


def blocks_error(blocks: Column, source: Column, target: Column) -> Column:
    return F.when(T.is_blank(source) | T.is_blank(target), X.LANGUAGES_REQUIRED).when(
        F.size(blocks) > X.MAX_BLOCKS, X.TOO_MANY_BLOCKS
    )


def blocks_to_translate(blocks: Column, source: Column, target: Column) -> Column:
    """Blocks a translator sees: blanks skipped, but equal languages pass every block through."""
    same = F.lower(source) == F.lower(target)
    return F.when(same, blocks).otherwise(F.filter(blocks, lambda b: ~T.is_blank(b["text"])))


def shown_translation(ocr_text: Column, block_texts: Column, direct_source: Column, direct_text: Column) -> Column:
    """Block translation when there is one, else the direct one if it translates exactly this text."""
    blocks = T.trim_all(F.array_join(block_texts, " "))
    direct = F.when(T.trim_all(direct_source) == T.trim_all(ocr_text), T.trim_all(direct_text))
    return F.when(blocks != "", blocks).otherwise(F.coalesce(direct, F.lit("")))


def transcript_row(text: Column, partial: Column) -> Column:
    """``struct<kind,text>`` of a trimmed transcript; null when it is blank."""
    clean = T.trim_all(text)
    return F.when(clean != "", F.struct(F.when(partial, "Partial").otherwise("Final").alias("kind"), clean.alias("text")))
