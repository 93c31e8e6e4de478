"""Document catalog, persona and history tables: change detection, resume points, deletes, upserts.

Every function returns the new table; a single writer stores it under a new path.  Nothing is updated
in place, and keys are (document, ordinal), never generated numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions import fixed as X
from ragspark.functions import text as T
from ragspark.operators.chunking import CHUNK_OVERLAP
from ragspark.schemas import TRANSLATION_HISTORY

METADATA = ("display_name", "size_bytes", "mime_type", "modified_ms")


def guard_error(size: Column, name: Column, mime: Column) -> Column:
    """Null for a document that may be ingested, otherwise the reason."""
    return F.when(size > X.DOCUMENT_BYTES, X.TOO_LARGE).when(~T.is_supported_document(name, mime), X.UNSUPPORTED_TYPE)


def records(catalog: DataFrame) -> DataFrame:
    """The public view of the catalog: headers without the change-detection time."""
    return catalog.drop("modified_ms")


def same_metadata(left: str, right: str) -> Column:
    same = F.lit(True)
    for c in METADATA:
        same = same & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return same


def classify(listing: DataFrame, catalog: DataFrame, healthy: DataFrame | None = None, key: str = "document_id") -> DataFrame:
    """Each listed document as NEW, CHANGED, INCOMPLETE, UNCHANGED or REJECTED; catalog rows not listed as ABSENT.

    ``healthy`` holds the keys whose chunks are all complete; by default the ``indexed`` flag decides.
    """
    error = guard_error(F.col("l.size_bytes"), F.col("l.display_name"), F.col("l.mime_type"))
    both = listing.alias("l").join(catalog.alias("c"), F.col(f"l.{key}") == F.col(f"c.{key}"), "full")
    complete = F.coalesce(F.col("c.indexed"), F.lit(False))
    if healthy is not None:
        both = both.join(healthy.select(F.col(key).alias("_h")).distinct().alias("h"), F.col(f"c.{key}") == F.col("_h"), "left")
        complete = complete & F.col("_h").isNotNull()
    status = (
        F.when(F.col(f"l.{key}").isNull(), "ABSENT").when(error.isNotNull(), "REJECTED")
        .when(F.col(f"c.{key}").isNull(), "NEW").when(~same_metadata("l", "c"), "CHANGED")
        .when(~complete, "INCOMPLETE").otherwise("UNCHANGED")
    )
    return both.select(
        F.coalesce(f"l.{key}", f"c.{key}").alias(key), status.alias("status"),
        F.when(status == "REJECTED", error).alias("reason"),
    )


def resume_points(chunks: DataFrame, complete: Column, key: str = "document_id", overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Per document: first incomplete ordinal, next ordinal, token to resume from.

    The tail from the first incomplete chunk on is discarded, so what precedes it decides.
    """
    rows = chunks.select(key, "ordinal", "end_token", complete.alias("_ok"))
    broken = rows.where(~F.col("_ok")).groupBy(key).agg(F.min("ordinal").alias("first_incomplete"))
    before = rows.join(broken, key, "left")
    usable = F.col("first_incomplete").isNull() | (F.col("ordinal") < F.col("first_incomplete"))
    last = before.groupBy(key).agg(
        F.first("first_incomplete").alias("first_incomplete"),
        F.max(F.when(usable, F.struct("ordinal", "end_token"))).alias("_last"),
    )
    return last.select(
        key, "first_incomplete",
        F.coalesce(F.col("_last.ordinal") + 1, F.lit(0)).alias("next_ordinal"),
        F.greatest(F.coalesce(F.col("_last.end_token") - overlap, F.lit(0)), F.lit(0)).alias("resume_token"),
    )


def missing_chunks(expected: DataFrame, stored: DataFrame, complete: Column, key: str = "document_id") -> DataFrame:
    """Expected chunks without a complete stored one: holes in the middle are found too."""
    return expected.join(stored.where(complete).select(key, "ordinal"), [key, "ordinal"], "left_anti")


def health(catalog: DataFrame, chunks: DataFrame, complete: Column, key: str = "document_id") -> DataFrame:
    """Audit of the header count: the true count is the last complete ordinal + 1, not a row count."""
    facts = chunks.select(key, "ordinal", complete.alias("_ok")).groupBy(key).agg(
        F.bool_and("_ok").alias("_all"), (F.max(F.when(F.col("_ok"), F.col("ordinal"))) + 1).alias("_count")
    )
    joined = catalog.join(facts, key, "left")
    count = F.coalesce("_count", F.lit(0)).cast("int")
    return joined.select(
        key, F.coalesce("_all", F.lit(True)).alias("healthy"), count.alias("expected_count"),
        (F.col("chunk_count") == count).alias("count_ok"),
    )


def skip_completed(files: DataFrame, done: DataFrame, uri: str, size: str, modified: str) -> DataFrame:
    """Files whose ``uri|size|mtime`` token is not checkpointed yet."""
    token = T.file_token(F.col(uri), F.col(size), F.col(modified))
    return files.withColumn("token", token).join(done.select("token").distinct(), "token", "left_anti")


def folder_summary(files: DataFrame, folder: str, status: str = "outcome") -> DataFrame:
    """Per folder: discovered, indexed, skipped and failed files, and the message shown.

    Counts combine before the shuffle; the failures themselves stay rows (see ``folder_failures``).
    """
    def n(value: str) -> Column:
        return F.count(F.when(F.col(status) == value, 1))

    counted = files.groupBy(folder).agg(
        F.count("*").alias("discovered"), n("INDEXED").alias("indexed"), n("SKIPPED").alias("skipped"), n("FAILED").alias("failed")
    )
    return counted.withColumn("complete", F.col("indexed") + F.col("skipped") == F.col("discovered")).withColumn(
        "message", summary_message(F.col("discovered"), F.col("indexed"), F.col("skipped"), F.col("failed"))
    )


def summary_message(discovered: Column, indexed: Column, skipped: Column, failed: Column) -> Column:
    def text(c: Column) -> Column:
        return c.cast("string")

    return F.concat(
        F.lit("Indexed "), text(indexed), F.lit(" of "), text(discovered), F.lit(" files"),
        F.when(skipped > 0, F.concat(F.lit("; skipped "), text(skipped))).otherwise(""),
        F.when(failed > 0, F.concat(F.lit("; failed "), text(failed))).otherwise(""),
    )


def folder_failures(files: DataFrame, folder: str, uri: str, name: str, reason: str, status: str = "outcome") -> DataFrame:
    return files.where(F.col(status) == "FAILED").select(folder, uri, F.coalesce(name, uri).alias(name), reason)


def checkpoint_tokens(done: DataFrame, files: DataFrame, folder: str, status: str = "outcome") -> DataFrame:
    """Checkpoint after a run: tokens of completed files, dropped for folders that are complete."""
    ok = files.where(F.col(status).isin("INDEXED", "SKIPPED")).select(folder, "token")
    open_folders = files.where(F.col(status) == "FAILED").select(folder).distinct()
    return done.select(folder, "token").unionByName(ok).distinct().join(open_folders, folder, "left_semi")


def delete_documents(table: DataFrame, doomed: DataFrame, key: str = "document_id") -> DataFrame:
    """The table without the rows of the doomed documents; apply to vectors, chunks, then headers."""
    return table.join(doomed.select(key).distinct(), key, "left_anti")


def set_index_state(catalog: DataFrame, states: DataFrame, key: str = "document_id") -> DataFrame:
    """Headers with ``chunk_count`` and ``indexed`` replaced where ``states`` has the document."""
    new = states.select(key, F.col("chunk_count").alias("_n"), F.col("indexed").alias("_i"))
    swap = {"chunk_count": "_n", "indexed": "_i"}
    return catalog.join(new, key, "left").select(
        *[F.coalesce(swap[c], c).alias(c) if c in swap else F.col(c) for c in catalog.columns]
    )


def after_failure(catalog: DataFrame, failed: DataFrame, saved: DataFrame, key: str = "document_id") -> DataFrame:
    """Failed documents keep their saved chunk count and lose the indexed flag."""
    counts = failed.select(key).distinct().join(saved.select(key, "chunk_count"), key, "left")
    return set_index_state(catalog, counts.select(
        key, F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit(False).alias("indexed")
    ), key)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Insert or replace by key: the row with the highest ``version`` survives; combines before the shuffle.

    Of equal versions a row of ``rows`` beats one of ``table``, and a hash decides between the rest.
    """
    rest = [c for c in table.columns if c not in keys]
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    order = F.struct(F.col(version), F.col("_new"), F.xxhash64(*rest))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def set_active(personas: DataFrame, target: DataFrame, owner: str, key: str = "persona_id") -> DataFrame:
    """Exactly the target active per owner; an unknown target leaves the owner unchanged.

    ``target`` has one ``(owner, persona)`` row per owner at most.
    """
    wanted = target.select(owner, F.col(key).alias("_target"))
    known = wanted.join(personas.select(owner, F.col(key).alias("_target")), [owner, "_target"], "left_semi")
    return personas.join(known, owner, "left").select(*[
        F.when(F.col("_target").isNull(), F.col("active")).otherwise(F.col(key) == F.col("_target")).alias(c)
        if c == "active" else F.col(c) for c in personas.columns
    ])


def save_active(personas: DataFrame, row: DataFrame, owner: str, key: str = "persona_id") -> DataFrame:
    """Insert or replace rows and make them the only active ones of their owners."""
    others = personas.join(row.select(owner, key), [owner, key], "left_anti")
    cleared = others.join(row.select(owner, F.lit(True).alias("_hit")).distinct(), owner, "left").select(*[
        (F.col("active") & F.col("_hit").isNull()).alias("active") if c == "active" else F.col(c) for c in personas.columns
    ])
    return cleared.unionByName(row.withColumn("active", F.lit(True)))


def delete_outcome(personas: DataFrame, doomed: DataFrame, key: str = "persona_id") -> DataFrame:
    """Per requested delete: DELETED, or the error for an unknown id."""
    known = personas.select(key).distinct().withColumn("_known", F.lit(True))
    return doomed.join(known, key, "left").select(
        *doomed.columns, F.when(F.col("_known"), "DELETED").otherwise(X.PERSONA_DELETE_MISSING).alias("outcome")
    )


def persona_error(name: Column, prompt: Column, temperature: Column, top_p: Column, max_tokens: Column) -> Column:
    """First violated persona rule, or null."""
    n, p = T.trim_all(name), T.trim_all(prompt)

    def between(c: Column, low: float, high: float) -> Column:
        return c.cast("float").between(F.lit(low).cast("float"), F.lit(high).cast("float"))

    return (
        F.when(n == "", X.PERSONA_NAME_REQUIRED).when(F.length(n) > 80, X.PERSONA_NAME_LONG)
        .when(p == "", X.PERSONA_PROMPT_REQUIRED).when(F.length(p) > 20_000, X.PERSONA_PROMPT_LONG)
        .when(~between(temperature, 0.1, 1.0) | F.isnan(temperature), X.PERSONA_TEMPERATURE)
        .when(~between(top_p, 0.5, 1.0) | F.isnan(top_p), X.PERSONA_TOP_P)
        .when(~max_tokens.between(256, 4096), X.PERSONA_MAX_TOKENS)
    )


def persona_from_template(templates: DataFrame, new_id: Column, active: bool = False) -> DataFrame:
    return templates.withColumn("persona_id", new_id).withColumn("active", F.lit(active))


def persona_copy(personas: DataFrame, new_id: Column) -> DataFrame:
    """Duplicate: a new id, the name followed by `` copy``, inactive."""
    return personas.withColumn("persona_id", new_id).withColumn(
        "name", F.concat("name", F.lit(" copy"))
    ).withColumn("active", F.lit(False))


def recent_history(history: DataFrame, limit: int = X.RECENT_DEFAULT, created: str = "created_ms", key: str = "id") -> DataFrame:
    n = max(1, min(limit, X.RECENT_MAX))
    return history.orderBy(F.desc(created), F.desc(key)).limit(n)


def history_error(source: Column, translated: Column) -> Column:
    """Null for a translation that may be saved, otherwise the reason."""
    long = X.HISTORY_TEXT_CHARS
    return F.when(T.is_blank(source) | T.is_blank(translated), X.EMPTY_TRANSLATION).when(
        (F.length(source) > long) | (F.length(translated) > long), X.LONG_TRANSLATION
    )


def append_history(history: DataFrame, rows: DataFrame) -> DataFrame:
    return history.unionByName(rows.where(history_error(F.col("source_text"), F.col("translated_text")).isNull()))


# Additive schema steps (version reached, table, column, type, default).
MIGRATIONS = (
    (2, "document_chunks", "embedding", "array<float>", None),
    (4, "documents", "modified_ms", "bigint", 0),
)
HISTORY_VERSION = 3  # brought the table of translation history


def upgrade(table: DataFrame, name: str, from_version: int, to_version: int = 4) -> DataFrame:
    """Add the columns that versions after ``from_version`` brought, with their defaults."""
    for version, owner, column, dtype, default in MIGRATIONS:
        if owner == name and from_version < version <= to_version and column not in table.columns:
            table = table.withColumn(column, F.lit(default).cast(dtype))
    return table


def upgrade_tables(tables: dict[str, DataFrame], from_version: int, to_version: int = 4) -> dict[str, DataFrame]:
    """All tables of a store brought to ``to_version``: columns added with their defaults, new tables created empty.

    Running it again, or on tables that have a step already, changes nothing.
    """
    if not tables:
        raise ValueError("a store has at least one table")
    spark = next(iter(tables.values())).sparkSession
    done = {name: upgrade(rows, name, from_version, to_version) for name, rows in tables.items()}
    if from_version < HISTORY_VERSION <= to_version and "translation_history" not in done:
        done["translation_history"] = spark.createDataFrame([], TRANSLATION_HISTORY)
    return done


def first_match(rows: DataFrame, keys: list[str], condition: Column, order: list[str]) -> DataFrame:
    """First row per key that satisfies the condition, in an explicit order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.where(condition).groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    ).select(*keys, "_row.*")


def latest_rows(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(window)).where(F.col("position") <= n)
