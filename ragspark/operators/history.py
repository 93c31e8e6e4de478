"""Conversation history: the last messages and their character budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions import fixed as X
from ragspark.functions import text as T


def last_messages(messages: DataFrame, keys: list[str], order: str, n: int = X.HISTORY_MESSAGES) -> DataFrame:
    """The last ``n`` messages per key.

    The limit applies on the map side as well, so a hot conversation shuffles ``n`` rows per task.
    """
    latest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return messages.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= n).drop("_n")


def budget(
    messages: DataFrame, keys: list[str], order: str, text_col: str = "text", n: int = X.HISTORY_MESSAGES,
    total: int = X.HISTORY_CHARS, each: int = X.MESSAGE_CHARS, newest_first: bool = False,
) -> DataFrame:
    """Last ``n`` messages with the excerpt each may use; blanks and starved messages drop out.

    Oldest messages spend first (``newest_first`` reverses that).  The greedy rule equals a prefix
    sum: each message takes what its predecessors' caps leave.
    """
    recent = last_messages(messages, keys, order, n)
    clean = T.trim_all(F.col(text_col))
    spend = Window.partitionBy(*keys).orderBy(F.desc(order) if newest_first else F.asc(order)).rowsBetween(
        Window.unboundedPreceding, -1
    )
    capped = recent.withColumn("_clean", clean).withColumn("_cap", F.least(F.lit(each), F.length("_clean")))
    before = F.coalesce(F.sum("_cap").over(spend), F.lit(0))
    taken = F.greatest(F.lit(0), F.least(F.col("_cap"), F.lit(total) - before)).cast("int")
    return (
        capped.withColumn("taken", taken).where(F.col("taken") > 0)
        .withColumn("excerpt", T.take_chars(F.col("_clean"), F.col("taken"))).drop("_clean", "_cap")
    )


def history_lines(budgeted: DataFrame, keys: list[str], order: str, role_col: str = "role", user_role: str = "user",
                  assistant_label: str = "Assistant") -> DataFrame:
    """``keys, history``: one labelled line per kept message, in order (at most ``n`` per key)."""
    line = F.concat(
        F.when(F.lower(role_col) == user_role, F.lit("User: ")).otherwise(F.lit(f"{assistant_label}: ")), F.col("excerpt"), F.lit("\n")
    )
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return budgeted.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["l"]), "").alias("history"))
