"""Prompt text assembly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragspark.functions import fixed as X
from ragspark.functions import text as T


def escape_markers(text: Column) -> Column:
    """Space out control markers so untrusted text cannot open or close a turn."""
    for marker in X.CONTROL_MARKERS:
        text = F.replace(text, F.lit(marker), F.lit(f"< {marker[1:-1]} >"))
    return text


def chat_turns(system: Column, user: Column) -> Column:
    def lit(s: str) -> Column:
        return F.lit(s)

    return F.concat(
        lit(f"{X.TURN_OPEN}system\n"), system, lit(f"{X.TURN_CLOSE}\n{X.TURN_OPEN}user\n"), user,
        lit(f"{X.TURN_CLOSE}\n{X.TURN_OPEN}model\n"),
    )


def system_prompt(description: Column, persona_prompt: Column, context: Column, policy: Column) -> Column:
    """Description, persona block, behaviour policy, then the evidence or the no-evidence clause."""
    persona = F.when(T.is_blank(persona_prompt), F.lit("")).otherwise(
        F.concat(F.lit(f"\n\n{X.PERSONA_HEADING}\n"), T.trim_all(persona_prompt))
    )
    has_context = ~T.is_blank(F.coalesce(context, F.lit("")))
    clause = F.when(has_context, F.concat(F.lit(f"\n\n{X.EVIDENCE_CLAUSE}\n"), context)).otherwise(
        F.lit(f"\n\n{X.NO_EVIDENCE_CLAUSE}")
    )
    return F.concat(T.trim_all(description), persona, F.lit("\n\n"), policy, clause)


def user_prompt(history_lines: Column, message: Column) -> Column:
    """``history_lines`` is null when there was no history at all (an empty string is a heading only)."""
    history = F.when(history_lines.isNull(), F.lit("")).otherwise(
        F.concat(F.lit(f"{X.HISTORY_HEADING}\n"), history_lines, F.lit("\n"))
    )
    return F.concat(history, F.lit(f"{X.MESSAGE_HEADING}\n"), T.trim_all(message))
