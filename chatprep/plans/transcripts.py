"""From logged answers to the calls they made and how their sessions went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.functions.text import strip_reasoning
from chatprep.operators.audit import audit_log, session_metrics
from chatprep.operators.calls import count_calls, extract_tool_calls, resolve_calls, tool_catalogue
from chatprep.operators.policy import screen_calls
from chatprep.operators.usage import context_status, context_usage, limit_breach, session_outcome
from chatprep.rules import MAX_NEW_TOKENS, MAX_TOTAL_TOKENS, MAX_TURNS


def screened_calls(turns: DataFrame, allowed_roots: list[str], mode: str = "compat") -> DataFrame:
    """Calls in logged answers, with the catalogue's and the policy's verdict."""
    answers = turns.where(F.col("role") == "assistant").withColumn("text", strip_reasoning(F.col("text")))
    known = resolve_calls(extract_tool_calls(answers, mode), tool_catalogue(turns.sparkSession))
    return screen_calls(known, allowed_roots)


def outcomes(
    turns: DataFrame,
    max_turns: int = MAX_TURNS,
    max_total: int = MAX_TOTAL_TOKENS,
    max_new: int = MAX_NEW_TOKENS,
    mode: str = "compat",
) -> DataFrame:
    """How each logged conversation ends under the turn and token limits."""
    answers = turns.where(F.col("role") == "assistant").select(
        "conv_id", "turn", count_calls(strip_reasoning(F.col("text")), mode).alias("n_calls")
    )
    return session_outcome(answers, max_turns, limit_breach(context_usage(turns), max_total, max_new))


def metrics(calls: DataFrame, turns: DataFrame, limit: int = MAX_TOTAL_TOKENS) -> DataFrame:
    """Figures of each session, with the status of its context at the end."""
    return context_status(session_metrics(audit_log(calls), context_usage(turns)), limit)
