"""Token use, limits and outcomes over the turns of a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatprep.functions.text import token_count
from chatprep.operators.running import running_totals
from chatprep.rules import (
    MAX_CALLS_PER_TURN,
    MAX_NEW_TOKENS,
    MAX_TOTAL_TOKENS,
    MAX_TURNS,
    STATUS_ABOVE,
    STATUS_BOUNDS,
)


def context_usage(turns: DataFrame, tokens: Column | None = None, part_turns: int = 10_000) -> DataFrame:
    """Input, output and total tokens of every answer.

    Input is all text before the answer in its conversation. The total adds input
    and output of every answer so far, so that history counts again each turn.

    With S(t) the tokens up to turn t, the total at an answer is the sum of S over
    the answers so far. Both sums run within ranges of ``part_turns`` turns; per
    earlier range only three numbers are carried: its tokens, its answers and its
    own sum of S. A long conversation is thus spread over one task per range. Turns
    without a conversation or number are left out.
    """
    tokens = token_count(F.col("text")) if tokens is None else tokens
    parts = ["conv_id", "part"]
    rows = turns.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(
        "conv_id",
        "turn",
        F.expr(f"turn div {part_turns}").alias("part"),
        (F.col("role") == "assistant").alias("is_answer"),
        tokens.alias("n"),
    )
    inside = Window.partitionBy(*parts).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    answer = F.col("is_answer").cast("long")
    rows = rows.withColumns({"tokens": F.sum("n").over(inside), "answers": F.sum(answer).over(inside)})
    rows = rows.withColumn("total", F.sum(F.col("tokens") * answer).over(inside))

    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*parts)
        .agg(*[F.max(name).alias(name) for name in ("tokens", "answers", "total")])
        .withColumn("tokens_before", F.sum("tokens").over(before))
        .withColumn("whole", F.col("total") + F.col("answers") * F.coalesce("tokens_before", F.lit(0)))
        .select(*parts, "tokens_before", F.sum("whole").over(before).alias("total_before"))
        .where(F.col("tokens_before").isNotNull())
    )
    tokens_before = F.coalesce("tokens_before", F.lit(0))
    return (
        rows.where("is_answer")
        .join(carried, parts, "left")
        .select(
            "conv_id",
            "turn",
            (F.col("tokens") + tokens_before - F.col("n")).alias("input_tokens"),
            F.col("n").alias("output_tokens"),
            (
                F.col("total") + F.col("answers") * tokens_before + F.coalesce("total_before", F.lit(0))
            ).alias("total_tokens"),
        )
    )


def limit_breach(
    usage: DataFrame, max_total: int = MAX_TOTAL_TOKENS, max_new: int = MAX_NEW_TOKENS
) -> DataFrame:
    """First answer of each conversation that the token limit would have refused."""
    used = F.col("total_tokens") - F.col("input_tokens") - F.col("output_tokens")
    projected = used + F.col("input_tokens") + F.lit(max_new)
    return (
        usage.select("conv_id", "turn", used.alias("used"), projected.alias("projected"))
        .where(F.col("projected") > max_total)
        .groupBy("conv_id")
        .agg(
            F.min("turn").alias("turn"),
            F.min_by("used", "turn").alias("used_tokens"),
            F.min_by("projected", "turn").alias("projected_tokens"),
        )
    )


def context_status(usage: DataFrame, limit: int = MAX_TOTAL_TOKENS) -> DataFrame:
    """Add percent of the limit in use (at most 100), status and warning."""
    percent = F.least(F.col("total_tokens") / F.lit(limit) * 100, F.lit(100.0))
    status = F.lit(STATUS_ABOVE)
    for bound, name in reversed(STATUS_BOUNDS):
        status = F.when(F.col("percent") < bound, name).otherwise(status)
    return usage.withColumn("percent", percent).withColumns(
        {"status": status, "warning": F.col("percent") > STATUS_BOUNDS[-1][0]}
    )


def session_outcome(
    answers: DataFrame, max_turns: int = MAX_TURNS, breaches: DataFrame | None = None
) -> DataFrame:
    """How each conversation ends, from its answers with their number of calls.

    ``answers`` holds ``conv_id, turn, n_calls``; ``breaches`` is a ``limit_breach``
    table. A conversation ends with its first answer without calls, fails at a
    breach, and otherwise stops after ``max_turns`` answers. One that holds fewer
    answers, all with calls, is unfinished. Only the first ``max_turns`` answers of
    a conversation leave each map task.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    first = (
        answers.select("conv_id", "turn", "n_calls")
        .withColumn("number", F.row_number().over(order))
        .where(F.col("number") <= max_turns)
    )
    if breaches is None:
        first = first.withColumn("breach_turn", F.lit(None).cast("long"))
    else:
        first = first.join(breaches.select("conv_id", F.col("turn").alias("breach_turn")), "conv_id", "left")
    ends = first.groupBy("conv_id").agg(
        F.max("number").alias("n_answers"),
        F.min(F.when(F.col("n_calls") == 0, F.col("number"))).alias("final"),
        F.min(F.when(F.col("turn") >= F.col("breach_turn"), F.col("number"))).alias("breach"),
    )
    never = F.lit(max_turns + 1)
    outcome = (
        F.when(F.col("breach") <= F.coalesce("final", never), "failed")
        .when(F.col("final").isNotNull(), "final_answer")
        .when(F.col("n_answers") >= max_turns, "max_turns")
        .otherwise("unfinished")
    )
    return ends.select(
        "conv_id", outcome.alias("outcome"), F.least("breach", "final", "n_answers").cast("long").alias("n_turns")
    )


def calls_over_cap(calls: DataFrame, cap: int = MAX_CALLS_PER_TURN) -> DataFrame:
    """Turns with more calls than the cap."""
    return (
        calls.groupBy("session_id", "turn")
        .agg(F.count("*").alias("n_calls"))
        .where(F.col("n_calls") > cap)
        .withColumn("n_over", F.col("n_calls") - cap)
    )


def failure_streaks(audit: DataFrame, part_calls: int = 10_000, ordered: bool = False) -> DataFrame:
    """Runs of failed calls that follow each other in a session; longest first if ``ordered``.

    Failures with the same number of successes before them are one run. ``audit``
    holds ``session_id, call_no, success``, with calls numbered in order; numbers
    are counted in ranges of ``part_calls``, see ``running_totals``.
    """
    rows = audit.select("session_id", "call_no", F.col("success").cast("long").alias("ok"))
    part = F.expr(f"call_no div {part_calls}")
    numbered = running_totals(rows, ["session_id"], ["call_no"], part, {"run": F.col("ok")})
    runs = (
        numbered.where(F.col("ok") == 0)
        .groupBy("session_id", "run")
        .agg(
            F.count("*").alias("length"),
            F.min("call_no").alias("first_call"),
            F.max("call_no").alias("last_call"),
        )
        .drop("run")
    )
    return runs.orderBy(F.desc("length"), "session_id", "first_call") if ordered else runs
