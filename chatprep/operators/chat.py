"""Pairs and turns to chat messages and training text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.functions.frames import with_once
from chatprep.functions.text import clean_text
from chatprep.rules import SYSTEM_PROMPT, TOOL_OUTPUT

# Fixed value. The public ChatML layout.
CHATML = "<|im_start|>{role}\n{content}<|im_end|>\n"
CHATML_PROMPT = "<|im_start|>assistant\n"


def null_text(path: str) -> str:
    """What a missing value of a file turns to as text: ``None`` from JSON, ``nan`` from tables."""
    return "None" if path.rstrip("/").lower().endswith((".json", ".jsonl")) else "nan"


def _cleaned(col: str, compat: bool | str) -> Column:
    text = clean_text(F.col(col))
    return F.coalesce(text, F.lit(compat if isinstance(compat, str) else "nan")) if compat else text


def _reason(instruction: Column, response: Column) -> Column:
    return (
        F.when(F.coalesce(instruction, F.lit("")) == "", "empty instruction")
        .when(F.lower(instruction).isin("nan", "none"), "missing instruction")
        .when(F.coalesce(response, F.lit("")) == "", "empty response")
    )


def _judged(pairs: DataFrame, instruction_col: str, response_col: str, compat: bool | str) -> DataFrame:
    return with_once(
        pairs, _instruction=_cleaned(instruction_col, compat), _response=_cleaned(response_col, compat)
    ).withColumn("_reason", _reason(F.col("_instruction"), F.col("_response")))


def reject_reason(
    instruction_col: str = "instruction", response_col: str = "response", compat: bool | str = False
) -> Column:
    """Why a pair is dropped, null for a pair that stays.

    A null response is dropped; with ``compat`` it stays as a text: ``nan``, which is
    what a row of a table file turned to text gives, or the text that is given, see
    ``null_text``.
    """
    return _reason(_cleaned(instruction_col, compat), _cleaned(response_col, compat))


def valid_pairs(
    pairs: DataFrame,
    instruction_col: str = "instruction",
    response_col: str = "response",
    compat: bool | str = False,
) -> DataFrame:
    """Pairs that stay, see ``reject_reason``, with both texts cleaned."""
    kept = _judged(pairs, instruction_col, response_col, compat).where(F.col("_reason").isNull())
    cleaned = {instruction_col: F.col("_instruction"), response_col: F.col("_response")}
    return kept.withColumns(cleaned).select(*pairs.columns)


def rejected_pairs(
    pairs: DataFrame,
    instruction_col: str = "instruction",
    response_col: str = "response",
    compat: bool | str = False,
) -> DataFrame:
    """Pairs that are dropped, with the reason."""
    judged = _judged(pairs, instruction_col, response_col, compat)
    return judged.where(F.col("_reason").isNotNull()).select(*pairs.columns, F.col("_reason").alias("reason"))


def to_messages(
    pairs: DataFrame,
    system_prompt: str = SYSTEM_PROMPT,
    instruction_col: str = "instruction",
    response_col: str = "response",
    input_col: str | None = None,
) -> DataFrame:
    """Replace instruction, response and input of valid pairs by one messages array."""
    user = F.col(instruction_col)
    if input_col and input_col in pairs.columns:
        extra = F.concat(F.lit("\n\nInput:\n"), clean_text(F.col(input_col)))
        user = F.concat(user, F.coalesce(extra, F.lit("")))
    turns = [("user", user), ("assistant", F.col(response_col))]
    if system_prompt:
        turns.insert(0, ("system", F.lit(system_prompt)))
    messages = F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in turns])
    used = {instruction_col, response_col, input_col}
    return pairs.select(*[c for c in pairs.columns if c not in used], messages.alias("messages"))


def explode_messages(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per message: the keys, position from 0, role and content."""
    return df.select(*keys, F.posexplode("messages").alias("position", "message")).select(
        *keys, "position", "message.role", "message.content"
    )


def collect_messages(turns: DataFrame, part_turns: int = 1000) -> DataFrame:
    """Turns to ordered messages arrays, one row per conversation and ``part``.

    A row holds the turns of one range of ``part_turns`` numbers, so that a
    conversation of any length never becomes one row or one task. ``(conv_id,
    turn)`` must be unique. Parts in order are the whole conversation; ``is_last``
    marks the one that ends it, so that ``part_turns`` changes no result.
    """
    part = F.expr(f"turn div {part_turns}")
    message = F.struct("turn", "role", F.col("text").alias("content"))
    ordered = F.array_sort(F.collect_list(message))
    parts = turns.groupBy("conv_id", part.alias("part")).agg(
        F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias(
            "messages"
        )
    )
    # One narrow row for each conversation.
    ends = turns.groupBy(F.col("conv_id").alias("_conv_id")).agg(F.max(part).alias("_last"))
    return parts.join(ends, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left").select(
        *parts.columns, F.col("part").eqNullSafe(F.col("_last")).alias("is_last")
    )


def render_chat(
    messages: Column,
    add_generation_prompt: bool | Column = False,
    layout: str = CHATML,
    prompt: str = CHATML_PROMPT,
) -> Column:
    """Messages array to model text.

    ``layout`` is the text of one message with ``{role}`` and ``{content}``;
    ``prompt`` is appended where an answer is to be generated; of the parts of a
    conversation that is the last one, so give their column ``is_last``.
    """
    before, rest = layout.split("{role}")
    middle, after = rest.split("{content}")
    parts = F.transform(
        messages,
        lambda m: F.concat(F.lit(before), m["role"], F.lit(middle), m["content"], F.lit(after)),
    )
    text = F.array_join(parts, "")
    if isinstance(add_generation_prompt, Column):
        return F.concat(text, F.when(add_generation_prompt, F.lit(prompt)).otherwise(F.lit("")))
    return F.concat(text, F.lit(prompt)) if add_generation_prompt else text


def to_training_text(df: DataFrame, layout: str = CHATML) -> DataFrame:
    """Replace the messages column by its training text."""
    return df.withColumn("text", render_chat(F.col("messages"), layout=layout)).drop("messages")


def tool_message(name: Column, result: Column) -> Column:
    """Text of the message that hands a tool's result back to the model."""
    before, rest = TOOL_OUTPUT.split("{name}")
    middle, _ = rest.split("{result}")
    return F.concat(F.lit(before), name, F.lit(middle), result)
