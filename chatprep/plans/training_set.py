"""From raw pairs or logged conversations to packed training text, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.operators.chat import collect_messages, render_chat, to_messages, to_training_text, valid_pairs
from chatprep.operators.pack import count_tokens, pack_sequences
from chatprep.operators.split import split_exact, split_hash
from chatprep.rules import MAX_SEQUENCE, SPLIT_SEED, SYSTEM_PROMPT, TRAIN_RATIO
from chatprep.sources.pairs import read_jsonl_checked, read_pairs
from chatprep.sources.tables import MESSAGES_SCHEMA, read_splits, write_jsonl, write_splits, write_table

#: Equal samples that one task writes out.
COPIES = 65_536


def format_file(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    instruction_col: str = "instruction",
    response_col: str = "response",
    input_col: str | None = None,
    system_prompt: str = SYSTEM_PROMPT,
) -> None:
    """Raw pairs of any format to chat samples as JSON lines."""
    pairs = read_pairs(spark, input_path, instruction_col, response_col, input_col)
    kept = valid_pairs(pairs, instruction_col, response_col)
    samples = to_messages(kept, system_prompt, instruction_col, response_col, input_col)
    write_jsonl(samples.select("messages"), output_path)


def sample_text(messages: Column) -> Column:
    """Messages as one text that no other messages have."""
    parts = F.transform(
        messages,
        lambda m: F.concat_ws(
            "\x1f", F.coalesce(m["role"], F.lit("\x1d")), F.coalesce(m["content"], F.lit("\x1d"))
        ),
    )
    return F.coalesce(F.array_join(parts, "\x1e"), F.lit("\x1d"))


def keyed_samples(samples: DataFrame) -> DataFrame:
    """Samples (``messages``) with a ``key``: the hash of the content, and 1 to n for n equal ones.

    Equal samples are counted, map tasks first, and then written out again; which of
    two equal ones is which plays no part. A sample with very many copies is written
    out in blocks that are spread over the tasks.
    """
    counted = samples.groupBy("messages").agg(F.count("*").alias("n"))
    counted = counted.withColumn("_content", F.sha2(sample_text(F.col("messages")), 256))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))).alias("_block")
    few = counted.where(F.col("n") <= COPIES).select("*", F.lit(0).cast("long").alias("_block"))
    many = counted.where(F.col("n") > COPIES).select("*", block).repartition("_content", "_block")
    number = F.expr(f"explode(sequence(_block * {COPIES} + 1, least(n, (_block + 1) * {COPIES})))")
    rows = few.unionByName(many).select("messages", "_content", number.alias("_number"))
    return rows.select("messages", F.concat_ws("-", "_content", "_number").alias("key"))


def split_file(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    work_path: str,
    train_ratio: float = TRAIN_RATIO,
    seed: int = SPLIT_SEED,
) -> None:
    """Chat samples as JSON lines to training and validation lines of exact size.

    The same samples and seed give the same parts, however the input is cut into files
    and tasks: samples are keyed by their content and numbered among their equals, see
    ``keyed_samples``. Keyed samples are landed in ``work_path``, since the split reads
    their keys several times. A broken line stops the split, see ``read_jsonl_checked``.
    """
    good, bad = read_jsonl_checked(spark, input_path, MESSAGES_SCHEMA)
    if found := bad.limit(1).collect():
        raise ValueError(f"'{input_path}' has lines that are no JSON object: {found[0].line!r:.200}")
    write_table(keyed_samples(good), work_path)
    samples = spark.read.parquet(work_path)
    write_splits(split_exact(samples, "key", train_ratio, seed).drop("key"), output_path)


def text_of_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Named samples to training text with token counts."""
    return count_tokens(to_training_text(read_splits(spark, paths)))


def pair_set(
    pairs: DataFrame,
    key: str,
    curated_path: str,
    input_col: str | None = None,
    system_prompt: str = SYSTEM_PROMPT,
    train_ratio: float = TRAIN_RATIO,
    seed: int = SPLIT_SEED,
) -> DataFrame:
    """Raw pairs to training text with an exact split: ``key, messages, split, text, n_tokens``.

    Formatted samples are written to ``curated_path`` first. The exact split reads
    the keys of the samples twice before it reads the samples; from the written
    table that is one narrow column, not the raw texts again.
    """
    samples = to_messages(valid_pairs(pairs), system_prompt, input_col=input_col)
    write_table(samples.select(key, "messages"), curated_path)
    curated = pairs.sparkSession.read.parquet(curated_path)
    text = split_exact(curated, key, train_ratio, seed).withColumn("text", render_chat(F.col("messages")))
    return count_tokens(text)


def conversation_set(
    turns: DataFrame, train_ratio: float = TRAIN_RATIO, seed: int = SPLIT_SEED
) -> DataFrame:
    """Logged turns to training text; a conversation is in one part as a whole."""
    text = to_training_text(collect_messages(turns))
    return count_tokens(split_hash(text, "conv_id", train_ratio, seed))


def set_size(samples: DataFrame) -> DataFrame:
    """Samples and tokens in each part; a conversation in several rows is one sample."""
    n_samples = F.count_if("is_last") if "is_last" in samples.columns else F.count("*")
    return samples.groupBy("split").agg(n_samples.alias("n_samples"), F.sum("n_tokens").alias("n_tokens"))


def packed_part(samples: DataFrame, key: str, split: str = "train", max_len: int = MAX_SEQUENCE) -> DataFrame:
    """Blocks of one part of a training set."""
    return pack_sequences(samples.where(F.col("split") == split).select(key, "n_tokens"), key, max_len)
