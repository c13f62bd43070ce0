"""Reproducible training and validation parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatprep.rules import SPLIT_SEED, TRAIN_RATIO

MILLION = 1_000_000
#: Hash digits that are counted per step, and steps: 4,096 rows each, then 1/16,777,216 of all is ranked.
STEP_DIGITS = 3
STEPS = 2


def shuffle_hash(key: Column, seed: int) -> Column:
    """Hash that puts rows in a seeded order: 32 hex digits, even over all keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _held_out_share(train_ratio: float) -> int:
    """Validation share in millionths; whole numbers keep 5 of 100 at 5."""
    return round((1 - train_ratio) * MILLION)


def split_exact(
    df: DataFrame, key: str, train_ratio: float = TRAIN_RATIO, seed: int = SPLIT_SEED
) -> DataFrame:
    """Add ``split``: the rows with the smallest hashes are validation, exactly
    ``ceil(n * (1 - train_ratio))`` of them.

    No row is shuffled. Counts by hash prefix (4,096 rows at most) say which prefix
    holds the last validation row, and counts of longer prefixes which of its parts;
    the few hashes left are ranked to find the cut; then one filter over the rows
    compares with the cut. The key must be unique, else equal keys share a part and
    sizes may pass. Rows with a null key belong to no part: their ``split`` is null,
    and they count for no size.
    """
    hashed = shuffle_hash(F.col(key), seed)
    hashes = df.where(F.col(key).isNotNull()).select(hashed.alias("hash"))

    total = hashes.agg(F.count("*").alias("total"))
    needed = total.select(F.expr(f"(total * {_held_out_share(train_ratio)} + {MILLION - 1}) div {MILLION}")).scalar()
    in_order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    for step in range(1, STEPS + 1):
        prefix = F.substring("hash", 1, step * STEP_DIGITS)
        counted = hashes.groupBy(prefix.alias("bucket")).agg(F.count("*").alias("n"))
        counted = counted.withColumns({"upto": F.sum("n").over(in_order), "needed": needed})
        last = counted.where((F.col("upto") >= F.col("needed")) & (F.col("upto") - F.col("n") < F.col("needed")))
        needed = last.select((F.col("needed") - F.col("upto") + F.col("n")).alias("needed")).scalar()
        hashes = hashes.where(prefix == last.select("bucket").scalar())
    ranked = hashes.withColumn("rank", F.row_number().over(Window.orderBy("hash"))).withColumn("needed", needed)
    cut = ranked.where(F.col("rank") == F.col("needed")).select("hash").scalar()
    part = F.when(hashed <= cut, "validation").otherwise("train")
    return df.withColumn("split", F.when(F.col(key).isNotNull(), part))


def split_hash(
    df: DataFrame, key: str, train_ratio: float = TRAIN_RATIO, seed: int = SPLIT_SEED
) -> DataFrame:
    """Add ``split`` by a hash threshold, in one pass and with approximate sizes.

    A row keeps its part when data is added. Rows with equal keys share a part, so
    that a conversation is never cut in two.
    """
    threshold = _held_out_share(train_ratio) * 2**32 // MILLION
    held_out = F.substring(shuffle_hash(F.col(key), seed), 1, 8) < F.lit(f"{threshold:08x}")
    if threshold >= 2**32:
        held_out = F.lit(True)
    return df.withColumn("split", F.when(held_out, "validation").otherwise("train"))
