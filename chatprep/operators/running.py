"""Running sums that never bring a whole key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    totals: dict[str, Column],
) -> DataFrame:
    """Add running sums (own row included) of non-negative columns, per key in order.

    ``chunk`` cuts a key into pieces that follow each other in ``order``. Rows are
    shuffled by (keys, chunk) once and sums run inside a chunk. The sum before a chunk
    is joined back; it comes from chunk sums that are made before any shuffle, of the
    few columns they need, so that wide rows are read and moved once. A key with a
    third of all rows is so spread over as many tasks as it has chunks. Only later
    chunks take part in the join, and adaptive execution broadcasts them when their
    measured size is below Spark's threshold. Rows with a null key or chunk have no
    place in any order; ``without_place`` has them.
    """
    parts = [*keys, "_chunk"]
    rows = df.withColumn("_chunk", chunk)
    for part in parts:
        rows = rows.where(F.col(part).isNotNull())

    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*parts)
        .agg(*[F.sum(value).alias(name) for name, value in totals.items()])
        .select(*parts, *[F.sum(name).over(before).alias(f"_before_{name}") for name in totals])
        .where(F.col(f"_before_{next(iter(totals))}").isNotNull())
    )
    inside = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.sum(value).over(inside).alias(name) for name, value in totals.items()])
    kept = [name for name in rows.columns if name != "_chunk" and name not in totals]
    return rows.join(carried, parts, "left").select(
        *kept,
        *[(F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n) for n in totals],
    )


def without_place(df: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """The rows that ``running_totals`` has no place for."""
    missing = chunk.isNull()
    for key in keys:
        missing = missing | F.col(key).isNull()
    return df.where(missing)
