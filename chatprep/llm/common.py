"""What several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.session import new_path

#: Fixed value: what stands between two words.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; all other letters stay."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The runs without blanks of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda word: word != "")


def shares(values: list[Column]) -> list[Column]:
    """Each value over their sum; zeros where the sum is zero."""
    total = sum(values[1:], values[0])
    return [F.when(total > 0, value / total).otherwise(0.0) for value in values]


def span_list(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` by start, then by the place of the kind, joined by commas.

    ``spans`` is an array of (kind, start, end).
    """
    place = F.array(*[F.lit(kind) for kind in kinds])
    ordered = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(s["start"], F.array_position(place, s["kind"]), s["end"], s["kind"]),
        )
    )
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
