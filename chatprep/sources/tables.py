"""Sinks, landed raw data and named parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.sources.pairs import read_jsonl_checked

MESSAGES_SCHEMA = "messages ARRAY<STRUCT<role: STRING, content: STRING>>"


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One object per line in UTF-8; nulls are written."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def write_table(df: DataFrame, path: str, append: bool = False) -> None:
    """Write parquet, replacing or appending; a path that is a plain file is refused."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target) and files.getFileStatus(target).isFile():
        raise ValueError(f"'{path}' already exists and is not a table")
    df.write.mode("append" if append else "overwrite").parquet(path)


def land_raw(source: DataFrame, path: str, split: str = "train", split_col: str = "split") -> None:
    """Keep one named part of a dataset and land it as JSON lines."""
    write_jsonl(source.where(F.col(split_col) == split).drop(split_col), path)


def write_splits(df: DataFrame, path: str) -> None:
    """Training and validation rows as JSON lines in folders of their own, one pass."""
    df.write.mode("overwrite").option("ignoreNullFields", False).partitionBy("split").json(path)


def read_splits(spark: SparkSession, paths: dict[str, str], schema: str = MESSAGES_SCHEMA) -> DataFrame:
    """Named inputs as one table with a ``split`` column, without broken lines."""
    return read_splits_checked(spark, paths, schema)[0]


def read_splits_checked(
    spark: SparkSession, paths: dict[str, str], schema: str = MESSAGES_SCHEMA
) -> tuple[DataFrame, DataFrame]:
    """Named inputs as one table with a ``split`` column, and their broken lines, see ``read_jsonl_checked``."""
    both = [
        [rows.withColumn("split", F.lit(name)) for rows in read_jsonl_checked(spark, path, schema)]
        for name, path in paths.items()
    ]
    good, bad = both[0]
    for more_good, more_bad in both[1:]:
        good, bad = good.unionByName(more_good), bad.unionByName(more_bad)
    return good, bad
