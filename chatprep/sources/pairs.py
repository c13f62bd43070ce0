"""Readers for instruction and response pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.rules import NA_WORDS, PYTHON_SPACE

QUOTING = {"multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def _missing_words_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(NA_WORDS), F.col(f"`{c}`")) for c in columns})


def read_pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; all columns text, words for missing values null.

    Quoted fields may hold line breaks, so one file is one task; keep large data in
    JSON lines or parquet.
    """
    rows = spark.read.options(header=True, inferSchema=False, **QUOTING).csv(path)
    return _missing_words_to_null(rows, rows.columns)


def read_pairs_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, or one object, per file; all columns text."""
    columns = spark.read.json(path, multiLine=True, primitivesAsString=True).columns
    return spark.read.schema(_text_schema(columns)).json(path, multiLine=True)


def read_jsonl(
    spark: SparkSession,
    path: str,
    columns: list[str] | str | None = None,
    required: list[str] | None = None,
) -> DataFrame:
    """One object per line.

    ``columns`` is a list of names to read as text, or a schema; without it the
    data is scanned for its columns. Each name in ``required`` is looked for until
    one line has it, and its absence from all lines is an error.
    """
    for name in required or []:
        has = F.array_contains(F.json_object_keys("value"), name)
        if spark.read.text(path).where(has).isEmpty():
            raise ValueError(f"column '{name}' not found, available: {_columns_of(spark, path)}")
    if columns is None:
        columns = _columns_of(spark, path)
    return read_jsonl_checked(spark, path, columns if isinstance(columns, str) else _text_schema(columns))[0]


BROKEN = "_broken_line"


def read_jsonl_checked(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the lines that are objects of the schema, and the other lines with the reason.

    A broken line is no row of nulls. Empty lines are passed over. The second table
    has ``line`` and ``reason``: ``no JSON object``, or ``wrong type`` where the line
    is an object but a value does not fit the schema.
    """
    lines = spark.read.text(path).where(F.trim(F.col("value"), F.lit(PYTHON_SPACE)) != "")
    folders = [name for name in lines.columns if name != "value"]
    options = {"columnNameOfCorruptRecord": BROKEN}
    is_object = F.json_object_keys("value").isNotNull() & F.try_parse_json("value").isNotNull()
    rows = lines.select(
        "*", is_object.alias("_is_object"), F.from_json("value", f"{schema}, {BROKEN} STRING", options).alias("_row")
    )
    fits = F.col("_is_object") & F.col(f"_row.{BROKEN}").isNull()
    good = rows.where(fits).select("_row.*", *folders).drop(BROKEN)
    reason = F.when(F.col("_is_object"), "wrong type").otherwise("no JSON object")
    return good, rows.where(~fits).select(F.col("value").alias("line"), reason.alias("reason"))


def _columns_of(spark: SparkSession, path: str) -> list[str]:
    found = spark.read.option("columnNameOfCorruptRecord", BROKEN).json(path, primitivesAsString=True).columns
    return [name for name in found if name != BROKEN]


def read_pairs_tsv(
    spark: SparkSession, path: str, instruction_col: str = "instruction", response_col: str = "response"
) -> DataFrame:
    """Tab-separated, no header; the first two fields of a line count.

    ``malformed`` marks lines with more fields.
    """
    schema = _text_schema([instruction_col, response_col, "_rest"])
    rows = spark.read.schema(schema).options(header=False, sep="\t", **QUOTING).csv(path)
    texts = _missing_words_to_null(rows, [instruction_col, response_col])
    return texts.withColumn("malformed", F.col("_rest").isNotNull()).drop("_rest")


def read_pairs(
    spark: SparkSession,
    path: str,
    instruction_col: str = "instruction",
    response_col: str = "response",
    input_col: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Pairs from a CSV, JSON, JSONL or TXT path, chosen by its extension.

    JSON lines are read without a pass over the data for their schema: they give
    the named columns and those in ``keep``; CSV and JSON give all they have.
    """
    extension = path.rstrip("/").rpartition(".")[2].lower()
    if extension == "csv":
        df = read_pairs_csv(spark, path)
    elif extension == "json":
        df = read_pairs_json(spark, path)
    elif extension == "jsonl":
        wanted = [*keep, instruction_col, response_col, *([input_col] if input_col else [])]
        df = read_jsonl(spark, path, wanted, [instruction_col, response_col])
    elif extension == "txt":
        df = read_pairs_tsv(spark, path, instruction_col, response_col)
    else:
        raise ValueError(f"unsupported extension '.{extension}', use CSV, JSON, JSONL or TXT")
    for role, column in (("instruction", instruction_col), ("response", response_col)):
        if column not in df.columns:
            raise ValueError(f"{role} column '{column}' not found, available: {df.columns}")
    return df


def malformed_count(pairs: DataFrame) -> DataFrame:
    """Lines of a TXT input that had more than two fields."""
    return pairs.agg(F.count_if("malformed").alias("n_malformed"))


def _text_schema(columns: list[str]) -> str:
    return ", ".join(f"`{c}` STRING" for c in columns)
