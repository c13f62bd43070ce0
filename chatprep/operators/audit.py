"""The audit log and the figures read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.functions.python_json import python_args_hash
from chatprep.functions.text import preview
from chatprep.functions.tool_json import canonical_json
from chatprep.rules import AUDIT_PREVIEW_CHARS, AUDITED, TIMEOUT_BOUNDS, TOOLS


def audited_arguments(tool: Column, arguments: Column) -> Column:
    """The arguments of a call as it is executed, as JSON with sorted keys and no blanks.

    Defaults are filled in, timeouts held between their bounds, and contents and code
    replaced by their lengths. A call that is not executed, for its tool is unknown or
    its arguments don't fit, stands as it was written.
    """
    given = F.json_object_keys(arguments)
    values = F.try_parse_json(arguments)
    executed = F.lit(None).cast("string")
    for name, kept in AUDITED.items():
        params = {param: default for param, _, default in TOOLS[name][1]}
        required = [param for param, default in params.items() if default is None]
        fits = F.size(F.array_except(given, F.array(*map(F.lit, params)))) == 0
        if required:
            fits &= F.size(F.array_except(F.array(*map(F.lit, required)), given)) == 0
        parts = []
        for key in kept:
            param = key.removesuffix("_len")
            stated = F.to_json(F.try_variant_get(values, f"$.{param}", "variant"))
            value = F.when(F.array_contains(given, param), F.coalesce(stated, F.lit("null")))
            if key != param:
                value = F.coalesce(F.length(F.try_variant_get(values, f"$.{param}", "string")).cast("string"), value)
            elif param == "timeout":
                low, high = TIMEOUT_BOUNDS[name]
                seconds = F.try_variant_get(values, "$.timeout", "long")
                held = F.least(F.greatest(seconds, F.lit(low)), F.lit(high)).cast("string")
                value = F.coalesce(F.when(seconds.isNotNull(), held), value)
            if params[param] is not None:
                value = F.coalesce(value, F.lit(params[param]))
            parts.append(F.concat(F.lit(f'"{key}":'), value))
        whole = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
        executed = F.when((tool == name) & fits, whole).otherwise(executed)
    return F.coalesce(executed, canonical_json(arguments))


def audit_log(calls: DataFrame, compat: bool = False) -> DataFrame:
    """Call rows to audit rows; each call has one, also those with empty results.

    The hash is over ``audited_arguments``; with ``compat`` over their text as Python writes
    it, so that the rows join with logs that a Python program wrote. Session and turn
    stay, so that the figures below can be read from the log alone.
    """
    audited = audited_arguments(F.col("tool"), F.col("arguments"))
    hashed = python_args_hash(audited) if compat else F.substring(F.sha2(audited, 256), 1, 16)
    result = F.when(F.col("result") != "", F.col("result"))
    return calls.select(
        "session_id",
        "turn",
        "call_no",
        "ts",
        "tool",
        hashed.alias("args_hash"),
        "success",
        preview(result, AUDIT_PREVIEW_CHARS).alias("result_preview"),
    )


def append_audit_log(log: DataFrame, path: str, files_per_day: int = 16) -> None:
    """Add audit rows to a table kept by day, in at most ``files_per_day`` files for each.

    Rows are brought together by day and a part of the day, so that tasks don't write
    a file for every day each; a busy day is spread over as many tasks as it has parts.
    """
    rows = log.withColumn("day", F.to_date("ts"))
    part = F.pmod(F.xxhash64(*log.columns), F.lit(files_per_day))
    rows.repartition("day", part).write.mode("append").partitionBy("day").parquet(path)


def iso_timestamp(ts: Column) -> Column:
    """A timestamp as ISO text with microseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def stage_counts(pairs: DataFrame, kept: Column, split: Column) -> DataFrame:
    """Rows loaded, kept, and kept by split, in one pass over the pairs."""
    counts = pairs.agg(
        F.count("*").alias("loaded"),
        F.count_if(kept).alias("kept"),
        F.count_if(kept & (split == "train")).alias("train"),
        F.count_if(kept & (split == "validation")).alias("validation"),
    )
    return counts.unpivot([], ["loaded", "kept", "train", "validation"], "stage", "n_rows")


def split_counts(df: DataFrame) -> DataFrame:
    """Rows by split."""
    return df.groupBy("split").agg(F.count("*").alias("n_rows"))


def session_metrics(audit: DataFrame, usage: DataFrame) -> DataFrame:
    """Turns, calls, success rate, time and tokens of each session.

    ``usage`` is a ``context_usage`` table whose conversations are the sessions.
    """
    calls = audit.groupBy("session_id").agg(
        F.count_distinct("turn").alias("n_turns"),
        F.count("*").alias("n_calls"),
        F.count_if("success").alias("n_ok"),
        F.count_if(~F.col("success")).alias("n_errors"),
        (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias(
            "elapsed_us"
        ),
    )
    tokens = usage.groupBy(F.col("conv_id").alias("session_id")).agg(
        F.sum("output_tokens").alias("output_tokens"),
        F.max(F.col("input_tokens") + F.col("output_tokens")).alias("context_tokens"),
        F.max("total_tokens").alias("total_tokens"),
    )
    return calls.withColumn("success_rate", F.col("n_ok") / F.col("n_calls")).join(tokens, "session_id", "left")


def tool_metrics(audit: DataFrame) -> DataFrame:
    """Calls, failures, success rate and distinct arguments by tool."""
    return (
        audit.groupBy("tool")
        .agg(
            F.count("*").alias("n_calls"),
            F.count_if(~F.col("success")).alias("n_failures"),
            F.count_distinct("args_hash").alias("n_arguments"),
        )
        .withColumn("success_rate", (F.col("n_calls") - F.col("n_failures")) / F.col("n_calls"))
    )


def error_history(audit: DataFrame, ordered: bool = False) -> DataFrame:
    """Failed calls; by session and time if ``ordered``."""
    failed = audit.where(~F.col("success")).select("session_id", "ts", "call_no", "tool", "result_preview")
    return failed.orderBy("session_id", "ts", "call_no") if ordered else failed
