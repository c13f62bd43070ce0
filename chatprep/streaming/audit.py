"""The audit log and the policy over calls as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chatprep.operators.policy import screen_calls


def audit_stream_metrics(
    audit: DataFrame, window: str = "1 hour", watermark: str = "10 minutes"
) -> DataFrame:
    """Calls and failure rate by tool and tumbling window, over a stream or a table.

    ``audit`` holds ``ts, tool, success``. On a stream, rows later than the
    watermark are dropped and a window comes out once it is closed, so the state is
    one small row per tool and open window.
    """
    timed = audit.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return (
        timed.groupBy(F.window("ts", window).alias("span"), "tool")
        .agg(F.count("*").alias("n_calls"), F.count_if(~F.col("success")).alias("n_failures"))
        .select(
            F.col("span.start").alias("window_start"),
            F.col("span.end").alias("window_end"),
            "tool",
            "n_calls",
            "n_failures",
            (F.col("n_failures") / F.col("n_calls")).alias("failure_rate"),
        )
    )


def policy_stream(calls: DataFrame, allowed_roots: list[str], cwd: str | None = None) -> DataFrame:
    """Calls with their verdict; ``verdict`` names the folder that each row goes to."""
    verdict = F.when(F.col("allowed"), "allowed").when(~F.col("allowed"), "refused").otherwise("not_screened")
    return screen_calls(calls, allowed_roots, cwd).withColumn("verdict", verdict)


def write_stream(
    stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None
) -> StreamingQuery:
    """Start a parquet sink over all that is there now.

    The checkpoint holds progress and state, so a restart goes on where it stopped;
    keep it in a folder that all executors see.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.option("checkpointLocation", checkpoint).start(path)


def write_policy_stream(screened: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Sink of ``policy_stream``: refused calls in a folder apart from allowed ones."""
    return write_stream(screened, path, checkpoint, ["verdict"])
