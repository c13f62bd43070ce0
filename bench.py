"""Time the headline queries: median of three warm runs each, one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chatprep.session import drop_work, new_path
from checks import derived
from checks.queries import QUERIES

WARM_RUNS = 3
HEADLINE = [
    "to_messages",
    "render_chat",
    "split_exact",
    "split_hash",
    "token_counts",
    "pack_blocks",
    "fill_blocks",
    "corpus_truncate",
    "grep_counts",
    "grep_top50",
    "context_usage",
    "tool_calls",
    "tool_calls_balanced",
    "argument_check",
    "screen_calls",
    "policy_summary",
    "session_outcome",
    "failure_streaks",
    "audit_log",
    "session_metrics",
]
#: Tables that queries derive from the given ones; written once, untimed, so that the
#: times are those of the operators.
PREPARED = ["raw_pairs", "corpus", "calls", "responses"]
#: Queries that also run over ten times the rows.
LARGER = ["render_chat", "split_hash", "token_counts", "grep_counts", "context_usage"]
TIMES = 10


def _median(run) -> float:
    seconds = []
    for _ in range(1 + WARM_RUNS):
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds[1:]), 3)


def _prepare(spark: SparkSession, folder: str) -> None:
    events = spark.read.parquet(f"{folder}/events.parquet")
    derived.unnumbered_calls(events).write.parquet(f"{folder}/derived_unnumbered_calls")
    for name in PREPARED:
        getattr(derived, name)(spark, folder).write.parquet(f"{folder}/derived_{name}")
        setattr(derived, name, lambda spark, sf, name=name: spark.read.parquet(f"{sf}/derived_{name}"))
    derived.unnumbered_calls = lambda events: spark.read.parquet(f"{folder}/derived_unnumbered_calls")


def _larger(spark: SparkSession, folder: str, cpus: int) -> str:
    """The tables ten times over, under new numbers."""
    larger = new_path(spark, "larger")
    copies = F.explode(F.sequence(F.lit(0), F.lit(TIMES - 1)))
    for name, key in (("documents", "doc_id"), ("conversations", "conv_id")):
        rows = spark.read.parquet(f"{folder}/{name}.parquet").withColumn("_copy", copies)
        rows = rows.withColumn(key, F.col(key) + F.col("_copy") * 10_000_000).drop("_copy")
        rows.repartition(2 * cpus).write.parquet(f"{larger}/{name}.parquet")
    corpus = spark.read.parquet(f"{folder}/derived_corpus").withColumn("_copy", copies)
    corpus.withColumn("path", F.concat(F.col("_copy").cast("string"), F.lit("/"), F.col("path"))).drop("_copy").write.parquet(f"{larger}/derived_corpus")
    return larger


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The given tables are single files of one row group, so one task would read
    # each; lay them out as a cluster would have them, in several files.
    spread = new_path(spark, "tables")
    for name in ("conversations", "documents", "events"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(2 * int(cpus)).write.parquet(f"{spread}/{name}.parquet")
    _prepare(spark, spread)
    seconds = {name: _median(lambda name=name: QUERIES[name](spark, spread)) for name in HEADLINE}
    larger = _larger(spark, spread, int(cpus))
    ten_times = {name: _median(lambda name=name: QUERIES[name](spark, larger)) for name in LARGER}
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of warm medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf).name.removeprefix("sf"),
                "layout": f"{2 * int(cpus)} files per table, derived tables prepared",
                "ten_times_the_rows": ten_times,
            }
        )
    )
    drop_work(spark)
    spark.stop()


if __name__ == "__main__":
    main()
