"""All names below a folder, listed by tasks, level by level."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.session import written
from chatprep.sources.store import Entry, Store, located

ENTRY = "path string, kind string, length long, reason string"
#: Names that a task lists below one folder before it hands the folders that are left to others.
LISTED_AT_ONCE = 10_000
#: Rows that leave a task at once.
BATCH_ROWS = 10_000


def _batch(rows: list[Entry]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([e.path for e in rows], pa.string()),
            pa.array([e.kind for e in rows], pa.string()),
            pa.array([e.length for e in rows], pa.int64()),
            pa.array([e.reason for e in rows], pa.string()),
        ],
        ["path", "kind", "length", "reason"],
    )


def _listed(store: Store, folder: str, at_once: int) -> Iterator[Entry]:
    """What is below a folder; folders that are left over come out as ``later``."""
    waiting, n = deque([folder]), 0
    while waiting and n < at_once:
        for entry in store.entries(waiting.popleft()):
            n += 1
            yield entry
            if entry.entered:
                waiting.append(entry.path)
    for path in waiting:
        yield Entry(path, "later")


def _level(folders: DataFrame, store: Store, at_once: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[Entry] = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for entry in _listed(store, folder, at_once):
                    rows.append(entry)
                    if len(rows) >= BATCH_ROWS:
                        yield _batch(rows)
                        rows = []
        yield _batch(rows)

    tasks = 4 * folders.sparkSession.sparkContext.defaultParallelism
    return folders.repartition(tasks, "path").mapInArrow(run, ENTRY)


def walk(spark: SparkSession, path: str, at_once: int = LISTED_AT_ONCE) -> DataFrame:
    """Files, folders and what can't be read below a folder, whatever their names: ``path`` relative
    to it, ``kind`` (file, folder, unread), ``length`` of files, ``reason`` where unread.

    The frontier of folders is expanded by a job for each round. A task lists what is below
    its folders up to ``at_once`` names each, and what is left is dealt out anew, so a
    small tree is one job and a large one no task's own. Empty folders are there. Links
    to folders are named but not entered, so that a circle of them ends. A path that is a
    file has itself as its only entry.
    """
    store = located(spark, path)
    if store is None:
        return _by_spark(spark, path)
    if store.only is not None:
        return _only(spark, store)
    folders = spark.createDataFrame([("",)], "path string")
    found = None
    while found is None or not folders.isEmpty():
        level = written(_level(folders, store, at_once), "listed")
        names = level.where("kind <> 'later'")
        found = names if found is None else found.unionByName(names)
        folders = level.where("kind = 'later'").select("path")
    return found


def _only(spark: SparkSession, store: Store) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([store.file()] * batch.num_rows)

    return spark.range(1, numPartitions=1).mapInArrow(run, ENTRY)


def _by_spark(spark: SparkSession, path: str) -> DataFrame:
    """In a store that only Spark opens: the files that its readers see, and the folders that hold them."""
    files = spark_files(spark, path).select("path", F.lit("file").alias("kind"), "length")
    names = F.split("path", "/")
    above = F.filter(
        F.transform(names, lambda _, k: F.array_join(F.slice(names, F.lit(1), k), "/")), lambda folder: folder != ""
    )
    folders = files.select(F.explode(above).alias("path")).distinct()
    folders = folders.select("path", F.lit("folder").alias("kind"), F.lit(None).cast("long").alias("length"))
    return files.unionByName(folders).withColumn("reason", F.lit(None).cast("string"))


def spark_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as Spark's own reader has them, names with a leading dot or underscore left out: path, length, content."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = given.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(given).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    relative = F.when(F.startswith("path", F.lit(root)), F.substr("path", F.lit(len(root) + 1)))
    return files.select(
        F.coalesce(relative, F.substring_index("path", "/", -1)).alias("path"), "length", "content"
    )
