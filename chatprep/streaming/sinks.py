"""Several sinks of one stream, each written exactly once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _run_id(spark: SparkSession, checkpoint: str) -> str:
    """A name for the batches of a checkpoint, made once. Another checkpoint counts from zero again under another name."""
    path = f"{checkpoint.rstrip('/')}/sinks"
    files, folder = _folder(spark, f"{path}/_SUCCESS")
    if not files.exists(folder):
        made = spark.createDataFrame([(uuid.uuid4().hex,)], "value string")
        made.coalesce(1).write.mode("overwrite").text(path)
    return spark.read.text(path).first()[0]


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a batch's folder was completed: Spark marks it when all its files are in place."""
    files, mark = _folder(spark, f"{path}/_SUCCESS")
    return files.exists(mark)


def write_sinks(stream: DataFrame, sinks: dict[str, Column], path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that writes the rows of each sink below ``path/<sink>``, over all that is there now.

    ``sinks`` says by name which rows go where; a row may go to several. A batch is a
    folder of its own in each sink, named by the checkpoint and the batch's number, and
    Spark's mark in it records that the sink has it. When a run fails between two sinks,
    the stream repeats the batch: sinks that have it are passed over, and what a failed
    write has left is replaced. So no row is lost or there twice, in any sink. Read a sink
    with ``read_sink``, which passes over folders that are not complete.
    """
    spark = stream.sparkSession
    run = _run_id(spark, checkpoint)

    def put(batch: DataFrame, number: int) -> None:
        for name, chosen in sinks.items():
            folder = f"{path.rstrip('/')}/{name}/batch={run}-{number:010d}"
            if not _written(batch.sparkSession, folder):
                batch.where(chosen).write.mode("overwrite").parquet(folder)

    query = stream.writeStream.foreachBatch(put).trigger(availableNow=True)
    return query.option("checkpointLocation", checkpoint).start()


def read_sink(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a sink's complete batches, with the ``batch`` that each came with."""
    files, folder = _folder(spark, path)
    found = [str(s.getPath()) for s in files.listStatus(folder)] if files.exists(folder) else []
    whole = [p for p in found if "/batch=" in p and _written(spark, p)]
    if not whole:
        return spark.createDataFrame([], f"{schema}, batch string")
    rows = spark.read.schema(schema).option("basePath", path).parquet(*whole)
    return rows.withColumn("batch", F.col("batch").cast("string"))
