"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

def apply_settings(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on: UTC and adaptive execution."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors see alike: ``spark.checkpoint.dir``.

    Where it is not set, one in the warehouse, if the cluster has set that or if all runs
    in one process. The warehouse's own default is a folder of the driver's machine: on a
    cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    settings = spark.sparkContext.getConf()
    if not settings.contains("spark.sql.warehouse.dir") and not one_process(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/work"


def one_process(master: str) -> bool:
    """Whether a master runs driver and executors in one process."""
    return master == "local" or master.startswith("local[")


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to yet."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    _made.append(folder)
    return f"{folder}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: made once, and there if an executor is lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_work(spark: SparkSession) -> None:
    """Delete the intermediate tables that this process has written, once no result needs them."""
    while _made:
        folder = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
