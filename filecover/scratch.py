"""Tables a query writes on its way, below the folder that all machines share, deleted when the session ends or by whoever made them."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="filecover-")


def file_system(spark: SparkSession, uri: str) -> tuple:
    """Hadoop's file system of a place, and the place as its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below spark.checkpoint.dir, gone at the end of the session.

    Where that setting is missing, a local session (driver and executors are one process)
    gets a temporary folder, and a cluster one below its warehouse.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        root = _local_root() if local else spark.conf.get("spark.sql.warehouse.dir")
    uri = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    system, path = file_system(spark, uri)
    system.mkdirs(path)
    system.deleteOnExit(path)
    return uri


def drop(spark: SparkSession, uri: str) -> None:
    system, path = file_system(spark, uri)
    system.delete(path, True)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written and read again: what follows doesn't make them anew."""
    path = f"{new_folder(df.sparkSession, purpose)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def all_written(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``written`` for several tables, as jobs side by side: the cores that the last tasks of one leave idle work on the next."""
    with ThreadPoolExecutor(max(1, len(tables))) as pool:
        jobs = {name: pool.submit(inheritable_thread_target(df.sparkSession)(written), df, name) for name, df in tables.items()}
    return {name: job.result() for name, job in jobs.items()}
