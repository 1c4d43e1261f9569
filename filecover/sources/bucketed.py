"""Tables bucketed by a key, kept as folders: a catalog entry is made anew in each session that reads one."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from ..scratch import file_system


def _name(uri: str) -> str:
    return f"filecover_{hashlib.md5(uri.encode()).hexdigest()}"


def write_bucketed(rows: DataFrame, uri: str, keys: list[str], buckets: int) -> None:
    """Write ``rows`` to ``uri``, a file per bucket, sorted by key."""
    # Dealt by the same hash as buckets are, so a task holds one bucket.
    dealt = rows.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", uri).mode("overwrite").format("parquet").saveAsTable(_name(uri))


def read_bucketed(spark: SparkSession, uri: str, schema: str, keys: list[str], buckets: int) -> DataFrame | None:
    """The table written to ``uri`` with these keys and buckets, or None where there is none."""
    name = _name(uri)
    if not spark.catalog.tableExists(name):
        system, path = file_system(spark, f"{uri}/_SUCCESS")
        if not system.exists(path):
            return None
        columns = ", ".join(keys)
        spark.sql(
            f"create table if not exists {name} ({schema}) using parquet "
            f"clustered by ({columns}) sorted by ({columns}) into {buckets} buckets location '{uri}'"
        )
    return spark.table(name)
