"""Path-keyed comparison of two manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("match", "differ", "only_a", "only_b")


def compare(a: DataFrame, b: DataFrame, min_size: int = 0) -> DataFrame:
    """(path, size_a, size_b, state). ``min_size`` applies to a's size, or b's where only b
    has the path; the other side is not limited."""
    left = a.select("path", F.col("size").alias("size_a"))
    right = b.select("path", F.col("size").alias("size_b"))
    state = (
        F.when(F.col("size_b").isNull(), "only_a")
        .when(F.col("size_a").isNull(), "only_b")
        .when(F.col("size_a") == F.col("size_b"), "match")
        .otherwise("differ")
    )
    joined = left.join(right, "path", "full_outer")
    if min_size:
        joined = joined.where(F.coalesce("size_a", "size_b") >= min_size)
    return joined.withColumn("state", state)


def summary(compared: DataFrame) -> DataFrame:
    return compared.agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])


def differing(compared: DataFrame) -> DataFrame:
    return compared.where(F.col("state") == "differ").select("path", "size_a", "size_b")


def largest_differing(compared: DataFrame, n: int = 10) -> DataFrame:
    larger = F.greatest("size_a", "size_b")
    return differing(compared).orderBy(larger.desc(), "path").limit(n)


def largest_only(compared: DataFrame, side: str, n: int = 10) -> DataFrame:
    """Top ``n`` by size of the paths only ``side`` ('a' or 'b') has."""
    only = compared.where(F.col("state") == f"only_{side}")
    return only.select("path", F.col(f"size_{side}").alias("size")).orderBy(F.desc("size"), "path").limit(n)
