"""Which files to fingerprint, what is already done, and what turned out equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import parent_folder
from .filters import at_least
from .key_filter import key_filter, may_hold
from .skew import skew_join

HASH_KEY = ["scan_id", "path", "algo", "sample_size"]


def candidates(
    files: DataFrame, min_size: int = 0, only_collisions: bool = True, sizes: DataFrame | None = None
) -> DataFrame:
    """Files whose size occurs at least twice; a file of unique size has no duplicate.

    Sizes are counted first; of the files, only those whose size may occur twice are shuffled. ``sizes``: (size, n) counted
    elsewhere, as from a stored index.
    """
    files = at_least(files, min_size)
    if not only_collisions:
        return files
    counts = files.groupBy("size").agg(F.count("*").alias("n")) if sizes is None else at_least(sizes, min_size)
    repeated = counts.where(F.col("n") >= 2).select("size")
    key = [F.col("size").cast("bigint")]
    return skew_join(may_hold(files, key_filter(repeated, key), key), repeated, ["size"], "left_semi", by=["path"])


def unfinished(wanted: DataFrame, hashes: DataFrame, algo: str, sample_size: int = 0) -> DataFrame:
    """Candidates with no stored fingerprint of this algorithm and sample size."""
    done = hashes.where((F.col("algo") == algo) & (F.col("sample_size") == sample_size))
    return wanted.join(done.select("path").distinct(), "path", "left_anti")


def summary(wanted: DataFrame, todo: DataFrame, sample_size: int = 0) -> DataFrame:
    """One row: candidates, skipped, todo, bytes to read."""
    to_read = F.least("size", F.lit(sample_size)) if sample_size else F.col("size")
    both = wanted.select(F.lit(1).alias("all"), F.lit(0).alias("todo"), F.lit(0).cast("bigint").alias("b")).unionByName(
        todo.select(F.lit(0).alias("all"), F.lit(1).alias("todo"), to_read.cast("bigint").alias("b"))
    )
    counted = both.agg(
        F.coalesce(F.sum("all"), F.lit(0)).alias("candidates"),
        F.coalesce(F.sum("todo"), F.lit(0)).alias("todo"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("bytes_to_read"),
    )
    return counted.withColumn("skipped", F.col("candidates") - F.col("todo"))


def latest_hashes(hashes: DataFrame) -> DataFrame:
    """The newest fingerprint per key of an append-only table."""
    rest = [c for c in hashes.columns if c not in (*HASH_KEY, "hashed_at")]
    newest = hashes.groupBy(*HASH_KEY).agg(F.max(F.struct("hashed_at", *rest)).alias("v"))
    return newest.select(*HASH_KEY, "v.*")


_CONTENT = ["fingerprint", "algo", "sample_size"]


def _confidence() -> F.Column:
    return F.when(F.col("sample_size") > 0, "tentative").otherwise("certain").alias("confidence")


def duplicate_pairs(files: DataFrame) -> DataFrame:
    """Files of equal fingerprint within one scan.

    Each group of copies has its first path as the original, and every other copy is paired
    with that one: n - 1 rows for n copies, from which every other pair follows.
    """
    firsts = (
        files.groupBy(*_CONTENT)
        .agg(F.min("path").alias("path_a"), F.count("*").alias("copies"))
        .where(F.col("copies") >= 2)
        .drop("copies")
    )
    copies = files.select(*_CONTENT, F.col("path").alias("path_b"), "size")
    paired = skew_join(copies, firsts, _CONTENT, "inner", by=["path_b"]).where(F.col("path_a") < F.col("path_b"))
    folders = [parent_folder(F.col(p)).alias(f) for p, f in (("path_a", "folder_a"), ("path_b", "folder_b"))]
    return paired.select(*_CONTENT, "path_a", "path_b", "size", *folders, _confidence())


def duplicates_across(a: DataFrame, b: DataFrame) -> DataFrame:
    """Files of equal fingerprint in two scans: a row per file of either scan whose content the other holds too.

    ``side`` is a or b, ``original`` the first path of the group in the first scan. Every pair of the group follows
    from its rows, which are as many as files.
    """
    both = a.select(*_CONTENT, "path", "size", F.lit("a").alias("side")).unionByName(
        b.select(*_CONTENT, "path", "size", F.lit("b").alias("side"))
    )
    groups = (
        both.groupBy(*_CONTENT)
        .agg(F.min(F.when(F.col("side") == "a", F.col("path"))).alias("original"), F.max("side").alias("last"))
        .where(F.col("original").isNotNull() & (F.col("last") == "b"))
        .drop("last")
    )
    held = skew_join(both, groups, _CONTENT, "inner", by=["side", "path"])
    return held.select(*_CONTENT, "side", "path", "size", parent_folder(F.col("path")).alias("folder"), "original", _confidence())
