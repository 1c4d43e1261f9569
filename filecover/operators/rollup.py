"""Roll-ups by folder and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ROOT_FOLDER, parent_folder
from .skew import bucket_of

#: Parts of a folder whose names are ranked apart.
BUCKETS = 32


def first_per_group(rows: DataFrame, group: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each group; each task hands on no more than ``n`` per group."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("__n") <= n).drop("__n")


def first_names(rows: DataFrame, n: int) -> DataFrame:
    """(folder, sample): the first ``n`` paths of each folder, in order, from (folder, path).

    Names are ranked within parts of a folder, so a large folder is no single task's work; each task hands on no more
    than ``n`` per part. Other columns of ``rows`` are carried along: where counts are made of the same rows,
    both then need the same of what lies before, and share its exchange.
    """
    parts = rows.withColumn("part", bucket_of(F.col("path"), BUCKETS))
    firsts = first_per_group(parts, ["folder", "part"], ["path"], n)
    carried = F.collect_list(F.struct("path", *[c for c in rows.columns if c not in ("folder", "path")]))  # n x BUCKETS at most
    shown = F.transform(F.slice(F.sort_array(carried), 1, n), lambda row: row["path"])
    return firsts.groupBy("folder").agg(shown.alias("sample"))


def by_folder(
    files: DataFrame, order: str = "name", sample: int = 5, root: str = ROOT_FOLDER, sort: bool = True
) -> DataFrame:
    """(folder, files, bytes, sample, more) from (path, size).

    ``order``: "name", or "bytes" for the largest folder first. Counts are aggregated where the rows are; of names, each
    task hands on the first few.
    """
    if order not in ("name", "bytes"):
        raise ValueError(f"unknown order: {order}")
    placed = files.select(parent_folder(F.col("path"), root).alias("folder"), "path", "size")
    counts = placed.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    rolled = counts.join(first_names(placed, sample), "folder").select(
        "folder", "files", "bytes", "sample", (F.col("files") - F.size("sample")).alias("more")
    )
    if not sort:
        return rolled
    return rolled.orderBy(*([F.desc("bytes"), "folder"] if order == "bytes" else ["folder"]))
