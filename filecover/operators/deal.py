"""Rows dealt to tasks by the work they are, so that none has much more than its share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the rows whose work is summed before that of single rows.
BINS = 4096


def parts_by_work(rows: DataFrame, by: list[str], work: Column, parts: int) -> DataFrame:
    """``rows`` with ``part``, from 0 to 2 x ``parts`` - 1: a part has at most twice a mean share, or one row.

    Rows lie in the order of a hash of ``by``, large beside small ones; running sums of their work cut that line at equal shares. Sums are
    those of ``BINS`` ranges of the line, and within each range those of its rows, so no task orders more than a range. A row above a share
    by itself, of which there are fewer than ``parts``, has a part of its own. Rows are read more than once: give a table.
    """
    placed = rows.withColumns({"__work": work.cast("double"), "__at": F.xxhash64(*by)}).withColumn("__bin", F.pmod("__at", F.lit(BINS)).cast("int"))
    share = placed.agg((F.sum("__work") / parts).alias("share")).scalar()
    large = placed.where(F.col("__work") > share)
    small = placed.where(F.coalesce(F.col("__work") <= share, F.lit(True)))
    bins = small.groupBy("__bin").agg(F.sum("__work").alias("bin_work"))  # BINS rows
    line = Window.orderBy("__bin")
    before = F.coalesce(F.sum("bin_work").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    begins = bins.select("__bin", before.alias("__before"))
    within = Window.partitionBy("__bin").orderBy("__at", *by).rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("__before") + F.coalesce(F.sum("__work").over(within), F.lit(0.0))
    cut = F.least(F.floor(F.try_divide(at, share)).cast("int"), F.lit(parts - 1))
    dealt = small.join(F.broadcast(begins), "__bin").withColumn("part", F.coalesce(cut, F.lit(0)))
    alone = large.withColumn("part", F.lit(parts - 1) + F.row_number().over(Window.orderBy("__at", *by)))  # fewer than `parts` rows
    return dealt.select(*rows.columns, "part").unionByName(alone.select(*rows.columns, "part"))


def deal_by_work(rows: DataFrame, by: list[str], work: Column, parts: int) -> DataFrame:
    """``rows`` in 2 x ``parts`` partitions (see ``parts_by_work``)."""
    return parts_by_work(rows, by, work, parts).repartitionById(2 * parts, F.col("part")).drop("part")
