"""Joins whose many-side may hold very frequent keys.

A key that holds more than 1/PIECES of the rows is dealt over sub-keys in proportion to its share, and the
other side, which has few rows per key, is copied to each of them. How often a key occurs is counted, so it
comes out the same however often a plan is run; there are fewer than PIECES such keys, and that
small table is joined to both sides. Every join takes this path, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = 1024
SALT = "__salt"


def hot_keys(rows: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """(__h0, __h1, ..., pieces): the keys above 1/PIECES of the rows, fewer than PIECES rows.

    A piece has about ``least`` rows at least: as many as the other side may have under a key, so that
    copying those to all pieces gives no more rows than there are.
    """
    names = [F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)]
    counts = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()  # from the counts, whose exchange it shares
    pieces = F.least(F.ceil(F.col("__n") * PIECES / total), F.ceil(F.col("__n") / F.lit(least))).cast("int")
    return counts.where(F.col("__n") * PIECES > total).select(*[f"__h{i}" for i in range(len(keys))], pieces.alias("__pieces"))


class Spread:
    """How the rows of ``keys`` are dealt out, taken from the many-side."""

    def __init__(self, many: DataFrame, keys: list[str], least: int = 1):
        self.keys, self.hot = keys, hot_keys(many, keys, least)

    def _with_pieces(self, rows: DataFrame) -> DataFrame:
        # Fewer than PIECES rows by construction, whatever the size of the data.
        same = [rows[k].eqNullSafe(self.hot[f"__h{i}"]) for i, k in enumerate(self.keys)]
        joined = rows.join(F.broadcast(self.hot), same, "left").drop(*[f"__h{i}" for i in range(len(self.keys))])
        return joined.withColumn("__pieces", F.coalesce("__pieces", F.lit(1)))

    def deal(self, rows: DataFrame, by: list[str]) -> DataFrame:
        """Give each row one sub-key. ``by`` must tell rows of one key apart, and be repeatable."""
        salt = F.pmod(F.xxhash64(*by), F.col("__pieces").cast("bigint")).cast("int")
        return self._with_pieces(rows).withColumn(SALT, salt).drop("__pieces")

    def replicate(self, rows: DataFrame) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1))
        return self._with_pieces(rows).withColumn(SALT, every).drop("__pieces")


def skew_join(many: DataFrame, few: DataFrame, keys: list[str], how: str, by: list[str]) -> DataFrame:
    """Equi-join; ``few`` has a small number of rows per key, ``many`` may have any number."""
    spread = Spread(many, keys)
    return spread.deal(many, by).join(spread.replicate(few), [*keys, SALT], how).drop(SALT)


def bucket_of(column: Column, n: int) -> Column:
    """A bucket of 0 to n - 1 from a hash."""
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
