"""A stored scan by match key: one row per size, name and stretch of time, with the files there.

Written bucketed by that key, an index is joined by an audit as it lies: source rows are sent to the buckets, and nothing of the
destination is shuffled or reduced anew. A stretch is ``STRETCH`` seconds, and a row has one entry per second (its first path), so
a row has no more entries than that however often a key occurs. A source row whose window crosses the edge of a stretch
looks into both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import SALT, hot_keys

STRETCH = 256
#: A wider window reaches more than two stretches.
MOST_WINDOW = STRETCH // 2
KEY = ["size", "bn", "stretch"]


def _stretch(time: Column) -> Column:
    return time - F.pmod(time, F.lit(STRETCH).cast("bigint"))


def file_index(keyed: DataFrame, carry: list[str]) -> DataFrame:
    """(size, bn, stretch, n, files) from (size, bn, mt, path and the ``carry`` columns).

    ``files``: array of (mt, path, carry), the first path of each second, in order; ``n``: all files of the row.
    """
    firsts = keyed.groupBy("size", "bn", "mt").agg(F.min(F.struct("path", *carry)).alias("first"), F.count(F.lit(1)).alias("n"))
    entry = F.struct("mt", F.col("first.path").alias("path"), *[F.col(f"first.{c}").alias(c) for c in carry])
    placed = firsts.select("size", "bn", _stretch(F.col("mt")).alias("stretch"), "n", entry.alias("entry"))
    return placed.groupBy(*KEY).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("entry")).alias("files"))  # STRETCH at most


def _looked_up(rows: DataFrame, i: int) -> DataFrame:
    """``rows`` with ``__d{i}``: the first of their ``__files`` inside their window."""
    inside = F.filter("__files", lambda f: (f["mt"] >= F.col("__from")) & (f["mt"] <= F.col("__to")))
    return rows.withColumn(f"__d{i}", F.get(inside, F.lit(0))).drop("__files")


def held_by_index(source: DataFrame, indexes: list[DataFrame], window: int, carry: list[str]) -> DataFrame:
    """``source`` (path, size, bn, mt; paths once each) with ``found``, as ``near.held_by`` gives it, from one index per destination.

    Rows of very frequent keys are dealt over sub-keys, with the few index rows they need; all others go to the
    buckets of the first index, and stay there for those of as many buckets.
    """
    if window > MOST_WINDOW:
        raise ValueError(f"window: at most {MOST_WINDOW} seconds with an index")
    columns = source.columns
    reach = F.lit(window).cast("bigint")
    timed = source.withColumns({"__from": F.col("mt") - reach, "__to": F.col("mt") + reach})
    stretches = F.array_distinct(F.array(_stretch(F.col("__from")), _stretch(F.col("__to"))))
    rows = timed.withColumn("__stretches", stretches).withColumn("__parts", F.size("__stretches")).withColumn("stretch", F.explode("__stretches")).drop("__stretches")
    named = [index.select(*KEY, F.col("files").alias("__files")) for index in indexes]

    pieces = hot_keys(rows, KEY).toDF(*KEY, "__pieces").where("__pieces > 1")
    same = [rows[k].eqNullSafe(pieces[k]) for k in KEY]
    common = rows.join(F.broadcast(pieces), same, "left_anti")
    salt = F.pmod(F.xxhash64("path"), F.col("__pieces").cast("bigint")).cast("int").alias(SALT)
    hot = rows.join(F.broadcast(pieces), same).select(*[rows[c] for c in rows.columns], salt)
    every = F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1)).alias(SALT)
    for i, index in enumerate(named):
        # At most one row per frequent key and sub-key. Without such keys, the index isn't read again.
        few = index.join(F.broadcast(pieces), KEY).select(*KEY, "__files", every)
        common = _looked_up(common.hint("merge").join(index, KEY, "left"), i)
        hot = _looked_up(hot.join(few, [*KEY, SALT], "left"), i)
    hot = hot.drop(SALT)
    found = [f"__d{i}" for i in range(len(indexes))]
    both = common.unionByName(hot).select(*columns, "__parts", *found)
    # A row that looked into two stretches takes the earlier find; all others are done.
    whole = both.where("__parts = 1").drop("__parts")
    merged = both.where("__parts > 1").groupBy(*columns).agg(*[F.min(d).alias(d) for d in found])
    entries = [
        F.when(F.col(d).isNotNull(), F.struct(F.lit(i).alias("ord"), F.col(d)["path"].alias("dest_path"), *[F.col(d)[c].alias(c) for c in carry]))
        for i, d in enumerate(found)
    ]
    return whole.unionByName(merged).select(*columns, F.array_compact(F.array(*entries)).alias("found"))


def index_sizes(indexes: list[DataFrame]) -> DataFrame:
    """(size, n): how many files of each size there are, without looking at a path."""
    every = reduce(DataFrame.unionByName, [index.select("size", "n") for index in indexes])
    return every.groupBy("size").agg(F.sum("n").alias("n"))
