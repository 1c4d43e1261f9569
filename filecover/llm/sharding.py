"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered 0 to N - 1 in an order that depends on the rows alone (a hash bucket of the
row, then id, size and checksum). The numbering is distributed: a window counts within each
bucket, and the buckets' first numbers come from a table of as many rows as there are buckets.
Equal rows are counted before they are numbered, so a row that makes up a third of the table is one
row until its copies are numbered at the end.

The permutation writes a number as a pair in [0, a) x [0, b) with a * b just above N, and
adds a hash of one half to the other in turn, modulo a or b. A number that lands at N or above is
permuted again (cycle walking) until it is below N. Shard and slot are the remainder and
the quotient of the permuted number by the number of shards, so any row's place can be computed
from its number alone, counts differ by one at most, and slots have no gaps.

Only DataFrame functions are used. Texts leave the first scan as size and checksum only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, written

#: Buckets of the numbering. A part of the definition of the order: to change it changes all places.
BUCKETS = 4096
ROUNDS = 6
#: Steps of a walk; the numbers above N are fewer than its square root, and a walk visits each once at most.
WALK = 64


def _hashed(*parts) -> Column:
    """60 bits of the parts' md5, so that other engines can compute it too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def permuted(number: Column, n: Column, seed: int, rounds: int = ROUNDS) -> Column:
    """Where a number of 0 to n - 1 goes under the permutation of that range."""
    a = F.greatest(F.ceil(F.sqrt(n)).cast("long"), F.lit(1).cast("long"))
    b = F.floor((n + a - 1) / a).cast("long")

    def once(x: Column) -> Column:
        pair = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"))

        def turn(s: Column, i: Column) -> Column:
            left = F.pmod(s["l"] + _hashed(F.lit(str(seed)), i.cast("string"), s["r"].cast("string")), a)
            right = F.pmod(s["r"] + _hashed(F.lit(str(seed)), i.cast("string"), s["l"].cast("string")), b)
            return F.when(i % 2 == 1, F.struct(left.alias("l"), s["r"].alias("r"))).otherwise(
                F.struct(s["l"].alias("l"), right.alias("r"))
            )

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), pair, turn, lambda s: s["l"] * b + s["r"])

    walks = F.least(a * b - n, F.lit(WALK).cast("long"))
    steps = F.when(walks > 0, F.sequence(F.lit(1).cast("long"), walks)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, once(number), lambda x, _: F.when(x < n, x).otherwise(once(x)))


def numbered(rows: DataFrame, by: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Each row with `row_no`, 0 to N - 1, and `n_rows`, N. `by`: columns that tell rows apart."""
    from pyspark.sql import Window

    known = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in by]
    counted = written(
        rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_same")).withColumn("_bucket", F.pmod(_hashed(*known), F.lit(buckets))),
        "numbered",
    )
    per_bucket = counted.groupBy("_bucket").agg(F.sum("_same").alias("_n"))
    in_order = Window.orderBy("_bucket")  # as many rows as buckets
    firsts = per_bucket.select(
        "_bucket",
        (F.sum("_n").over(in_order) - F.col("_n")).alias("_first"),
        F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_rows"),
    )
    inside = Window.partitionBy("_bucket").orderBy(*(F.col(c).asc_nulls_first() for c in by))
    before = counted.withColumn(
        "_before", F.coalesce(F.sum("_same").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    )
    placed = before.join(firsts, "_bucket").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_same") - 1)))
    return placed.select(*by, (F.col("_first") + F.col("_before") + F.col("_copy")).alias("row_no"), "n_rows")


def feistel_shards(
    docs: DataFrame, shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, row_no, shard, slot.

    size: UTF-8 bytes of the text and 8 more; a null text has none, and the checksum of an empty one.
    Unknown ids and repeated rows get places of their own. No rows: no rows.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = texts(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    placed = numbered(rows, ["doc_id", "size", "text_crc32"])
    return placed.withColumn("_to", permuted(F.col("row_no"), F.col("n_rows"), seed)).select(
        "doc_id", "size", "text_crc32", "row_no",
        (F.col("_to") % shards).cast("int").alias("shard"), F.floor(F.col("_to") / shards).cast("long").alias("slot"),
    )


def op2_feistel_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return feistel_shards(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
