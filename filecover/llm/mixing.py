"""Mixing sources to target weights: hash-random order, prefix sums and an exact cut.

Each row gets a key that is a hash of its id and size. Keys spread evenly, so a fixed number of key
ranges sorts a source of any size in parallel: within a range a window sums up sizes in key
order, and the ranges' own sums, a small table, are summed up by source. Both give a row the words
before it in its source. A source's budget is its target in whole words: so many times the whole source
(epochs), and the rest from the front of the order; the row at the cut gives just the words that remain.

Only DataFrame functions are used. Texts leave the first scan as word counts. Equal rows are
counted before they are placed. A hot source is spread over all its ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, written
from .sharding import _hashed

#: Key ranges per source; keys have 60 bits.
RANGE_BITS = 10
#: Copies of a row made at once.
TOGETHER = 1024
#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)


def targets(per_source: DataFrame, share: float, most: float, weights: tuple = WEIGHTS) -> DataFrame:
    """`_none, _source, source_size` with `target`: words each source gives.

    `share` of all words, by weight; none gives above `most` times its size, what it can't give goes
    to the others by weight. With sources in order of size by weight, a source is at its limit
    if what is left, by the weights that are left, is no less than that limit.
    """
    in_order = Window.orderBy("_none", "_source")  # one row per source from here on
    place = (F.row_number().over(in_order) - 1) % len(weights)
    weighed = per_source.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("double"))
    limited = weighed.withColumn("_limit", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("_limit") / F.col("_w"), "_none", "_source")
    before, whole = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    left = limited.select(
        "*",
        (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))).alias("_words"),
        (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))).alias("_weights"),
    ).withColumn("_level", F.col("_words") / F.col("_weights"))
    full = F.col("_limit") / F.col("_w") <= F.col("_level")
    # All that aren't full share one level: the first one's.
    level = F.min(F.when(~full, F.struct(F.col("_limit") / F.col("_w"), "_none", "_source", "_level"))).over(whole)["_level"]
    return left.select("_none", "_source", "source_size", F.when(full, F.col("_limit")).otherwise(F.col("_w") * level).alias("target"))


def _planned(docs: DataFrame, share: float, most: float, weights: tuple, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """A row per distinct (doc_id, source, size), `_same` rows of `docs`: `_epochs` whole passes for each, and `_rest`.

    `_rest`: words of the source's budget that are left for these rows one after the other, each taking its size at most; perhaps below 0.
    """
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        docs[source_col].isNull().alias("_none"),
        F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("_source"),
        F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long").alias("size"),
    )
    key = _hashed(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("size").cast("string"))
    counted = rows.groupBy("doc_id", "_none", "_source", "size").agg(F.count(F.lit(1)).alias("_same")).withColumn("_key", key)
    keyed = written(counted.withColumn("_range", F.shiftright("_key", 60 - RANGE_BITS)), "mix")

    per_range = keyed.groupBy("_none", "_source", "_range").agg(F.sum(F.col("size") * F.col("_same")).alias("_words"))
    per_source = per_range.groupBy("_none", "_source").agg(F.sum("_words").alias("source_size"))
    in_source = Window.partitionBy("_none", "_source").orderBy("_range")  # 2 ** RANGE_BITS rows at most
    starts = (
        per_range.withColumn("_start", F.sum("_words").over(in_source) - F.col("_words"))
        .drop("_words")
        .join(targets(per_source, share, most, weights), ["_none", "_source"])
    )
    in_range = Window.partitionBy("_none", "_source", "_range").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size")
    before = F.sum(F.col("size") * F.col("_same")).over(in_range) - F.col("size") * F.col("_same")
    placed = keyed.withColumn("_before", before).join(starts, ["_none", "_source", "_range"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(0)
    rest = budget - F.col("_epochs") * F.col("source_size") - F.col("_start") - F.col("_before")
    return placed.withColumn("_epochs", epochs).withColumn("_rest", rest)


def mix(
    docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, target, taken (words), passes.

    `passes`: how often the row is in the mix, the last time perhaps in part. A null text has no
    words and is never taken; a null source is a source of its own, the last. No rows: no rows.
    """
    planned = _planned(docs, share, most, weights, seed, id_col, text_col, source_col)
    cut = planned.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_same") - 1)))
    left = F.col("_rest") - F.col("_copy") * F.col("size")
    taken = F.col("_epochs") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least("size", left))
    return cut.withColumn("taken", taken).select(
        "doc_id", F.when(~F.col("_none"), F.col("_source")).alias("source"), "size", "source_size", "target", "taken",
        F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int").alias("passes"),
    )


def _repeated(rows: DataFrame, times: str, number: str) -> DataFrame:
    """Each row `times` times, numbered from 0. One that is repeated often is first split into parts, and those are dealt out."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    few = rows.where((F.col(times) > 0) & (F.col(times) <= TOGETHER)).withColumn(number, every(F.col(times)))
    parts = rows.where(F.col(times) > TOGETHER).withColumn("_part", every(F.ceil(F.col(times) / TOGETHER).cast("long")))
    dealt = parts.repartition("__mix_all", "_part")
    own = F.least(F.lit(TOGETHER).cast("long"), F.col(times) - F.col("_part") * TOGETHER)
    many = dealt.withColumn("_at", every(own)).withColumn(number, F.col("_part") * TOGETHER + F.col("_at")).drop("_part", "_at")
    return few.unionByName(many)


def mixed_rows(
    docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix: rows of `docs`, with all their columns, as often as they are taken.

    The row at a source's cut has its first words only, the last time it is taken, so each source's budget is met to the word.
    Rows of one id, text and source share one place in the order, and take their words one after the other, however many they are;
    rows that are equal in every column leave the first scan once, with their number. Rows with a null text have no words: they go.
    """
    from pyspark.sql.types import StringType

    key = ["__mix_row", "__mix_none", "__mix_source"]
    keyed = docs.withColumns({
        "__mix_row": F.xxhash64(docs[id_col], docs[text_col]), "__mix_none": docs[source_col].isNull(),
        "__mix_source": F.coalesce(docs[source_col].cast("string"), F.lit("")), "__mix_all": F.xxhash64(*[docs[c] for c in docs.columns]),
    })
    planned = _planned(keyed, share, most, weights, seed, "__mix_row", text_col, source_col).select(
        F.col("doc_id").alias("__mix_row"), F.col("_none").alias("__mix_none"), F.col("_source").alias("__mix_source"),
        F.col("size").alias("__mix_size"), F.col("_same").alias("__mix_same"), F.col("_epochs").alias("__mix_epochs"), F.col("_rest").alias("__mix_rest"),
    ).where("__mix_size > 0")
    counts = keyed.groupBy(*key, "__mix_all").agg(F.count(F.lit(1)).alias("__mix_n"))
    along = Window.partitionBy(*key).orderBy("__mix_all").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    first = F.coalesce(F.sum("__mix_n").over(along), zero)  # of the equal rows' places, those of this kind begin here
    size, same, rest, n = (F.col(f"__mix_{c}") for c in ("size", "same", "rest", "n"))
    whole = F.greatest(zero, F.least(same, F.floor(rest / size).cast("long")))  # places that take their whole size once more
    partly = (rest > whole * size) & (whole < same)  # the next one takes what remains
    begin, end = F.col("__mix_first"), F.col("__mix_first") + n
    takes = (
        counts.withColumn("__mix_first", first)
        .join(planned, key)
        .withColumn("__mix_whole", F.col("__mix_epochs") * n + F.greatest(zero, F.least(end, whole) - begin))
        .withColumn("__mix_words", F.when(partly & (whole >= begin) & (whole < end), rest - whole * size).otherwise(zero))
        .withColumn("__mix_times", F.col("__mix_whole") + F.when(F.col("__mix_words") > 0, 1).otherwise(0))
        .select(*key, "__mix_all", "__mix_whole", "__mix_words", "__mix_times")
        .where("__mix_times > 0")
    )
    # One row of those that are equal in all columns; each task hands on one.
    one = F.row_number().over(Window.partitionBy(*key, "__mix_all").orderBy("__mix_all"))
    distinct = keyed.withColumn("__mix_one", one).where("__mix_one = 1").drop("__mix_one")
    repeated = _repeated(distinct.join(takes, [*key, "__mix_all"]), "__mix_times", "__mix_pass")
    # A text's pieces from the end of a word to the end of the next, so joining them gives the text again.
    pieces = F.split(F.col(text_col), f"(?<=[^{SPACE}])(?=[{SPACE}])")
    front = F.array_join(F.slice(pieces, 1, F.greatest(F.col("__mix_words"), F.lit(1)).cast("int")), "")
    text = F.when(F.col("__mix_pass") >= F.col("__mix_whole"), front).otherwise(F.col(text_col)).cast(StringType())
    return repeated.withColumn(text_col, text).select(*docs.columns)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
