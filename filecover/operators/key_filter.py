"""A bit set of one side's keys, tested where the other side is read.

Each key sets one of ``bits`` bits by its hash. Tasks make 64-bit words of them (one aggregation, which each task
starts on its own rows), words are gathered to rows of ``WORDS`` words, and those are broadcast: bits / 8 bytes at most,
whatever the size of the data, as the number of bits is fixed and checked. A row whose bit isn't set has no partner, and goes before it is
shuffled. One with a partner always stays; one without stays with a chance of (number of keys) / bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits by default, and at most: 32 MB and 128 MB to broadcast.
BITS, MOST_BITS = 1 << 28, 1 << 30
WORDS = 512


def _place(keys: list[Column | str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def key_filter(rows: DataFrame, keys: list[Column | str], bits: int = BITS) -> DataFrame:
    """(__block, __words): the bits that the keys of ``rows`` set; a row per ``WORDS`` words that have any."""
    if not 64 * WORDS <= bits <= MOST_BITS or bits % (64 * WORDS):
        raise ValueError(f"bits: a multiple of {64 * WORDS}, at most {MOST_BITS}")
    at = rows.select(_place(keys, bits).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))
    words = at.groupBy(F.floor(F.col("at") / 64).cast("bigint").alias("word")).agg(F.bit_or(bit).alias("bits"))
    held = F.collect_list(F.struct((F.col("word") % WORDS).cast("int").alias("i"), "bits"))  # WORDS at most
    blocks = words.groupBy(F.floor(F.col("word") / WORDS).cast("bigint").alias("__block")).agg(held.alias("held"))
    absent = F.array_except(F.sequence(F.lit(0), F.lit(WORDS - 1)), F.col("held.i"))
    unset = F.transform(absent, lambda i: F.struct(i.alias("i"), F.lit(0).cast("bigint").alias("bits")))
    every = F.sort_array(F.concat("held", unset))["bits"]  # sorted by place: looking each up took a search apiece
    return blocks.select("__block", every.alias("__words"))


def may_hold(rows: DataFrame, found: DataFrame, keys: list[Column | str], bits: int = BITS) -> DataFrame:
    """The ``rows`` whose keys may be among those ``found`` (by ``key_filter``, with the same ``bits``).

    Keys of both sides must have the same types, as their hashes are compared.
    """
    at = _place(keys, bits)
    placed = rows.withColumns({"__at": at, "__block": F.floor(at / (64 * WORDS)).cast("bigint")})
    joined = placed.join(F.broadcast(found), "__block")
    word = F.get("__words", (F.floor(F.col("__at") / 64) % WORDS).cast("int"))
    return joined.where(F.getbit(word, (F.col("__at") % 64).cast("int")) == 1).select(*rows.columns)
