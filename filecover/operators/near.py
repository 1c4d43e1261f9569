"""The earliest row in reach of each destination, for every source row, in one pass over sorted rows.

Both sides are put into one table, partitioned by key and slot of time, and sorted from late to early. A source
row stands at the earliest time it accepts, so the destination row last passed is the earliest that is not too early;
whether it is too late is seen from its time. Nothing is compared with anything else, so the work does not depend
on how wide the window is or how many rows a key has.

A slot is eight windows wide. A source row lies in the slot of its time, a destination row is copied
to the one or two slots it can serve. Keys that stay frequent within a slot are dealt over sub-keys (``skew``), in pieces
of no fewer rows than a slot has seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import SALT, Spread

SLOT = "__slot"


def _slot(time: Column, window: int) -> Column:
    return time - F.pmod(time, F.lit(max(1, 8 * window)).cast("bigint"))


def _reachable_slots(time: Column, window: int) -> Column:
    if not window:
        return F.array(_slot(time, 0))
    return F.array_distinct(F.array(_slot(time - window, window), _slot(time + window, window)))


def held_by(
    source: DataFrame, dests: DataFrame, n_dests: int, keys: list[str], time: str, window: int | None,
    by: list[str], carry: list[str],
) -> DataFrame:
    """``source`` with ``found``: an array of (ord, and the ``carry`` columns) of the destinations that hold the row.

    ``dests``: ord (0 to ``n_dests`` - 1), keys, time and carry; one row per ord, keys and time. The earliest time
    in reach is taken. With ``window=None`` time plays no part, and there is one row per ord and keys.
    ``by`` tells source rows of one key apart.
    """
    columns = source.columns
    if window is None:
        left, right = source.withColumn(SLOT, F.lit(0).cast("bigint")), dests.withColumn(SLOT, F.lit(0).cast("bigint"))
        at, reach = F.lit(0).cast("bigint"), None
        left, right = left.withColumn("__at", at), right.withColumn("__at", at)
    else:
        reach = F.lit(window).cast("bigint")
        left = source.withColumn(SLOT, _slot(F.col(time), window)).withColumn("__at", F.col(time) - reach)
        right = dests.withColumn(SLOT, F.explode(_reachable_slots(F.col(time), window))).withColumn("__at", F.col(time))
    place = [*keys, SLOT]
    spread = Spread(left, place, n_dests * max(1, 10 * (window or 0)))  # seconds that destinations in a slot can have
    held = F.struct(F.col("__at").alias("at"), "ord", *carry)
    # Single columns, not a struct: whoever needs the same of them gets the same plan, and shares its exchange.
    own = {c: f"__row_{c}" for c in columns}
    rows = spread.deal(left, by).select(
        *place, SALT, "__at", F.lit(1).alias("__kind"), *[F.col(c).alias(o) for c, o in own.items()],
        F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType).alias("__held"),
    )
    serving = spread.replicate(right).select(
        *place, SALT, "__at", F.lit(0).alias("__kind"),
        *[F.lit(None).cast(source.schema[c].dataType).alias(o) for c, o in own.items()], held.alias("__held"),
    )
    late_to_early = (
        Window.partitionBy(*place, SALT)
        .orderBy(F.desc("__at"), "__kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    last = [
        F.last(F.when(F.col("__held.ord") == i, F.col("__held")), ignorenulls=True).over(late_to_early).alias(f"__d{i}")
        for i in range(n_dests)
    ]
    passed = rows.unionByName(serving).select("__kind", *own.values(), *last).where("__kind = 1")
    inside = (lambda d: d.isNotNull()) if reach is None else (lambda d: d["at"] <= F.col(own[time]) + reach)
    found = F.filter(F.array(*[F.col(f"__d{i}") for i in range(n_dests)]), inside)
    shown = F.transform(found, lambda d: F.struct(d["ord"].alias("ord"), *[d[c].alias(c) for c in carry]))
    return passed.select(*[F.col(o).alias(c) for c, o in own.items()], shown.alias("found"))
