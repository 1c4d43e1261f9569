"""One row per path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_files(rows: DataFrame, scan: list[str] | None = None) -> DataFrame:
    """One row per path (and scan): the one that sorts first by the remaining columns.

    An aggregation rather than a ranking: copies of a path collapse before the shuffle. Spark sorts for it, as the least
    struct has no place in a hash table; a hash leads the keys, so that sorts compare numbers and not paths, which begin alike.
    """
    scan = scan or []
    rest = [c for c in rows.columns if c not in (*scan, "path")]
    keys = [*scan, "path"]
    first = rows.groupBy(F.xxhash64(*keys).alias("__hash"), *keys).agg(F.min(F.struct(*rest)).alias("v"))
    return first.select(*scan, "path", "v.*")
