"""Text listings with lines of ``size date time path``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import nfc
from ..operators.filters import drop_metadata


def parse_lsl(lines: DataFrame) -> DataFrame:
    """``value`` lines -> file entries. Short lines and bad sizes are skipped; a bad date is 0."""
    # The fourth part is the rest of the line, blanks included.
    split = lines.select(F.split(F.ltrim("value", F.lit(" \t")), r"\s+", 4).alias("p"))
    at = F.concat_ws(" ", F.get("p", F.lit(1)), F.get("p", F.lit(2))).try_cast("timestamp").cast("double")
    entries = split.select(
        F.get("p", F.lit(3)).alias("raw"),
        F.get("p", F.lit(0)).try_cast("bigint").alias("size"),
        F.coalesce(at, F.lit(0.0)).alias("mtime"),
    )
    # Before NFC, which runs in Python: the names looked for are ASCII, in either spelling.
    real = drop_metadata(entries.where(F.col("size").isNotNull() & (F.col("raw") != "")), "raw")
    return normalised(real)


def normalised(entries: DataFrame) -> DataFrame:
    """(raw, size, mtime) -> file entries; the raw spelling is kept only where NFC differs."""
    path = nfc(F.col("raw"))
    return entries.withColumn("path", path).select(
        "path", F.when(F.col("raw") != F.col("path"), F.col("raw")).alias("path_raw"), "size", "mtime"
    )


def as_manifest(rows: DataFrame) -> DataFrame:
    """Rows with path, size, mtime and perhaps path_raw, as a table may hold them, with paths in NFC.

    A given raw spelling stays; otherwise the given path is it, where NFC differs.
    """
    raw = F.col("path_raw") if "path_raw" in rows.columns else F.lit(None).cast("string")
    given = rows.select(F.col("path").alias("raw"), raw.alias("kept"), F.col("size").cast("bigint"), F.col("mtime").cast("double"))
    named = given.withColumn("path", nfc(F.col("raw")))
    spelled = F.coalesce("kept", F.when(F.col("raw") != F.col("path"), F.col("raw")))
    return named.select("path", spelled.alias("path_raw"), "size", "mtime")


def read_lsl(spark: SparkSession, path: str) -> DataFrame:
    return parse_lsl(spark.read.text(path))
