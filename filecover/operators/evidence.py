"""How well capture metadata supports a match. It never changes matched or missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.capture import BLANKS

KINDS = ("strong", "weak", "conflict")
CLOCK_TOLERANCE = 5
FIELDS = ("taken_at", "camera_make", "camera_model")


def _differs(a: Column, b: Column) -> Column:
    def bare(text: Column) -> Column:
        return F.lower(F.btrim(text, F.lit(BLANKS)))

    return (a != "") & (b != "") & (bare(a) != bare(b))


def classify(source: Column, dest: Column, tolerance: int = CLOCK_TOLERANCE) -> Column:
    """Kind of one pair of (taken_at, camera_make, camera_model) structs, either may be NULL."""
    apart = F.abs(source["taken_at"] - dest["taken_at"])
    return (
        F.when(source.isNull() | dest.isNull(), "weak")
        .when(_differs(source["camera_make"], dest["camera_make"]), "conflict")
        .when(_differs(source["camera_model"], dest["camera_model"]), "conflict")
        .when(apart > tolerance, "conflict")
        .when(apart.isNotNull(), "strong")
        .otherwise("weak")
    )


def combine(kind: Column) -> Column:
    """Aggregate: any strong, else all conflict, else weak."""
    return (
        F.when(F.coalesce(F.bool_or(kind == "strong"), F.lit(False)), "strong")
        .when(F.coalesce(F.bool_and(kind == "conflict"), F.lit(False)), "conflict")
        .otherwise("weak")
    )


def exif_key() -> Column:
    return F.struct(*FIELDS)


def pair_evidence(matches: DataFrame, source_exif: DataFrame, tolerance: int = CLOCK_TOLERANCE) -> DataFrame:
    """Matches that carry ``dest_key`` (see ``Audit.matches_with_exif``), with their ``kind``."""
    source = source_exif.select("path", exif_key().alias("source_key"))
    kind = classify(F.col("source_key"), F.col("dest_key"), tolerance)
    return matches.join(source, "path", "left").withColumn("kind", kind).drop("source_key", "dest_key")


def evidence(pairs: DataFrame) -> DataFrame:
    """(path, kind) per matched source file."""
    return pairs.groupBy("path").agg(combine(F.col("kind")).alias("kind"))


def evidence_counts(per_source: DataFrame) -> DataFrame:
    """Files per kind, all three kinds kept."""
    kinds = per_source.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    counts = per_source.groupBy("kind").agg(F.count("*").alias("files"))
    return kinds.join(F.broadcast(counts), "kind", "left").select(
        "kind", F.coalesce("files", F.lit(0)).alias("files")
    )


def conflicts(per_source: DataFrame) -> DataFrame:
    """Their paths, in order.

    A sort samples its input to find ranges, and makes it again to deal it out. The shuffle before it holds the paths that
    are left, and is read twice instead; by a hash, as Spark drops one by the path that rows already lie by.
    """
    return per_source.where(F.col("kind") == "conflict").select("path").repartition(F.xxhash64("path")).orderBy("path")
