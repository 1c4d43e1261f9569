"""Manifests, catalog and history derived from the driver's tables, for queries and tests."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import unique_files

C = F.col


@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=64)
def base(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        """concat('shoot_', lpad(cast(l_suppkey as string), 3, '0'), '/', case when l_discount = 0.1 then '._' else '' end,
                  'IMG_', lpad(cast(l_orderkey % 200 as string), 4, '0'), '_', cast(l_linenumber as string),
                  case l_returnflag when 'A' then '.JPG' when 'N' then '.MP4' else '.ARW' end) as path""",
        "cast(l_partkey % 10 as bigint) * 100000 + cast(l_quantity as bigint) as size",
        "unix_timestamp(l_shipdate) + l_linenumber * 3600 as mtime",
        "l_partkey", "l_quantity", "l_linestatus", "l_tax", "l_shipdate",
    )


# Per scan: which rows it has, and how its path, size and time follow from them.
_OFF_BY_ONE = "size + case when l_tax = 0.08 then 1 else 0 end"
SCANS = {
    "card": ("l_linestatus = 'O'", "path", "size", "mtime"),
    "backup_a": ("l_linestatus = 'O' and l_quantity <= 30", "concat('copy/', lower(path))", "size", "mtime + l_partkey % 7 - 3"),
    "backup_b": ("l_quantity > 25", "concat('b/', path)", _OFF_BY_ONE, "mtime"),
    "mirror": ("l_quantity < 45 and (l_linestatus = 'O' or l_tax = 0.06)", "path", _OFF_BY_ONE, "mtime"),
}


def files_raw(spark: SparkSession, d: str, *labels: str) -> DataFrame:
    """All scans, or those named, before repeated paths are dropped."""

    def rows(label: str) -> DataFrame:
        kept, path, size, mtime = SCANS[label]
        return base(spark, d).where(kept).selectExpr(
            f"'{label}' as label", f"{path} as path", f"{size} as size", f"{mtime} as mtime", "l_partkey", "l_shipdate"
        )

    return reduce(DataFrame.unionByName, map(rows, labels or SCANS))


@lru_cache(maxsize=64)
def files(spark: SparkSession, d: str, *labels: str) -> DataFrame:
    return unique_files(files_raw(spark, d, *labels), ["label"])


def exif(spark: SparkSession, d: str, *labels: str) -> DataFrame:
    return exif_of(files(spark, d, *labels))


def exif_of(files: DataFrame) -> DataFrame:
    drift = F.when((C("label") != "card") & (C("l_partkey") % 5 == 0), 10).otherwise(0)
    kept = files.where(F.lower("path").like("%.jpg") & (C("l_partkey") % 4 != 0))
    return kept.select(
        "label",
        "path",
        F.when(C("l_partkey") % 9 != 0, C("mtime") - 30 + drift).alias("taken_at"),
        F.when(C("l_partkey") % 11 == 0, None)
        .when((C("label") == "backup_b") & (C("l_partkey") % 13 == 0), "GoPro")
        .when(C("label") == "card", "SONY")
        .otherwise(" sony ")
        .alias("camera_make"),
        F.when(C("l_partkey") % 17 != 0, "ILCE-7M4").alias("camera_model"),
    )


def _drive() -> F.Column:
    return F.concat(F.lit("drive_"), F.lpad((C("o_custkey") % 40).cast("string"), 2, "0"))


def scans(spark: SparkSession, d: str) -> DataFrame:
    urgent = C("o_orderpriority") == "1-URGENT"
    return table(spark, d, "orders").select(
        (C("o_orderkey") + 1).alias("id"),
        _drive().alias("label"),
        F.concat(F.lit("/Volumes/d"), (C("o_custkey") % 40).cast("string")).alias("root_path"),
        F.when(C("o_orderkey") % 3 == 0, "hdd").when(C("o_orderkey") % 3 == 1, "ssd").otherwise("unknown").alias("drive_type"),
        C("o_orderdate").alias("started_at"),
        F.when(C("o_orderstatus") != "P", C("o_orderdate")).alias("finished_at"),
        C("o_custkey").alias("file_count"),
        F.when(urgent, "incremental").otherwise("full").alias("scan_mode"),
        F.when(urgent, C("o_orderkey")).alias("parent_scan_id"),
    )


DEST_SPECS = '[{"ident":"backup_a","kind":"label"},{"ident":"/mnt/b","kind":"path"}]'


def audit_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs with no files carry text that is not JSON; every fifth has no per-destination map."""
    total, missing = C("o_custkey") % 100, (C("o_custkey") % 100) % 7
    per_dest = F.concat(F.lit('{"backup_a":'), (total - missing).cast("string"), F.lit("}"))
    return table(spark, d, "orders").select(
        (C("o_orderkey") + 1).alias("id"),
        _drive().alias("source_ident"),
        F.lit("label").alias("source_kind"),
        # A run's own scan id exists in the catalog unless it is odd one out.
        (C("o_orderkey") + 1 - F.when(C("o_orderkey") % 50 == 0, 1000000000).otherwise(0)).alias("source_scan_id"),
        F.when(total == 0, "oops").otherwise(DEST_SPECS).alias("dest_specs"),
        total.alias("total_files"),
        (total - missing).alias("matched_count"),
        missing.alias("missing_count"),
        F.when(C("o_orderkey") % 5 != 0, per_dest).alias("per_dest_match"),
        C("o_orderdate").alias("ran_at"),
    )


def audit_missing(spark: SparkSession, d: str) -> DataFrame:
    """Files a run found missing: those of the order's lines, one row per path."""
    rows = table(spark, d, "lineitem").select(
        (C("l_orderkey") + 1).alias("run_id"),
        F.concat(F.lit("shoot_"), (C("l_suppkey") % 5).cast("string"), F.lit("/p"), (C("l_partkey") % 20).cast("string"), F.lit(".arw")).alias("path"),
        C("l_quantity").cast("bigint").alias("size"),
    )
    return unique_files(rows, ["run_id"]).withColumnRenamed("path", "source_path")


def contents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id",
        F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), C("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.octet_length(C("text").cast("binary")).cast("bigint").alias("size"),
        C("text").cast("binary").alias("content"),
    )


def stored_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints already stored; every sixth file was done twice, with other content first."""
    done = contents(spark, d).where(C("doc_id") % 3 == 0)
    columns = ["scan_id", "path", "algo", "fingerprint", "sample_size", "hashed_at"]
    day = F.lit("2024-01-01 00:00:00").cast("timestamp")

    def rows(content, seconds: int) -> list:
        at = F.timestamp_seconds(F.unix_timestamp(day) + C("doc_id") + seconds)
        return [
            F.lit(1).cast("bigint").alias("scan_id"), "path", F.lit("md5").alias("algo"),
            F.md5(content).alias("fingerprint"), F.lit(0).cast("bigint").alias("sample_size"), at.alias("hashed_at"),
        ]

    old = done.where(C("doc_id") % 6 == 0).select(*rows(F.concat(C("content"), F.lit("x").cast("binary")), 0))
    return done.select(*rows(C("content"), 86400)).unionByName(old).select(*columns)


def lsl_lines(spark: SparkSession, d: str) -> DataFrame:
    listed = files(spark, d, "card").select(
        F.concat(
            F.lpad(C("size").cast("string"), 9, " "), F.lit(" "), C("l_shipdate").cast("string"),
            F.lit(".000000000 "), C("path"),
        ).alias("value")
    )
    odd = spark.createDataFrame([(line,) for line in ODD_LINES], "value string")
    return listed.unionByName(odd)


ODD_LINES = (
    "",
    "not a listing",
    "x 2020-01-01 00:00:00 a.txt",
    "        7 2020-01-01 00:00:00.000000000 .Trashes/gone.jpg",
    "        7 9999-99-99 00:00:00.000000000 odd date.jpg",
)
