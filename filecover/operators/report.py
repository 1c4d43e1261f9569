"""The audit document as JSON lines, so that it can be written in parallel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import human_size


def _section(name: str, rows: DataFrame, key: str) -> DataFrame:
    body = F.to_json(F.struct(*rows.columns))
    return rows.select(F.lit(name).alias("section"), F.col(key).cast("string").alias("key"), body.alias("body"))


def _sized(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(f"{column}_human", human_size(F.col(column)))


def audit_document(
    totals: DataFrame,
    per_dest: DataFrame,
    folders: DataFrame,
    missing: DataFrame,
    locations: DataFrame | None = None,
    evidence: DataFrame | None = None,
) -> DataFrame:
    """(section, key, body): one line per total, destination, folder and file."""
    parts = [
        _section("totals", _sized(_sized(totals, "total_bytes"), "missing_bytes"), "total_files"),
        _section("dest", per_dest, "dest"),
        _section("folder", _sized(folders, "bytes"), "folder"),
        _section("missing", _sized(missing, "size"), "path"),
    ]
    if locations is not None:
        parts.append(_section("match", locations, "path"))
    if evidence is not None:
        parts.append(_section("evidence", evidence, "path"))
    return reduce(DataFrame.unionByName, parts)


def plan_document(plan: DataFrame, totals: DataFrame, outcome: DataFrame | None = None) -> DataFrame:
    parts = [
        _section("totals", _sized(totals, "bytes"), "files"),
        _section("planned", _sized(plan, "size"), "path"),
    ]
    if outcome is not None:
        parts.append(_section("outcome", outcome, "path"))
    return reduce(DataFrame.unionByName, parts)


def write_document(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").partitionBy("section").json(path)
