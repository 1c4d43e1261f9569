"""Catalog of scans and history of audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shares import percent
from ..functions.sizes import human_size
from ..schemas import DEST_SPECS, PER_DEST
from .rollup import first_per_group


def _newest() -> list[Column]:
    return [F.desc("started_at"), F.desc("id")]


def finished(scans: DataFrame, mode: str | None = None) -> DataFrame:
    done = scans.where(F.col("finished_at").isNotNull())
    return done.where(F.col("scan_mode") == mode) if mode else done


def latest_scan(scans: DataFrame, label: str, mode: str | None = None) -> DataFrame:
    """At most one row: the label's newest finished scan, of ``mode`` if given."""
    return finished(scans, mode).where(F.col("label") == label).orderBy(*_newest()).limit(1)


def latest_per_label(scans: DataFrame, mode: str | None = None) -> DataFrame:
    return first_per_group(finished(scans, mode), ["label"], _newest(), 1)


def parent_scans(scans: DataFrame) -> DataFrame:
    """Newest finished full scan per label, which an incremental scan builds on."""
    return latest_per_label(scans, "full").select("label", F.col("id").alias("parent_scan_id"))


def labels(scans: DataFrame) -> DataFrame:
    return (
        latest_per_label(scans)
        .orderBy(*_newest())
        .select(
            "label",
            F.col("id").alias("scan_id"),
            "root_path",
            "drive_type",
            "file_count",
            F.col("finished_at").alias("scanned_at"),
        )
    )


def scan_status(scans: DataFrame) -> DataFrame:
    # The texts shown for a state.
    return scans.orderBy(*_newest()).select(
        "id",
        "label",
        F.coalesce("drive_type", F.lit("unknown")).alias("drive_type"),
        "scan_mode",
        F.when(
            F.col("parent_scan_id").isNotNull(),
            F.concat(F.lit("incremental of #"), F.col("parent_scan_id").cast("string")),
        ).otherwise("").alias("note"),
        "file_count",
        F.when(F.col("finished_at").isNull(), "in-progress").otherwise("done").alias("state"),
        "started_at",
    )


def audit_status(runs: DataFrame) -> DataFrame:
    """Newest first; destinations as text, or the stored text where it is not valid JSON."""
    specs = F.from_json("dest_specs", DEST_SPECS)
    names = F.array_join(F.transform(specs, lambda s: F.coalesce(s["ident"], F.lit("?"))), ", ")
    return runs.orderBy(F.desc("ran_at"), F.desc("id")).select(
        "id",
        "source_ident",
        F.coalesce(names, F.col("dest_specs")).alias("destinations"),
        F.col("matched_count").alias("matched"),
        "total_files",
        percent(F.col("matched_count"), F.col("total_files")).alias("percent"),
        F.col("missing_count").alias("missing"),
        "ran_at",
    )


def decoded_runs(runs: DataFrame) -> DataFrame:
    """Runs with their JSON columns as arrays and maps; a missing map is empty."""
    return runs.withColumns(
        {
            "dest_specs": F.from_json("dest_specs", DEST_SPECS),
            "per_dest_match": F.from_json(F.coalesce("per_dest_match", F.lit("{}")), PER_DEST),
        }
    )


def missing_of_run(missing: DataFrame, run_id: int) -> DataFrame:
    """A stored run's missing files, largest first."""
    rows = missing.where(F.col("run_id") == run_id)
    return rows.orderBy(F.desc("size"), "source_path").select(
        F.col("source_path").alias("path"), "size", human_size(F.col("size")).alias("size_human")
    )


#: Runs whose rows of one path lie in one group.
BLOCK = 1024


def numbered_runs(runs: DataFrame) -> DataFrame:
    """(run_id, source_ident, no, next_id): runs of each source from 1 on, by time and id, and the one that follows.

    A source may hold a large part of all runs, so runs are first numbered within days; the numbers of
    a day begin behind those of the days before, from a table of one row per source and day.
    """
    dated = runs.select("id", "source_ident", "ran_at", F.to_date("ran_at").alias("day"))
    in_day = Window.partitionBy("source_ident", "day").orderBy("ran_at", "id")
    ordered = dated.withColumns({"at": F.row_number().over(in_day), "later": F.lead("id").over(in_day)})
    days = dated.groupBy("source_ident", "day").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ran_at", "id")).alias("first"))
    by_day = Window.partitionBy("source_ident").orderBy("day")
    before = F.coalesce(F.sum("n").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = days.select("source_ident", "day", before.alias("before"), F.lead("first.id").over(by_day).alias("next_day"))
    same_day = [ordered[c].eqNullSafe(placed[c]) for c in ("source_ident", "day")]
    return ordered.join(placed, same_day).select(
        F.col("id").alias("run_id"), ordered["source_ident"], (F.col("before") + F.col("at")).alias("no"),
        F.coalesce("later", "next_day").alias("next_id"),
    )


def audit_changes(runs: DataFrame, missing: DataFrame) -> DataFrame:
    """(run_id, source_path, size, change) against the previous run of the same source, over the whole history.

    ``newly_missing``: missing now, not then. ``newly_covered``: missing then, not now. The runs in which a
    path of a source is missing are islands of run numbers: an island's first run finds it newly missing (unless there was no run before), and
    the run behind its last finds it newly covered (if there is one). Missing rows meet their run in a plain join, and are shuffled once more, by
    source, path and block of ``BLOCK`` runs; a row at the edge of a block is also a mark in the next, so no group is larger.
    """
    numbered = numbered_runs(runs).where(F.col("run_id").isNotNull())
    rows = missing.join(numbered, "run_id").select("run_id", "source_ident", "source_path", "size", "no", "next_id")
    block = F.floor(F.col("no") / BLOCK).cast("bigint")
    edge = F.when(F.col("no") % BLOCK == 0, block - 1).when(F.col("no") % BLOCK == BLOCK - 1, block + 1)
    placed = rows.withColumn("own", block).withColumn("block", F.explode(F.array_compact(F.array(block, edge))))
    along = Window.partitionBy("source_ident", "source_path", "block").orderBy("no", F.desc("size"))
    seen = placed.withColumns({"last": F.lag("no").over(along), "next": F.lead("no").over(along)}).where(F.col("block") == F.col("own"))
    starts = (F.col("no") > 1) & (F.col("last").isNull() | (F.col("last") < F.col("no") - 1))
    ends = F.col("next_id").isNotNull() & (F.col("next").isNull() | (F.col("next") > F.col("no") + 1))
    change = lambda run, kind: F.struct(F.col(run).alias("run_id"), "source_path", "size", F.lit(kind).alias("change"))
    changes = F.array_compact(F.array(F.when(starts, change("run_id", "newly_missing")), F.when(ends, change("next_id", "newly_covered"))))
    return seen.select(F.explode(changes).alias("c")).select("c.*")
