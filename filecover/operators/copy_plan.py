"""What to copy where, and what became of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import absolute_path
from ..schemas import DEST_SPECS
from .history import latest_per_label
from .skew import skew_join


def roots(runs: DataFrame, scans: DataFrame, dest_ident: str | None = None) -> DataFrame:
    """(run_id, dest_ident, source_root, dest_root, refusal) per audit run.

    ``refusal`` says why nothing may be copied; it is NULL for a usable run.
    """
    specs = F.from_json("dest_specs", DEST_SPECS)
    if dest_ident is None:
        fitting = F.when(F.size(specs) == 1, specs)
    else:
        fitting = F.filter(specs, lambda s: s["ident"] == dest_ident)
    chosen = F.try_element_at(fitting, F.lit(1))
    run = runs.select(
        F.col("id").alias("run_id"), "source_ident", "source_kind", "source_scan_id",
        F.coalesce(F.size(specs), F.lit(0)).alias("n_specs"),
        chosen["ident"].alias("dest_ident"), chosen["kind"].alias("dest_kind"),
    )
    source = scans.select(F.col("id").alias("source_scan_id"), F.col("root_path").alias("scan_root"))
    dest = latest_per_label(scans).select(
        F.col("label").alias("dest_ident"), F.col("root_path").alias("label_root")
    )
    # Registries: a row per scan or run, and at most one partner for each.
    placed = run.join(source, "source_scan_id", "left").join(dest, "dest_ident", "left")
    by_path = F.col("source_kind") == "path"
    placed = placed.withColumns(
        {
            "source_root": F.when(by_path, F.col("source_ident")).otherwise(F.col("scan_root")),
            "dest_root": F.when(F.col("dest_kind") == "path", F.col("dest_ident")).otherwise(F.col("label_root")),
        }
    )
    same = F.rtrim("source_root", F.lit("/")) == F.rtrim("dest_root", F.lit("/"))
    refusal = (
        F.when(F.col("n_specs") == 0, "the run has no destination")
        .when(F.col("dest_ident").isNull() & F.lit(dest_ident is None), "several destinations, choose one")
        .when(F.col("dest_ident").isNull(), "the run has no such destination")
        .when(F.col("source_root").isNull(), "the source scan is gone")
        .when(F.col("dest_root").isNull(), "no finished scan of the destination")
        .when(same, "source and destination are the same")
    )
    return placed.select("run_id", "dest_ident", "source_root", "dest_root", refusal.alias("refusal"))


def copy_plan(runs: DataFrame, missing: DataFrame, scans: DataFrame, dest_ident: str | None = None) -> DataFrame:
    """(run_id, path, size, source_path, dest_path) for the missing files of usable runs."""
    usable = roots(runs, scans, dest_ident).where(F.col("refusal").isNull())
    planned = skew_join(missing, usable, ["run_id"], "inner", by=["source_path"])
    path = F.col("source_path")
    return planned.select(
        "run_id",
        path.alias("path"),
        "size",
        absolute_path(F.col("source_root"), path).alias("source_path"),
        absolute_path(F.col("dest_root"), path).alias("dest_path"),
    )


def plan_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def copy_outcome(plan: DataFrame, dest_files: DataFrame) -> DataFrame:
    """``plan`` against fresh listings of the destinations: succeeded, or failed and why.

    ``dest_files``: path and size, with ``run_id`` where the plan is of several runs, whose destinations differ;
    without it, ``path`` is below the one destination of the plan. Other columns of the plan stay. A path may be listed
    more than once (two spellings of one name): a planned file has one outcome, and succeeded if any of
    them has its size.
    """
    keys = [c for c in ("run_id", "path") if c in dest_files.columns]
    there = dest_files.select(*keys).distinct().withColumn("__there", F.lit(True))
    same = dest_files.select(*keys, "size").distinct().withColumn("__same", F.lit(True))
    placed = plan.join(same, [*keys, "size"], "left").join(there, keys, "left")
    reason = F.when(F.col("__there").isNull(), "not on destination").when(F.col("__same").isNull(), "size differs on destination")
    outcome = F.when(reason.isNull(), "succeeded").otherwise("failed")
    return placed.select(*plan.columns, outcome.alias("outcome"), reason.alias("reason"))
