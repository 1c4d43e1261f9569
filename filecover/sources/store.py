"""Scans, fingerprints, capture metadata and audits as Parquet tables.

Rows of a scan or a run are written first and its registry row last, so a job that fails half
way leaves nothing that a reader would take for complete. Ids come from the registry; one
writer at a time is assumed.

Files, metadata and missing lists are written once per scan or run. Registries grow by a file a row, and are
gathered into one from time to time; the fingerprints of a scan are merged with each job (see ``generations``), so a
reader finds one row per key however many jobs there were. A finished scan is also kept by match key (see ``key_index``).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.paths import clean_label_text, default_label
from ..operators.audit import scan_index
from ..operators.dedup import unique_files
from ..operators.filters import drop_metadata
from ..operators.fingerprint import latest_hashes
from ..operators.history import latest_scan
from ..operators.key_index import KEY
from ..scratch import drop
from . import generations
from .bucketed import read_bucketed, write_bucketed

#: Files of a registry before they are gathered into one.
REGISTRY_FILES = 64


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(microsecond=0)


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str
    #: Buckets of a scan by match key; audits join scans of as many buckets without a shuffle of theirs.
    buckets: int = 64

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _read(self, name: str, schema: StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self._path(name))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: DataFrame, schema: StructType, partition: str | None = None) -> None:
        writer = rows.select(*schema.names).write.mode("append")
        (writer.partitionBy(partition) if partition else writer).parquet(self._path(name))

    def _registry(self, name: str, schema: StructType) -> DataFrame:
        newest = generations.current(self.spark, self._path(name))
        return self.spark.read.schema(schema).parquet(newest) if newest else self._read(name, schema)

    def _register(self, name: str, row: tuple, schema: StructType) -> None:
        path, added = self._path(name), self.spark.createDataFrame([row], schema).coalesce(1)
        newest = generations.current(self.spark, path)
        if newest and generations.files_in(self.spark, newest) < REGISTRY_FILES:
            added.write.mode("append").parquet(newest)
        else:
            generations.replace(self.spark, path, self._registry(name, schema).unionByName(added).coalesce(1))

    def _next_id(self, registry: DataFrame) -> int:
        return (registry.agg(F.max("id")).first()[0] or 0) + 1

    @property
    def scans(self) -> DataFrame:
        return self._registry("scans", schemas.SCANS)

    @property
    def audit_runs(self) -> DataFrame:
        return self._registry("audit_runs", schemas.AUDIT_RUNS)

    @property
    def audit_missing(self) -> DataFrame:
        return self._read("audit_missing", schemas.AUDIT_MISSING)

    def _of_scan(self, name: str, schema: StructType, scan_id: int) -> DataFrame:
        """Rows of one scan; only its folder is looked at."""
        try:
            reader = self.spark.read.schema(schema).option("basePath", self._path(name))
            return reader.parquet(self._path(f"{name}/scan_id={scan_id}")).select(*schema.names)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def files(self, scan_id: int) -> DataFrame:
        return self._of_scan("files", FILES, scan_id).drop("scan_id")

    def exif(self, scan_id: int) -> DataFrame:
        return self._of_scan("exif", schemas.EXIF, scan_id)

    def hashes(self, scan_id: int) -> DataFrame:
        """The newest fingerprint per path, algorithm and sample size."""
        newest = generations.current(self.spark, self._path(f"hashes/scan_id={scan_id}"))
        if newest:
            return self.spark.read.schema(schemas.HASHES).parquet(newest)
        return latest_hashes(self._of_scan("hashes", schemas.HASHES, scan_id))

    def _index_path(self, scan_id: int) -> str:
        return self._path(f"index/buckets={self.buckets}/scan_id={scan_id}")

    def index(self, scan_id: int) -> DataFrame | None:
        """The scan by match key, None for one that was stored without."""
        return read_bucketed(self.spark, self._index_path(scan_id), schemas.INDEX, KEY, self.buckets)

    def latest(self, label: str, mode: str | None = None):
        """Registry row of the label's newest finished scan, or None."""
        return latest_scan(self.scans, label, mode).first()

    def save_scan(
        self,
        entries: DataFrame,
        root_path: str,
        label: str | None = None,
        drive_type: str = "unknown",
        incremental: bool = False,
        exif: Callable[[DataFrame], DataFrame] | None = None,
    ) -> int:
        """Store a listing. An incremental scan lists everything too; only its lineage differs.

        ``exif`` makes capture metadata of the files as stored, so the tree is walked once and every row names a
        file of the scan. A scan that fails is registered unfinished, with the number of rows written so far.
        """
        label = clean_label_text(label or default_label(root_path))
        parent = self.latest(label, "full") if incremental else None
        scan_id, started = self._next_id(self.scans), _now()
        row = (
            scan_id, label, root_path, drive_type, started, None, 0,
            "incremental" if parent else "full", parent["id"] if parent else None,
        )
        # The count includes repeated paths, which are dropped on the way to the table.
        listed = Observation()
        counted = drop_metadata(entries).observe(listed, F.count(F.lit(1)).alias("files"))
        try:
            self._append_files(counted, scan_id)
            if exif is not None:
                found = _stamped(exif(self.files(scan_id)), scan_id).withColumn("extracted_at", F.lit(started))
                self._append("exif", found, schemas.EXIF, "scan_id")
            index = scan_index(self.files(scan_id), None if exif is None else self.exif(scan_id))
            write_bucketed(index, self._index_path(scan_id), KEY, self.buckets)
        except BaseException:
            self._register("scans", (*row[:6], self._written(scan_id), *row[7:]), schemas.SCANS)
            raise
        self._register("scans", (*row[:5], _now(), listed.get["files"], *row[7:]), schemas.SCANS)
        return scan_id

    def save_failed_scan(
        self, root_path: str, label: str | None, drive_type: str = "unknown", entries: DataFrame | None = None
    ) -> int:
        """Register a scan whose listing failed, unfinished, with the ``entries`` read before."""
        scan_id, started = self._next_id(self.scans), _now()
        if entries is not None:
            self._append_files(drop_metadata(entries), scan_id)
        count = 0 if entries is None else self._written(scan_id)
        row = (scan_id, clean_label_text(label or default_label(root_path)), root_path, drive_type, started, None, count, "full", None)
        self._register("scans", row, schemas.SCANS)
        return scan_id

    def _written(self, scan_id: int) -> int:
        """Rows of a scan that a failed job left behind."""
        return self.files(scan_id).count()

    def _append_files(self, entries: DataFrame, scan_id: int) -> None:
        rows = unique_files(entries.select("path", "size", "mtime", "path_raw"))
        self._append("files", _stamped(rows, scan_id), FILES, "scan_id")

    def save_hashes(self, rows: DataFrame, scan_id: int, algo: str, sample_size: int) -> None:
        """Merge (path, size, fingerprint) into the fingerprints of the scan: the newest per key stays.

        The rows there are written anew; next to reading the files for new fingerprints that is little.
        """
        stamped = _stamped(rows, scan_id).withColumns(
            {
                "algo": F.lit(algo),
                "sample_size": F.lit(sample_size).cast("bigint"),
                "hashed_at": F.lit(_now()),
            }
        )
        before = self.hashes(scan_id).select(*schemas.HASHES.names)
        merged = latest_hashes(before.unionByName(stamped.select(*schemas.HASHES.names)))
        generations.replace(self.spark, self._path(f"hashes/scan_id={scan_id}"), merged.select(*schemas.HASHES.names))

    def save_audit(
        self,
        missing: DataFrame,
        totals: dict,
        per_dest: dict,
        source: tuple,
        dest_specs: list,
        min_size: int = 0,
    ) -> int:
        """``missing``: (path, size); ``source``: (ident, kind, scan id or None)."""
        run_id = self._next_id(self.audit_runs)
        rows = missing.select(
            F.lit(run_id).cast("bigint").alias("run_id"), F.col("path").alias("source_path"), "size"
        )
        self._append("audit_missing", rows, schemas.AUDIT_MISSING, "run_id")
        counters = [totals[k] for k in ("total_files", "total_bytes", "matched", "missing", "missing_bytes")]
        specs = [{"ident": ident, "kind": kind} for ident, kind in dest_specs]
        self._register(
            "audit_runs",
            (
                run_id, *source, json.dumps(specs, ensure_ascii=False), min_size, False,
                *counters, json.dumps(per_dest, ensure_ascii=False), _now(),
            ),
            schemas.AUDIT_RUNS,
        )
        return run_id

    def work_path(self, name: str) -> str:
        return self._path(f"work/{name}")

    def drop_work(self, name: str) -> None:
        """Delete a folder below work, on whatever file system the store is."""
        drop(self.spark, self.work_path(name))


FILES = StructType([*schemas.FILE_ENTRY.fields, schemas.HASHES["scan_id"]])


def _stamped(rows: DataFrame, scan_id: int) -> DataFrame:
    return rows.withColumn("scan_id", F.lit(scan_id).cast("bigint"))
