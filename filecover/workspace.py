"""The whole job list over one store: scan, audit, compare, fingerprint, plan a copy, report."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions.sizes import parse_size_text
from .operators import audit as coverage
from .operators import compare as comparing
from .operators import copy_plan as copying
from .operators import evidence as proof
from .operators import fingerprint as hashing
from .operators import history
from .operators.key_index import index_sizes
from .operators.report import audit_document, write_document
from .operators.rollup import by_folder
from .scratch import written
from .sources.exif import read_exif
from .sources.file_hash import hash_files
from .sources.listing import read_listing
from .sources.manifest import read_manifest
from .sources.store import Store


def looks_like_path(ident: str) -> bool:
    return ident.startswith("~") or "/" in ident or os.sep in ident


@dataclass(frozen=True)
class Target:
    """What a name given by the user stands for."""

    ident: str
    kind: str
    root: str | None
    scan_id: int | None = None


@dataclass(frozen=True)
class StoredAudit:
    """A finished audit; ``tagged`` is read back from a table, so roll-ups do not match again.

    ``close`` (or the end of a ``with`` block) deletes that table; what the store keeps stays.
    """

    run_id: int | None
    tagged: DataFrame
    matches: DataFrame
    missing: DataFrame
    per_dest: DataFrame
    totals: DataFrame
    evidence: DataFrame
    dests: list
    store: Store
    work: str

    def __enter__(self) -> StoredAudit:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.store.drop_work(self.work)

    @property
    def locations(self) -> DataFrame:
        return coverage.locations(self.tagged, self.dests)

    def missing_by_folder(self, order: str = "name") -> DataFrame:
        return by_folder(self.missing, order)

    def document(self) -> DataFrame:
        return audit_document(
            self.totals,
            self.per_dest,
            by_folder(self.missing, sort=False),
            self.missing,
            self.locations,
            self.evidence,
        )

    def write_report(self, path: str) -> None:
        write_document(self.document(), path)


@dataclass(frozen=True)
class Workspace:
    spark: SparkSession
    store: Store

    @classmethod
    def at(cls, spark: SparkSession, root: str, buckets: int = Store.buckets) -> Workspace:
        return cls(spark, Store(spark, root, buckets))

    # Sources

    def scan(
        self, root: str, label: str | None = None, *, format: str = "listing", exif: bool = False, **options
    ) -> int:
        """List ``root`` and store it; ``path`` in ``options`` names the listing file if there is one."""
        lineage = {k: options.pop(k) for k in ("drive_type", "incremental") if k in options}
        if format == "listing":
            root = os.path.realpath(root)
            if not os.path.isdir(root):
                raise ValueError(f"not a directory: {root}")
            # A stored scan holds regular files only; links are followed in fresh listings.
            options.setdefault("links", "false")
        try:
            entries = read_manifest(self.spark, options.pop("path", root), format, **options)
        except (PySparkException, KeyboardInterrupt) as e:
            self.store.save_failed_scan(root, label, lineage.get("drive_type", "unknown"), getattr(e, "entries", None))
            raise
        pictures = (lambda files: read_exif(files, root)) if exif else None
        return self.store.save_scan(entries, root, label, exif=pictures, **lineage)

    def resolve(self, ident: str) -> Target:
        """A path if it looks like one, else a known label, else an existing directory."""
        if not looks_like_path(ident):
            row = self.store.latest(ident)
            if row is not None:
                return Target(ident, "label", row["root_path"], row["id"])
        root = os.path.realpath(os.path.expanduser(ident))
        if not os.path.isdir(root):
            raise ValueError(f"neither a known label nor a directory: {ident!r}")
        return Target(ident, "path", root)

    def _labelled(self, label: str):
        row = self.store.latest(label)
        if row is None:
            raise ValueError(f"no finished scan of {label!r}")
        return row

    def _files(self, target: Target, skip: str | None = None) -> DataFrame:
        if target.kind == "label":
            return self.store.files(target.scan_id)
        # A tree is walked once: it may change, and walking is the slow part. What was read is kept until the session ends.
        return read_listing(self.spark, target.root, skip_root=skip)

    def _index(self, target: Target) -> DataFrame | None:
        return self.store.index(target.scan_id) if target.kind == "label" else None

    # Audit

    def audit(
        self, source: str, against: list[str], *, min_size: int | str = 0, persist: bool = True, **options
    ) -> StoredAudit:
        """``persist=False``: nothing is added to the history, and there is no run id."""
        if not against:
            raise ValueError("an audit needs at least one destination")
        src = self.resolve(source)
        targets = [self.resolve(ident) for ident in against]
        min_bytes = parse_size_text(min_size)
        work = uuid.uuid4().hex
        plan = coverage.audit(
            self._files(src),
            [coverage.Destination(t.ident, self._files(t, src.root), t.kind, t.root, self._index(t)) for t in targets],
            min_size=min_bytes,
            source_root=src.root,
            **options,
        )
        # Matching is done once and written; every counter, list and roll-up reads it back.
        tagged = self._kept(plan.tagged_with_exif(self._dest_exif(targets)), f"{work}/tagged")
        missing = coverage.missing(tagged)
        per_dest = self.spark.createDataFrame(coverage.per_dest(tagged, plan.dests).collect(), "ord int, dest string, kind string, matched bigint")
        totals = coverage.totals(tagged).first().asDict()
        shown = self.spark.createDataFrame([tuple(totals.values())], ", ".join(f"{k} {'double' if k == 'percent' else 'bigint'}" for k in totals))
        run_id = None
        if persist:
            run_id = self.store.save_audit(
                missing,
                totals,
                {r["dest"]: r["matched"] for r in per_dest.collect()},
                (source, src.kind, src.scan_id),
                [(t.ident, t.kind) for t in targets],
                min_bytes,
            )
        matches = plan.matches_of(tagged)
        pairs = proof.pair_evidence(matches, self._exif(src))
        return StoredAudit(run_id, tagged, matches, missing, per_dest, shown, proof.evidence(pairs), plan.dests, self.store, work)

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        path = self.store.work_path(name)
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _exif(self, target: Target) -> DataFrame:
        return self.store.exif(-1 if target.scan_id is None else target.scan_id)

    def _dest_exif(self, targets: list[Target]) -> DataFrame:
        named = [self._exif(t).withColumn("dest", F.lit(t.ident)) for t in targets]
        out = named[0]
        for more in named[1:]:
            out = out.unionByName(more)
        return out

    # Other jobs

    def compare(self, a: str, b: str, min_size: int = 0) -> DataFrame:
        first, second = self._labelled(a), self._labelled(b)
        if first["id"] == second["id"]:
            raise ValueError(f"{a!r} and {b!r} are the same scan")
        return comparing.compare(self.store.files(first["id"]), self.store.files(second["id"]), min_size)

    def hash(
        self,
        label: str,
        algo: str = "xxh64",
        sample_size: int = 0,
        min_size: int = 0,
        only_collisions: bool = True,
        resume: bool = True,
    ) -> dict:
        """Fingerprint what is not done yet; returns the counters."""
        scan = self._labelled(label)
        index = self.store.index(scan["id"])
        # The index leaves out files without a name, of which a scan has none.
        sizes = None if index is None else index_sizes([index])
        wanted = hashing.candidates(self.store.files(scan["id"]), min_size, only_collisions, sizes)
        before = self.store.hashes(scan["id"])
        todo = written(hashing.unfinished(wanted, before, algo, sample_size) if resume else wanted, "todo")
        counters = hashing.summary(wanted, todo, sample_size).first().asDict()
        done = F.count(F.lit(1)).alias("hashed")
        read = F.sum(F.least("size", F.lit(sample_size)) if sample_size else F.col("size")).alias("bytes_read")
        seen = Observation()
        digests = hash_files(todo, scan["root_path"], algo, sample_size).observe(seen, done, read)
        self.store.save_hashes(digests, scan["id"], algo, sample_size)
        return {**counters, **{k: v or 0 for k, v in seen.get.items()}, "scan_id": scan["id"]}

    def duplicates(self, a: str, b: str | None = None) -> DataFrame:
        first = self.store.hashes(self._labelled(a)["id"])
        return hashing.duplicates_across(first, self.store.hashes(self._labelled(b)["id"])) if b else hashing.duplicate_pairs(first)

    def copy_plan(self, run_id: int, dest_ident: str | None = None, check: bool = True) -> DataFrame:
        """Source and destination path of every missing file of a stored audit."""
        run = self.store.audit_runs.where(F.col("id") == run_id)
        place = copying.roots(run, self.store.scans, dest_ident).first()
        if place is None:
            raise ValueError(f"no audit run {run_id}")
        if place["refusal"]:
            raise ValueError(f"audit run {run_id}: {place['refusal']}")
        source, dest = place["source_root"], place["dest_root"]
        if check:
            for root in (source, dest):
                if not os.path.isdir(root):
                    raise ValueError(f"not a directory: {root}")
            if os.path.realpath(source) == os.path.realpath(dest):
                raise ValueError("source and destination are the same")
        missing = self.store.audit_missing.where(F.col("run_id") == run_id)
        return copying.copy_plan(run, missing, self.store.scans, dest_ident)

    def stored_audit(self, run_id: int) -> tuple:
        """(run row with decoded columns, its missing files largest first)."""
        run = history.decoded_runs(self.store.audit_runs.where(F.col("id") == run_id)).first()
        if run is None:
            raise ValueError(f"no audit run {run_id}")
        return run, history.missing_of_run(self.store.audit_missing, run_id)

    def labels(self) -> DataFrame:
        return history.labels(self.store.scans)

    def status(self) -> tuple:
        return history.scan_status(self.store.scans), history.audit_status(self.store.audit_runs)
