"""Coverage of a source manifest by destination manifests."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import base_name_lower, parent_folder, whole_seconds
from ..functions.shares import percent
from .evidence import exif_key
from .filters import at_least, drop_metadata, exclude_matching, outside_root
from .near import held_by
from .key_filter import key_filter, may_hold
from .key_index import MOST_WINDOW, file_index, held_by_index
from .rollup import first_names

#: Names shown per folder.
SHOWN = 5
#: What a match has in common, besides its time.
KEYS = ["size", "bn"]


@dataclass(frozen=True)
class Destination:
    """``kind`` is ``label`` (a stored scan) or ``path`` (a fresh listing).

    A stored scan is taken as it is; a fresh listing is also subject to the exclude pattern
    and to self-exclusion. ``index``: the scan's stored ``scan_index``, if it has one.
    """

    name: str
    files: DataFrame
    kind: str = "label"
    root: str | None = None
    index: DataFrame | None = None


@dataclass(frozen=True)
class AuditOptions:
    mtime_match: bool = True
    window: int = 2
    min_size: int = 0
    exclude: str | None = None
    source_root: str | None = None
    prune: bool = True

    @property
    def reach(self) -> int | None:
        return self.window if self.mtime_match else None


def match_keys(files: DataFrame) -> DataFrame:
    """Adds ``bn`` (lower-cased name) and ``mt`` (whole-second time)."""
    return files.withColumns(
        {"bn": base_name_lower(F.col("path")), "mt": whole_seconds(F.col("mtime"))}
    )


def source_rows(files: DataFrame, options: AuditOptions) -> DataFrame:
    kept = exclude_matching(at_least(drop_metadata(files), options.min_size), options.exclude)
    keyed = match_keys(kept.select("path", "size", "mtime"))
    return keyed.select("path", "size", F.coalesce("bn", F.lit("")).alias("bn"), "mt")


def dest_rows(dests: list[Destination], options: AuditOptions) -> DataFrame:
    """All destinations as one table; ``ord`` is the user's order."""

    def rows(ord_: int, dest: Destination) -> DataFrame:
        files = at_least(drop_metadata(dest.files), options.min_size)
        if dest.kind == "path":
            files = exclude_matching(files, options.exclude)
            if dest.root:
                absolute = F.concat(F.lit(dest.root.rstrip("/") + "/"), F.col("path"))
                files = outside_root(files, absolute, options.source_root)
        keyed = match_keys(files.select("path", "size", "mtime")).where(F.col("bn").isNotNull())
        return keyed.select(F.lit(ord_).alias("ord"), "path", "size", "bn", "mt")

    return reduce(DataFrame.unionByName, [rows(i, d) for i, d in enumerate(dests)])


def dest_keys(rows: DataFrame, options: AuditOptions) -> DataFrame:
    """One row per destination and match key: its first path. A hash leads the keys, as in ``unique_files``."""
    keys = ["ord", "size", "bn", *(["mt"] if options.mtime_match else [])]
    return rows.groupBy(F.xxhash64(*keys).alias("__hash"), *keys).agg(F.min("path").alias("path")).drop("__hash")


def scan_index(files: DataFrame, exif: DataFrame | None = None) -> DataFrame:
    """A scan by match key (see ``key_index``), each file with its capture metadata where there is any."""
    keyed = match_keys(drop_metadata(files).select("path", "size", "mtime")).where(F.col("bn").isNotNull())
    if exif is None:
        none = F.lit(None).cast("struct<taken_at: bigint, camera_make: string, camera_model: string>")
        with_exif = keyed.withColumn("dest_key", none)
    else:
        with_exif = keyed.join(exif.select("path", exif_key().alias("dest_key")), "path", "left")
    return file_index(with_exif.select("size", "bn", "mt", "path", "dest_key"), ["dest_key"])


@dataclass(frozen=True)
class Audit:
    """Lazy results of one audit. Each is a plan; nothing runs until the caller asks.

    All of them come from ``tagged``, which matches the source with all destinations in one pass.
    """

    source: DataFrame
    dests: list[Destination]
    options: AuditOptions = field(default_factory=AuditOptions)

    def __post_init__(self):
        if not self.dests:
            raise ValueError("an audit needs at least one destination")
        names = [d.name for d in self.dests]
        if len(set(names)) < len(names):
            raise ValueError(f"a destination is named twice: {names}")
        if self.options.window < 0:
            raise ValueError("the time window cannot be negative")

    @cached_property
    def rows(self) -> DataFrame:
        return source_rows(self.source, self.options)

    @cached_property
    def _dest_rows(self) -> DataFrame:
        """Destination rows; with ``prune``, few but those whose size and name the source has, dropped before any shuffle."""
        rows = dest_rows(self.dests, self.options)
        keys = [F.col("size").cast("bigint"), "bn"]
        return may_hold(rows, key_filter(self.rows, keys), keys) if self.options.prune else rows

    @cached_property
    def keys(self) -> DataFrame:
        return dest_keys(self._dest_rows, self.options)

    @property
    def by_index(self) -> bool:
        """Whether all destinations are stored by match key, and the window is one that their indexes serve."""
        near = self.options.mtime_match and self.options.window <= MOST_WINDOW
        return near and all(d.kind == "label" and d.index is not None for d in self.dests)

    def _tagged(self, keys: DataFrame | None, *carry: str) -> DataFrame:
        if self.by_index:
            indexes = [at_least(d.index, self.options.min_size) for d in self.dests]
            return held_by_index(self.rows, indexes, self.options.window, list(carry))
        named = keys.withColumnRenamed("path", "dest_path")
        columns = ["dest_path", *carry]
        return held_by(self.rows, named, len(self.dests), KEYS, "mt", self.options.reach, ["path"], columns)

    @cached_property
    def tagged(self) -> DataFrame:
        """(path, size, bn, mt, found): every source file once, with the destinations that hold it.

        ``found``: array of (ord, dest_path). Among several candidates of a destination the earliest time
        wins, then the first path.
        """
        return self._tagged(None if self.by_index else self.keys)

    @cached_property
    def matches(self) -> DataFrame:
        """(path, size, bn, mt, ord, dest, dest_path): one row per source file and destination that holds it."""
        return self.matches_of(self.tagged)

    def matches_of(self, tagged: DataFrame) -> DataFrame:
        rows = tagged.select("path", "size", "bn", "mt", F.explode("found").alias("f")).select("path", "size", "bn", "mt", "f.*")
        return rows.withColumn("dest", self._dest_name())

    def tagged_with_exif(self, dest_exif: DataFrame) -> DataFrame:
        """``tagged`` with ``dest_key``, the capture metadata of the destination file, in each entry.

        ``dest_exif``: dest, path and the three fields; listings without stored metadata have
        no rows there. It is attached before matching, where each file stands once; afterwards
        one destination file may stand beside any number of source files. Indexes hold it already.
        """
        if self.by_index:
            return self._tagged(None, "dest_key")
        exif = dest_exif.select("dest", F.col("path"), exif_key().alias("dest_key"))
        named = self.keys.withColumn("dest", self._dest_name()).join(exif, ["dest", "path"], "left").drop("dest")
        return self._tagged(named, "dest_key")

    def matches_with_exif(self, dest_exif: DataFrame) -> DataFrame:
        return self.matches_of(self.tagged_with_exif(dest_exif))

    def _dest_name(self) -> Column:
        return F.get(F.array(*[F.lit(dest.name) for dest in self.dests]), F.col("ord"))

    @cached_property
    def missing(self) -> DataFrame:
        """(path, size) of source files that no destination holds."""
        return missing(self.tagged)

    @cached_property
    def status(self) -> DataFrame:
        """Every source file once, with ``matched``."""
        return self.tagged.withColumn("matched", F.size("found") > 0).drop("found")

    @cached_property
    def folders(self) -> DataFrame:
        return folder_counts(self.tagged, len(self.dests))

    @cached_property
    def totals(self) -> DataFrame:
        return totals(self.tagged)

    @cached_property
    def per_dest(self) -> DataFrame:
        return per_dest(self.tagged, self.dests)

    @cached_property
    def coverage(self) -> DataFrame:
        """Distinct (size, bn) of the source and the first destination that holds one."""
        first = F.min(F.get("found", F.lit(0))["ord"])  # entries are in the user's order
        return self.tagged.groupBy("size", "bn").agg(first.alias("first_ord"))


def audit(source: DataFrame, dests: list[Destination], **options) -> Audit:
    return Audit(source, dests, replace(AuditOptions(), **options))


def missing(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.size("found") == 0).select("path", "size")


def folder_counts(tagged: DataFrame, n_dests: int) -> DataFrame:
    """Per folder: files, bytes, missing, missing_bytes, a first few missing names, and on0, on1, ...: files each holds.

    Totals and counts per destination are sums of these rows. Counts are aggregated where the rows are; only missing
    files are ranked, and each task hands on the first few of a folder.
    """
    held = F.transform("found", lambda f: f["ord"])
    lost = F.size("found") == 0
    placed = tagged.select(
        parent_folder(F.col("path")).alias("folder"), "path", "size",
        lost.alias("lost"), *[F.array_contains(held, i).cast("bigint").alias(f"on{i}") for i in range(n_dests)],
    )
    missing_bytes = F.coalesce(F.sum(F.when(F.col("lost"), F.col("size"))), F.lit(0))
    counts = placed.groupBy("folder").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("bytes"),
        F.count_if("lost").alias("missing"),
        missing_bytes.alias("missing_bytes"),
        *[F.sum(f"on{i}").alias(f"on{i}") for i in range(n_dests)],
    )
    sample = F.coalesce("sample", F.array().cast("array<string>")).alias("sample")
    ons = [f"on{i}" for i in range(n_dests)]
    named = counts.join(first_names(placed.where("lost"), SHOWN), "folder", "left")
    return named.select("folder", "files", "bytes", "missing", "missing_bytes", sample, *ons)


def missing_folders(folders: DataFrame) -> DataFrame:
    """(folder, files, bytes, sample, more) of the folders that miss files."""
    return folders.where("missing > 0").select(
        "folder", F.col("missing").alias("files"), F.col("missing_bytes").alias("bytes"), "sample",
        (F.col("missing") - F.size("sample")).alias("more"),
    )


def _with_percent(counted: DataFrame) -> DataFrame:
    return counted.withColumn("percent", percent(F.col("matched"), F.col("total_files")))


def totals(tagged: DataFrame) -> DataFrame:
    """One row of counters."""
    size, matched = F.col("size"), F.size("found") > 0
    return _with_percent(
        tagged.agg(
            F.count("*").alias("total_files"),
            F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"),
            F.count_if(matched).alias("matched"),
            F.count_if(~matched).alias("missing"),
            F.coalesce(F.sum(F.when(~matched, size)), F.lit(0)).alias("missing_bytes"),
        )
    )


def totals_of_folders(folders: DataFrame) -> DataFrame:
    """``totals`` from ``folder_counts``."""
    zero = F.lit(0).cast("bigint")
    sums = {c: F.coalesce(F.sum(c), zero) for c in ("files", "bytes", "missing", "missing_bytes")}
    return _with_percent(
        folders.agg(
            sums["files"].alias("total_files"),
            sums["bytes"].alias("total_bytes"),
            (sums["files"] - sums["missing"]).alias("matched"),
            sums["missing"].alias("missing"),
            sums["missing_bytes"].alias("missing_bytes"),
        )
    )


def _listed(counts: DataFrame, dests: list[Destination]) -> DataFrame:
    """(ord, dest, kind, matched) from one row of on0, on1, ..."""
    entries = [
        F.struct(F.lit(i).alias("ord"), F.lit(d.name).alias("dest"), F.lit(d.kind).alias("kind"), F.coalesce(f"on{i}", F.lit(0)).alias("matched"))
        for i, d in enumerate(dests)
    ]
    return counts.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def per_dest(tagged: DataFrame, dests: list[Destination]) -> DataFrame:
    """Source files found on each destination, zeros kept."""
    held = F.transform("found", lambda f: f["ord"])
    counts = tagged.agg(*[F.count_if(F.array_contains(held, i)).alias(f"on{i}") for i in range(len(dests))])
    return _listed(counts, dests)


def per_dest_of_folders(folders: DataFrame, dests: list[Destination]) -> DataFrame:
    return _listed(folders.agg(*[F.sum(f"on{i}").alias(f"on{i}") for i in range(len(dests))]), dests)


def locations(tagged: DataFrame, dests: list[Destination]) -> DataFrame:
    """Per source file that is held: the list of (dest, dest_path), in destination order."""
    names = F.array(*[F.lit(d.name) for d in dests])
    found = F.transform("found", lambda f: F.struct(F.get(names, f["ord"]).alias("dest"), f["dest_path"].alias("dest_path")))
    return tagged.where(F.size("found") > 0).select("path", found.alias("found"))
