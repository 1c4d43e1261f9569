"""Every operator as a query over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import capture, paths, sizes
from ..functions.fingerprints import fingerprint
from ..operators import compare as cmp
from ..operators import copy_plan as copying
from ..operators import evidence as proof
from ..operators import filters
from ..operators import fingerprint as hashing
from ..operators import history
from ..operators.audit import (
    Audit,
    Destination,
    audit,
    folder_counts,
    locations,
    match_keys,
    missing,
    missing_folders,
    per_dest_of_folders,
    scan_index,
    totals_of_folders,
)
from ..operators.dedup import unique_files
from ..operators.key_index import KEY, index_sizes
from ..operators.report import audit_document, plan_document
from ..operators.rollup import by_folder
from ..schemas import INDEX
from ..sources.exif import clean_exif
from ..scratch import all_written, new_folder, written
from ..sources.bucketed import read_bucketed, write_bucketed
from ..sources.lsl import as_manifest, normalised, parse_lsl
from . import views as v

C = F.col
EXCLUDED = r"(?i)_[37]\.(mp4|arw)$"
PYTHON_PATTERNS = (
    r"(?P<digit>\d)(?P=digit)(?P=digit)_",  # a digit three times
    r"_7\.(?i:mp4)\w+\Z",  # letters of any script up to the very end
    r"(?i)(?<=/)img_0*1\d_[^\W_]\.arw$",  # the end, or a line end before it
)
CARD_SCANS = ("card", "backup_a", "backup_b")
BIG = 500_000
HEAD = 64
RUN_DEST = "/mnt/b"
# Names and folders that belong to systems, and near misses.
ODD_NAMES = (*sorted(filters.METADATA_NAMES), "._x", "x._y", "Thumbs.dbx")
ODD_FOLDERS = (*sorted(filters.SYSTEM_DIRS), "a/.Trashes", "Trashes")


def card_audit(spark: SparkSession, d: str, kind: str = "path", scans: dict[str, DataFrame] | None = None, **options) -> Audit:
    """The card against its destinations, in the user's order; the last one holds nothing. ``scans``: their manifests, if already made."""
    card, *backups = CARD_SCANS
    files = scans or {n: v.files(spark, d, n) for n in CARD_SCANS}
    dests = [Destination(n, files[n], kind) for n in backups]
    return audit(files[card], [*dests, Destination("empty_drive", files[card].where(F.lit(False)))], **options)


# Sources and tables


def lsl_parse(spark, d):
    parsed = parse_lsl(v.lsl_lines(spark, d))
    return parsed.select("path", "size", "mtime")


def files_dedup(spark, d):
    return unique_files(v.files_raw(spark, d), ["label"]).select("label", "path", "size", "mtime")


def nfc_paths(spark, d):
    """Document texts as names, with a decomposed letter added, so that NFC has work to do."""
    raw = v.table(spark, d, "documents").select(
        "doc_id", F.concat("source", F.lit("/e\u0301_"), "text").alias("raw"), F.lit(0).alias("size"), F.lit(0.0).alias("mtime")
    )
    named = normalised(raw.drop("doc_id")).select("path", "path_raw")
    return named.select(F.md5("path").alias("path_md5"), F.md5("path_raw").alias("raw_md5"))


# Filters


def metadata_filter(spark, d):
    return filters.drop_metadata(v.files(spark, d)).select("label", "path", "size")


def system_dirs(spark, d):
    """Paths moved below directories of which some are to be skipped."""
    place = F.when(C("l_partkey") % 5 == 0, ".Trashes/").when(C("l_partkey") % 5 == 1, "a/$RECYCLE.BIN/").when(
        C("l_partkey") % 5 == 2, "x.fseventsd/").otherwise("")
    moved = v.files(spark, d).select("label", F.concat(place, "path").alias("path"), "size")
    return filters.drop_metadata(moved)


def min_size(spark, d):
    return filters.at_least(v.files(spark, d), BIG).select("label", "path", "size")


def exclude_regex(spark, d):
    return filters.exclude_matching(v.files(spark, d), EXCLUDED).select("label", "path", "size")


def exclude_python(spark, d):
    """Patterns as Python reads them: named groups and references, ends of text, Unicode classes, local flags, look-behind."""
    moved = v.files(spark, d).select(
        "label", F.concat("path", F.when(C("l_partkey") % 3 == 0, "é").when(C("l_partkey") % 3 == 1, "\n").otherwise("_É1")).alias("path"), "size"
    )
    return reduce(filters.exclude_matching, PYTHON_PATTERNS, moved)


def self_exclusion(spark, d):
    """Mounted destinations, seen from a source that lies inside one of them."""
    mounted = v.files(spark, d).withColumn("abs_path", F.concat(F.lit("/Volumes/"), "label", F.lit("/"), "path"))
    return filters.outside_root(mounted, C("abs_path"), "/Volumes/card/shoot_001/").select("label", "path", "abs_path")


# Column functions


def match_keys_query(spark, d):
    keyed = match_keys(v.files(spark, d).withColumn("mtime", C("mtime") + F.lit(0.75)))
    folder = paths.parent_folder(C("path"))
    absolute = paths.absolute_path(F.lit("/Volumes/x/"), C("path"))
    return keyed.select("label", "path", "size", "bn", "mt", folder.alias("folder"), absolute.alias("abs_path"))


def parse_size(spark, d):
    number = C("l_quantity") / 4
    unit = F.element_at(F.array(*[F.lit(u) for u in ("", "k", "M", "GB", "tb", "Z")]), (C("l_orderkey") % 6 + 1).cast("int"))
    text = F.concat(F.lit(" "), number.cast("string"), unit, F.when(C("l_linenumber") == 1, " ").otherwise(""))
    return v.table(spark, d, "lineitem").select("l_orderkey", text.alias("text")).withColumn(
        "bytes", sizes.parse_size(C("text"))
    )


def human_size(spark, d):
    scale = F.pow(F.lit(1000.0), (C("l_orderkey") % 6).cast("double")).cast("bigint")
    size = (C("l_partkey") % 9000 + C("l_linenumber")) * scale
    return v.table(spark, d, "lineitem").select("l_orderkey", size.alias("size")).withColumn(
        "text", sizes.human_size(C("size"))
    )


def jpeg_filter(spark, d):
    return v.files(spark, d).where(paths.wants_exif(C("path"))).select("label", "path")


def label_clean(spark, d):
    raw = F.concat("label", F.lit(" \x07"), "drive_type", F.lit("\u00a0\u2028x\u200b y"))
    return v.scans(spark, d).select("id", paths.clean_label(raw).alias("label"))


def exif_clean(spark, d):
    """Capture metadata as a camera stores it, from the view's clean values."""
    date = F.date_format(F.timestamp_seconds("taken_at"), "yyyy:MM:dd HH:mm:ss")
    stored = v.exif(spark, d).select(
        F.concat_ws("/", "label", "path").alias("path"),
        F.when(C("camera_model").isNull(), "yesterday at noon").otherwise(F.concat(date, F.lit("\x00"))).alias("date_text"),
        F.coalesce(C("camera_make"), F.lit("  \x00")).alias("make_text"),
        F.concat(C("camera_model"), F.lit("\x00\x00")).alias("model_text"),
    )
    return clean_exif(stored)


# Audit


def audit_matches(spark, d):
    return card_audit(spark, d).matches.select("path", "dest", "dest_path")


def audit_matches_legacy(spark, d):
    return card_audit(spark, d, mtime_match=False).matches.select("path", "dest", "dest_path")


def audit_wide_window(spark, d):
    return card_audit(spark, d, window=7200).matches.select("path", "dest", "dest_path")


def audit_missing(spark, d):
    return card_audit(spark, d).missing


def audit_totals(spark, d):
    return card_audit(spark, d).totals


def audit_per_dest(spark, d):
    return card_audit(spark, d).per_dest.select("dest", "matched")


def audit_filtered(spark, d):
    """Size limit on both sides; the pattern on the source and the fresh listings."""
    options = {"min_size": BIG, "exclude": EXCLUDED}
    return card_audit(spark, d, **options).totals


def coverage(spark, d):
    return card_audit(spark, d).coverage


def missing_by_folder(spark, d):
    rolled = missing_folders(card_audit(spark, d).folders)
    return rolled.select("folder", "files", "bytes", F.array_join("sample", ", ").alias("sample"), "more")


def match_locations(spark, d):
    a = card_audit(spark, d)
    found = locations(a.tagged, a.dests)
    text = F.array_join(F.transform("found", lambda x: F.concat(x["dest"], F.lit(":"), x["dest_path"])), "; ")
    return found.select("path", text.alias("found"))


def matched_by_folder(spark, d):
    status = card_audit(spark, d).status
    rolled = by_folder(status.where("matched"), order="bytes")
    return rolled.select("folder", "files", "bytes", F.array_join("sample", ", ").alias("sample"), "more")


def audit_json(spark, d):
    """Matching and the counts per folder are each done once and written; all sections read those."""
    a = card_audit(spark, d)
    tagged = written(a.tagged, "tagged")
    folders = written(folder_counts(tagged, len(a.dests)), "folders")
    dests = per_dest_of_folders(folders, a.dests).select("dest", "kind", "matched")
    return audit_document(totals_of_folders(folders), dests, missing_folders(folders), missing(tagged))


def audit_small_source(spark, d):
    """One folder of the card against whole backups: destination rows without a partner go before they are shuffled."""
    dests = [Destination(n, v.files(spark, d, n)) for n in ("backup_a", "backup_b")]
    return audit(v.files(spark, d, "card").where(C("path").like("shoot_001/%")), dests).matches.select("path", "dest", "dest_path")


def _indexed(spark, d, *labels: str) -> list[DataFrame]:
    """Scans stored by match key: small tables, so few buckets."""
    found = []
    for label in labels:
        uri = f"{new_folder(spark, 'index')}/keys"
        write_bucketed(scan_index(v.files(spark, d, label)), uri, KEY, 8)
        found.append(read_bucketed(spark, uri, INDEX, KEY, 8))
    return found


def audit_stored(spark, d):
    """The card against backups stored by match key: the same matches, without a shuffle of a destination."""
    names = ("backup_a", "backup_b")
    dests = [Destination(n, v.files(spark, d, n), index=index) for n, index in zip(names, _indexed(spark, d, *names), strict=True)]
    return audit(v.files(spark, d, "card"), dests).matches.select("path", "dest", "dest_path")


def audit_hot_key(spark, d):
    """A third of the source has one size, name and time, and stands beside copies at nearly that time."""
    def rows(label: str, folder: str, shift) -> DataFrame:
        hot = C("l_partkey") % 3 == 0
        return v.files(spark, d, label).select(
            F.when(hot, F.concat(F.lit(folder), F.md5("path"), F.lit("/SAME.JPG"))).otherwise(C("path")).alias("path"),
            F.when(hot, 7).otherwise(C("size")).alias("size"),
            F.when(hot, 1_600_000_000 + shift).otherwise(C("mtime")).alias("mtime"),
        )

    card = rows("card", "c/", F.lit(0))
    dests = [
        Destination("backup_a", rows("backup_a", "a/", C("l_partkey") % 11 - 5), "path"),
        Destination("backup_b", rows("backup_b", "b/", C("l_partkey") % 2 + 3), "path"),
    ]
    return audit(card, dests).matches.select("path", "dest", "dest_path")


def audit_spellings(spark, d):
    """Names of a source in decomposed spelling, of the destination composed, as two tables hold them."""
    docs = v.table(spark, d, "documents").select("doc_id", "source", C("n_chars").cast("bigint").alias("size"))
    name = lambda letter: F.concat("source", F.lit(f"/{letter}_"), C("doc_id").cast("string"), F.lit(".txt"))
    entry = [F.lit(None).cast("string").alias("path_raw"), "size", F.lit(5.0).alias("mtime")]
    source = as_manifest(docs.select(name("e\u0301").alias("path"), *entry))
    dest = as_manifest(docs.where("doc_id % 4 != 0").select(name("\u00e9").alias("path"), *entry))
    return audit(source, [Destination("table", dest)]).missing


def audit_odd_files(spark, d):
    """Metadata names, system folders, unknown times, files at the root, and a pattern that spares stored scans."""
    def rows(label: str) -> DataFrame:
        n = C("l_partkey") % 29
        name = F.when(n < len(ODD_NAMES), F.get(F.array(*map(F.lit, ODD_NAMES)), n.cast("int"))).otherwise(
            F.concat(F.lit("f"), C("l_partkey").cast("string"), F.lit("_3.mp4"))
        )
        k = C("l_partkey") % 13
        folder = F.when(k < len(ODD_FOLDERS), F.concat(F.get(F.array(*map(F.lit, ODD_FOLDERS)), k.cast("int")), F.lit("/"))).otherwise(F.lit(""))
        time = F.when(C("l_partkey") % 5 != 0, C("mtime"))
        return unique_files(v.files(spark, d, label).select(F.concat(folder, name).alias("path"), "size", time.alias("mtime")))

    dests = [Destination("backup_a", rows("backup_a"), "path"), Destination("backup_b", rows("backup_b"), "label")]
    found = audit(rows("card").where(~F.col("path").rlike("_3.mp4$") | F.col("mtime").isNull()), dests, exclude=r"f[0-9]*1_3")
    return found.matches.select("path", "dest", "dest_path")


# Evidence


def _pairs(spark, d) -> DataFrame:
    """Matching and the metadata of both sides all read the scans, so those are made once and written, side by side."""
    scans = all_written({n: unique_files(v.files_raw(spark, d, n).drop("l_shipdate"), ["label"]) for n in CARD_SCANS})
    card, *backups = CARD_SCANS
    source = v.exif_of(scans[card]).drop("label")
    dests = v.exif_of(reduce(DataFrame.unionByName, [scans[n] for n in backups])).withColumnRenamed("label", "dest")
    return proof.pair_evidence(card_audit(spark, d, kind="label", scans=scans).matches_with_exif(dests), source)


def pair_evidence(spark, d):
    return _pairs(spark, d).select("path", "dest", "kind")


def evidence(spark, d):
    return proof.evidence(_pairs(spark, d))


def evidence_counts(spark, d):
    return proof.evidence_counts(proof.evidence(_pairs(spark, d)))


def evidence_conflicts(spark, d):
    return proof.conflicts(proof.evidence(_pairs(spark, d)))


# Compare


def _compared(spark, d) -> DataFrame:
    return cmp.compare(v.files(spark, d, "card"), v.files(spark, d, "mirror"), BIG)


def compare_summary(spark, d):
    return cmp.summary(_compared(spark, d))


def compare_differ(spark, d):
    return cmp.differing(_compared(spark, d))


def compare_top_differ(spark, d):
    return cmp.largest_differing(_compared(spark, d))


def compare_only_a(spark, d):
    return cmp.largest_only(_compared(spark, d), "a")


def compare_only_b(spark, d):
    return cmp.largest_only(_compared(spark, d), "b")


# Catalog and history


def latest_scan(spark, d):
    return history.latest_scan(v.scans(spark, d), "drive_07").select("id", "label", "root_path")


def parent_scan(spark, d):
    return history.parent_scans(v.scans(spark, d))


def labels(spark, d):
    return history.labels(v.scans(spark, d))


def scan_status(spark, d):
    return history.scan_status(v.scans(spark, d))


def audit_status(spark, d):
    return history.audit_status(v.audit_runs(spark, d))


def audit_decoded(spark, d):
    """All stored runs with their JSON columns taken apart."""
    runs = history.decoded_runs(v.audit_runs(spark, d))
    return runs.select(
        "id",
        F.try_element_at("dest_specs", F.lit(2))["ident"].alias("second_dest"),
        F.size("per_dest_match").alias("n_counts"),
        F.try_element_at("per_dest_match", F.lit("backup_a")).alias("on_backup_a"),
    )


def audit_readback(spark, d):
    return history.missing_of_run(v.audit_missing(spark, d), 1)


def audit_changes(spark, d):
    return history.audit_changes(v.audit_runs(spark, d), v.audit_missing(spark, d))


# Fingerprints


def _documents(spark, d) -> DataFrame:
    return v.contents(spark, d).select("path", "size")


def _document_candidates(spark, d):
    wanted = hashing.candidates(_documents(spark, d), 1)
    return wanted, hashing.unfinished(wanted, hashing.latest_hashes(v.stored_hashes(spark, d)), "md5")


def hash_candidates(spark, d):
    return hashing.candidates(v.files(spark, d, "mirror").select("path", "size"), 1000)


def hash_candidates_stored(spark, d):
    """Sizes counted from a stored index instead of the files."""
    sizes = index_sizes(_indexed(spark, d, "mirror"))
    return hashing.candidates(filters.drop_metadata(v.files(spark, d, "mirror")).select("path", "size"), 1000, sizes=sizes)


def hash_resume(spark, d):
    """The fingerprint job: candidates, less those done, with their fingerprint."""
    todo = _document_candidates(spark, d)[1]
    read = v.contents(spark, d).select("path", "content").join(todo, "path")
    return read.select("path", "size", fingerprint(C("content")).alias("fingerprint"))


def hash_summary(spark, d):
    wanted, todo = _document_candidates(spark, d)
    return hashing.summary(wanted, todo, sample_size=1000)


def hash_latest(spark, d):
    return hashing.latest_hashes(v.stored_hashes(spark, d)).select("path", "algo", "sample_size", "fingerprint")


def fingerprint_md5(spark, d):
    return v.contents(spark, d).select("path", fingerprint(C("content")).alias("fingerprint"))


def fingerprint_head(spark, d):
    return v.contents(spark, d).select("path", fingerprint(C("content"), HEAD).alias("fingerprint"))


def _fingerprinted(spark, d, sample: int) -> DataFrame:
    return v.contents(spark, d).select(
        "path", "size", fingerprint(C("content"), sample).alias("fingerprint"),
        F.lit("md5").alias("algo"), F.lit(sample).cast("bigint").alias("sample_size"),
    )


_PAIR = ["path_a", "path_b", "size", "folder_a", "folder_b", "confidence"]


def dup_pairs(spark, d):
    both = _fingerprinted(spark, d, 0).unionByName(_fingerprinted(spark, d, HEAD))
    return hashing.duplicate_pairs(both).select(*_PAIR)


def dup_pairs_across(spark, d):
    """Every file of either side whose head the other side holds too; heads, so that groups are large."""
    prints = _fingerprinted(spark, d, 0).unionByName(_fingerprinted(spark, d, 2))
    a = prints.where("path like 'src1%'")
    across = hashing.duplicates_across(a, prints.where("path not like 'src1%'"))
    return across.select("side", "path", "size", "folder", "original", "confidence")


# Copy plan


def copy_roots(spark, d):
    return copying.roots(v.audit_runs(spark, d), v.scans(spark, d), RUN_DEST)


def _plan(spark, d) -> DataFrame:
    return copying.copy_plan(v.audit_runs(spark, d), v.audit_missing(spark, d), v.scans(spark, d), RUN_DEST)


def copy_plan(spark, d):
    return _plan(spark, d)


def copy_plan_totals(spark, d):
    return copying.plan_totals(_plan(spark, d))


def copy_outcome(spark, d):
    """What the card audit found missing, against the mirror as the destination after copying; some of its paths are listed twice."""
    runs = F.when(C("size") % 2 == 0, 1).otherwise(2).cast("bigint").alias("run_id")
    plan = card_audit(spark, d).missing.select(runs, "path", "size")
    sizes = F.explode(F.when(C("l_partkey") % 4 == 0, F.array(C("size"), C("size") + 1)).otherwise(F.array("size")))
    mirror = v.files(spark, d, "mirror").select("path", C("size").alias("listed"), sizes.alias("size"))
    both = mirror.select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).alias("run_id"), "path", "listed", "size")
    return copying.copy_outcome(plan, both.where("run_id = 1 or listed % 3 = 0").drop("listed"))


def copy_json(spark, d):
    plan = _plan(spark, d)
    return plan_document(plan.select("run_id", "path", "size"), copying.plan_totals(plan))


QUERIES = {
    "lsl_parse": lsl_parse,
    "files_dedup": files_dedup,
    "nfc_paths": nfc_paths,
    "metadata_filter": metadata_filter,
    "system_dirs": system_dirs,
    "min_size": min_size,
    "exclude_regex": exclude_regex,
    "exclude_python": exclude_python,
    "self_exclusion": self_exclusion,
    "match_keys": match_keys_query,
    "parse_size": parse_size,
    "human_size": human_size,
    "jpeg_filter": jpeg_filter,
    "label_clean": label_clean,
    "exif_clean": exif_clean,
    "audit_matches": audit_matches,
    "audit_matches_legacy": audit_matches_legacy,
    "audit_wide_window": audit_wide_window,
    "audit_missing": audit_missing,
    "audit_totals": audit_totals,
    "audit_per_dest": audit_per_dest,
    "audit_filtered": audit_filtered,
    "coverage": coverage,
    "audit_small_source": audit_small_source,
    "audit_stored": audit_stored,
    "audit_hot_key": audit_hot_key,
    "audit_spellings": audit_spellings,
    "audit_odd_files": audit_odd_files,
    "missing_by_folder": missing_by_folder,
    "matched_by_folder": matched_by_folder,
    "match_locations": match_locations,
    "audit_json": audit_json,
    "pair_evidence": pair_evidence,
    "evidence": evidence,
    "evidence_counts": evidence_counts,
    "evidence_conflicts": evidence_conflicts,
    "compare_summary": compare_summary,
    "compare_differ": compare_differ,
    "compare_top_differ": compare_top_differ,
    "compare_only_a": compare_only_a,
    "compare_only_b": compare_only_b,
    "latest_scan": latest_scan,
    "parent_scan": parent_scan,
    "labels": labels,
    "scan_status": scan_status,
    "audit_status": audit_status,
    "audit_decoded": audit_decoded,
    "audit_readback": audit_readback,
    "audit_diff": audit_changes,
    "hash_candidates": hash_candidates,
    "hash_candidates_stored": hash_candidates_stored,
    "hash_resume": hash_resume,
    "hash_summary": hash_summary,
    "hash_latest": hash_latest,
    "fingerprint_md5": fingerprint_md5,
    "fingerprint_head": fingerprint_head,
    "dup_pairs": dup_pairs,
    "dup_pairs_across": dup_pairs_across,
    "copy_roots": copy_roots,
    "copy_plan": copy_plan,
    "copy_plan_totals": copy_plan_totals,
    "copy_outcome": copy_outcome,
    "copy_json": copy_json,
}
