"""Fixed table schemas."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, nullable) for name, kind, nullable in fields])


FILE_ENTRY = _struct(
    ("path", StringType(), False),
    ("path_raw", StringType(), True),
    ("size", LongType(), False),
    ("mtime", DoubleType(), True),
)

SCANS = _struct(
    ("id", LongType(), False),
    ("label", StringType(), False),
    ("root_path", StringType(), False),
    ("drive_type", StringType(), True),
    ("started_at", TimestampType(), False),
    ("finished_at", TimestampType(), True),
    ("file_count", LongType(), True),
    ("scan_mode", StringType(), False),
    ("parent_scan_id", LongType(), True),
)

HASHES = _struct(
    ("scan_id", LongType(), False),
    ("path", StringType(), False),
    ("size", LongType(), True),
    ("algo", StringType(), False),
    ("fingerprint", StringType(), False),
    ("sample_size", LongType(), False),
    ("hashed_at", TimestampType(), False),
)

EXIF = _struct(
    ("scan_id", LongType(), False),
    ("path", StringType(), False),
    ("taken_at", LongType(), True),
    ("camera_make", StringType(), True),
    ("camera_model", StringType(), True),
    ("extracted_at", TimestampType(), False),
)

#: A scan by match key, as columns of a table.
INDEX = (
    "size bigint, bn string, stretch bigint, n bigint, files array<struct<mt: bigint, path: string, "
    "dest_key: struct<taken_at: bigint, camera_make: string, camera_model: string>>>"
)

DEST_SPECS = ArrayType(_struct(("ident", StringType(), True), ("kind", StringType(), True)))
PER_DEST = MapType(StringType(), LongType())

AUDIT_RUNS = _struct(
    ("id", LongType(), False),
    ("source_ident", StringType(), False),
    ("source_kind", StringType(), False),
    ("source_scan_id", LongType(), True),
    ("dest_specs", StringType(), False),
    ("min_size", LongType(), False),
    ("early_stop", BooleanType(), False),
    ("total_files", LongType(), False),
    ("total_bytes", LongType(), False),
    ("matched_count", LongType(), False),
    ("missing_count", LongType(), False),
    ("missing_bytes", LongType(), False),
    ("per_dest_match", StringType(), True),
    ("ran_at", TimestampType(), False),
)

AUDIT_MISSING = _struct(
    ("run_id", LongType(), False),
    ("source_path", StringType(), False),
    ("size", LongType(), False),
)
