"""Manifest filters."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import java_pattern

# File names written by operating systems, never user content.
METADATA_NAMES = (
    ".DS_Store",
    ".localized",
    ".VolumeIcon.icns",
    ".VolumeIcon.ico",
    "Autorun.inf",
    "desktop.ini",
    "Thumbs.db",
)
METADATA_PREFIX = "._"

# Directories whose whole content is skipped.
SYSTEM_DIRS = (
    ".Spotlight-V100",
    ".fseventsd",
    ".Trashes",
    ".TemporaryItems",
    "System Volume Information",
    "$RECYCLE.BIN",
)


def _any_of(names: tuple) -> str:
    return "|".join(re.escape(name) for name in names)


# A metadata file name at the end, or a system directory at any level. One pattern reads the
# path once, also where the path is itself computed.
METADATA_PATH = (
    rf"(?s)(?:^|/)(?:(?:{_any_of(SYSTEM_DIRS)})(?:/.*)?|{_any_of(METADATA_NAMES)}|{re.escape(METADATA_PREFIX)}[^/]*)\z"
)


def drop_metadata(files: DataFrame, column: str = "path") -> DataFrame:
    return files.where(~F.col(column).rlike(METADATA_PATH))


def at_least(files: DataFrame, min_size: int) -> DataFrame:
    return files.where(F.col("size") >= min_size) if min_size else files


def checked_pattern(spark: SparkSession, pattern: str) -> str:
    """A Python pattern as the executors' expression; what they can't compile is refused before any job runs."""
    written = java_pattern(pattern)
    try:
        spark.sql("select '' rlike :p", args={"p": written}).collect()
    except PySparkException as e:
        raise ValueError(f"{pattern!r} can't be used on executors") from e
    return written


def exclude_matching(files: DataFrame, pattern: str | None) -> DataFrame:
    """Drop files in whose path the regular expression, as Python reads it, finds anything."""
    if not pattern:
        return files
    return files.where(~F.col("path").rlike(checked_pattern(files.sparkSession, pattern)))


def outside_root(files: DataFrame, abs_path: Column, root: str | None) -> DataFrame:
    """Drop rows at or below ``root``, given each row's resolved absolute path."""
    if not root:
        return files
    prefix = root.rstrip("/")
    return files.where((abs_path != prefix) & ~abs_path.startswith(prefix + "/"))
