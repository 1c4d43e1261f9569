"""Content fingerprints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALGORITHMS = ("xxh64", "md5")


def check_algorithm(algo: str) -> None:
    if algo not in ALGORITHMS:
        raise ValueError(f"unknown algorithm: {algo}")


def fingerprint(content: Column, sample_size: int = 0) -> Column:
    """MD5 of the whole content, or of its first ``sample_size`` bytes, as hex.

    A column has md5 only: Spark's xxhash64 has a fixed seed, so its values cannot be compared with
    fingerprints made elsewhere. The job over files (``sources.file_hash``) knows both.
    """
    return F.md5(F.substring(content, 1, sample_size) if sample_size else content)
