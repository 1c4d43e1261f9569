"""Fingerprints of files on a mounted tree, read in chunks on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprints import check_algorithm
from ..functions.paths import absolute_path
from ..operators.deal import deal_by_work
from .listing import SKIPPED, require_root, unescaped

CHUNK = 8 << 20
FILES_PER_BATCH = 64


#: What opening a file counts as, in bytes read.
OPENING = 64 << 10


def hash_files(
    files: DataFrame, root: str, algo: str = "xxh64", sample_size: int = 0
) -> DataFrame:
    """(path, size, fingerprint); files that are gone, or may not be read, are left out. Any other failure fails the job.

    Unlike ``binaryFile`` this has no 2 GB limit and reads no more than ``sample_size`` bytes. Files are dealt to tasks by
    the bytes to read, twice as many tasks as the session's shuffles have; ``files`` is read more than once for that.
    """
    check_algorithm(algo)
    raw = F.col("path_raw") if "path_raw" in files.columns else F.col("path")
    located = files.select("path", "size", absolute_path(F.lit(root), F.col("path"), raw).alias("at"))

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        import xxhash

        def digest(at: str) -> str | None:
            state = xxhash.xxh64() if algo == "xxh64" else hashlib.md5()
            left = sample_size or None
            try:
                with open(unescaped(at), "rb") as f:
                    while chunk := f.read(CHUNK if left is None else min(CHUNK, left)):
                        state.update(chunk)
                        left = left and left - len(chunk)
                        if left == 0:
                            break
            except SKIPPED:
                return None
            return state.hexdigest()

        require_root(root)
        for rows in batches:
            for start in range(0, len(rows), FILES_PER_BATCH):
                part = rows.iloc[start : start + FILES_PER_BATCH]
                yield part[["path", "size"]].assign(fingerprint=part["at"].map(digest)).dropna()

    schema = "path string, size bigint, fingerprint string"
    to_read = F.least("size", F.lit(sample_size)) if sample_size else F.col("size")
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return deal_by_work(located, ["path"], to_read + OPENING, parts).mapInPandas(digests, schema)
