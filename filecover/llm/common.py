"""What several operators share: Arrow slices, words, hashes, and the folder all executors see."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that is worked on at once, in bytes. A longer single text is worked on alone.
SLICE_BYTES = 4 << 20
#: ASCII white space: what separates words, in a pattern's brackets.
SPACE = r"\x20\x09-\x0D"
MIX = np.uint64(0x9E3779B97F4A7C15)
FOLD = np.uint64(0xC2B2AE3D27D4EB4F)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors and the driver see.

    Where that setting is missing, a local session (driver and executors are one process)
    gets a temporary folder, and a cluster one below its warehouse.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        root = _local_root() if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="filecover-")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts the lineage."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str | None:
    """The path the operating system knows, or None for a store it doesn't."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def write_file(uri: str, chunks: list) -> None:
    """Write a file of the shared folder; it is complete or absent under its name."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temporary = f"{path}.{uuid.uuid4().hex}"
        with open(temporary, "wb") as out:
            for chunk in chunks:
                out.write(chunk)
        os.replace(temporary, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as out:
        for chunk in chunks:
            out.write(chunk)


def read_file(uri: str):
    """The bytes of a file of the shared folder: mapped where the system can map it."""
    path = local_path(uri)
    if path is not None:
        return np.memmap(path, dtype=np.uint8, mode="r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as src:
        return np.frombuffer(src.read(), np.uint8)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string): other columns, whatever their names, are not read."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts are about `size` bytes together."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < n:
            base = at[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(at, base + size, side="right")))
            yield batch.slice(start, end - start)
            start = end
    hand_back()


def hand_back() -> None:
    """Return memory that is no longer used to the system: workers live on, and others share the executor's memory."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def large(text: pa.Array) -> pa.Array:
    """Texts as large strings (64-bit offsets), null as empty.

    Copied, so that the first text starts at offset 0: some kernels return wrong offsets for slices.
    """
    return pc.fill_null(text, "").cast(pa.large_string()).take(pa.array(np.arange(len(text))))


def id_bounds(docs: DataFrame, parts: int) -> np.ndarray:
    """Ids that cut the documents into at most `parts` ranges of about the same number, from the id column alone.

    Range r holds the ids above bound r - 1, up to and with bound r; unknown ids are in range 0.
    A sort by range would read, and so encode or parse, everything twice to find its bounds.
    """
    shares = [i / parts for i in range(1, parts)]
    if not shares:
        return np.zeros(0, np.int64)
    row = docs.agg(F.percentile_approx("doc_id", shares, 20 * parts).alias("at")).first()
    return np.unique(np.array(row["at"] or [], np.int64))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Words:
    """Words of a slice: `ids` into `vocab`, in order of text; `doc` is the row of each; `n` words per row."""

    def __init__(self, text: pa.Array):
        parts = pc.ascii_split_whitespace(large(text))
        flat = parts.flatten()
        per = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.repeat(np.arange(len(per)), per)
        real = pc.not_equal(pc.binary_length(flat), 0)
        self.doc = rows[real.to_numpy(zero_copy_only=False)]
        coded = flat.filter(real).dictionary_encode()
        self.vocab = coded.dictionary
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.n = np.bincount(self.doc, minlength=len(per)).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.n)])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word of the vocabulary."""
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(w) for w in self.vocab.to_pylist()), np.uint64, len(self.vocab))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= FOLD
    x ^= x >> np.uint64(29)
    x *= MIX
    x ^= x >> np.uint64(32)
    return x


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hash of its front and of its last word."""
    return mixed(left * MIX + right)


def per_worker(make, *args):
    """make(*args), made once per worker process and kept.

    Kept outside this package, whose code travels with each task and so is new in each.
    """
    held = sys.__dict__.setdefault("_filecover_held", {})
    key = (make.__module__, make.__qualname__, *args)
    if key not in held:
        if len(held) > 8192:  # files of models and tables that are no longer in use
            held.clear()
        held[key] = make(*args)
    return held[key]


def crc_rest(column: str, divisor: int):
    """crc32 of an id as text, modulo a divisor; an unknown id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor
