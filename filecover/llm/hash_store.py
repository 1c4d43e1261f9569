"""A table by 64-bit key as sorted arrays in the shared folder, mapped by workers.

For filters and verdicts that every scan of the texts has to look up: rows are dealt to partitions by
key, each partition becomes one file, and a worker looks up the sorted keys of a few megabytes of text
file by file. Nothing of it passes through the driver but the names of the files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, per_worker, read_file, shared_folder, shuffle_parts, write_file


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(keys.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _bits(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows with `key`, each in the partition that holds its key."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.array(part_of(_bits(batch.column("key")), parts).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part, *batch.columns], names=["part", *batch.schema.names])

    schema = ", ".join(["part int", *(f"{n} {t}" for n, t in rows.dtypes)])
    return rows.mapInArrow(place, schema).repartitionById(parts, F.col("part")).drop("part")


class _Part:
    def __init__(self, uri: str):
        data = read_file(uri)
        n, columns, blob = map(int, np.frombuffer(bytes(data[:24]), "<i8"))
        at = 24
        self.keys = np.frombuffer(data, "<u8", n, at)
        self.values = [np.frombuffer(data, "<i8", n, at + 8 * n * (k + 1)) for k in range(columns)]
        at += 8 * n * (columns + 1)
        self.ends = np.frombuffer(data, "<i8", n + 1, at) if blob else None
        self.blob = data[at + 8 * (n + 1) :] if blob else None


def _part(uri: str) -> _Part:
    return per_worker(_Part, uri)


@dataclass(frozen=True)
class HashStore:
    """A written table: key, `columns` long values and perhaps a binary one."""

    parts: int
    columns: int
    files: tuple  # (partition, uri)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """For each key: is it there; its long values (a row each); its binary value (or None)."""
        uris = dict(self.files)
        distinct, back = np.unique(keys.astype(np.uint64), return_inverse=True)
        there = np.zeros(len(distinct), bool)
        values = np.zeros((len(distinct), self.columns), np.int64)
        blobs: list = [None] * len(distinct)
        part = part_of(distinct, self.parts)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(self.parts + 1))
        for p, uri in uris.items():
            rows = order[cuts[p] : cuts[p + 1]]
            if not len(rows):
                continue
            arrays = _part(uri)
            at = np.minimum(np.searchsorted(arrays.keys, distinct[rows]), len(arrays.keys) - 1)
            hit = arrays.keys[at] == distinct[rows]
            there[rows] = hit
            for k, column in enumerate(arrays.values):
                values[rows, k] = np.where(hit, column[at], 0)
            if arrays.blob is not None:
                for r, a in zip(rows[hit].tolist(), at[hit].tolist(), strict=True):
                    blobs[r] = bytes(arrays.blob[arrays.ends[a] : arrays.ends[a + 1]])
        return there[back], values[back], [blobs[i] for i in back] if len(blobs) else []


def write_store(rows: DataFrame, purpose: str) -> HashStore:
    """Write rows of distinct `key` long, long columns, and at most one binary column, the last. Returns the table to look up."""
    spark = rows.sparkSession
    parts, folder = shuffle_parts(spark), shared_folder(spark, purpose)
    blob = rows.dtypes[-1][1] == "binary"
    columns = len(rows.dtypes) - 1 - blob

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        keys = np.concatenate([_bits(c) for c in table.column("key").chunks])
        order = np.argsort(keys)
        chunks = [np.array([len(keys), columns, blob], "<i8").tobytes(), keys[order].tobytes()]
        for k in range(columns):
            chunks.append(table.column(k + 1).to_numpy().astype("<i8")[order].tobytes())
        if blob:
            data = table.column(table.num_columns - 1).combine_chunks().take(pa.array(order))
            sizes = pc.binary_length(data).to_numpy(zero_copy_only=False).astype("<i8")
            chunks += [np.concatenate([[0], np.cumsum(sizes)]).astype("<i8").tobytes(), *data.to_pylist()]
        part = TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        write_file(uri, chunks)
        yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri]})

    done = dealt(rows, parts).mapInArrow(write, "part long, uri string").collect()  # a row per partition
    return HashStore(parts, columns, tuple((r.part, r.uri) for r in done))
