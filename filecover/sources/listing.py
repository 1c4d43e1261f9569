"""Directory tree as rows: one per regular file, dotfiles included.

The tree has to be mounted at the same place on every executor. It is listed level by level: each round a
job reads the directories of one level, dealt out to all tasks, and writes the entries; the next round
reads the directories found. So no branch, however deep or heavy, is one task's work, and a
task holds one batch of entries of a directory, however large that is.

A name that isn't UTF-8 keeps its row: each of its other bytes becomes a zero character and two hexadecimal digits, which no
name on disk can hold, and `unescaped` gives the path to open.

A directory or file that is gone by then or may not be read is left out. Every other failure, such as a missing
mount on a worker, fails the listing: a listing with gaps would let an audit report files as lost or covered.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import METADATA_NAMES, METADATA_PREFIX, SYSTEM_DIRS, drop_metadata
from ..scratch import new_folder
from .lsl import normalised

BATCH = 8192
#: What may happen to an entry while a tree is in use.
SKIPPED = (PermissionError, FileNotFoundError, NotADirectoryError)
ENTRY = "is_dir boolean, raw string, size bigint, mtime double"


def escaped(name: str) -> str:
    """A name as the system gives it, as text that any table can hold."""
    return re.sub("[\udc80-\udcff]", lambda m: f"\0{ord(m[0]) - 0xDC00:02x}", name)


def unescaped(path: str) -> str:
    """The path to open for a path of a listing."""
    return re.sub("\0([0-9a-f]{2})", lambda m: chr(0xDC00 + int(m[1], 16)), path)


def require_root(root: str) -> None:
    """Called in tasks: a worker without the mount must not pass for an empty tree."""
    if not os.path.isdir(root):
        raise NotADirectoryError(f"not a directory on this machine: {root}")


def entries_below(root: str, relative: str, links: bool, skip: tuple | None) -> Iterator[tuple]:
    """(is_dir, path below root, size, mtime) of one directory; ``skip``: real path and identity of one never to enter."""
    directory = os.path.join(root, unescaped(relative)) if relative else root
    if skip is not None and _is_skipped(directory, skip):
        return
    front = relative + "/" if relative else ""
    try:
        found = os.scandir(directory)
    except SKIPPED:
        if not relative:
            raise
        return
    with found:
        for entry in found:
            try:
                path = front + escaped(entry.name)
                if entry.is_dir(follow_symlinks=False):
                    if entry.name not in SYSTEM_DIRS:
                        yield True, path, None, None
                elif entry.is_file(follow_symlinks=links) and not _is_metadata(entry.name):
                    stat = entry.stat()
                    yield False, path, stat.st_size, stat.st_mtime
            except SKIPPED:
                continue


def _is_skipped(directory: str, skip: tuple) -> bool:
    real, identity = skip
    return (directory + "/").startswith(real.rstrip("/") + "/") or (identity is not None and _identity(directory) == identity)


def _identity(path: str) -> tuple | None:
    try:
        stat = os.stat(path)
    except SKIPPED:
        return None
    return stat.st_dev, stat.st_ino


def _is_metadata(name: str) -> bool:
    return name in METADATA_NAMES or name.startswith(METADATA_PREFIX)


def list_level(batches, root: str, links: bool, skip_root: str | None):
    """Arrow batches of directories (raw) to batches of their entries."""
    import pyarrow as pa

    skip = None if skip_root is None else (os.path.realpath(skip_root), _identity(skip_root))
    names = ["is_dir", "raw", "size", "mtime"]
    types = [pa.bool_(), pa.string(), pa.int64(), pa.float64()]
    rows: list = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    require_root(root)
    for directories in batches:
        for relative in directories.column("raw").to_pylist():
            for row in entries_below(root, relative, links, skip):
                rows.append(row)
                if len(rows) == BATCH:
                    yield batch()
                    rows.clear()
    if rows:
        yield batch()


def read_listing(spark: SparkSession, root: str, skip_root: str | None = None, links: bool | str = True) -> DataFrame:
    """File entries of the tree below ``root``, paths relative to it. The tree is read now, once.

    ``skip_root``: a directory never to enter, also not through a bind mount. ``links``: whether linked
    files count; linked directories are never entered. A listing that fails half way raises what it failed with;
    ``entries`` of that exception holds the files of all levels read before. What is read lies in a folder that
    goes with the session.
    """
    root = os.path.realpath(root)
    if not os.path.isdir(root):
        raise ValueError(f"not a directory: {root}")
    follow = str(links).lower() == "true"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder, levels = new_folder(spark, "listing"), []
    below = spark.createDataFrame([("",)], "raw string")

    def entries(batches):
        return list_level(batches, root, follow, skip_root)

    def found() -> DataFrame:
        files = reduce(DataFrame.unionByName, [level.where("not is_dir").drop("is_dir") for level in levels])
        return normalised(drop_metadata(files, "raw"))

    while True:
        path = f"{folder}/{len(levels)}"
        # Dealt out by hash, so the many directories below one are not one task's work.
        try:
            below.repartition(parts, F.xxhash64("raw")).mapInArrow(entries, ENTRY).write.parquet(path)
        except BaseException as e:
            e.entries = found() if levels else None
            raise
        levels.append(spark.read.schema(ENTRY).parquet(path))
        below = levels[-1].where("is_dir").select("raw")
        if below.isEmpty():
            return found()
