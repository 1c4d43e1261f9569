"""One entry point for every form a manifest comes in.

An object store is read through an ``lsl`` listing of it. Spark's ``binaryFile`` source is no
substitute: it leaves out hidden names and empty files, which an audit must not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import FILE_ENTRY
from .listing import read_listing
from .lsl import as_manifest, parse_lsl

#: Formats and the options each takes; those of a file are Spark's reader's.
OPTIONS = {
    "listing": {"skip_root", "links"},
    "lsl": {"encoding", "wholetext", "lineSep", "recursiveFileLookup", "pathGlobFilter"},
    "parquet": {"mergeSchema", "recursiveFileLookup", "pathGlobFilter"},
    "csv": {"sep", "delimiter", "header", "quote", "escape", "encoding", "multiLine", "nullValue", "recursiveFileLookup", "pathGlobFilter"},
    "json": {"multiLine", "encoding", "lineSep", "recursiveFileLookup", "pathGlobFilter"},
}
FORMATS = tuple(OPTIONS)


def read_manifest(spark: SparkSession, path: str, format: str = "listing", **options) -> DataFrame:
    """File entries from a tree, a text listing or a table. Paths of every form come out in NFC."""
    if format not in OPTIONS:
        raise ValueError(f"unknown manifest format {format!r}; one of {FORMATS}")
    if unknown := set(options) - OPTIONS[format]:
        raise ValueError(f"{format} takes no option {sorted(unknown)}; it takes {sorted(OPTIONS[format])}")
    if format == "listing":
        return read_listing(spark, path, **options)
    reader = spark.read.options(**options)
    if format == "lsl":
        return parse_lsl(reader.text(path))
    if format == "parquet":
        return as_manifest(reader.parquet(path))
    if format == "csv":
        return as_manifest(reader.schema(FILE_ENTRY).csv(path, header=options.get("header", True)))
    return as_manifest(reader.schema(FILE_ENTRY).json(path))
