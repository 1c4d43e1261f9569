"""Tables that are replaced as a whole: each generation is a folder with all rows, and the newest complete one is the table.

A generation is complete when its job has left its mark of success, which comes last, so a writer that fails leaves the table as
it was. The one before stays for readers that have already planned; older ones are deleted.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..scratch import drop, file_system

_NAME = re.compile(r"gen-(\d{8})$")


def _numbers(spark: SparkSession, uri: str, complete: bool) -> list[int]:
    system, path = file_system(spark, uri)
    if not system.exists(path):
        return []
    found = []
    for status in system.listStatus(path):
        name = _NAME.search(status.getPath().getName())
        if name and (not complete or system.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))):
            found.append(int(name[1]))
    return sorted(found)


def _folder(uri: str, number: int) -> str:
    return f"{uri}/gen-{number:08d}"


def current(spark: SparkSession, uri: str) -> str | None:
    """The folder of the newest complete generation."""
    found = _numbers(spark, uri, complete=True)
    return _folder(uri, found[-1]) if found else None


def files_in(spark: SparkSession, folder: str) -> int:
    system, path = file_system(spark, folder)
    return sum(status.getPath().getName().endswith(".parquet") for status in system.listStatus(path))


def replace(spark: SparkSession, uri: str, rows: DataFrame) -> None:
    """Make ``rows``, which may be read from the current generation, the next one."""
    known, complete = _numbers(spark, uri, complete=False), _numbers(spark, uri, complete=True)
    rows.write.parquet(_folder(uri, max(known, default=0) + 1))
    for number in known:
        if number != max(complete, default=-1):
            drop(spark, _folder(uri, number))
