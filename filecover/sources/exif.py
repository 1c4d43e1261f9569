"""Capture metadata of JPEG files on a mounted tree."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.capture import clean_text, taken_at
from ..functions.paths import absolute_path, wants_exif
from .listing import SKIPPED, require_root, unescaped

# Fixed values of the Exif and TIFF formats.
MAKE, MODEL, EXIF_POINTER, DATE_TIME_ORIGINAL = 0x010F, 0x0110, 0x8769, 0x9003
ASCII, LONG = 2, 4
START, APP1, SCAN, END = 0xD8, 0xE1, 0xDA, 0xD9
BARE_MARKERS = (0x01, *range(0xD0, 0xD8))


def exif_block(f) -> bytes | None:
    """The TIFF part of a JPEG's APP1 segment; only segment heads before it are read."""
    if f.read(2) != bytes((0xFF, START)):
        return None
    while True:
        byte = f.read(1)
        if byte != b"\xff":
            return None
        while byte == b"\xff":
            byte = f.read(1)
        if not byte or byte[0] in (SCAN, END):
            return None
        if byte[0] in BARE_MARKERS:
            continue
        length = f.read(2)
        if len(length) < 2:
            return None
        body = int.from_bytes(length, "big") - 2
        if body < 0:
            return None
        if byte[0] != APP1:
            f.seek(body, 1)
            continue
        segment = f.read(body)
        if segment[:6] == b"Exif\0\0":
            return segment[6:]


def _directory(tiff: bytes, order: str, offset: int) -> dict:
    """Tag -> value of one image file directory; only text and offsets are of interest."""
    found = {}
    (count,) = struct.unpack_from(order + "H", tiff, offset)
    for i in range(count):
        at = offset + 2 + 12 * i
        tag, kind, n = struct.unpack_from(order + "HHI", tiff, at)
        if kind == LONG:
            (found[tag],) = struct.unpack_from(order + "I", tiff, at + 8)
        elif kind == ASCII:
            start = at + 8 if n <= 4 else struct.unpack_from(order + "I", tiff, at + 8)[0]
            found[tag] = tiff[start : start + n].decode("ascii", "replace")
    return found


def exif_texts(f) -> tuple:
    """(date, make, model) as stored, each None when absent. Never raises on bad content."""
    nothing = (None, None, None)
    try:
        tiff = exif_block(f)
        if not tiff or tiff[:2] not in (b"II", b"MM"):
            return nothing
        order = "<" if tiff[:2] == b"II" else ">"
        main = _directory(tiff, order, struct.unpack_from(order + "I", tiff, 4)[0])
    except (struct.error, OSError):
        return nothing
    date = None
    try:
        if isinstance(main.get(EXIF_POINTER), int):
            date = _directory(tiff, order, main[EXIF_POINTER]).get(DATE_TIME_ORIGINAL)
    except struct.error:
        pass
    texts = (date, main.get(MAKE), main.get(MODEL))
    return tuple(t if isinstance(t, str) else None for t in texts)


def clean_exif(texts: DataFrame) -> DataFrame:
    """(path, date_text, make_text, model_text) -> EXIF rows; no row where nothing is left."""
    # A stored text ends with a NUL.
    date = F.regexp_replace("date_text", r"\x00+$", "")
    cleaned = texts.select(
        "path",
        taken_at(date).alias("taken_at"),
        clean_text(F.col("make_text")).alias("camera_make"),
        clean_text(F.col("model_text")).alias("camera_model"),
    )
    return cleaned.dropna("all", subset=["taken_at", "camera_make", "camera_model"])


def read_exif(files: DataFrame, root: str) -> DataFrame:
    """(path, taken_at, camera_make, camera_model) of the JPEG files of a manifest.

    A file that is gone, or that may not be read, has none; any other failure fails the job.
    """
    raw = F.col("path_raw") if "path_raw" in files.columns else F.col("path")
    pictures = files.where(wants_exif(F.col("path"))).select(
        "path", absolute_path(F.lit(root), F.col("path"), raw).alias("at")
    )

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def read(at: str) -> tuple:
            try:
                with open(unescaped(at), "rb") as f:
                    return exif_texts(f)
            except SKIPPED:
                return None, None, None

        require_root(root)
        for rows in batches:
            read_rows = [read(at) for at in rows["at"]]
            yield pd.DataFrame(read_rows, columns=["date_text", "make_text", "model_text"]).assign(
                path=rows["path"].to_numpy()
            )

    schema = "date_text string, make_text string, model_text string, path string"
    # Of each file only the head is read, so all are as much work.
    dealt = pictures.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("path"))
    return clean_exif(dealt.mapInPandas(texts, schema))
