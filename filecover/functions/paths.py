"""Column functions on paths, labels and modification times."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of files that can carry capture metadata.
JPEG_SUFFIXES = ("jpg", "jpeg", "jpe")

ROOT_FOLDER = "(root)"

#: Bytes of names that are Python strings at once.
SLICE = 1 << 20


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def base_name_lower(path: Column) -> Column:
    return F.lower(base_name(path))


def whole_seconds(mtime: Column) -> Column:
    """Seconds truncated toward zero; an unknown time counts as 0."""
    return F.coalesce(mtime.cast("bigint"), F.lit(0).cast("bigint"))


def parent_folder(path: Column, root: str = ROOT_FOLDER) -> Column:
    head = F.substr(path, F.lit(1), F.length(path) - F.length(base_name(path)) - 1)
    return F.coalesce(F.nullif(F.rtrim(head, F.lit("/")), F.lit("")), F.lit(root))


def absolute_path(root: Column, path: Column, path_raw: Column | None = None) -> Column:
    """Path for file access: the name as the file system spells it, below ``root``."""
    relative = path if path_raw is None else F.coalesce(path_raw, path)
    return F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), relative)


def wants_exif(path: Column) -> Column:
    return path.rlike(r"(?i)[^/.][^/]*\.(" + "|".join(JPEG_SUFFIXES) + r")\z")


def clean_label(label: Column) -> Column:
    """Drop characters that do not print, line and paragraph separators included."""
    return F.regexp_replace(label, r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]", "")


def clean_label_text(label: str) -> str:
    return "".join(filter(str.isprintable, label))


def default_label(root: str) -> str:
    return re.sub(r"^.*/", "", root.rstrip("/")) or root


def nfc(path: Column) -> Column:
    """Unicode NFC. Only names with non-ASCII characters travel to Python; ASCII is already NFC."""

    @F.arrow_udf("string")
    def normalise(names: pa.Array) -> pa.Array:
        import unicodedata

        def composed(part: pa.Array) -> pa.Array:
            return pa.array([s if s is None else unicodedata.normalize("NFC", s) for s in part.to_pylist()], names.type)

        # Python strings take several times the bytes of a batch, so there are never many.
        step = max(1, len(names) * SLICE // max(1, names.nbytes))
        return pa.concat_arrays([composed(names.slice(at, step)) for at in range(0, len(names), step)] or [names])

    non_ascii = F.octet_length(path) > F.length(path)
    return F.coalesce(normalise(F.when(non_ascii, path)), path)
