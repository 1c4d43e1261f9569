"""Clean-up of capture metadata text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"


def clean_text(text: Column) -> Column:
    """Strip blanks and NULs from both ends; nothing left means NULL."""
    return F.nullif(F.regexp_replace(text, r"^[\s\x00]+|[\s\x00]+$", ""), F.lit(""))


def taken_at(text: Column) -> Column:
    """'2019:11:03 08:05:59' in the session time zone -> epoch seconds, else NULL."""
    return F.unix_timestamp(F.try_to_timestamp(F.btrim(text, F.lit(BLANKS)), F.lit("y:M:d H:m:s")))
