"""Byte sizes as text, both ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Binary units, smallest first.
PARSE_UNITS = "KMGT"
SHOW_UNITS = ("KB", "MB", "GB", "TB", "PB", "EB")

BLANK = " \t\r\n"


def parse_size(text: Column) -> Column:
    """'1.5G' -> bytes; NULL where the text is not a size.

    Trimmed, without the B at its end; the last letter is the unit, and the rest a plain decimal number.
    """
    bare = F.upper(F.btrim(text, F.lit(BLANK)))
    bare = F.when(F.endswith(bare, F.lit("B")), F.left(bare, F.length(bare) - 1)).otherwise(bare)
    power = F.instr(F.lit(PARSE_UNITS), F.right(bare, F.lit(1))) * (F.length(bare) > 0).cast("int")
    number = F.when(power > 0, F.rtrim(F.left(bare, F.length(bare) - 1), F.lit(BLANK))).otherwise(F.rtrim(bare, F.lit(BLANK)))
    digits = F.translate(number, "0123456789", "")
    plain = (digits == "") & (number != "") | (digits == ".") & ~F.startswith(number, F.lit(".")) & ~F.endswith(number, F.lit("."))
    value = F.when(plain, number).try_cast("double")
    return (value * F.pow(F.lit(1024.0), power)).try_cast("bigint")


def parse_size_text(text: str | int) -> int:
    """Driver-side form, for arguments."""
    if isinstance(text, int):
        return text
    bare = text.strip(BLANK).upper().removesuffix("B")
    power = PARSE_UNITS.find(bare[-1:]) + 1 if bare else 0
    number = (bare[:-1] if power else bare).rstrip(BLANK)
    whole, dot, part = number.partition(".")
    if not (whole.isascii() and whole.isdigit()) or (dot and not (part.isascii() and part.isdigit())):
        raise ValueError(f"not a size: {text!r}")
    return int(float(number) * 1024**power)


def human_size(size: Column) -> Column:
    """Bytes with a unit; one decimal, ties to even."""

    def shown(power: int) -> Column:
        scaled = size.cast("double") / float(1024**power)
        return F.format_string("%.1f " + SHOW_UNITS[power - 1], F.bround(scaled, 1))

    text = F.when(size < 1024, F.format_string("%d B", size))
    for power in range(1, len(SHOW_UNITS)):
        text = text.when(size.cast("double") / float(1024**power) < 1024, shown(power))
    return text.otherwise(shown(len(SHOW_UNITS)))
