"""Percentages."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.lit(100.0) * part / whole).otherwise(F.lit(0.0))
