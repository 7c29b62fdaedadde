"""Column helpers for keys, blank texts and versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as surrounding space of a key.
SPACES = " \t\n\r\x0b\x0c\u00a0\u200b\ufeff"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACES))


def norm_key(col: Column) -> Column:
    """Key under which two spellings are the same: no surrounding space, lower case."""
    return F.lower(strip(col))


def is_blank(col: Column) -> Column:
    """True for null and for texts without a letter or digit."""
    return ~F.coalesce(col.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def micros(col: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col.cast("timestamp_ntz"))
