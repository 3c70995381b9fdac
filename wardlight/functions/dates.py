"""Wall-clock dates in the formats hospital extracts use, as native columns; NULL wherever a value doesn't parse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The accepted layouts. ISO and day-first dates with an optional time, and digits alone.
_TIME = r"([T ]\d{1,2}:\d{2}(:\d{2})?)?$"
ISO = r"^\d{4}-\d{1,2}-\d{1,2}" + _TIME
DAY_FIRST = r"^(\d{1,2})/(\d{1,2})/(\d{4})" + _TIME
COMPACT = r"^\d{8}( \d{4}(\d{2})?)?$"


def as_wall_clock(column: Column, kind: T.DataType, zone: str | None = None) -> Column:
    """TIMESTAMP_NTZ of a column of that type: dates and timestamps as they are, fractions and all; texts are parsed."""
    return column.cast("timestamp_ntz") if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else parse_wall_clock(column, zone)


def parse_wall_clock(raw: Column, zone: str | None = None, day_first_digits: bool = False) -> Column:
    """TIMESTAMP_NTZ of a date or date-time string: each layout is rewritten as ISO, and one cast checks the values.

    With a zone, times that its daylight-saving change skips are NULL; without, any wall clock stands. day_first_digits: eight
    digits that are no date as year, month, day are read as day, month, year.
    """
    raw = raw.cast("string")
    day_first = F.regexp_replace(raw, r"^(\d+)/(\d+)/(\d+)", "$3-$2-$1")
    timed = lambda dated: F.regexp_replace(F.regexp_replace(dated, r" (\d{2})(\d{2})$", " $1:$2"), r" (\d{2})(\d{2})(\d{2})$", " $1:$2:$3")
    compact = timed(F.regexp_replace(raw, r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3"))
    iso = F.when(raw.rlike(ISO), raw).when(raw.rlike(DAY_FIRST), day_first).when(raw.rlike(COMPACT), compact)
    ts = iso.try_cast("timestamp_ntz")
    if day_first_digits:
        turned = timed(F.regexp_replace(raw, r"^(\d{2})(\d{2})(\d{4})", "$3-$2-$1"))
        ts = F.coalesce(ts, F.when(raw.rlike(COMPACT), turned).try_cast("timestamp_ntz"))
    if zone is None:
        return ts
    there_and_back = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.convert_timezone(F.lit(zone), F.lit("UTC"), ts))
    return F.when(there_and_back == ts, ts)


def has_clock(raw: Column) -> Column:
    """Whether the text writes a time of day with a colon."""
    return F.coalesce(raw.cast("string").rlike(r"\d{2}:\d{2}"), F.lit(False))


def clock_time(ts: Column, raw: Column) -> Column:
    """HH:mm:ss where the time was written out; independent of the session's zone, as the cast of an NTZ is."""
    return F.when(ts.isNotNull() & has_clock(raw), F.substring(ts.cast("string"), 12, 8))
