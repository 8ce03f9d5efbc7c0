"""Times as seconds since 1970 and their texts, in UTC whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _utc(seconds: Column, form: str) -> Column:
    # A timestamp without time zone is shown as it stands.
    return F.date_format(F.timestamp_add("SECOND", seconds.cast("bigint"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), form)


def time_text(seconds: Column) -> Column:
    """``2006-01-02T15:04:05``."""
    return _utc(seconds, "yyyy-MM-dd'T'HH:mm:ss")


def date_text(seconds: Column) -> Column:
    """``20060102``."""
    return _utc(seconds, "yyyyMMdd")


def file_text(seconds: Column, rounded: bool = False) -> Column:
    """As part of a file name: the date alone if rounded, else the time with hyphens for colons."""
    return date_text(seconds) if rounded else F.replace(time_text(seconds), F.lit(":"), F.lit("-"))


def parse_time(text: Column) -> Column:
    """Seconds of either form of text, null where it is neither."""
    whole = F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    day = F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit("yyyyMMddXXX"))
    return F.unix_seconds(F.when(F.length(text) == 8, day).otherwise(whole))
