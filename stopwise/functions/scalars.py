"""Scalar expressions on columns.

Bad input yields null instead of an error, whatever the session's ANSI
setting, and no result depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The padded form of TIMESTAMP_PATTERN. The cast alone would also take dates
# without a time, fractions and unpadded fields; year 0 is not a valid year.
_PADDED_TIMESTAMP = r"^(?!0000)\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\z"

# Offset of each part within "HH:mm:ss".
_CLOCK_OFFSETS = {"hour": 1, "minute": 4, "second": 7}

_PART_FUNCTIONS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
}


def parse_timestamp(text: Column) -> Column:
    """Text in ``yyyy-MM-dd HH:mm:ss`` to a zone-free timestamp, else null."""
    return F.when(text.rlike(_PADDED_TIMESTAMP), text.try_cast("timestamp_ntz"))


def timestamp_part(ts: Column, part: str) -> Column:
    return _PART_FUNCTIONS[part](ts)


def clock_part(text: Column, part: str) -> Column:
    """Hour, minute or second of ``HH:mm:ss`` text; the hour may exceed 23."""
    return F.substring(text, _CLOCK_OFFSETS[part], 2).try_cast("int")


def adjusted_hour(hour: Column, expected_hour: Column) -> Column:
    """Take 24 off a scheduled hour of 24, or of 23 when 0 is expected.

    The condition is null when the expected hour is needed but unknown; the
    hour then stays as it is.
    """
    past_midnight = (hour == 24) | ((hour == 23) & (expected_hour == 0))
    return F.when(past_midnight, hour - 24).otherwise(hour)


def _seconds_of_day(hour: Column, minute: Column, second: Column) -> Column:
    return hour * 3600 + minute * 60 + second


def delay_seconds(
    expected: tuple[Column, Column, Column], scheduled: tuple[Column, Column, Column]
) -> Column:
    """Expected minus scheduled time of day; null if any part is null."""
    return _seconds_of_day(*expected) - _seconds_of_day(*scheduled)


def coordinate_sum(latitude: Column, longitude: Column) -> Column:
    return latitude + longitude


def whole_minutes(seconds: Column) -> Column:
    """Seconds to whole minutes, rounded down also below zero."""
    return F.floor(seconds / 60).cast("int")


def whole_number(number: Column) -> Column:
    """A double as an integer, null if it is no whole one: a column with gaps may
    have been written as 1.0 rather than 1."""
    return F.when(number == F.floor(number), number.try_cast("int"))


def typed_null(data_type: T.DataType) -> Column:
    return F.lit(None).cast(data_type)
