"""Stateless cleaning steps and missing-value handling.

Every step is one projection or filter, so a chain of them runs as a single
stage over the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopwise import schemas
from stopwise.functions import (
    adjusted_hour,
    clock_part,
    coordinate_sum,
    delay_seconds,
    parse_timestamp,
)
from stopwise.functions.scalars import timestamp_part


def drop_incomplete(raw: DataFrame) -> DataFrame:
    """Drop rows without an expected or a scheduled arrival time."""
    return raw.dropna("any", subset=schemas.ARRIVAL_TIMES)


def rename_dotted(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed(schemas.DOTTED_NAMES)


_SPELLING = {c.lower(): c for c in schemas.TABLE_ORDER}


def restore_names(records: DataFrame) -> DataFrame:
    """Processed records with their columns spelled as here; databases fold names."""
    folded = {c: _SPELLING[c.lower()] for c in records.columns if _SPELLING.get(c.lower(), c) != c}
    return records.withColumnsRenamed(folded) if folded else records


def parse_times(df: DataFrame) -> DataFrame:
    """Turn the two full timestamps from text into timestamps."""
    return df.withColumns(
        {c: parse_timestamp(F.col(c)) for c in ("RecordedAtTime", "ExpectedArrivalTime")}
    )


def columns_of_type(df: DataFrame, *types: type[T.DataType]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types)]


def impute_means(
    df: DataFrame, *, columns: list[str] | None = None, include_integers: bool = True
) -> DataFrame:
    """Replace nulls of numeric columns by the column's mean over all rows.

    All means come from one aggregate over the needed columns, used as a scalar
    subquery. Integer columns take the mean truncated toward zero. The mean of
    an all-null column is null and changes nothing.
    """
    if columns is None:
        types = (T.DoubleType, T.IntegerType) if include_integers else (T.DoubleType,)
        columns = columns_of_type(df, *types)
    if not columns:
        return df
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("means")).scalar()
    return df.withColumns(
        {c: F.coalesce(c, means.getField(c).cast(df.schema[c].dataType)) for c in columns}
    )


def fill_missing_text(df: DataFrame, *, columns: list[str] | None = None) -> DataFrame:
    """Replace null text by the empty string, except in the arrival times.

    Only the record's own text columns are filled, not columns carried along.
    """
    if columns is None:
        text = columns_of_type(df, T.StringType)
        columns = [c for c in text if c in schemas.TEXT_COLUMNS]
    return df.fillna("", subset=columns)


def split_timestamps(df: DataFrame) -> DataFrame:
    """Replace the two timestamps by six integer parts each."""
    parts = {
        f"{c}_{p}": timestamp_part(F.col(c), p)
        for c in ("RecordedAtTime", "ExpectedArrivalTime")
        for p in schemas.TIMESTAMP_PARTS
    }
    return df.withColumns(parts).drop("RecordedAtTime", "ExpectedArrivalTime")


def split_schedule(df: DataFrame) -> DataFrame:
    """Replace the scheduled clock text by adjusted hour, minute and second.

    Needs ``ExpectedArrivalTime_hour``.
    """
    text = F.col("ScheduledArrivalTime")
    parts = {f"ScheduledArrivalTime_{p}": clock_part(text, p) for p in schemas.CLOCK_PARTS}
    parts["ScheduledArrivalTime_hour"] = adjusted_hour(
        parts["ScheduledArrivalTime_hour"], F.col("ExpectedArrivalTime_hour")
    )
    return df.withColumns(parts).drop("ScheduledArrivalTime")


def add_delay(df: DataFrame) -> DataFrame:
    def clock(prefix: str):
        return tuple(F.col(f"{prefix}_{p}") for p in schemas.CLOCK_PARTS)

    delay = delay_seconds(clock("ExpectedArrivalTime"), clock("ScheduledArrivalTime"))
    return df.withColumn("Delay", delay)


def combine_coordinates(df: DataFrame) -> DataFrame:
    """Replace each latitude and longitude pair by its sum."""
    sums = {
        name: coordinate_sum(F.col(lat), F.col(long))
        for name, (lat, long) in schemas.COORDINATES.items()
    }
    used = [c for pair in schemas.COORDINATES.values() for c in pair]
    return df.withColumns(sums).drop(*used)
