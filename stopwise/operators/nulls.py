"""Operators on all-null rows and columns, and casts of whole frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopwise.functions import typed_null

# Everything the cast to double accepts. The cast meets other text with an
# exception inside, which costs far more than this test does.
_NUMBER = (
    r"(?i)^[\x00-\x20]*[-+]?(inf|infinity|nan|0x.*"
    r"|(\d+\.?\d*|\.\d+)(e[-+]?\d+)?)[fd]?[\x00-\x20]*$"
)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every column is null."""
    return df.dropna("all")


def null_column_counts(df: DataFrame) -> DataFrame:
    """One row per column: ``column_name``, ``row_count``, ``value_count``.

    All counts come from one aggregate without a group.
    """
    names = df.columns
    counted = df.agg(F.count(F.lit(1)).alias("row_count"), *[F.count(c).alias(c) for c in names])
    return counted.unpivot("row_count", names, "column_name", "value_count").select(
        "column_name", "row_count", "value_count"
    )


def empty_columns(df: DataFrame) -> list[str]:
    """Names of the columns without any value; at most one per schema column."""
    empty = null_column_counts(df).filter("value_count = 0")
    found = {r.column_name for r in empty.collect()}
    return [c for c in df.columns if c in found]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return df.drop(*empty_columns(df))


def null_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null out the given columns, keeping their types and places."""
    return df.withColumns({c: typed_null(df.schema[c].dataType) for c in columns})


def as_doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns as doubles; text that is no number becomes null."""
    return df.select([_as_double(df, c).alias(c) for c in columns])


def _as_double(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    number = column.try_cast("double")
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.when(column.rlike(_NUMBER), number)
    return number
