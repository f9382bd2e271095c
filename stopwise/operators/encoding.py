"""Label dictionaries for text columns, as data rather than driver state.

Labels are numbered by falling frequency, ties in alphabetical order. The
number is a position in one range-sorted table of distinct labels, so no task
ever holds all labels of a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.session import shared_folder

_POSITION_BITS = 33  # monotonically_increasing_id keeps the task above these bits


def label_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name``, ``label``, ``label_count``; nulls are not labels."""
    long = df.select(*columns).unpivot([], columns, "column_name", "label")
    counted = long.filter("label is not null").groupBy("column_name", "label")
    return counted.agg(F.count(F.lit(1)).alias("label_count"))


def label_index(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column_name``, ``label``, ``label_count``, ``label_index`` (from 0)."""
    return rank_labels(label_counts(df, columns or schemas.TEXT_COLUMNS))


def rank_labels(counts: DataFrame) -> DataFrame:
    """The index of labels that are counted, each once (``label_counts``)."""
    spark = counts.sparkSession
    order = [F.asc("column_name"), F.desc("label_count"), F.asc("label")]
    sorted_labels = (
        counts.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
    )
    # Positions depend on the sampled range bounds: write them down once.
    folder = shared_folder(spark)
    sorted_labels.write.parquet(folder)
    placed = spark.read.parquet(folder).select(
        "*",
        F.shiftright("place", _POSITION_BITS).alias("slice"),
        F.col("place").bitwiseAND((1 << _POSITION_BITS) - 1).alias("offset"),
    )
    # One row per column and slice, in sort order: how many labels of the
    # column earlier slices hold, and where the column starts in this slice.
    by_slice = placed.groupBy("column_name", "slice").agg(
        F.count(F.lit(1)).alias("labels"), F.min("offset").alias("start")
    )
    earlier = Window.partitionBy("column_name").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = by_slice.select(
        F.col("column_name").alias("start_column"),
        F.col("slice").alias("start_slice"),
        (F.coalesce(F.sum("labels").over(earlier), F.lit(0)) - F.col("start")).alias("shift"),
    )
    same_slice = (F.col("column_name") == F.col("start_column")) & (
        F.col("slice") == F.col("start_slice")
    )
    placed = placed.join(starts, same_slice)
    return placed.select(
        "column_name",
        "label",
        "label_count",
        (F.col("offset") + F.col("shift")).alias("label_index"),
    )


INDEX_SCHEMA = "label string, label_index long, column_name string"


def write_index(index: DataFrame, folder: str) -> DataFrame:
    """The index written as a table, one folder per column, and read back."""
    columns = index.select("label", "label_index", "column_name")
    columns.write.mode("overwrite").partitionBy("column_name").parquet(folder)
    return index.sparkSession.read.schema(INDEX_SCHEMA).parquet(folder)


def label_encode(
    df: DataFrame, columns: list[str] | None = None, index: DataFrame | None = None
) -> DataFrame:
    """Add ``<column>_indexed``; unseen and null labels get the label count.

    ``index`` is a written one (``write_index``); without it the labels of ``df``
    are indexed and written first. So each lookup is planned from its real size:
    broadcast while small, else a sort-merge join with skew splitting.
    """
    columns = schemas.TEXT_COLUMNS if columns is None else columns
    if not columns:
        return df
    written = index
    if written is None:
        written = write_index(label_index(df, columns), shared_folder(df.sparkSession))
    known = {
        r.column_name: r.labels
        for r in written.groupBy("column_name").agg(F.count(F.lit(1)).alias("labels")).collect()
    }
    for c in columns:
        lookup = written.filter(F.col("column_name") == c).select(
            F.col("label").alias(f"{c}_label"), F.col("label_index").alias(f"{c}_at")
        )
        df = df.join(lookup, F.col(c) == F.col(f"{c}_label"), "left").drop(f"{c}_label")
        code = F.coalesce(F.col(f"{c}_at"), F.lit(known.get(c, 0))).cast("double")
        df = df.withColumn(f"{c}_indexed", code).drop(f"{c}_at")
    return df
