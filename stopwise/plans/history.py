"""What is known of all stored records without reading them again.

Every batch is summarised once, when it is stored: sums of columns, moments of column
pairs, counts of labels. Summaries are committed with their batch, so one that runs
again is not counted twice; whoever reads them merges those of a version.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.operators import correlation, encoding
from stopwise.operators.nulls import as_doubles
from stopwise.operators.pair_moments import MOMENTS
from stopwise.sources import record_table

NUMBERS = [c for c in schemas.TABLE_ORDER if c not in schemas.TEXT_COLUMNS]


def _sums(rows: DataFrame) -> DataFrame:
    """``column_name``, ``value_count``, ``total`` of the columns of numbers."""
    numbers = as_doubles(rows, NUMBERS)
    values = [F.struct(F.lit(c).alias("column_name"), F.count(c).alias("value_count"), F.sum(c).alias("total")) for c in NUMBERS]
    return numbers.agg(F.array(*values).alias("all")).select(F.inline("all"))


def _moments(rows: DataFrame) -> DataFrame:
    return correlation.moments_of(rows, schemas.FEATURE_ORDER).coalesce(1)


def _labels(rows: DataFrame) -> DataFrame:
    """A run of label counts, sorted by column and label."""
    counts = encoding.label_counts(rows, schemas.TEXT_COLUMNS)
    return counts.repartitionByRange("column_name", "label").sortWithinPartitions("column_name", "label")


SUMMARIES = {"sums": _sums, "moments": _moments, "labels": _labels}


def _merged_sums(sums: DataFrame) -> DataFrame:
    merged = sums.groupBy("column_name").agg(F.sum("value_count").alias("value_count"), F.sum("total").alias("total"))
    return merged.coalesce(1)


def _merged_labels(runs: DataFrame) -> DataFrame:
    merged = runs.groupBy("column_name", "label").agg(F.sum("label_count").alias("label_count"))
    return merged.repartitionByRange("column_name", "label").sortWithinPartitions("column_name", "label")


def column_means(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """``column_name``, ``value_count`` and ``mean`` of the columns of numbers; no rows
    for a table without summaries."""
    sums = record_table.read_summaries(spark, table, "sums", version)
    if sums is None:
        sums = spark.createDataFrame([], "column_name string, value_count long, total double")
    mean = F.try_divide("total", "value_count").alias("mean")
    return _merged_sums(sums).select("column_name", "value_count", mean)


def correlation_pairs(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """``correlation.correlation_pairs`` over the stored records, columns in feature order."""
    moments = record_table.read_summaries(spark, table, "moments", version)
    if moments is None:
        moments = spark.createDataFrame([], MOMENTS)
    return correlation.pairs_of_moments(correlation.merge_moments(moments), schemas.FEATURE_ORDER)


def label_index(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """``encoding.label_index`` of the stored records of a version."""
    runs = record_table.read_summaries(spark, table, "labels", version)
    if runs is None:
        runs = spark.createDataFrame([], "column_name string, label string, label_count long")
    return encoding.rank_labels(_merged_labels(runs))


_MERGES = {"sums": _merged_sums, "moments": lambda m: correlation.merge_moments(m).coalesce(1), "labels": _merged_labels}


def merge(spark: SparkSession, table: str, names: Iterable[str] = tuple(SUMMARIES)) -> None:
    """Bring the summaries of all batches together, so that readers open few files."""
    for name in names:
        record_table.merge_summaries(spark, table, name, _MERGES[name])
