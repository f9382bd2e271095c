"""Pairwise-complete Pearson correlation and selection of correlated columns.

Each task reduces its rows to one small block of pair moments; Spark merges the
blocks by pair. Nothing is exploded per row: the shuffle carries one row per
column pair and task, and the work per row is a share of a matrix product.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.operators import pair_moments
from stopwise.operators.nulls import as_doubles

# Send the small task code itself, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(pair_moments)


def merge_moments(moments: DataFrame) -> DataFrame:
    """One row of moments for each pair; one shuffle by pair serves window and group."""
    pair = Window.partitionBy("i", "j")
    known = moments.filter("n > 0")
    means = {
        f"merged_{side}": F.sum(F.col("n") * F.col(f"mean_{side}")).over(pair) / F.sum("n").over(pair) for side in "xy"
    }
    gaps = known.withColumns(means)
    n = F.col("n")
    x, y = (F.col(f"mean_{side}") - F.col(f"merged_{side}") for side in "xy")
    return gaps.groupBy("i", "j").agg(
        F.sum("n").alias("n"),
        F.first("merged_x").alias("mean_x"),
        F.first("merged_y").alias("mean_y"),
        F.sum(F.col("m2_x") + n * x * x).alias("m2_x"),
        F.sum(F.col("m2_y") + n * y * y).alias("m2_y"),
        F.sum(F.col("c_xy") + n * x * y).alias("c_xy"),
        *[how(c).alias(c) for side in "xy" for how, c in ((F.min, f"lo_{side}"), (F.max, f"hi_{side}"))],
    )


def moments_of(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Moments of every column pair over the rows that have both values, one row a
    pair; columns are cast to double first. They merge with those of other rows."""
    numbers = as_doubles(df, columns or df.columns)
    return merge_moments(numbers.mapInArrow(pair_moments.task_moments, pair_moments.MOMENTS))


def pairs_of_moments(moments: DataFrame, columns: list[str]) -> DataFrame:
    """What ``correlation_pairs`` gives, from merged moments of these columns."""
    names = F.array(*[F.lit(c) for c in columns])
    r = F.abs(F.try_divide(F.col("c_xy"), F.sqrt("m2_x") * F.sqrt("m2_y")))
    varies = (F.col("lo_x") < F.col("hi_x")) & (F.col("lo_y") < F.col("hi_y"))
    return moments.select(
        "i",
        "j",
        names[F.col("i")].alias("column_i"),
        names[F.col("j")].alias("column_j"),
        F.col("n").cast("bigint").alias("pair_rows"),
        F.when(varies & ~F.isnan(r), F.least(r, F.lit(1.0))).alias("r"),
    )


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Absolute correlation ``r`` of every column pair with a shared value.

    Columns are cast to double first. A row counts for a pair if it has both
    values. ``r`` is null when either column is constant or infinite over those rows.
    Output: ``i``, ``j`` (positions, i < j), ``column_i``, ``column_j``,
    ``pair_rows``, ``r``.
    """
    columns = columns or df.columns
    return pairs_of_moments(moments_of(df, columns), columns)


def correlated_columns(
    pairs: DataFrame,
    *,
    threshold: float = schemas.CORRELATION_THRESHOLD,
    exempt: tuple[str, ...] = tuple(schemas.CORRELATION_EXEMPT),
) -> DataFrame:
    """Columns whose correlation with some earlier column is above the threshold.

    Exempt columns are never chosen but can still cause a later column to be.
    """
    above = pairs.filter((F.col("r") > threshold) & ~F.col("column_j").isin(list(exempt)))
    return above.select(F.col("column_j").alias("column_name")).distinct()
