"""First-write-wins storage by key, with a reason for every rejected row.

The checked rows are written to a staging folder once, so that cleaning runs
once, arrival numbers stay fixed and the key is a set of plain columns.

A key seen once needs no comparison, so the rows are matched only against the
contested keys: those seen more than once, or stored before. They are counted
with a partial aggregate (a hot key shrinks to one row per task) and written
out, so that the planner knows their size: a small table is broadcast and the
rows are not shuffled at all, a large one is joined with skew splitting.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.session import shared_folder

NULL_KEY = "null key"
TEXT_TOO_LONG = "text too long"
DUPLICATE_KEY = "duplicate key"
UNDECODABLE = "undecodable"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def contract_reason(rows: DataFrame, known: Column | None = None) -> DataFrame:
    """Add ``reason``: ``known`` if given and not null, else why the table
    cannot take the row, or null."""
    null_key = reduce(or_, [F.col(c).isNull() for c in schemas.KEY])
    too_long = reduce(
        or_, [F.length(c) > schemas.MAX_TEXT_LENGTH for c in schemas.TEXT_COLUMNS]
    )
    reason = F.when(null_key, NULL_KEY).when(too_long, TEXT_TOO_LONG)
    if known is not None:
        reason = F.coalesce(known, reason)
    return rows.withColumn("reason", reason)


def contested_keys(rows: DataFrame, arrival: str, stored: DataFrame | None = None) -> DataFrame:
    """Keys seen more than once in ``rows`` or present in ``stored``.

    ``first_arrival`` is the arrival that wins, or null if the key is stored.
    The stored keys are filtered by a semi join with the keys of the rows: for
    a small batch these are broadcast, and the stored rows are only scanned.
    """
    keys = rows.groupBy(*schemas.KEY).agg(
        F.min(arrival).alias("first_arrival"), F.count(F.lit(1)).alias("seen")
    )
    repeated = keys.filter("seen > 1").drop("seen")
    if stored is None:
        return repeated
    taken = stored.select(*schemas.KEY).join(keys, schemas.KEY, "left_semi")
    both = repeated.withColumn("taken", F.lit(False)).unionByName(
        taken.withColumn("taken", F.lit(True)), allowMissingColumns=True
    )
    merged = both.groupBy(*schemas.KEY).agg(
        F.max("taken").alias("taken"), F.min("first_arrival").alias("first_arrival")
    )
    winner = F.when(~F.col("taken"), F.col("first_arrival"))
    return merged.select(*schemas.KEY, winner.alias("first_arrival"))


def classify(
    rows: DataFrame,
    arrival: str,
    stored: Callable[[DataFrame], DataFrame] | None = None,
    staging: str | None = None,
    known: Column | None = None,
) -> DataFrame:
    """Add ``reason`` to processed rows; a row without a reason is accepted.

    ``arrival`` names a column that is unique and increases in arrival order.
    ``stored`` gives, for the valid rows, the rows accepted before. Of the valid
    rows with one key the first to arrive is accepted, unless the key is stored
    already. The folder ``staging`` is overwritten; the result reads from it.
    ``known`` is the reason for rows that are known to be unusable.
    """
    spark = rows.sparkSession
    staging = staging or shared_folder(spark)
    checked = _written(contract_reason(rows, known), f"{staging}/rows")
    valid = checked.filter("reason is null").select(*schemas.KEY, arrival)
    contested = contested_keys(valid, arrival, stored(valid) if stored else None)
    contested = _written(contested, f"{staging}/contested").withColumn("contested", F.lit(True))

    late = F.col("contested") & ~F.col("first_arrival").eqNullSafe(F.col(arrival))
    reason = F.coalesce(F.col("reason"), F.when(late, F.lit(DUPLICATE_KEY)))
    joined = checked.join(contested, schemas.KEY, "left")
    return joined.select(*rows.columns, reason.alias("reason"))


def accepted(classified: DataFrame) -> DataFrame:
    return classified.filter("reason is null").drop("reason")


def rejects(classified: DataFrame) -> DataFrame:
    return classified.filter("reason is not null")
