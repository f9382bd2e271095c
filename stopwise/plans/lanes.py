"""The two cleaning lanes from raw records to processed records.

The ingest lane holds only stateless steps, so its result does not depend on
how a stream was cut into batches. The analysis lane also fills numeric gaps
with column means over all complete rows, before coordinates are summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.operators import cleaning
from stopwise.operators.correlation import correlated_columns, correlation_pairs
from stopwise.operators.nulls import null_columns


def complete_records(raw: DataFrame) -> DataFrame:
    """Complete raw records with plain names, parsed times and filled text."""
    complete = cleaning.rename_dotted(cleaning.drop_incomplete(raw))
    return cleaning.fill_missing_text(cleaning.parse_times(complete))


def derive_features(records: DataFrame, keep: list[str]) -> DataFrame:
    df = cleaning.split_timestamps(records)
    df = cleaning.add_delay(cleaning.split_schedule(df))
    return cleaning.combine_coordinates(df).select(*schemas.FEATURE_ORDER, *keep)


def ingest_lane(raw: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Processed records; ``keep`` names extra columns to carry through."""
    return derive_features(complete_records(raw), list(keep))


def analysis_lane(raw: DataFrame, *, include_integers: bool = True) -> DataFrame:
    """Processed records with numeric gaps filled by column means."""
    numeric = [
        schemas.DOTTED_NAMES.get(n, n)
        for n, t in schemas.RAW_FIELDS
        if t == "double" or (t == "int" and include_integers)
    ]
    records = cleaning.impute_means(complete_records(raw), columns=numeric)
    return derive_features(records, [])


def table_rows(processed: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Processed records with the stored table's column order and types."""
    typed = [F.col(c).cast(schemas.processed_type(c)).alias(c) for c in schemas.TABLE_ORDER]
    return processed.select(*typed, *keep)


def selected_features(processed: DataFrame) -> DataFrame:
    """Processed records with the correlated columns nulled out.

    The chosen columns are at most as many as the schema has.
    """
    pairs = correlation_pairs(processed.select(*schemas.FEATURE_ORDER))
    chosen = [r.column_name for r in correlated_columns(pairs).collect()]
    return null_columns(processed, chosen)
