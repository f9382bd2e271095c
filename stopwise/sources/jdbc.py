"""The processed table in a relational database, reached over JDBC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stopwise import schemas
from stopwise.operators.cleaning import restore_names
from stopwise.sources import record_table

_SQL_TYPES = {
    T.IntegerType: "INTEGER",
    T.DoubleType: "DOUBLE PRECISION",
    T.StringType: f"VARCHAR({schemas.MAX_TEXT_LENGTH})",
}
_SPARK_TYPES = {T.IntegerType: "INT", T.DoubleType: "DOUBLE", T.StringType: "STRING"}


def create_table_sql(table: str = schemas.DEFAULT_TABLE) -> str:
    """DDL for a database table with the key as primary key."""
    columns = [f"{f.name} {_SQL_TYPES[type(f.dataType)]}" for f in schemas.table_schema().fields]
    columns.append(f"PRIMARY KEY ({', '.join(schemas.KEY)})")
    return f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(columns)})"


def create_spark_table_sql(location: str, table: str = schemas.DEFAULT_TABLE) -> str:
    """DDL that makes the stored table at ``location`` (``record_table``) known by
    name; ``MSCK REPAIR TABLE`` then finds its folders. It shows every file there is:
    vacuum the table first if a compaction or a batch that broke off left some."""
    columns = [f"{f.name} {_SPARK_TYPES[type(f.dataType)]}" for f in schemas.table_schema().fields]
    partitions = [record_table.BATCH, *schemas.DATE_PARTITION]
    return (
        f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(columns)}, {record_table.BATCH} STRING)"
        f" USING parquet PARTITIONED BY ({', '.join(partitions)}) LOCATION '{location}'"
    )


def date_predicate(year: int, month: int, day: int) -> str:
    parts = zip(schemas.DATE_PARTITION, (year, month, day))
    return " AND ".join(f"{c} = {int(v)}" for c, v in parts)


def date_predicates(first: dt.date, last: dt.date) -> list[str]:
    """One predicate per recorded date, for one read task per date."""
    days = (first + dt.timedelta(n) for n in range((last - first).days + 1))
    return [date_predicate(d.year, d.month, d.day) for d in days]


def read_table(
    spark: SparkSession,
    url: str,
    table: str = schemas.DEFAULT_TABLE,
    *,
    properties: dict[str, str],
    predicates: list[str] | None = None,
    hour_slices: int | None = None,
) -> DataFrame:
    """Scan the table in parallel: by ``predicates``, or in ranges of the hour.

    Columns come in table order and spelled as here, whatever the database makes of
    unquoted names.
    """
    if predicates is not None:
        read = spark.read.jdbc(url, table, predicates=predicates, properties=properties)
    elif hour_slices is not None:
        read = spark.read.jdbc(
            url,
            table,
            column="RecordedAtTime_hour",
            lowerBound=0,
            upperBound=24,
            numPartitions=hour_slices,
            properties=properties,
        )
    else:
        read = spark.read.jdbc(url, table, properties=properties)
    return restore_names(read).select(*schemas.TABLE_ORDER)


def latest_query(table: str = schemas.DEFAULT_TABLE, n: int = 100) -> str:
    """Subquery for the newest ``n`` rows, so the database does the top-n; ties go by
    the rest of the key."""
    ties = [c for c in schemas.KEY if c not in schemas.RECORDED_PARTS]
    newest = ", ".join([f"{c} DESC" for c in schemas.RECORDED_PARTS] + [f"{c} ASC" for c in ties])
    return f"(SELECT * FROM {table} ORDER BY {newest} LIMIT {int(n)}) newest"


def read_latest(
    spark: SparkSession,
    url: str,
    table: str = schemas.DEFAULT_TABLE,
    n: int = 100,
    *,
    properties: dict[str, str],
) -> DataFrame:
    return read_table(spark, url, latest_query(table, n), properties=properties)


def missing_rows(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose key is not stored yet."""
    return rows.join(stored.select(*schemas.KEY), schemas.KEY, "left_anti")


def date_ranges(dates: list[tuple[int, int, int]], parts: int) -> list[str]:
    """At most ``parts`` predicates that together hold all ``dates``: ranges of
    neighbouring dates, as row comparisons a database can answer from the key."""
    ordered = sorted(set(dates))
    names = ", ".join(schemas.DATE_PARTITION)
    size = max(1, -(-len(ordered) // parts))
    found = []
    for start in range(0, len(ordered), size):
        some = ordered[start : start + size]
        first, last = (", ".join(str(int(v)) for v in d) for d in (some[0], some[-1]))
        found.append(f"({names}) >= ({first}) AND ({names}) <= ({last})")
    return found


def stored_for(
    rows: DataFrame, url: str, table: str, *, properties: dict[str, str], connections: int
) -> DataFrame:
    """Stored rows on the dates of ``rows``, in ``connections`` reads at most."""
    dates = [tuple(d) for d in rows.select(*schemas.DATE_PARTITION).dropna().distinct().collect()]
    predicates = date_ranges(dates, connections) or ["1 = 0"]
    return read_table(rows.sparkSession, url, table, properties=properties, predicates=predicates)


def append_rows(
    rows: DataFrame,
    url: str,
    table: str = schemas.DEFAULT_TABLE,
    *,
    properties: dict[str, str],
    connections: int = 8,
) -> None:
    """Append accepted rows, skipping those a failed earlier try has stored.

    Each write task is one transaction, in which a single duplicate would roll
    back all rows; the rows are therefore compared with the stored keys of
    their dates first. At most ``connections`` tasks read or write at a time; the
    comparison itself runs on all executors.
    """
    rows = rows.select(*schemas.TABLE_ORDER)
    stored = stored_for(rows, url, table, properties=properties, connections=connections)
    missing = missing_rows(rows, stored).repartition(connections)
    missing.write.jdbc(url, table, mode="append", properties=properties)
