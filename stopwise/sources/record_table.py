"""The stored table of processed records: Parquet by batch and recorded date.

A batch writes a folder of its own, its rejected rows another, filters of its keys a
third, and then commits all of it as one version of the table (``table_log``). What
breaks off before that leaves files that no version names; what is committed is not
written again. ``compact`` brings the files of a date together, again as one
version; the old files stay for readers of older versions until ``vacuum``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopwise import schemas
from stopwise.operators import key_filter
from stopwise.operators.ranking import latest
from stopwise.session import folders, remove_folder
from stopwise.sources.table_log import GONE, TableLog

BATCH = "ingest_batch"
ROWS, REJECTS = "rows", "rejects"  # kinds of entries
_PARTITIONS = [BATCH, *schemas.DATE_PARTITION]
_DATE = ["year", "month", "day"]
_TIME = dict(zip(schemas.TIMESTAMP_PARTS, (10_000_000_000, 100_000_000, 1_000_000, 10_000, 100, 1)))


def _stored_schema() -> T.StructType:
    nullable = [T.StructField(f.name, f.dataType) for f in schemas.table_schema().fields]
    return T.StructType([*nullable, T.StructField(BATCH, T.StringType())])


def _read(spark: SparkSession, table: str, paths: list[str]) -> DataFrame:
    """The rows below ``paths``, folders or files of the table."""
    if not paths:
        return spark.createDataFrame([], _stored_schema())
    rooted = [f"{table.rstrip('/')}/{p}" for p in paths]
    return spark.read.schema(_stored_schema()).option("basePath", table).parquet(*rooted)


def recorded_number() -> Column:
    """The recorded time as a number that sorts alike: 20240131235959."""
    parts = [F.col(c).cast("long") * factor for c, factor in zip(schemas.RECORDED_PARTS, _TIME.values())]
    return sum(parts[1:], parts[0])


def _row_files(entries: DataFrame) -> DataFrame:
    """One row for each file with records: its date, rows, first and last record."""
    found = entries.filter(F.col("kind") == ROWS).groupBy("path", *_DATE, "batch")
    return found.agg(F.sum("row_count").alias("row_count"), F.min("first").alias("first"), F.max("last").alias("last"))


def _folder(path: Column) -> Column:
    return F.substring_index(path, "/", len(_PARTITIONS))


def _dates(rows: DataFrame, *more: Column) -> list:
    """The recorded dates of ``rows``, at most as many as the calendar has."""
    return rows.groupBy(*schemas.DATE_PARTITION).agg(F.count(F.lit(1)).alias("n"), *more).dropna().collect()


def _of_dates(dates: list) -> Column:
    number = F.col("year") * 10_000 + F.col("month") * 100 + F.col("day")
    return number.isin([d[0] * 10_000 + d[1] * 100 + d[2] for d in dates])


def read_records(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """All stored records of a version, the newest one if none is given, in table
    order; none if the table does not exist."""
    files = TableLog(spark, table).entries(version).filter(F.col("kind") == ROWS)
    paths = [r.folder for r in files.select(_folder(F.col("path")).alias("folder")).distinct().collect()]
    return _read(spark, table, sorted(paths)).select(*schemas.TABLE_ORDER)


def read_rejects(spark: SparkSession, table: str, version: int | None = None) -> DataFrame | None:
    """The rejected rows that were committed with the records, None if there are none yet."""
    entries = TableLog(spark, table).entries(version).filter((F.col("kind") == REJECTS) & (F.col("row_count") > 0))
    paths = sorted(r.path for r in entries.select("path").collect())
    return spark.read.option("mergeSchema", True).parquet(*paths) if paths else None


def count_records(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """``record_count`` from the versions' lists alone; no data file is opened."""
    files = TableLog(spark, table).entries(version).filter(F.col("kind") == ROWS)
    return files.agg(F.coalesce(F.sum("row_count"), F.lit(0).cast("long")).alias("record_count"))


def is_committed(spark: SparkSession, table: str, batch: str) -> bool:
    """Whether a version has the batch."""
    entries = TableLog(spark, table).entries()
    return not entries.filter((F.col("kind") == REJECTS) & (F.col("batch") == batch)).isEmpty()


def batch_counts(spark: SparkSession, table: str, batch: str) -> dict[str, int]:
    """How many rows of a batch were ``accepted`` and ``rejected``, from the lists."""
    entries = TableLog(spark, table).entries().filter(F.col("batch") == batch)
    counted = {r.kind: r.n for r in entries.groupBy("kind").agg(F.sum("row_count").alias("n")).collect()}
    return {"accepted": counted.get(ROWS) or 0, "rejected": counted.get(REJECTS) or 0}


def batch_records(spark: SparkSession, table: str, batch: str) -> DataFrame:
    """The stored records of a batch that no compaction has taken in yet."""
    files = _row_files(TableLog(spark, table).entries()).filter(F.col("batch") == batch)
    return _read(spark, table, sorted(r.path for r in files.collect())).select(*schemas.TABLE_ORDER)


def stored_for(rows: DataFrame, table: str, batch: str) -> DataFrame:
    """Stored rows of other batches with a date of ``rows`` and an hour between their
    first and last one. Only files of these dates and hours are opened."""
    spark, hour = rows.sparkSession, schemas.RECORDED_PARTS[3]
    dates = _dates(rows, F.min(hour).alias("first"), F.max(hour).alias("last"))
    if not dates:
        return _read(spark, table, [])
    files = _files_around(spark, table, batch, dates)
    hours = F.col(hour).between(min(d["first"] for d in dates), max(d["last"] for d in dates))
    return _read(spark, table, sorted(r.path for r in files.select("path").collect())).filter(hours)


def _files_around(spark: SparkSession, table: str, batch: str, dates: list) -> DataFrame:
    files = _row_files(TableLog(spark, table).entries())
    first, last = min(d["first"] for d in dates), max(d["last"] for d in dates)
    hour_of = lambda c: F.floor(F.col(c) / _TIME["hour"]) % 100
    return files.filter(
        _of_dates(dates) & (F.col("batch") != batch) & (hour_of("last") >= first) & (hour_of("first") <= last)
    )


def stored_matches(rows: DataFrame, table: str, batch: str) -> DataFrame:
    """Stored rows of other batches that may share a key with ``rows``.

    Of the files with their dates and hours only those are opened whose key filter
    one of the keys passes: those that hold one of them, and of the others about one
    for a million keys looked up.
    """
    spark, hour = rows.sparkSession, schemas.RECORDED_PARTS[3]
    dates = _dates(rows, F.min(hour).alias("first"), F.max(hour).alias("last"))
    if not dates:
        return _read(spark, table, [])
    files = _files_around(spark, table, batch, dates).select("path", *_DATE)
    segment = F.substring_index(F.substring_index("path", "/", 1), "=", -1)
    filters = sorted(r.segment for r in files.select(segment.alias("segment")).distinct().collect())
    if not filters:
        return _read(spark, table, [])
    blocks = spark.read.schema(key_filter.BLOCK).parquet(*[_filter_folder(table, f) for f in filters])
    hours = F.col(hour).between(min(d["first"] for d in dates), max(d["last"] for d in dates))
    return _read(spark, table, key_filter.files_with(rows, files, blocks)).filter(hours)


def _filter_folder(table: str, segment: str) -> str:
    return f"{table.rstrip('/')}/_keys/{segment}"


def _segment(batch: str) -> str:
    """A folder name for one try of a batch."""
    return f"{re.sub('[^A-Za-z0-9_-]', '_', batch)}.{uuid.uuid4().hex[:12]}"


def write_batch(
    rows: DataFrame,
    table: str,
    batch: str,
    rejected: DataFrame | None = None,
    rejects: str | None = None,
    summaries: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> None:
    """Store a batch's rows and, in the folder ``rejects``, its rejected ones, and commit
    both as one version. A batch that a version has already is left as it is.
    ``summaries`` make small tables of the batch's rows, by name, that are committed
    with it (``read_summaries``).

    Rows are brought together by date, so that a date gets few files whatever
    the number of tasks; a large date is split over several tasks. Files are in the
    order of time, so a read of some hours skips the others.
    """
    spark = rows.sparkSession
    log = TableLog(spark, table)
    base = log.newest()
    if is_committed(spark, table, batch):
        return
    segment = _segment(batch)
    _write_rows(rows, table, segment)
    entry = _list_entry(spark, REJECTS, batch, f"none/{segment}", 0)
    if rejected is not None:
        folder = f"{rejects.rstrip('/')}/{BATCH}={segment}"
        _write_rejects(rejected, folder)
        entry = _list_entry(spark, REJECTS, batch, folder, spark.read.schema(rejected.schema).parquet(folder).count())
    extra = [entry]
    for name, summary in (summaries or {}).items():
        folder = f"_{name}/{segment}"
        summary(_read(spark, table, [f"{BATCH}={segment}"])).write.parquet(f"{table.rstrip('/')}/{folder}")
        extra.append(_list_entry(spark, name, batch, folder, 0))
    log.commit(base, _described(spark, log, table, batch, segment, *extra))


def read_summaries(spark: SparkSession, table: str, name: str, version: int | None = None) -> DataFrame | None:
    """A version's summaries of that name, those of all its batches together; None if
    it has none. Compaction of files leaves them alone."""
    entries = TableLog(spark, table).entries(version).filter(F.col("kind") == name)
    paths = sorted(r.path for r in entries.select("path").collect())
    return spark.read.parquet(*[f"{table.rstrip('/')}/{p}" for p in paths]) if paths else None


def merge_summaries(spark: SparkSession, table: str, name: str, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Put one summary, what ``merge`` makes of all, in the place of the batches' own; one
    version has it and not them."""
    log = TableLog(spark, table)
    base = log.newest()
    old = [r.path for r in log.entries(base).filter(F.col("kind") == name).select("path").collect()]
    if len(old) < 2:
        return
    folder = f"_{name}/{_segment('merged')}"
    merge(read_summaries(spark, table, name, base)).write.parquet(f"{table.rstrip('/')}/{folder}")
    entries = _list_entry(spark, name, "", folder, 0).unionByName(_gone(spark, old))
    log.commit(base, [log.write_list(entries)])


def _gone(spark: SparkSession, paths: list[str]) -> DataFrame:
    gone = spark.createDataFrame([(GONE, "", p) for p in paths], "kind string, batch string, path string")
    empty = [F.lit(None).cast("int").alias(c) for c in _DATE]
    return gone.select("*", *empty, *[F.lit(None).cast("long").alias(c) for c in ("row_count", "first", "last")])


def _write_rows(rows: DataFrame, table: str, segment: str) -> None:
    (
        rows.select(*schemas.TABLE_ORDER)
        .hint("rebalance", *schemas.DATE_PARTITION)
        .sortWithinPartitions(*schemas.RECORDED_PARTS)
        .write.partitionBy(*schemas.DATE_PARTITION)
        .parquet(f"{table.rstrip('/')}/{BATCH}={segment}")
    )


def _write_rejects(rejected: DataFrame, folder: str) -> None:
    rejected.write.parquet(folder)


def _list_entry(spark: SparkSession, kind: str, batch: str, path: str, rows: int) -> DataFrame:
    named = {"kind": kind, "batch": batch, "path": path}
    entry = spark.range(1).select(*[F.lit(v).alias(k) for k, v in named.items()])
    return entry.select(
        "*", *[F.lit(None).cast("int").alias(c) for c in _DATE], F.lit(rows).cast("long").alias("row_count"),
        *[F.lit(None).cast("long").alias(c) for c in ("first", "last")],
    )


def _written(spark: SparkSession, table: str, segment: str) -> DataFrame:
    """A segment's rows with the ``path`` of their file below the table."""
    rows = _read(spark, table, [f"{BATCH}={segment}"])
    parts = [F.lit(f"{BATCH}={segment}"), *[F.concat(F.lit(f"{c}="), F.col(c)) for c in schemas.DATE_PARTITION]]
    return rows.withColumn("path", F.concat_ws("/", *parts, F.col("_metadata.file_name")))


def _described(
    spark: SparkSession, log: TableLog, table: str, batch: str, segment: str, *more: DataFrame
) -> list[str]:
    """A list of a segment's files, by file and hour, and of ``more``; the filters of
    the files' keys are written too."""
    rows = _written(spark, table, segment).withColumn("time", recorded_number())
    bounds = [F.count(F.lit(1)).alias("row_count"), F.min("time").alias("first"), F.max("time").alias("last")]
    by_hour = rows.groupBy("path", *schemas.RECORDED_PARTS[:4]).agg(*bounds)
    entries = by_hour.withColumnsRenamed(dict(zip(schemas.DATE_PARTITION, _DATE))).select(
        F.lit(ROWS).alias("kind"), F.lit(batch).alias("batch"), "path", *_DATE, "row_count", "first", "last"
    )
    for extra in more:
        entries = entries.unionByName(extra)
    name = log.write_list(entries)
    _write_filters(rows.select("path", *schemas.KEY), _row_files(log.read_lists([name])), _filter_folder(table, segment))
    return [name]


def _write_filters(keys: DataFrame, files: DataFrame, folder: str) -> None:
    order = ["path", "level", "block"]
    key_filter.build(keys, files).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(folder)


def latest_records(spark: SparkSession, table: str, n: int = 100, version: int | None = None) -> DataFrame:
    """The newest ``n`` stored records, opening only files, and of these only row groups,
    that can hold one.

    The lists say how many records every file has of each hour, and the first and last
    one. Taken by falling first record, n entries at most have n records, so no
    record before the first one of these is wanted.
    """
    zones = TableLog(spark, table).entries(version).filter(F.col("kind") == ROWS)
    found, bound = 0, None
    for zone in zones.orderBy(F.desc("first")).limit(n).collect():
        bound = zone["first"]
        found += zone["row_count"]
        if found >= n:
            break
    if bound is None:
        return _read(spark, table, []).select(*schemas.TABLE_ORDER)
    day = _TIME["day"]
    files = zones.filter(F.col("last") >= bound).select("path", F.floor(F.col("last") / day).alias("date")).distinct().collect()
    # The bound's own date by its clock, which reaches the row groups; all of later dates.
    same = _read(spark, table, sorted(r.path for r in files if r.date == bound // day)).filter(_not_before(bound))
    later = _read(spark, table, sorted(r.path for r in files if r.date > bound // day))
    rows = later.unionByName(same) if any(r.date > bound // day for r in files) else same
    return latest(rows.select(*schemas.TABLE_ORDER), n)


def _not_before(bound: int) -> Column:
    """Records of the bound's date from its time on."""
    hour, minute, second = (F.col(c) for c in schemas.RECORDED_PARTS[3:])
    h, m, s = (bound // _TIME[p] % 100 for p in schemas.CLOCK_PARTS)
    return (hour > h) | ((hour == h) & ((minute > m) | ((minute == m) & (second >= s))))


def compact(spark: SparkSession, table: str, date: tuple[int, int, int], open_batches: tuple[str, ...] = ()) -> None:
    """Bring the files of a date together, but those of ``open_batches``, whose records
    are still to be told from others: one version has the new files in the place
    of the old ones. Nothing is deleted."""
    log = TableLog(spark, table)
    base = log.newest()
    files = _row_files(log.entries(base)).filter(_of_dates([date]))
    closed = [r for r in files.collect() if r["batch"] not in open_batches]
    if len({r["batch"] for r in closed}) < 2:
        return
    segment = _segment("compacted")
    _write_rows(_read(spark, table, sorted(r["path"] for r in closed)), table, segment)
    log.commit(base, _described(spark, log, table, segment, segment, _gone(spark, [r["path"] for r in closed])))


def compact_closed(spark: SparkSession, table: str, most_files: int, open_batches: tuple[str, ...] = ()) -> int:
    """Compact every date that has files of more than ``most_files`` closed batches;
    how many there were."""
    files = _row_files(TableLog(spark, table).entries()).filter(~F.col("batch").isin(list(open_batches)))
    crowded = files.groupBy(*_DATE).agg(F.count_distinct("batch").alias("batches")).filter(F.col("batches") > most_files)
    dates = [(r.year, r.month, r.day) for r in crowded.collect()]
    for date in dates:
        compact(spark, table, date, open_batches)
    return len(dates)


def vacuum(spark: SparkSession, table: str, versions: int = 1) -> None:
    """Keep the newest ``versions`` versions and delete what none of them has: files that
    compaction replaced and what broke off before its commit. Call it between the
    batches of the one writer, when no reader needs the versions before."""
    log = TableLog(spark, table)
    kept = log.versions()[-versions:]
    if not kept:
        return
    log.forget(kept[0])
    table = table.rstrip("/")
    rows, segments = set(), set()
    for version in kept:
        files = log.entries(version).filter(F.col("kind") == ROWS)
        for r in files.select(_folder(F.col("path")).alias("folder")).distinct().collect():
            rows.add(r.folder)
            segments.add(r.folder.split("/")[0])
    for segment in [f for f in folders(spark, table) if f.startswith(f"{BATCH}=")]:
        if segment not in segments:
            remove_folder(spark, f"{table}/{segment}")
            remove_folder(spark, _filter_folder(table, segment.split("=", 1)[1]))
            continue
        for folder in _date_folders(spark, table, segment):
            if folder not in rows:
                remove_folder(spark, f"{table}/{folder}")


def _date_folders(spark: SparkSession, table: str, segment: str) -> list[str]:
    found = [segment]
    for _ in schemas.DATE_PARTITION:
        found = [f"{f}/{below}" for f in found for below in folders(spark, f"{table}/{f}")]
    return found
