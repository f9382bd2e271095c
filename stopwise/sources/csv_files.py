"""CSV scan: header row, overlong lines skipped, NA tokens read as null."""

from __future__ import annotations

import csv
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopwise import schemas
from stopwise.functions.scalars import whole_number
from stopwise.sources import csv_ranges

# Text that stands for a missing value.
NA_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

_LINE = "_irregular_line"


def _field_count(line: Column) -> Column:
    """Fields in a CSV line; commas inside quotes do not separate."""
    unquoted = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(F.regexp_replace(unquoted, "[^,]", "")) + 1


def null_na_tokens(column: Column) -> Column:
    return F.when(~column.isin(NA_TOKENS), column)


def _typed(column: Column, type_name: str) -> Column:
    value = null_na_tokens(column)
    if type_name == "int":
        return whole_number(value.try_cast("double"))
    return value.try_cast(type_name)


def _place(uri: str) -> str:
    """A file's path as readers take it, one spelling for each file."""
    return re.sub("^file:/+", "file:/", unquote(uri))


def _headers(spark: SparkSession, files: list[str]) -> list:
    """Of every file with a line: its first line that is not blank (``header``), whether
    that one ends inside quotes, how many lines are before it, and whether any
    line ends inside quotes (``spans``). One job for all files."""
    lines = csv_ranges.text_lines(spark, files).withColumn("n", F.monotonically_increasing_id())
    order = F.struct("start", "n")
    filled = F.when(F.length(F.trim("value")) > 0, order)
    found = lines.groupBy("file").agg(
        F.min_by("value", filled).alias("header"),
        F.min_by("from_outside", filled).alias("open"),
        (F.min(filled)["n"] - F.min(order)["n"]).alias("before"),
        F.max("from_outside").alias("spans"),
    )
    return found.filter("header is not null").collect()


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, named by each file's own header.

    Lines with too many fields are skipped, short lines are kept and filled
    with nulls. Every file is split into ranges, also one in which quotes hold line
    breaks (``csv_ranges``). Columns that a file lacks are null. Files without a
    line are left out; a folder without any has no columns.
    """
    files = spark.read.text(path).inputFiles()
    looked = _headers(spark, [_place(f) for f in files]) if files else []
    plain: dict[str, list[str]] = {}
    for file in looked:
        if not file.spans:
            plain.setdefault(file.header, []).append(_place(file.file))
    parts = [_read_alike(spark, some) for _, some in sorted(plain.items())]
    spanning = [f for f in looked if f.spans]
    if spanning:
        parts += _read_spanning(spark, spanning)
    if not parts:
        return spark.createDataFrame([], T.StructType([]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _read_spanning(spark: SparkSession, looked: list) -> list[DataFrame]:
    """Files with records that span lines, one frame for each header."""
    records = csv_ranges.records(spark, [_place(f.file) for f in looked])
    at = {f.file: (f.header, f.before) for f in looked}
    if long_headers := [f.file for f in looked if f.open]:  # the header itself spans lines
        first = records.filter(F.col("file").isin(long_headers)).groupBy("file")
        for r in first.agg(F.min_by("record", F.struct("start", "place")).alias("header")).collect():
            at[r.file] = (r.header, at[r.file][1])
    alike: dict[tuple[str, int], list[str]] = {}
    for file, header in at.items():
        alike.setdefault(header, []).append(file)
    frames = []
    for (header, before), some in sorted(alike.items()):
        own = records.filter(F.col("file").isin(some) & ((F.col("start") > 0) | (F.col("place") != before)))
        names = _safe_names(next(csv.reader([header])))
        parsed = F.from_csv("record", _schema(names), _OPTIONS | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _LINE})
        frames.append(_without_long_lines(own.select(parsed.alias("fields")).select("fields.*"), names))
    return frames


def _safe_names(header: list[str]) -> list[str]:
    """Names as Spark's reader gives them: empty ones by their place, repeated ones with it."""
    lowered = [n.lower() for n in header]
    named = [f"_c{i}" if not n.strip() else f"{n}{i}" if lowered.count(n.lower()) > 1 else n for i, n in enumerate(header)]
    return named


def _schema(names: list[str]) -> str:
    quoted = [f"`{n.replace('`', '``')}`" for n in [*names, _LINE]]
    return ", ".join(f"{q} string" for q in quoted)


_OPTIONS = {"escape": '"'}


def _without_long_lines(lines: DataFrame, names: list[str]) -> DataFrame:
    last = F.col(f"`{names[-1].replace('`', '``')}`")
    short = last.isNull() & (_field_count(F.col(_LINE)) < len(names))
    return lines.filter(F.col(_LINE).isNull() | short).drop(_LINE)


def _read_alike(spark: SparkSession, files: list[str]) -> DataFrame:
    """Files of one header, without records that span lines."""
    names = spark.read.options(**_OPTIONS, header=True).csv(files[0]).columns
    settings = {"header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _LINE, "columnPruning": False}
    return _without_long_lines(spark.read.schema(_schema(names)).options(**_OPTIONS, **settings).csv(files), names)


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw records from CSV; values that do not fit their type become null."""
    text = read_text_csv(spark, path)
    columns = []
    for name, type_name in schemas.RAW_FIELDS:
        if name in text.columns:
            columns.append(_typed(F.col(f"`{name}`"), type_name).alias(name))
        else:
            columns.append(F.lit(None).cast(type_name).alias(name))
    return text.select(*columns)
