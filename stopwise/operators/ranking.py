"""Newest records first, with a total order so that results are repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise import schemas

_TIE_BREAK = [c for c in schemas.KEY if c not in schemas.RECORDED_PARTS]


def newest_first() -> list[Column]:
    return [F.desc(c) for c in schemas.RECORDED_PARTS] + [F.asc(c) for c in _TIE_BREAK]


def oldest_first() -> list[Column]:
    return [F.asc(c) for c in schemas.RECORDED_PARTS] + [F.desc(c) for c in _TIE_BREAK]


def latest(records: DataFrame, n: int = 100) -> DataFrame:
    """The newest ``n`` records by recorded time; a top-n per task, no full sort."""
    return records.orderBy(*newest_first()).limit(n)


def oldest_of_latest(records: DataFrame, n: int = 100, keep: int = 5) -> DataFrame:
    """The last ``keep`` of the newest ``n`` records."""
    return latest(records, n).orderBy(*oldest_first()).limit(keep)
