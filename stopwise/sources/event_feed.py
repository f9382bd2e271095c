"""Raw arrival records derived from the ``events`` table.

One raw record per event, in event order, with gaps, bad times and hours of 24
in fixed places so that every cleaning rule has rows to act on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stopwise import schemas

ARRIVAL = "event_id"


def _text(seconds: str = "0") -> str:
    """``yyyy-MM-dd HH:mm:ss`` of the event's time, shifted; no time zone involved."""
    return f"substr(cast(ts + ({seconds}) * interval '1' second as string), 1, 19)"


def _scheduled() -> str:
    clock = f"substr({_text('event_id % 900')}, 12)"
    return (
        "case when event_id % 17 = 0 then null"
        f" when {clock} like '00%' and event_id % 2 = 0 then concat('24', substr({clock}, 3))"
        f" else {clock} end"
    )


def _expected() -> str:
    return (
        "case when event_id % 7 = 0 then null when event_id % 101 = 0 then 'bad'"
        f" else {_text('event_id % 1200')} end"
    )


def _vehicle(base: float, offset: str) -> str:
    return (
        "case when event_id % 13 = 0 then null"
        f" else cast({base} as double) + {offset} * cast(0.001 as double) end"
    )


def _degrees(base: float, modulus: int) -> str:
    return f"cast({base} as double) + (user_id % {modulus}) * cast(0.01 as double)"


_EXPRESSIONS = {
    "RecordedAtTime": _text(),
    "DirectionRef": "case when event_id % 41 = 0 then null else cast(event_id % 2 as int) end",
    "PublishedLineName": "case when event_id % 29 = 0 then null else concat('L', user_id % 20) end",
    "OriginName": "concat('O', user_id % 10)",
    "OriginLat": _degrees(40.5, 10),
    "OriginLong": _degrees(-74.0, 7),
    "DestinationName": "concat('D', user_id % 9)",
    "DestinationLat": _degrees(40.6, 9),
    "DestinationLong": _degrees(-73.9, 8),
    "VehicleRef": "concat('V', user_id)",
    "VehicleLocation.Latitude": _vehicle(40.5, "value"),
    "VehicleLocation.Longitude": _vehicle(-74.0, "(event_id % 100)"),
    "NextStopPointName": "concat('S', (user_id * 7 + event_id) % 50)",
    "ArrivalProximityText": "case when event_id % 19 = 0 then null else event_type end",
    "DistanceFromStop": "case when event_id % 11 = 0 then null else value end",
    "ExpectedArrivalTime": _expected(),
    "ScheduledArrivalTime": _scheduled(),
}


def raw_records(spark: SparkSession, sf_dir: str, *, with_arrival: bool = False) -> DataFrame:
    """Raw records of the whole ``events`` table, optionally with arrival order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    columns = [f"{_EXPRESSIONS[n]} as `{n}`" for n, _ in schemas.RAW_FIELDS]
    if with_arrival:
        columns.append(ARRIVAL)
    return events.selectExpr(*columns)
