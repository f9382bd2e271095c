"""Small raw and processed records for tests."""

from __future__ import annotations

from stopwise import schemas

RAW_DEFAULTS = {
    "RecordedAtTime": "2017-06-01 00:03:34",
    "DirectionRef": 1,
    "PublishedLineName": "B8",
    "OriginName": "A",
    "OriginLat": 40.0,
    "OriginLong": -74.0,
    "DestinationName": "B",
    "DestinationLat": 41.0,
    "DestinationLong": -73.0,
    "VehicleRef": "V1",
    "VehicleLocation.Latitude": 40.5,
    "VehicleLocation.Longitude": -73.5,
    "NextStopPointName": "S",
    "ArrivalProximityText": "near",
    "DistanceFromStop": 10.0,
    "ExpectedArrivalTime": "2017-06-01 00:05:00",
    "ScheduledArrivalTime": "24:04:00",
}


def raw_frame(spark, *changes: dict, arrival: bool = False):
    names = [n for n, _ in schemas.RAW_FIELDS]
    rows = [tuple((RAW_DEFAULTS | c)[n] for n in names) for c in changes]
    schema = schemas.raw_schema()
    if arrival:
        rows = [(*r, n) for n, r in enumerate(rows)]
        schema = schema.add("arrival", "bigint")
    return spark.createDataFrame(rows, schema)


def table_rows(spark, *changes: dict):
    """Rows of the stored table with ``arrival`` in the given order."""
    defaults = {f.name: "t" if f.name in schemas.TEXT_COLUMNS else 1 for f in schemas.table_schema()}
    doubles = [f.name for f in schemas.table_schema() if f.dataType.typeName() == "double"]
    defaults |= {c: 1.0 for c in doubles}
    rows = [
        (*[(defaults | c)[n] for n in schemas.TABLE_ORDER], c.get("arrival", n))
        for n, c in enumerate(changes)
    ]
    kinds = {c: schemas.processed_type(c).simpleString() for c in schemas.TABLE_ORDER}
    ddl = ", ".join(f"{c} {k}" for c, k in kinds.items())
    return spark.createDataFrame(rows, f"{ddl}, arrival bigint")
