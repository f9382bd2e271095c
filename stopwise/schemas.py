"""Record layouts: the raw arrival record, the processed record, its key."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. Names, order, types, formats and thresholds below are the data
# contract: changing one changes results.

TIMESTAMP_PATTERN = "yyyy-MM-dd HH:mm:ss"

RAW_FIELDS = [
    ("RecordedAtTime", "string"),
    ("DirectionRef", "int"),
    ("PublishedLineName", "string"),
    ("OriginName", "string"),
    ("OriginLat", "double"),
    ("OriginLong", "double"),
    ("DestinationName", "string"),
    ("DestinationLat", "double"),
    ("DestinationLong", "double"),
    ("VehicleRef", "string"),
    ("VehicleLocation.Latitude", "double"),
    ("VehicleLocation.Longitude", "double"),
    ("NextStopPointName", "string"),
    ("ArrivalProximityText", "string"),
    ("DistanceFromStop", "double"),
    ("ExpectedArrivalTime", "string"),
    ("ScheduledArrivalTime", "string"),
]

DOTTED_NAMES = {
    "VehicleLocation.Latitude": "VehicleLocation_Latitude",
    "VehicleLocation.Longitude": "VehicleLocation_Longitude",
}

ARRIVAL_TIMES = ["ExpectedArrivalTime", "ScheduledArrivalTime"]

TEXT_COLUMNS = [
    "PublishedLineName",
    "OriginName",
    "DestinationName",
    "VehicleRef",
    "NextStopPointName",
    "ArrivalProximityText",
]

TIMESTAMP_PARTS = ["year", "month", "day", "hour", "minute", "second"]
CLOCK_PARTS = ["hour", "minute", "second"]

COORDINATES = {
    "OriginCoordinates": ("OriginLat", "OriginLong"),
    "DestinationCoordinates": ("DestinationLat", "DestinationLong"),
    "VehicleCoordinates": ("VehicleLocation_Latitude", "VehicleLocation_Longitude"),
}

MAX_TEXT_LENGTH = 255
CORRELATION_THRESHOLD = 0.9
CORRELATION_EXEMPT = ["Delay", "VehicleRef", "NextStopPointName"]

DEFAULT_TOPIC = "bus_traffic_data"
DEFAULT_TABLE = "bus_traffic_processed"
# ---------------------------------------------------------------------------

RECORDED_PARTS = [f"RecordedAtTime_{p}" for p in TIMESTAMP_PARTS]
EXPECTED_PARTS = [f"ExpectedArrivalTime_{p}" for p in TIMESTAMP_PARTS]
SCHEDULED_PARTS = [f"ScheduledArrivalTime_{p}" for p in CLOCK_PARTS]

# Order the columns have after cleaning. Feature selection depends on it: of
# two correlated columns the later one goes.
FEATURE_ORDER = (
    ["DirectionRef"]
    + TEXT_COLUMNS
    + ["DistanceFromStop"]
    + RECORDED_PARTS
    + EXPECTED_PARTS
    + SCHEDULED_PARTS
    + ["Delay"]
    + list(COORDINATES)
)

# Order of the stored table.
TABLE_ORDER = (
    RECORDED_PARTS
    + EXPECTED_PARTS
    + SCHEDULED_PARTS
    + [
        "DirectionRef",
        "PublishedLineName",
        "OriginName",
        "OriginCoordinates",
        "DestinationName",
        "DestinationCoordinates",
        "VehicleRef",
        "VehicleCoordinates",
        "NextStopPointName",
        "ArrivalProximityText",
        "DistanceFromStop",
        "Delay",
    ]
)

KEY = RECORDED_PARTS + list(COORDINATES) + ["DistanceFromStop", "Delay"]

# The stored table is partitioned by recorded date, which is part of the key.
DATE_PARTITION = RECORDED_PARTS[:3]

_DOUBLES = [*COORDINATES, "DistanceFromStop", "Delay"]

_TYPES = {"string": T.StringType, "int": T.IntegerType, "double": T.DoubleType}


def raw_schema() -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]()) for n, t in RAW_FIELDS])


def processed_type(name: str) -> T.DataType:
    if name in TEXT_COLUMNS:
        return T.StringType()
    return T.DoubleType() if name in _DOUBLES else T.IntegerType()


def table_schema() -> T.StructType:
    """Schema of the stored table, key columns not nullable."""
    return T.StructType(
        [T.StructField(n, processed_type(n), n not in KEY) for n in TABLE_ORDER]
    )
