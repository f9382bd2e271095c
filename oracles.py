"""DuckDB SQL giving the results the registered queries must match."""

from __future__ import annotations

# The contract, spelled out here once more: a wrong list in the package must not
# agree with itself. Fixed values.
RECORDED_PARTS = [
    "RecordedAtTime_year",
    "RecordedAtTime_month",
    "RecordedAtTime_day",
    "RecordedAtTime_hour",
    "RecordedAtTime_minute",
    "RecordedAtTime_second",
]
EXPECTED_PARTS = [
    "ExpectedArrivalTime_year",
    "ExpectedArrivalTime_month",
    "ExpectedArrivalTime_day",
    "ExpectedArrivalTime_hour",
    "ExpectedArrivalTime_minute",
    "ExpectedArrivalTime_second",
]
SCHEDULED_PARTS = [
    "ScheduledArrivalTime_hour",
    "ScheduledArrivalTime_minute",
    "ScheduledArrivalTime_second",
]
TEXT_COLUMNS = [
    "PublishedLineName",
    "OriginName",
    "DestinationName",
    "VehicleRef",
    "NextStopPointName",
    "ArrivalProximityText",
]
TIMESTAMP_PARTS = ["year", "month", "day", "hour", "minute", "second"]
COORDINATES = {
    "OriginCoordinates": ("OriginLat", "OriginLong"),
    "DestinationCoordinates": ("DestinationLat", "DestinationLong"),
    "VehicleCoordinates": ("VehicleLocation_Latitude", "VehicleLocation_Longitude"),
}
MAX_TEXT_LENGTH = 255
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
    ("VehicleLocation_Latitude", "double"),
    ("VehicleLocation_Longitude", "double"),
    ("NextStopPointName", "string"),
    ("ArrivalProximityText", "string"),
    ("DistanceFromStop", "double"),
    ("ExpectedArrivalTime", "string"),
    ("ScheduledArrivalTime", "string"),
]
KEY = [
    "RecordedAtTime_year",
    "RecordedAtTime_month",
    "RecordedAtTime_day",
    "RecordedAtTime_hour",
    "RecordedAtTime_minute",
    "RecordedAtTime_second",
    "OriginCoordinates",
    "DestinationCoordinates",
    "VehicleCoordinates",
    "DistanceFromStop",
    "Delay",
]
TABLE_ORDER = [
    "RecordedAtTime_year",
    "RecordedAtTime_month",
    "RecordedAtTime_day",
    "RecordedAtTime_hour",
    "RecordedAtTime_minute",
    "RecordedAtTime_second",
    "ExpectedArrivalTime_year",
    "ExpectedArrivalTime_month",
    "ExpectedArrivalTime_day",
    "ExpectedArrivalTime_hour",
    "ExpectedArrivalTime_minute",
    "ExpectedArrivalTime_second",
    "ScheduledArrivalTime_hour",
    "ScheduledArrivalTime_minute",
    "ScheduledArrivalTime_second",
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
FEATURE_ORDER = [
    "DirectionRef",
    "PublishedLineName",
    "OriginName",
    "DestinationName",
    "VehicleRef",
    "NextStopPointName",
    "ArrivalProximityText",
    "DistanceFromStop",
    "RecordedAtTime_year",
    "RecordedAtTime_month",
    "RecordedAtTime_day",
    "RecordedAtTime_hour",
    "RecordedAtTime_minute",
    "RecordedAtTime_second",
    "ExpectedArrivalTime_year",
    "ExpectedArrivalTime_month",
    "ExpectedArrivalTime_day",
    "ExpectedArrivalTime_hour",
    "ExpectedArrivalTime_minute",
    "ExpectedArrivalTime_second",
    "ScheduledArrivalTime_hour",
    "ScheduledArrivalTime_minute",
    "ScheduledArrivalTime_second",
    "Delay",
    "OriginCoordinates",
    "DestinationCoordinates",
    "VehicleCoordinates",
]

_FULL = "'%Y-%m-%d %H:%M:%S'"
_EXPECTED_AT = "(ts + to_seconds(event_id % 1200))"
_SCHEDULED_AT = "(ts + to_seconds(event_id % 900))"

_RAW = f"""
 strftime(ts, {_FULL}) as RecordedAtTime,
 case when event_id%41=0 then null else cast(event_id%2 as int) end as DirectionRef,
 case when event_id%29=0 then null else concat('L',cast(user_id%20 as varchar)) end as PublishedLineName,
 concat('O',cast(user_id%10 as varchar)) as OriginName,
 cast(40.5 as double)+(user_id%10)*cast(0.01 as double) as OriginLat,
 cast(-74.0 as double)+(user_id%7)*cast(0.01 as double) as OriginLong,
 concat('D',cast(user_id%9 as varchar)) as DestinationName,
 cast(40.6 as double)+(user_id%9)*cast(0.01 as double) as DestinationLat,
 cast(-73.9 as double)+(user_id%8)*cast(0.01 as double) as DestinationLong,
 concat('V',cast(user_id as varchar)) as VehicleRef,
 case when event_id%13=0 then null
      else cast(40.5 as double)+value*cast(0.001 as double) end as VehicleLocation_Latitude,
 case when event_id%13=0 then null
      else cast(-74.0 as double)+(event_id%100)*cast(0.001 as double) end as VehicleLocation_Longitude,
 concat('S',cast((user_id*7+event_id)%50 as varchar)) as NextStopPointName,
 case when event_id%19=0 then null else event_type end as ArrivalProximityText,
 case when event_id%11=0 then null else value end as DistanceFromStop,
 case when event_id%7=0 then null when event_id%101=0 then 'bad'
      else strftime({_EXPECTED_AT}, {_FULL}) end as ExpectedArrivalTime,
 case when event_id%17=0 then null
      when strftime({_SCHEDULED_AT},'%H')='00' and event_id%2=0
        then concat('24',strftime({_SCHEDULED_AT},':%M:%S'))
      else strftime({_SCHEDULED_AT},'%H:%M:%S') end as ScheduledArrivalTime
"""

BUS = f"bus as (select event_id as arrival, {_RAW} from events)"

# Every third event comes a second time, after all others and with other text.
REDELIVERED = f"""
 once as (select event_id as arrival, {_RAW} from events),
 bus as (select * from once union all by name
         select * replace (arrival + 1000000000000 as arrival, 'again' as ArrivalProximityText)
         from once where arrival % 3 = 0)
"""

# Over-long text, times with a line break behind them, and messages that are none.
ODD_BUS = f"""
 odd as (select event_id as arrival, {_RAW} from events where event_id % 37 != 0),
 bus as (select * replace (case when arrival % 23 = 0 then repeat('x', 300) else VehicleRef end as VehicleRef,
   case when arrival % 31 = 0 then null else RecordedAtTime end as RecordedAtTime) from odd)
"""

# Lines with a field too many go, missing fields and tokens for missing values are null.
CSV_RULES = """
 select event_id as a,
  case when event_id % 17 = 0 or (event_id % 11 = 0 and event_id % 4 >= 2) then null
       when event_id % 19 = 0 then 'x, "' || event_type || chr(10) || 'y' else event_type end as b,
  case when event_id % 11 = 0 and event_id % 4 < 2 then null else value end as c
 from events where event_id % 13 != 0
"""

COMPLETE = """
 complete as (select * from bus where ExpectedArrivalTime is not null and ScheduledArrivalTime is not null)
"""

_RAW_NUMBERS = [n for n, t in RAW_FIELDS if t != "string"]
_RAW_DOUBLES = [n for n, t in RAW_FIELDS if t == "double"]
RAW_NAMES = [n for n, _ in RAW_FIELDS]


def _mean(column: str) -> str:
    mean = f"avg({column}) over ()"
    if column == "DirectionRef":
        mean = f"cast(trunc({mean}) as int)"
    return f"coalesce({column}, {mean})"


_IMPUTED = ", ".join(f"{_mean(c)} as {c}" for c in _RAW_NUMBERS)

IMPUTED = f"imputed as (select * replace ({_IMPUTED}) from complete)"

_STAMPS = f"""
 try_strptime(RecordedAtTime, {_FULL}) as rts, try_strptime(ExpectedArrivalTime, {_FULL}) as ets,
 try_cast(substr(ScheduledArrivalTime,1,2) as int) as sh,
 try_cast(substr(ScheduledArrivalTime,4,2) as int) as sm,
 try_cast(substr(ScheduledArrivalTime,7,2) as int) as ss
"""


def _part(stamp: str, part: str) -> str:
    return f"cast(floor(extract({part} from {stamp})) as int)"


_RECORDED = ", ".join(f"{_part('rts', p)} as RecordedAtTime_{p}" for p in TIMESTAMP_PARTS)
_EXPECTED = ", ".join(
    f"{_part('ets', p)} as ExpectedArrivalTime_{p}" for p in TIMESTAMP_PARTS
)
_SCHEDULED = f"""
 case when sh=24 or (sh=23 and {_part('ets', 'hour')}=0) then sh-24 else sh end as ScheduledArrivalTime_hour,
 sm as ScheduledArrivalTime_minute, ss as ScheduledArrivalTime_second
"""
_TEXT = ", ".join(f"coalesce({c}, '') as {c}" for c in TEXT_COLUMNS)
_SUMS = ", ".join(f"{lat} + {long} as {name}" for name, (lat, long) in COORDINATES.items())
_DELAY = """
 (ExpectedArrivalTime_hour*3600+ExpectedArrivalTime_minute*60+ExpectedArrivalTime_second)
 -(ScheduledArrivalTime_hour*3600+ScheduledArrivalTime_minute*60+ScheduledArrivalTime_second) as Delay
"""


def processed(source: str) -> str:
    return f"""
 stamped as (select *, {_STAMPS} from {source}),
 parts as (select arrival, DirectionRef, {_TEXT}, DistanceFromStop, {_RECORDED}, {_EXPECTED},
           {_SCHEDULED}, {_SUMS} from stamped),
 processed as (select *, {_DELAY} from parts)
"""


_KEY = ", ".join(KEY)
_NULL_KEY = " or ".join(f"{c} is null" for c in KEY)
_TOO_LONG = " or ".join(f"length({c}) > {MAX_TEXT_LENGTH}" for c in TEXT_COLUMNS)
_TABLE = ", ".join(
    "cast(Delay as double) as Delay" if c == "Delay" else c for c in TABLE_ORDER
)

CLASSIFIED = f"""
 checked as (select *, case when {_NULL_KEY} then 'null key'
                            when {_TOO_LONG} then 'text too long' end as broken from processed),
 ranked as (select *, row_number() over (partition by broken, {_KEY} order by arrival) as place from checked),
 classified as (select arrival, {_TABLE},
   case when broken is not null then broken when place > 1 then 'duplicate key' end as reason from ranked),
 accepted as (select * exclude (arrival, reason) from classified where reason is null)
"""

_TABLE_NAMES = ", ".join(TABLE_ORDER)
_TIES = [c for c in KEY if c not in RECORDED_PARTS]
_NEWEST = ", ".join([f"{c} desc" for c in RECORDED_PARTS] + [f"{c} asc" for c in _TIES])
_OLDEST = ", ".join([f"{c} asc" for c in RECORDED_PARTS] + [f"{c} desc" for c in _TIES])

_LONG_LABELS = " union all ".join(
    f"select '{c}' as column_name, {c} as label from accepted" for c in TEXT_COLUMNS
)
LABELS = f"""
 long as ({_LONG_LABELS}),
 counts as (select column_name, label, count(*) as label_count from long group by all),
 labels as (select *, cast(row_number() over (partition by column_name
     order by label_count desc, label) - 1 as bigint) as label_index from counts)
"""

# The split: eight hexadecimal digits of the MD5 of seed and key, modulo 5.
SPLIT = """
 drawn as (select *, ('0x' || substr(md5(concat_ws('|', '16',
   RecordedAtTime_year, RecordedAtTime_month, RecordedAtTime_day,
   RecordedAtTime_hour, RecordedAtTime_minute, RecordedAtTime_second,
   cast(floor(OriginCoordinates * 1000000) as bigint), cast(floor(DestinationCoordinates * 1000000) as bigint),
   cast(floor(VehicleCoordinates * 1000000) as bigint), cast(floor(DistanceFromStop * 1000000) as bigint),
   cast(floor(Delay * 1000000) as bigint))), 1, 8))::bigint % 5 as fifth from accepted),
 training as (select * exclude (fifth) from drawn where fifth < 4),
 held_out as (select * exclude (fifth) from drawn where fifth = 4)
"""

_DOUBLES = ", ".join(f"try_cast({c} as double) as {c}" for c in FEATURE_ORDER)
_POSITIONS = ", ".join(f"({n}, '{c}')" for n, c in enumerate(FEATURE_ORDER))
_VALUES = " union all ".join(
    f"select arrival, {n} as i, {c} as v from doubles where {c} is not null"
    for n, c in enumerate(FEATURE_ORDER)
)
_NAMED = f"(values {_POSITIONS})"

PAIRS = f"""
 doubles as (select arrival, {_DOUBLES} from processed),
 filled as ({_VALUES}),
 shared as (select a.i as i, b.i as j, a.v as x, b.v as y from filled a join filled b
            on a.arrival = b.arrival and a.i < b.i),
 pairs as (select i, j, x.name as column_i, y.name as column_j, count(*) as pair_rows,
   case when stddev_samp(shared.x) > 0 and stddev_samp(shared.y) > 0
        then abs(corr(shared.x, shared.y)) end as r
   from shared join {_NAMED} x(place, name) on x.place = i join {_NAMED} y(place, name) on y.place = j group by all),
 chosen as (select distinct column_j as column_name from pairs
   where r > 0.9 and column_j not in ('Delay', 'VehicleRef', 'NextStopPointName'))
"""

_ROUNDED = {*COORDINATES, "DistanceFromStop"}


def _analysis_column(name: str) -> str:
    return f"round({name}, 6)" if name in _ROUNDED else name


def _select(columns: list[str]) -> str:
    return ", ".join(columns)


def _with(*parts: str) -> str:
    return "with " + ", ".join(parts)


_PROCESSED_PLAIN = (BUS, COMPLETE, processed("complete"))
_PROCESSED_IMPUTED = (BUS, COMPLETE, IMPUTED, processed("imputed"))
_ACCEPTED = (*_PROCESSED_PLAIN, CLASSIFIED)
_REDELIVERED = (REDELIVERED, COMPLETE, processed("complete"), CLASSIFIED)

_FEATURES = _select(FEATURE_ORDER)
_RAW_LIST = _select(RAW_NAMES)
_ANALYSIS_LIST = _select([f"{_analysis_column(c)} as {c}" for c in FEATURE_ORDER])
_SELECTED_LIST = _select(
    [
        f"case when '{c}' not in (select column_name from chosen) then {_analysis_column(c)} end as {c}"
        for c in FEATURE_ORDER
    ]
)
_COUNT_ROWS = " union all ".join(
    f"select '{c}' as column_name, count(*) as row_count, count({c}) as value_count from doubles"
    for c in FEATURE_ORDER
)
_NUMERIC = [c for c in FEATURE_ORDER if c not in TEXT_COLUMNS]


def _code(column: str) -> str:
    count = f"(select count(*) from labels where column_name = '{column}')"
    code = f"(select label_index from labels where column_name = '{column}' and label = {column})"
    return f"cast(coalesce({code}, {count}) as double) as {column}_indexed"


def _feature(column: str) -> str:
    if column in TEXT_COLUMNS:
        return f"{_code(column).removesuffix(f' as {column}_indexed')} as feature_{column}_indexed_feature"
    mean = f"(select avg(cast({column} as double)) from training)"
    return f"round(coalesce(cast({column} as double), {mean}), 6) as feature_{column}_feature"


_VALUED = " union all ".join(
    f"select '{c}' as column_name, count({c}) as value_count from training" for c in TABLE_ORDER
)
# Pairs over the stored records, numbered as rows.
STORED_PAIRS = f"""
 numbered as (select *, row_number() over () as arrival from accepted),
 {PAIRS.replace("from processed", "from numbered")}
"""


# Versions of a table stored in batches: even arrivals, odd ones, even ones again; then
# a compaction, which changes nothing.
BATCHES = f"""
 versions as (select 1 as version union all select 2 union all select 3 union all select 4),
 delivered as (select *, arrival % 2 as half from checked),
 ordered as (select *, row_number() over (partition by broken, {_KEY} order by half, arrival) as turn from delivered),
 kept as (select * from ordered where broken is null and turn = 1),
 refused as (select half, count(*) as n from ordered where broken is not null or turn > 1 group by half),
 again as (select count(*) as n from checked where arrival % 2 = 0),
 refusals as (select version, cast((select coalesce(sum(n), 0) from refused where half < version)
   + case when version > 2 then (select n from again) else 0 end as bigint) as rejects from versions)
"""
_STORED = ", ".join("cast(Delay as double) as Delay" if c == "Delay" else c for c in KEY)
_NUMBERS = [c for c in TABLE_ORDER if c not in TEXT_COLUMNS]
_MEANS = " union all ".join(
    f"select '{c}' as column_name, count({c}) as value_count, round(avg(cast({c} as double)), 6) as mean from accepted"
    for c in _NUMBERS
)


def oracle_sql() -> dict[str, str]:
    accepted = f"{_with(*_ACCEPTED)} select {_TABLE_NAMES} from accepted"
    redelivered = f"{_with(*_REDELIVERED)} select {_TABLE_NAMES} from accepted"
    latest = f"{accepted} order by {_NEWEST} limit 100"
    raw = f"{_with(BUS)} select {_RAW_LIST} from bus"
    return {
        "json_round_trip": raw,
        "csv_round_trip": raw,
        "drop_incomplete": f"{_with(BUS, COMPLETE)} select {_RAW_LIST} from complete",
        "timestamp_parts": f"""{_with(*_PROCESSED_PLAIN)} select arrival,
            {_select(RECORDED_PARTS + EXPECTED_PARTS)} from processed""",
        "scheduled_parts": f"""{_with(*_PROCESSED_PLAIN)} select arrival,
            {_select(SCHEDULED_PARTS)} from processed""",
        "delay_seconds": f"""{_with(*_PROCESSED_PLAIN)} select VehicleRef, {_select(RECORDED_PARTS)},
            ExpectedArrivalTime_hour, ScheduledArrivalTime_hour, Delay from processed""",
        "coordinate_sums": f"{_with(BUS)} select arrival, {_SUMS} from bus",
        "impute_numeric_mean": f"""{_with(BUS, COMPLETE, IMPUTED)} select arrival, DirectionRef,
            {_select([f'round({c}, 6) as {c}' for c in _RAW_DOUBLES])} from imputed""",
        "impute_text_empty": f"{_with(BUS, COMPLETE)} select arrival, {_TEXT} from complete",
        "processed_records": f"{_with(*_PROCESSED_PLAIN)} select {_FEATURES} from processed",
        "processed_records_imputed": f"""{_with(*_PROCESSED_IMPUTED)}
            select {_ANALYSIS_LIST} from processed""",
        "csv_rules": CSV_RULES,
        "stored_rejects": f"""{_with(ODD_BUS, COMPLETE, processed("complete"), CLASSIFIED)}
            select arrival, reason, cast(null as varchar) as message from classified where reason is not null
            union all select event_id, 'undecodable', 'broken ' || event_id from events where event_id % 37 = 0""",
        "sink_accepted": accepted,
        "sink_rejects": f"""{_with(*_ACCEPTED)} select {_TABLE_NAMES}, arrival, reason
            from classified where reason is not null""",
        "redelivery_accepted": redelivered,
        "redelivery_rejects": f"""{_with(*_REDELIVERED)} select {_TABLE_NAMES}, arrival, reason
            from classified where reason is not null""",
        "stream_ingest": accepted,
        "stream_redelivery": redelivered,
        "stream_pace": f"""{_with(*_ACCEPTED)} select arrival % 2 as batch, count(*) as messages,
            (select count(*) from classified c where c.arrival % 2 = bus.arrival % 2 and reason is null) as accepted,
            (select count(*) from classified c where c.arrival % 2 = bus.arrival % 2 and reason is not null) as rejected
            from bus group by all""",
        "correlation_pairs": f"""{_with(*_PROCESSED_IMPUTED, PAIRS)} select cast(i as int) as i,
            cast(j as int) as j, column_i, column_j, pair_rows, round(r, 6) as r from pairs""",
        "correlated_columns": f"""{_with(*_PROCESSED_IMPUTED, PAIRS)}
            select column_name from chosen""",
        "selected_features": f"""{_with(*_PROCESSED_IMPUTED, PAIRS)}
            select {_SELECTED_LIST} from processed""",
        "double_casts": f"{_with(*_PROCESSED_PLAIN)} select {_DOUBLES} from processed",
        "null_column_counts": f"""{_with(*_PROCESSED_PLAIN)},
            doubles as (select {_DOUBLES} from processed) {_COUNT_ROWS}""",
        "drop_empty_columns": f"""{_with(*_PROCESSED_PLAIN)},
            doubles as (select {_DOUBLES} from processed) select {_select(_NUMERIC)} from doubles""",
        "drop_empty_rows": f"""{_with(BUS)} select DistanceFromStop, ExpectedArrivalTime,
            ScheduledArrivalTime from bus where not (DistanceFromStop is null
            and ExpectedArrivalTime is null and ScheduledArrivalTime is null)""",
        "latest_n": latest,
        "latest_stored": latest,
        "records_at_version": f"""{_with(*_ACCEPTED, BATCHES)} select {_STORED}, version, rejects
            from kept join refusals on half < version""",
        "stored_count": f"{_with(*_ACCEPTED)} select count(*) as record_count from accepted",
        "history_means": f"{_with(*_ACCEPTED)} {_MEANS}",
        "history_pairs": f"""{_with(*_ACCEPTED, STORED_PAIRS)} select cast(i as int) as i,
            cast(j as int) as j, column_i, column_j, pair_rows, round(r, 6) as r from pairs""",
        "history_labels": f"{_with(*_ACCEPTED, LABELS)} select * from labels",
        "oldest_of_latest": f"""{_with(*_ACCEPTED)}, newest as (select {_TABLE_NAMES} from accepted
            order by {_NEWEST} limit 100) select * from newest order by {_OLDEST} limit 5""",
        "label_index": f"{_with(*_ACCEPTED, LABELS)} select * from labels",
        "label_encode": f"""{_with(*_ACCEPTED, LABELS)} select {_TABLE_NAMES},
            {_select([_code(c) for c in TEXT_COLUMNS])} from accepted""",
        "training_split": f"""{_with(*_ACCEPTED, SPLIT)} select {_KEY},
            case when fifth < 4 then 'training' else 'held out' end as part from drawn""",
        "training_features": f"""{_with(*_ACCEPTED, SPLIT, STORED_PAIRS)}, valued as ({_VALUED})
            select column_name from valued where value_count > 0 and column_name != 'Delay'
            and column_name not in (select column_name from chosen)""",
        "feature_matrix": f"""{_with(*_ACCEPTED, LABELS, SPLIT)} select {_KEY},
            {_select([_feature(c) for c in TABLE_ORDER if c != 'Delay'])} from accepted""",
        "train_and_score": f"""{_with(*_ACCEPTED, SPLIT)} select {_KEY}, true as scored,
            true as within_labels, true as same_when_loaded, true as beats_mean from held_out""",
        "first_report": f"""{_with(*_ACCEPTED)}, newest as (select {_TABLE_NAMES} from accepted
            order by {_NEWEST} limit 100), last as (select * from newest order by {_OLDEST} limit 5)
            select VehicleRef as "Vehicle Reference", NextStopPointName as "Next Stop Point",
            true as within_labels from last""",
        "rescore_latest": f"""{_with(*_ACCEPTED)}, newest as (select {_TABLE_NAMES} from accepted
            order by {_NEWEST} limit 5) select VehicleRef as "Vehicle Reference",
            NextStopPointName as "Next Stop Point", true as within_labels from newest""",
        "record_count": f"{_with(*_ACCEPTED)} select count(*) as record_count from accepted",
        "readiness_gate": f"{_with(*_ACCEPTED)} select count(*) >= 20 as ready from accepted",
        "predicted_minutes": f"""{_with(*_ACCEPTED)} select VehicleRef as "Vehicle Reference",
            NextStopPointName as "Next Stop Point",
            cast(floor(Delay / 60) as int) as "Predicted Delay (minutes)" from accepted""",
    }
