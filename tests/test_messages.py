import json

from records import RAW_DEFAULTS, raw_frame

from stopwise import schemas
from stopwise.sources import messages


def _decode(spark, *values):
    return messages.decode_messages(spark.createDataFrame([(v,) for v in values], "value string"))


def test_messages_carry_every_field(spark):
    value = messages.encode_messages(raw_frame(spark, {"OriginName": None})).first().value
    assert json.loads(value) == RAW_DEFAULTS | {"OriginName": None}


def test_round_trip(spark):
    raw = raw_frame(spark, {}, {"OriginName": None, "DirectionRef": None}, {"VehicleRef": 'a"b,\n'})
    back = messages.decode_messages(messages.encode_messages(raw))
    assert back.schema == schemas.raw_schema()
    assert back.collect() == raw.collect()


def test_binary_values_and_carried_columns(spark):
    df = messages.encode_messages(raw_frame(spark, {})).selectExpr("cast(value as binary) value", "7L arrival")
    row = messages.decode_messages(df, keep=("arrival",)).first()
    assert (row.arrival, row.VehicleRef) == (7, "V1")


def test_decoding_is_lenient(spark):
    rows = _decode(
        spark,
        '{"OriginLat": 2}',
        '{"DirectionRef": 1.0, "VehicleRef": "V"}',
        '{"OriginName": "A", "unknown": 1}',
        '{"OriginLat": "x", "OriginName": "A", "DirectionRef": 1.5}',
        "{bad",
        "{}",
        None,
    ).collect()
    assert rows[0].OriginLat == 2.0
    assert rows[1].DirectionRef == 1 and rows[1].VehicleRef == "V"
    assert rows[2].OriginName == rows[3].OriginName == "A" and rows[3].DirectionRef is None
    assert all(v is None for r in rows[4:] for v in r)


def test_undecodable(spark):
    decoded = _decode(spark, '{"VehicleRef": "V"}', "{bad", None, "[]")
    assert decoded.filter(messages.is_undecodable()).count() == 3


def test_topic_options():
    plain = messages.topic_options("host:9092")
    assert plain["startingOffsets"] == "earliest"
    assert plain["subscribe"] == schemas.DEFAULT_TOPIC
    assert "maxOffsetsPerTrigger" not in plain
    assert messages.topic_options("h", "t", max_per_trigger=5)["maxOffsetsPerTrigger"] == "5"
    assert messages.topic_options("h", "t", min_partitions=64)["minPartitions"] == "64"


def test_topic_arrival_orders_by_partition_and_offset(spark):
    rows = [(1, 0), (0, 5), (0, 2**40), (1, 7)]
    df = spark.createDataFrame(rows, "partition int, offset bigint")
    ordered = df.withColumn("a", messages.topic_arrival()).orderBy("a").collect()
    assert [(r.partition, r.offset) for r in ordered] == sorted(rows)
    assert len({r.a for r in ordered}) == 4
