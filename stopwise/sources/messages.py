"""Records as JSON messages: encoding, decoding, topics and message files."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.functions.scalars import whole_number

_PARTITION_SHIFT = 48  # offsets stay far below 2^48


def encode_messages(records: DataFrame) -> DataFrame:
    """One JSON ``value`` per row with every field, nulls included; no key."""
    row = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    return records.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))


def decode_messages(messages: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw record fields from the JSON ``value``, plus the ``keep`` columns.

    Missing or unfitting fields become null, extra ones are ignored; 1.0 fits an
    integer, as a producer writes it whose column has gaps. Broken
    text gives a record of nulls, see ``is_undecodable``.
    """
    wide = ", ".join(f"`{n}` {'double' if t == 'int' else t}" for n, t in schemas.RAW_FIELDS)
    record = F.from_json(F.col("value").cast("string"), wide)
    parsed = messages.select(record.alias("record"), *keep)
    fields = []
    for name, kind in schemas.RAW_FIELDS:
        field = F.col(f"record.`{name}`")
        fields.append((whole_number(field) if kind == "int" else field).alias(name))
    return parsed.select(*fields, *keep)


def is_undecodable() -> Column:
    """True for a decoded record without a single value."""
    return reduce(and_, [F.col(f"`{n}`").isNull() for n, _ in schemas.RAW_FIELDS])


def topic_arrival() -> Column:
    """Arrival order of topic messages as one number: partition, then offset."""
    partition = F.shiftleft(F.col("partition").cast("bigint"), _PARTITION_SHIFT)
    return partition.bitwiseOR(F.col("offset"))


def topic_options(
    servers: str,
    topic: str = schemas.DEFAULT_TOPIC,
    *,
    max_per_trigger: int | None = None,
    min_partitions: int | None = None,
) -> dict[str, str]:
    """Read a topic from its first message; later runs resume by checkpoint.

    ``max_per_trigger`` limits the pace. ``min_partitions`` splits large topic
    partitions over several tasks, so one that holds most messages is no
    bottleneck.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
    }
    if max_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    if min_partitions is not None:
        options["minPartitions"] = str(min_partitions)
    return options


def read_topic(spark: SparkSession, servers: str, topic: str, **limits: int) -> DataFrame:
    """Streaming ``value`` and ``arrival``. Needs Spark's Kafka connector."""
    options = topic_options(servers, topic, **limits)
    stream = spark.readStream.format("kafka").options(**options).load()
    return stream.select("value", topic_arrival().alias("arrival"))


def write_topic(messages: DataFrame, servers: str, topic: str = schemas.DEFAULT_TOPIC) -> None:
    """Send a static frame of messages. Needs Spark's Kafka connector."""
    writer = messages.select("value").write.format("kafka")
    writer.option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def read_message_files(
    spark: SparkSession, path: str, *, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Streaming ``value`` from files with one message a line.

    ``max_files_per_trigger`` limits the pace of a replay.
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def write_message_files(messages: DataFrame, path: str, *, mode: str = "append") -> None:
    messages.select("value").write.mode(mode).text(path)
