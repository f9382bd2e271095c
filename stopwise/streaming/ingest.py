"""Unbounded ingest: messages to stored records, in micro-batches.

Delivery is at least once; storage by key makes the result the same as if each
message came once. A batch that is run again replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stopwise import schemas
from stopwise.operators import dedup
from stopwise.operators.readiness import is_ready
from stopwise.plans.lanes import ingest_lane, table_rows
from stopwise.sources import record_table
from stopwise.sources.messages import decode_messages, is_undecodable

ARRIVAL = "arrival"
MESSAGE = "message"


def store_messages(
    messages: DataFrame,
    batch: str,
    *,
    table: str,
    rejects: str,
    staging: str | None = None,
    publish: Callable[[DataFrame], None] | None = None,
    summaries: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> dict[str, int] | None:
    """Decode, clean and store one batch of messages.

    ``messages`` has ``value`` and ``arrival``; without ``arrival`` the order
    of the rows within the batch counts. ``staging`` is overwritten. Accepted and
    rejected rows become visible together, as one version of the table; a batch that
    a version has already is not stored again. ``publish`` gets the accepted rows, for
    example to append them to a database table, also when the batch runs again.
    ``summaries`` (see ``plans.history``) are committed with the batch.

    Returns how many ``messages`` were read, as observed on the way, and how many rows
    were ``accepted`` and ``rejected``, as committed; incomplete ones are neither. None
    for a batch without messages or one stored before.
    """
    if messages.isEmpty():
        return
    spark = messages.sparkSession
    if record_table.is_committed(spark, table, batch):
        if publish is not None:
            publish(record_table.batch_records(spark, table, batch))
        return
    received = Observation()  # counts while the rows are staged
    messages = messages.observe(received, F.count(F.lit(1)).alias("messages"))
    if ARRIVAL not in messages.columns:
        messages = messages.withColumn(ARRIVAL, F.monotonically_increasing_id())
    decoded = decode_messages(messages, keep=("value", ARRIVAL))
    decoded = decoded.withColumn(
        MESSAGE, F.when(is_undecodable(), F.col("value").cast("string"))
    )
    # Empty arrival times take an undecodable message past the filter for
    # incomplete records, so that it reaches the rejects in the same pass.
    empty = F.when(F.col(MESSAGE).isNotNull(), F.lit(""))
    decoded = decoded.withColumns(
        {c: F.coalesce(F.col(c), empty) for c in schemas.ARRIVAL_TIMES}
    )
    keep = (ARRIVAL, MESSAGE)
    processed = table_rows(ingest_lane(decoded, keep=keep), keep=keep)
    undecodable = F.when(F.col(MESSAGE).isNotNull(), F.lit(dedup.UNDECODABLE))

    def stored(valid: DataFrame) -> DataFrame:
        return record_table.stored_matches(valid, table, batch)

    classified = dedup.classify(processed, ARRIVAL, stored, staging, undecodable)
    accepted = dedup.accepted(classified).select(*schemas.TABLE_ORDER)
    record_table.write_batch(accepted, table, batch, dedup.rejects(classified), rejects, summaries)
    if publish is not None:
        publish(accepted)
    return {**received.get, **record_table.batch_counts(spark, table, batch)}


def start_ingest(
    messages: DataFrame,
    *,
    table: str,
    rejects: str,
    checkpoint: str,
    feed: str,
    publish: Callable[[DataFrame], None] | None = None,
    trigger: dict | None = None,
    compact_above: int | None = None,
    summaries: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    progress: Callable[[int, dict[str, int]], None] | None = None,
) -> StreamingQuery:
    """Start the stream. ``feed`` names this checkpoint's batches in the table.

    Use a new ``feed`` name with every new checkpoint: batch numbers start
    again at 0 there, and a batch of a name that is stored is not stored again.
    After a batch the dates with files of more than ``compact_above`` batches
    before it are compacted. ``progress`` gets the number of every batch that was
    stored and what ``store_messages`` observed of it.
    """

    # Beside the checkpoint, so that a restart uses the same folder.
    staging = f"{checkpoint.rstrip('/')}-staging"

    def handle(batch_messages: DataFrame, batch_id: int) -> None:
        seen = store_messages(
            batch_messages,
            f"{feed}-{batch_id}",
            table=table,
            rejects=rejects,
            staging=staging,
            publish=publish,
            summaries=summaries,
        )
        if progress is not None and seen is not None:
            progress(batch_id, seen)
        if compact_above is not None:
            spark = batch_messages.sparkSession
            record_table.compact_closed(spark, table, compact_above, open_batches=(f"{feed}-{batch_id}",))

    return (
        messages.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def table_is_ready(spark, table: str, threshold: int = 20) -> bool:
    """Whether the stored table holds enough records to train on."""
    return is_ready(record_table.read_records(spark, table), threshold)
