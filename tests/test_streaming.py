from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from stopwise import schemas
from stopwise.operators import dedup
from stopwise.sources import messages, record_table
from stopwise.streaming import ingest

SF = "/root/testdata/sf0.001"


def _rows(df):
    return Counter(tuple(r) for r in df.select(*schemas.TABLE_ORDER).collect())


class Feed:
    """Message files and one ingest stream over them."""

    def __init__(self, spark, folder, feed="feed"):
        self.spark, self.folder, self.feed = spark, folder, feed

    def add(self, raw, files=1):
        encoded = messages.encode_messages(raw).repartition(files)
        messages.write_message_files(encoded, f"{self.folder}/in")

    def add_text(self, *lines):
        values = self.spark.createDataFrame([(v,) for v in lines], "value string")
        messages.write_message_files(values, f"{self.folder}/in")

    def run(self, feed=None, files_per_batch=None, publish=None):
        feed = feed or self.feed
        query = ingest.start_ingest(
            messages.read_message_files(
                self.spark, f"{self.folder}/in", max_files_per_trigger=files_per_batch
            ),
            table=f"{self.folder}/table",
            rejects=f"{self.folder}/rejects",
            checkpoint=f"{self.folder}/checkpoint-{feed}",
            feed=feed,
            publish=publish,
            trigger={"availableNow": True},
        )
        query.awaitTermination()
        return query

    def table(self):
        return record_table.read_records(self.spark, f"{self.folder}/table")

    def rejects(self):
        return self.spark.read.parquet(f"{self.folder}/rejects")


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, str(tmp_path))


@pytest.fixture(scope="module")
def raw(spark):
    return registered._raw(spark, SF).cache()


@pytest.fixture(scope="module")
def expected(spark):
    return _rows(registered._accepted(spark, SF))


def test_many_batches_equal_one(feed, raw, expected):
    feed.add(raw, files=6)
    query = feed.run(files_per_batch=2)
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 3
    assert _rows(feed.table()) == expected
    assert feed.rejects().groupBy("reason").count().collect() == [(dedup.NULL_KEY, 137)]


def test_restart_reads_only_new_messages(feed, raw, expected):
    feed.add(raw.limit(300))
    feed.run()
    part = feed.table().count()
    feed.run()
    assert feed.table().count() == part
    feed.add(raw)
    feed.run()
    assert _rows(feed.table()) == expected
    duplicates = feed.rejects().filter(F.col("reason") == dedup.DUPLICATE_KEY)
    assert duplicates.count() == part


def test_replay_from_the_start_into_the_same_table(feed, raw, expected):
    feed.add(raw, files=2)
    feed.run()
    feed.run(feed="again", files_per_batch=1)
    assert _rows(feed.table()) == expected


def test_a_batch_run_twice_is_stored_once(spark, tmp_path, raw, expected):
    encoded = messages.encode_messages(raw)
    for _ in range(2):
        ingest.store_messages(
            encoded, "feed-0", table=f"{tmp_path}/t", rejects=f"{tmp_path}/r", staging=f"{tmp_path}/s"
        )
    assert _rows(record_table.read_records(spark, f"{tmp_path}/t")) == expected
    assert spark.read.parquet(f"{tmp_path}/r").count() == 137


def test_an_empty_batch_leaves_no_trace(spark, tmp_path):
    empty = spark.createDataFrame([], "value string")
    ingest.store_messages(empty, "feed-0", table=f"{tmp_path}/t", rejects=f"{tmp_path}/r")
    assert list(tmp_path.iterdir()) == []


def test_broken_messages_are_kept_as_rejects(feed, raw):
    feed.add_text("{broken", "[]", '{"OriginName": "no times"}')
    feed.add(raw.limit(50))
    feed.run()
    broken = feed.rejects().filter(F.col("reason") == dedup.UNDECODABLE)
    assert sorted(r.message for r in broken.collect()) == ["[]", "{broken"]
    assert feed.table().count() > 0


def test_accepted_rows_are_published_once(spark, feed, raw, expected):
    published = []
    feed.add(raw, files=2)
    feed.run(files_per_batch=1, publish=lambda df: published.extend(df.collect()))
    assert Counter(tuple(r) for r in published) == expected


def test_gate(spark, feed, raw):
    table = f"{feed.folder}/table"
    assert not ingest.table_is_ready(spark, table)
    feed.add(raw)
    feed.run()
    assert ingest.table_is_ready(spark, table)
    assert not ingest.table_is_ready(spark, table, 10_000)


def test_first_arrival_wins_across_batches(spark, feed, raw):
    feed.add(raw.withColumn("ArrivalProximityText", F.lit("first")))
    feed.run()
    feed.add(raw.withColumn("ArrivalProximityText", F.lit("second")))
    feed.run()
    assert [r[0] for r in feed.table().select("ArrivalProximityText").distinct().collect()] == ["first"]
