"""The registered queries and their SQL counterparts."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracles  # noqa: E402
from stopwise import schemas  # noqa: E402
from stopwise.operators import (  # noqa: E402
    cleaning,
    correlation,
    dedup,
    encoding,
    nulls,
    ranking,
    readiness,
)
from stopwise.plans import delay_model, history, lanes  # noqa: E402
from stopwise.session import shared_folder  # noqa: E402
from stopwise.sources import csv_files, event_feed, messages, record_table  # noqa: E402
from stopwise.streaming import ingest  # noqa: E402

try:  # the operators on training data are an addition that may be left out
    import corpus_pipeline  # noqa: E402
    from stopwise.llm import queries as llm_queries  # noqa: E402
    from stopwise.llm import sql as llm_sql  # noqa: E402
except ImportError as missing:  # the package itself, or a library that it needs
    sys.stderr.write(f"without the operators on training data: {missing}\n")
    corpus_pipeline = llm_queries = llm_sql = None

ARRIVAL = "arrival"
_SECOND_DELIVERY = 1_000_000_000_000


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_feed.raw_records(spark, sf_dir)


def _raw_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = event_feed.raw_records(spark, sf_dir, with_arrival=True)
    return raw.withColumnRenamed(event_feed.ARRIVAL, ARRIVAL)


def _plain_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.rename_dotted(_raw_in_order(spark, sf_dir))


def _complete_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.drop_incomplete(_plain_in_order(spark, sf_dir))


def _table_rows(raw: DataFrame) -> DataFrame:
    return lanes.table_rows(lanes.ingest_lane(raw, keep=(ARRIVAL,)), keep=(ARRIVAL,))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.classify(_table_rows(_raw_in_order(spark, sf_dir)), ARRIVAL)


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.accepted(_classified(spark, sf_dir)).drop(ARRIVAL)


def _second_delivery(once: DataFrame) -> DataFrame:
    """Every third record once more, after all others and with other text."""
    return once.filter(F.col(ARRIVAL) % 3 == 0).withColumns(
        {ARRIVAL: F.col(ARRIVAL) + _SECOND_DELIVERY, "ArrivalProximityText": F.lit("again")}
    )


def _redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = _raw_in_order(spark, sf_dir)
    both = once.unionByName(_second_delivery(once))
    return dedup.classify(_table_rows(both), ARRIVAL)


def _analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.analysis_lane(_raw(spark, sf_dir))


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


_SUMS_AND_DISTANCE = [*schemas.COORDINATES, "DistanceFromStop"]


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = messages.encode_messages(_raw(spark, sf_dir))
    return cleaning.rename_dotted(messages.decode_messages(encoded))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    _raw(spark, sf_dir).write.option("header", True).csv(folder)
    return cleaning.rename_dotted(csv_files.read_raw_csv(spark, folder))


def csv_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular lines read back: quoted line breaks, fields too many or missing,
    tokens for missing values, and two orders of columns."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    number = F.col("event_id")
    quoted = F.concat(F.lit('"x, ""'), F.col("event_type"), F.lit('\ny"'))
    a = number.cast("string")
    b = F.when(number % 17 == 0, "NA").when(number % 19 == 0, quoted).otherwise(F.col("event_type"))
    c = F.col("value").cast("string")
    first = F.concat_ws(",", a, b, F.when(number % 11 != 0, c), F.when(number % 13 == 0, "more"))
    other = F.concat_ws(",", c, a, F.when(number % 11 != 0, b), F.when(number % 13 == 0, "more"))
    # A missing field and one too many would make a whole line.
    first = F.when((number % 11 == 0) & (number % 13 == 0), F.concat(first, F.lit(",more"))).otherwise(first)
    other = F.when((number % 11 == 0) & (number % 13 == 0), F.concat(other, F.lit(",more"))).otherwise(other)
    file = (number % 4).cast("int")
    lines = events.select(file.alias("file"), F.lit(1).alias("place"), F.when(file < 2, first).otherwise(other).alias("value"))
    heads = [(i, 0, "a,b,c" if i < 2 else "c,a,b") for i in range(4)]
    both = lines.unionByName(spark.createDataFrame(heads, "file int, place int, value string"))
    folder = shared_folder(spark)
    sorted_lines = both.repartition(4, "file").sortWithinPartitions("file", "place")
    sorted_lines.select("file", "value").write.partitionBy("file").text(folder)
    read = csv_files.read_text_csv(spark, folder)
    text = {n: csv_files.null_na_tokens(F.col(n)) for n in "abc"}
    return read.select(text["a"].try_cast("bigint").alias("a"), text["b"].alias("b"), text["c"].try_cast("double").alias("c"))


def stored_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why rows of a stored batch were rejected: broken messages, text too long, times
    with a line break behind them, keys with gaps, duplicates."""
    raw = _raw_in_order(spark, sf_dir)
    number = F.col(ARRIVAL)
    odd = raw.withColumns(
        {
            "VehicleRef": F.when(number % 23 == 0, F.repeat(F.lit("x"), 300)).otherwise(F.col("VehicleRef")),
            "RecordedAtTime": F.when(number % 31 == 0, F.concat("RecordedAtTime", F.lit("\n"))).otherwise(
                F.col("RecordedAtTime")
            ),
        }
    )
    record = F.struct(*[F.col(f"`{n}`") for n, _ in schemas.RAW_FIELDS])
    value = F.to_json(record, {"ignoreNullFields": "false"})
    broken = F.concat(F.lit("broken "), number.cast("string"))
    sent = odd.select(F.when(number % 37 == 0, broken).otherwise(value).alias("value"), ARRIVAL)
    folder = shared_folder(spark)
    ingest.store_messages(sent, "odd-0", table=f"{folder}/table", rejects=f"{folder}/rejects")
    return spark.read.parquet(f"{folder}/rejects").select(ARRIVAL, "reason", ingest.MESSAGE)


def drop_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.rename_dotted(cleaning.drop_incomplete(_raw(spark, sf_dir)))


def timestamp_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = cleaning.parse_times(_complete_in_order(spark, sf_dir))
    parts = schemas.RECORDED_PARTS + schemas.EXPECTED_PARTS
    return cleaning.split_timestamps(parsed).select(ARRIVAL, *parts)


def scheduled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = cleaning.parse_times(_complete_in_order(spark, sf_dir))
    split = cleaning.split_schedule(cleaning.split_timestamps(parsed))
    return split.select(ARRIVAL, *schemas.SCHEDULED_PARTS)


def delay_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.ingest_lane(_raw(spark, sf_dir)).select(
        "VehicleRef",
        *schemas.RECORDED_PARTS,
        "ExpectedArrivalTime_hour",
        "ScheduledArrivalTime_hour",
        "Delay",
    )


def coordinate_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    combined = cleaning.combine_coordinates(_plain_in_order(spark, sf_dir))
    return combined.select(ARRIVAL, *schemas.COORDINATES)


def impute_numeric_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _complete_in_order(spark, sf_dir)
    doubles = [schemas.DOTTED_NAMES.get(n, n) for n, t in schemas.RAW_FIELDS if t == "double"]
    imputed = cleaning.impute_means(raw, columns=["DirectionRef", *doubles])
    return _rounded(imputed.select(ARRIVAL, "DirectionRef", *doubles), doubles)


def impute_text_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = cleaning.fill_missing_text(_complete_in_order(spark, sf_dir))
    return filled.select(ARRIVAL, *schemas.TEXT_COLUMNS)


def processed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.ingest_lane(_raw(spark, sf_dir))


def processed_records_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_analysis(spark, sf_dir), _SUMS_AND_DISTANCE)


def sink_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.rejects(_classified(spark, sf_dir))


def redelivery_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.accepted(_redelivered(spark, sf_dir)).drop(ARRIVAL)


def redelivery_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.rejects(_redelivered(spark, sf_dir))


def _stream(spark: SparkSession, *deliveries: DataFrame) -> DataFrame:
    """Stored records after each delivery was written as message files and the
    streaming ingest, resumed from its checkpoint, caught up with it."""
    folder = shared_folder(spark)
    for delivery in deliveries:
        encoded = messages.encode_messages(delivery)
        messages.write_message_files(encoded, f"{folder}/in")
        query = ingest.start_ingest(
            messages.read_message_files(spark, f"{folder}/in"),
            table=f"{folder}/table",
            rejects=f"{folder}/rejects",
            checkpoint=f"{folder}/checkpoint",
            feed="replay",
            trigger={"availableNow": True},
        )
        query.awaitTermination()
    return record_table.read_records(spark, f"{folder}/table")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records replayed through the streaming ingest."""
    return _stream(spark, _raw(spark, sf_dir))


def stream_redelivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a third of the records delivered again in a later run."""
    once = _raw_in_order(spark, sf_dir)
    return _stream(spark, once, _second_delivery(once))


def stream_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, accepted and rejected rows of every micro-batch of a replay that is
    limited to one file a batch."""
    folder = shared_folder(spark)
    raw = _raw_in_order(spark, sf_dir)
    for file in range(2):  # one after the other, as the stream takes files by age
        encoded = messages.encode_messages(raw.filter(F.col(ARRIVAL) % 2 == file)).coalesce(1)
        messages.write_message_files(encoded, f"{folder}/in")
    seen: dict[int, dict[str, int]] = {}
    query = ingest.start_ingest(
        messages.read_message_files(spark, f"{folder}/in", max_files_per_trigger=1),
        table=f"{folder}/table",
        rejects=f"{folder}/rejects",
        checkpoint=f"{folder}/checkpoint",
        feed="pace",
        trigger={"availableNow": True},
        progress=seen.__setitem__,
    )
    query.awaitTermination()
    rows = [(n, *(seen[n][c] for c in ("messages", "accepted", "rejected"))) for n in sorted(seen)]
    return spark.createDataFrame(rows, "batch long, messages long, accepted long, rejected long")


def correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(correlation.correlation_pairs(_analysis(spark, sf_dir)), ["r"])


def correlated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = correlation.correlation_pairs(_analysis(spark, sf_dir))
    return correlation.correlated_columns(pairs)


def selected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = lanes.selected_features(_analysis(spark, sf_dir))
    return _rounded(selected, _SUMS_AND_DISTANCE)


def double_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    processed = lanes.ingest_lane(_raw(spark, sf_dir))
    return nulls.as_doubles(processed, processed.columns)


def null_column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nulls.null_column_counts(double_casts(spark, sf_dir))


def drop_empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nulls.drop_empty_columns(double_casts(spark, sf_dir))


def drop_empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = _raw(spark, sf_dir).select("DistanceFromStop", *schemas.ARRIVAL_TIMES)
    return nulls.drop_empty_rows(gaps)


def latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.latest(_accepted(spark, sf_dir), 100)


def latest_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the stored table, reading only the newest dates."""
    folder = shared_folder(spark)
    record_table.write_batch(_accepted(spark, sf_dir), folder, "all")
    return record_table.latest_records(spark, folder, 100)


def _in_batches(spark: SparkSession, sf_dir: str, *summaries: str) -> str:
    """A table stored in three batches, the last one a redelivery that runs twice, its
    newest date compacted, its ``summaries`` merged."""
    folder = shared_folder(spark)
    rows = _table_rows(_raw_in_order(spark, sf_dir))
    even, odd = (rows.filter(F.col(ARRIVAL) % 2 == n) for n in (0, 1))
    for name, batch in (("b-0", even), ("b-1", odd), ("b-2", even), ("b-2", even)):
        classified = dedup.classify(
            batch, ARRIVAL, lambda valid, name=name: record_table.stored_matches(valid, folder, name)
        )
        record_table.write_batch(
            dedup.accepted(classified),
            folder,
            name,
            dedup.rejects(classified),
            f"{folder}-rejects",
            {n: history.SUMMARIES[n] for n in summaries},
        )
    newest = ranking.latest(record_table.latest_records(spark, folder, 1), 1).first()
    record_table.compact(spark, folder, tuple(newest[c] for c in schemas.DATE_PARTITION))
    history.merge(spark, folder, summaries)
    return folder


def records_at_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of the records of every version of a table that was stored in batches
    and compacted, and how many rejects the version has."""
    folder = _in_batches(spark, sf_dir)
    versions = []
    for version in (1, 2, 3, 4):
        rejected = record_table.read_rejects(spark, folder, version).count()
        keys = record_table.read_records(spark, folder, version).select(*schemas.KEY)
        versions.append(keys.withColumns({"version": F.lit(version), "rejects": F.lit(rejected).cast("long")}))
    return reduce(DataFrame.unionByName, versions)


def stored_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of stored records, from the table's lists alone."""
    return record_table.count_records(spark, _in_batches(spark, sf_dir))


def history_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the stored columns of numbers, from the batches' sums."""
    return _rounded(history.column_means(spark, _in_batches(spark, sf_dir, "sums")), ["mean"])


def history_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of the stored columns, from the batches' moments."""
    return _rounded(history.correlation_pairs(spark, _in_batches(spark, sf_dir, "moments")), ["r"])


def history_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label index of the stored records, from the batches' counts."""
    return history.label_index(spark, _in_batches(spark, sf_dir, "labels"))


def oldest_of_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.oldest_of_latest(_accepted(spark, sf_dir), 100, 5)


def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.label_index(_accepted(spark, sf_dir))


def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.label_encode(_accepted(spark, sf_dir))


def record_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.record_count(_accepted(spark, sf_dir))


def readiness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.readiness(_accepted(spark, sf_dir), 20)


def predicted_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's floor and relabelling, with the true delay as the score."""
    return delay_model.report(_accepted(spark, sf_dir), prediction="Delay")


def training_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of every record and the part it belongs to."""
    training, held_out = delay_model.split(_accepted(spark, sf_dir))
    key = schemas.KEY
    return training.select(*key, F.lit("training").alias("part")).unionByName(
        held_out.select(*key, F.lit("held out").alias("part"))
    )


def training_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that are features after selection by correlation."""
    rows = delay_model.snapshot(_accepted(spark, sf_dir))
    chosen = delay_model.feature_columns(rows, delay_model.split(rows)[0], select=True)
    return spark.createDataFrame([(c,) for c in chosen], "column_name string")


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of every record: labels of all records, means of the training part."""
    rows = delay_model.snapshot(_accepted(spark, sf_dir))
    training, _ = delay_model.split(rows)
    columns = delay_model.feature_columns(rows, training)
    encoded = encoding.label_encode(rows)
    preparation = delay_model.build_preparation(columns)
    fitted = preparation.fit(delay_model.split(encoded)[0])
    names = fitted.stages[-1].getInputCols()
    values = vector_to_array("features")
    plain = [F.round(values[i], 6).alias(f"feature_{n}") for i, n in enumerate(names)]
    return fitted.transform(encoded).select(*schemas.KEY, *plain)


def train_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on four fifths of all records, score the other fifth with the model
    and with the one loaded from its folder."""
    records = delay_model.snapshot(_accepted(spark, sf_dir))
    path = f"{shared_folder(spark)}/model"
    model = delay_model.train(records, path, stored=True)
    training, held_out = delay_model.split(records)
    checked = _scores_checked(spark, path, model, training, held_out)
    better = delay_model.holdout_error(model, records) < delay_model.mean_error(records)
    return checked.withColumn("beats_mean", F.lit(better)).select(*schemas.KEY, *_CHECKS)


_CHECKS = ("scored", "within_labels", "same_when_loaded", "beats_mean")


def _scores_checked(spark: SparkSession, path: str, model, training: DataFrame, rows: DataFrame) -> DataFrame:
    bounds = training.agg(F.min("Delay").alias("lo"), F.max("Delay").alias("hi")).first()
    once = delay_model.predict(model, rows).withColumnRenamed(delay_model.PREDICTION, "first_score")
    twice = delay_model.predict(delay_model.load(spark, path), once)
    score = F.col(delay_model.PREDICTION)
    return twice.withColumns(
        {
            "scored": score.isNotNull(),
            "within_labels": score.between(bounds["lo"], bounds["hi"]),
            "same_when_loaded": F.abs(score - F.col("first_score")) < 1e-9,
        }
    )


def first_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the newest window, report on its last records."""
    window = delay_model.snapshot(ranking.latest(_accepted(spark, sf_dir), delay_model.WINDOW))
    reported = delay_model.first_report(window, f"{shared_folder(spark)}/model")
    return _report_checked(reported, window)


def _report_checked(reported: DataFrame, window: DataFrame) -> DataFrame:
    """Vehicle and stop, and whether the minutes lie within those of the window's delays."""
    bounds = window.agg(F.min("Delay").alias("lo"), F.max("Delay").alias("hi")).first()
    vehicle, stop, minutes = reported.columns
    lo, hi = (int(bounds[b] // 60) for b in ("lo", "hi"))
    return reported.select(vehicle, stop, F.col(minutes).between(lo, hi).alias("within_labels"))


def rescore_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the newest window, save, load again, report on the newest records."""
    records = delay_model.snapshot(_accepted(spark, sf_dir))
    path = f"{shared_folder(spark)}/model"
    window = delay_model.snapshot(ranking.latest(records, delay_model.WINDOW))
    delay_model.train(window, path, stored=True)
    reported = delay_model.rescore_latest(delay_model.load(spark, path), records)
    return _report_checked(reported, window)


def entry(spark: SparkSession) -> DataFrame:
    """Delay of every complete record of the smallest data set."""
    return delay_seconds(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = [
        json_round_trip,
        csv_round_trip,
        csv_rules,
        stored_rejects,
        drop_incomplete,
        timestamp_parts,
        scheduled_parts,
        delay_seconds,
        coordinate_sums,
        impute_numeric_mean,
        impute_text_empty,
        processed_records,
        processed_records_imputed,
        sink_rejects,
        redelivery_accepted,
        redelivery_rejects,
        stream_ingest,
        stream_redelivery,
        stream_pace,
        correlation_pairs,
        correlated_columns,
        selected_features,
        double_casts,
        null_column_counts,
        drop_empty_columns,
        drop_empty_rows,
        latest_n,
        latest_stored,
        records_at_version,
        stored_count,
        history_means,
        history_pairs,
        history_labels,
        oldest_of_latest,
        label_index,
        label_encode,
        record_count,
        readiness_gate,
        predicted_minutes,
        training_split,
        training_features,
        feature_matrix,
        train_and_score,
        first_report,
        rescore_latest,
    ]
    named = {"sink_accepted": _accepted, **{q.__name__: q for q in registered}}
    if llm_queries:
        named |= llm_queries.queries() | {"pipeline": corpus_pipeline.run}
    return named


def oracle_sql() -> dict[str, str]:
    extra = llm_sql.oracle_sql() if llm_sql else {}
    return oracles.oracle_sql() | extra
