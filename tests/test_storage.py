import random
from collections import Counter

import pytest
from records import table_rows
from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.operators import dedup
from stopwise.sources import jdbc, record_table


def _reasons(classified):
    return {r.arrival: r.reason for r in classified.select("arrival", "reason").collect()}


def test_first_of_a_key_wins(spark):
    rows = table_rows(
        spark,
        {"VehicleRef": "late", "arrival": 9},
        {"VehicleRef": "first", "arrival": 2},
        {"Delay": 2.0, "arrival": 5},
    )
    classified = dedup.classify(rows, "arrival")
    assert _reasons(classified) == {9: dedup.DUPLICATE_KEY, 2: None, 5: None}
    assert dedup.accepted(classified).columns == rows.columns
    assert dedup.rejects(classified).first().VehicleRef == "late"


@pytest.mark.parametrize("column", schemas.KEY)
def test_null_key_parts_are_rejected(spark, column):
    rows = table_rows(spark, {column: None}, {column: None}, {})
    null, same, good = (_reasons(dedup.classify(rows, "arrival"))[n] for n in range(3))
    assert (null, same, good) == (dedup.NULL_KEY, dedup.NULL_KEY, None)


def test_long_text_is_rejected_and_does_not_take_the_key(spark):
    rows = table_rows(
        spark, {"OriginName": "x" * 256}, {"OriginName": "x" * 255}, {"DirectionRef": None, "Delay": 7.0}
    )
    assert _reasons(dedup.classify(rows, "arrival")) == {0: dedup.TEXT_TOO_LONG, 1: None, 2: None}


def test_stored_keys_are_taken(spark):
    rows = table_rows(spark, {}, {}, {"Delay": 3.0})
    stored = table_rows(spark, {}).select(*schemas.TABLE_ORDER)
    classified = dedup.classify(rows, "arrival", lambda valid: stored)
    assert _reasons(classified) == {0: dedup.DUPLICATE_KEY, 1: dedup.DUPLICATE_KEY, 2: None}


def _brute_force(changes):
    taken, reasons = set(), {}
    for n, change in sorted(enumerate(changes), key=lambda c: c[1]["arrival"]):
        key = (change["Delay"], change["RecordedAtTime_day"])
        if None in key:
            reasons[change["arrival"]] = dedup.NULL_KEY
        elif key in taken:
            reasons[change["arrival"]] = dedup.DUPLICATE_KEY
        else:
            taken.add(key)
            reasons[change["arrival"]] = None
    return reasons


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_random_rows_with_a_hot_key_match_brute_force(spark, broadcast):
    rng = random.Random(11)
    changes = []
    for arrival in rng.sample(range(1000), 300):
        hot = rng.random() < 0.4
        delay = 1.0 if hot else rng.choice([None, *map(float, range(60))])
        changes.append({"arrival": arrival, "Delay": delay, "RecordedAtTime_day": 1 if hot else rng.choice([1, 2])})
    rows = table_rows(spark, *changes).repartition(7)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        classified = dedup.classify(rows, "arrival")
        assert _reasons(classified) == _brute_force(changes)
        assert classified.count() == len(changes)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_hot_key_is_split_when_the_join_shuffles(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    changes = [{"arrival": n, "Delay": 1.0 if n % 3 else float(n)} for n in range(3000)]
    rows = table_rows(spark, *changes).repartition(8)
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        classified = dedup.classify(rows, "arrival")
        got = classified.groupBy("reason").count().withColumn("n", F.col("count"))
        assert {r.reason: r.n for r in got.collect()} == {None: 1001, dedup.DUPLICATE_KEY: 1999}
        classified.collect()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_random_batches_match_one_batch(spark, broadcast):
    rng = random.Random(4)
    changes = [{"arrival": n, "Delay": float(rng.choice([1, 1, rng.randrange(40)]))} for n in range(200)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        reasons, stored = {}, table_rows(spark).select(*schemas.TABLE_ORDER)
        for start in range(0, 200, 50):
            rows = table_rows(spark, *changes[start : start + 50])
            classified = dedup.classify(rows, "arrival", lambda valid: stored)
            reasons |= _reasons(classified)
            stored = stored.union(dedup.accepted(classified).select(*schemas.TABLE_ORDER))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    whole = [{**c, "RecordedAtTime_day": 1} for c in changes]
    assert reasons == _brute_force(whole)


def test_a_small_batch_leaves_the_stored_rows_unshuffled(spark, tmp_path):
    record_table.write_batch(table_rows(spark, {}), str(tmp_path / "t"), "b-0")
    rows = table_rows(spark, {}, {"Delay": 2.0})
    rows.write.parquet(str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r"))
    stored = record_table.stored_for(rows, str(tmp_path / "t"), "b-1")
    contested = dedup.contested_keys(rows, "arrival", stored)
    plan = contested._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan and "SortMergeJoin" not in plan
    assert [r.first_arrival for r in contested.collect()] == [None]


def test_few_contested_keys_leave_the_rows_unshuffled(spark):
    classified = dedup.classify(table_rows(spark, {}, {}, {"Delay": 2.0}), "arrival")
    plan = classified._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_table_round_trip_and_types(spark, tmp_path):
    table = str(tmp_path / "t")
    assert record_table.read_records(spark, table).isEmpty()
    rows = table_rows(spark, {"DirectionRef": None}, {"RecordedAtTime_day": 2})
    record_table.write_batch(rows, table, "b-0")
    read = record_table.read_records(spark, table)
    assert read.columns == schemas.TABLE_ORDER
    assert [f.dataType for f in read.schema] == [f.dataType for f in schemas.table_schema()]
    want = Counter(tuple(r) for r in rows.select(*schemas.TABLE_ORDER).collect())
    assert Counter(tuple(r) for r in read.collect()) == want


def test_batch_written_again_replaces_itself(spark, tmp_path):
    table = str(tmp_path / "t")
    record_table.write_batch(table_rows(spark, {}), table, "b-0")
    record_table.write_batch(table_rows(spark, {"Delay": 5.0}), table, "b-1")
    record_table.write_batch(table_rows(spark, {"Delay": 5.0}), table, "b-1")
    assert record_table.read_records(spark, table).count() == 2


def test_history_is_read_by_date_and_without_the_own_batch(spark, tmp_path):
    table = str(tmp_path / "t")
    assert record_table.stored_for(table_rows(spark, {}), table, "b-0").isEmpty()
    days = [{"RecordedAtTime_day": d} for d in (1, 2, 3)]
    record_table.write_batch(table_rows(spark, *days), table, "b-0")
    record_table.write_batch(table_rows(spark, {"Delay": 9.0}), table, "b-1")
    rows = table_rows(spark, {"RecordedAtTime_day": 1}, {"RecordedAtTime_day": 8})
    stored = record_table.stored_for(rows, table, "b-1")
    assert [r.RecordedAtTime_day for r in stored.collect()] == [1]
    assert all("day=1/" in f for f in stored.inputFiles())
    assert record_table.stored_for(rows, table, "b-2").count() == 2


def test_history_lists_only_the_dates_of_the_batch(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = table_rows(spark, *[{"RecordedAtTime_day": d, "RecordedAtTime_month": m} for d in range(1, 29) for m in (1, 2)])
    record_table.write_batch(rows, table, "b-0")
    stored = record_table.stored_for(table_rows(spark, {"RecordedAtTime_day": 3}), table, "b-1")
    assert stored.count() == 1
    files = stored._jdf.queryExecution().executedPlan().toString()
    assert "Location: InMemoryFileIndex(1 paths)" in files and len(stored.inputFiles()) == 1
    assert record_table.stored_for(rows, table, "b-1").count() == 56


def test_history_reads_only_the_hours_of_the_batch(spark, tmp_path):
    table = str(tmp_path / "t")
    record_table.write_batch(table_rows(spark, *[{"RecordedAtTime_hour": h} for h in range(24)]), table, "b-0")
    stored = record_table.stored_for(table_rows(spark, {"RecordedAtTime_hour": 7}, {"RecordedAtTime_hour": 8}), table, "b-1")
    assert sorted(r.RecordedAtTime_hour for r in stored.collect()) == [7, 8]
    plan = stored._jdf.queryExecution().optimizedPlan().toString()
    assert ">= 7" in plan and "<= 8" in plan


def _batches(table):
    return sorted(p.name.split("=")[1].split(".")[0] for p in table.glob("ingest_batch=*") if p.is_dir())


def test_compaction_keeps_rows_and_retries(spark, tmp_path):
    table = tmp_path / "t"
    for b in range(4):
        record_table.write_batch(table_rows(spark, {"Delay": float(b)}, {"Delay": b + 0.5}), str(table), f"b-{b}")
    before = Counter(tuple(r) for r in record_table.read_records(spark, str(table)).collect())
    date = tuple(table_rows(spark, {}).select(*schemas.DATE_PARTITION).first())
    record_table.compact(spark, str(table), date, open_batches=("b-3",))
    record_table.vacuum(spark, str(table))
    assert Counter(tuple(r) for r in record_table.read_records(spark, str(table)).collect()) == before
    names = _batches(table)
    assert names == ["b-3", "compacted"]
    # The open batch may still run again.
    record_table.write_batch(table_rows(spark, {"Delay": 3.0}, {"Delay": 3.5}), str(table), "b-3")
    assert Counter(tuple(r) for r in record_table.read_records(spark, str(table)).collect()) == before
    assert record_table.batch_records(spark, str(table), "b-3").count() == 2
    record_table.compact(spark, str(table), date, open_batches=("b-3",))
    assert _batches(table) == names


def test_latest_records_open_only_the_newest_dates(spark, tmp_path):
    table = str(tmp_path / "t")
    assert record_table.latest_records(spark, table, 3).isEmpty()
    changes = [{"RecordedAtTime_day": d, "RecordedAtTime_hour": h} for d in range(1, 8) for h in (1, 2)]
    record_table.write_batch(table_rows(spark, *changes), table, "b-0")
    newest = record_table.latest_records(spark, table, 3)
    got = [(r.RecordedAtTime_day, r.RecordedAtTime_hour) for r in newest.collect()]
    assert got == [(7, 2), (7, 1), (6, 2)]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert len(newest.inputFiles()) == 2 and "TakeOrderedAndProject" in plan


def test_missing_rows(spark):
    rows = table_rows(spark, {}, {"Delay": 2.0}).drop("arrival")
    stored = table_rows(spark, {})
    assert [r.Delay for r in jdbc.missing_rows(rows, stored).collect()] == [2.0]


def test_jdbc_append_skips_what_an_earlier_try_stored(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    asked, written = [], []

    def read_table(spark, url, table, *, properties, predicates=None, hour_slices=None):
        asked.append(predicates or hour_slices)
        return table_rows(spark, {"RecordedAtTime_day": 2})

    def write(writer, url, table, mode=None, properties=None):
        written.append((table, mode, [r.RecordedAtTime_day for r in writer._df.collect()]))

    monkeypatch.setattr(jdbc, "read_table", read_table)
    monkeypatch.setattr(DataFrameWriter, "jdbc", write)
    rows = table_rows(spark, *[{"RecordedAtTime_day": d} for d in (1, 2, 3)])
    jdbc.append_rows(rows, "jdbc:none", "t", properties={})
    assert asked[0] == jdbc.date_ranges([(1, 1, d) for d in (1, 2, 3)], 8) and len(asked[0]) == 3
    assert [(t, m, sorted(days)) for t, m, days in written] == [("t", "append", [1, 3])]
    jdbc.append_rows(rows, "jdbc:none", "t", properties={}, connections=2)
    assert len(asked[1]) == 2 and sorted(written[1][2]) == [1, 3]


def test_jdbc_reads_restore_folded_names(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader

    folded = table_rows(spark, {})
    folded = folded.toDF(*[c.lower() for c in folded.columns])
    monkeypatch.setattr(DataFrameReader, "jdbc", lambda *a, **k: folded)
    assert jdbc.read_table(spark, "jdbc:none", properties={}).columns == schemas.TABLE_ORDER
    assert jdbc.read_latest(spark, "jdbc:none", properties={}).columns == schemas.TABLE_ORDER


def test_jdbc_date_ranges():
    dates = [(2024, 1, 31), (2023, 12, 31), (2024, 2, 1), (2024, 1, 31)]
    names = "(RecordedAtTime_year, RecordedAtTime_month, RecordedAtTime_day)"
    assert jdbc.date_ranges(dates, 2) == [
        f"{names} >= (2023, 12, 31) AND {names} <= (2024, 1, 31)",
        f"{names} >= (2024, 2, 1) AND {names} <= (2024, 2, 1)",
    ]
    assert jdbc.date_ranges([], 3) == [] and len(jdbc.date_ranges(dates, 9)) == 3


def test_jdbc_sql():
    import datetime as dt

    ddl = jdbc.create_table_sql("t")
    assert ddl.startswith("CREATE TABLE IF NOT EXISTS t (RecordedAtTime_year INTEGER,")
    assert "VehicleRef VARCHAR(255)" in ddl and "Delay DOUBLE PRECISION" in ddl
    assert ddl.count("INTEGER") == 16 and ddl.count("VARCHAR") == 6 and ddl.count("DOUBLE") == 5
    assert ddl.endswith(f"PRIMARY KEY ({', '.join(schemas.KEY)}))")
    predicates = jdbc.date_predicates(dt.date(2024, 2, 28), dt.date(2024, 3, 1))
    assert len(predicates) == 3
    assert predicates[1] == (
        "RecordedAtTime_year = 2024 AND RecordedAtTime_month = 2 AND RecordedAtTime_day = 29"
    )
    assert "RecordedAtTime_second DESC, OriginCoordinates ASC" in jdbc.latest_query("t", 5)
    assert jdbc.latest_query("t", 5).endswith("Delay ASC LIMIT 5) newest")


def test_spark_table_ddl_fits_what_is_written(spark, tmp_path):
    record_table.write_batch(table_rows(spark, {}, {"RecordedAtTime_day": 5}), str(tmp_path / "t"), "b-0")
    spark.sql(jdbc.create_spark_table_sql(str(tmp_path / "t"), "stopwise_test"))
    try:
        spark.sql("msck repair table stopwise_test")
        named = spark.table("stopwise_test").select(*schemas.TABLE_ORDER)
        stored = record_table.read_records(spark, str(tmp_path / "t"))
        assert named.count() == 2 and named.exceptAll(stored).isEmpty()
    finally:
        spark.sql("drop table stopwise_test")


def test_ranking_breaks_ties_by_the_key(spark):
    from stopwise.operators import ranking

    changes = [{"Delay": float(d), "RecordedAtTime_hour": h} for h in (1, 2) for d in range(5)]
    rows = table_rows(spark, *changes).repartition(5)
    newest = [(r.RecordedAtTime_hour, r.Delay) for r in ranking.latest(rows, 7).collect()]
    assert newest == [(2, 0.0), (2, 1.0), (2, 2.0), (2, 3.0), (2, 4.0), (1, 0.0), (1, 1.0)]
    last = [(r.RecordedAtTime_hour, r.Delay) for r in ranking.oldest_of_latest(rows, 7, 2).collect()]
    assert last == [(1, 1.0), (1, 0.0)]


def test_readiness(spark):
    from stopwise.operators import readiness

    rows = spark.range(25).select(F.col("id"))
    assert readiness.is_ready(rows, 20) and not readiness.is_ready(rows, 26)
    assert readiness.readiness(rows, 25).first().ready
    assert readiness.record_count(rows).first().record_count == 25
