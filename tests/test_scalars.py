from itertools import product

import pytest
from pyspark.sql import functions as F

from stopwise import functions as fn


def _one(spark, value, type_name, expression):
    return spark.createDataFrame([(value,)], f"x {type_name}").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "text",
    ["bad", "", "2017-06-01 00:03:34\n", "2017-6-1 0:03:34", "2017-06-01", "2017-06-01 00:03:34.5", "2017-06-01T00:03:34",
     "2017-02-30 00:00:00", "2017-06-01 24:00:00", "0000-01-01 00:00:00", " 2017-06-01 00:03:34",
     "2017-06-01 00:03:3 ", "2017-06-01 00:03:60", None],
)
def test_unfit_timestamps_are_null(spark, text):
    assert _one(spark, text, "string", fn.parse_timestamp) is None


def test_timestamps_parse_like_the_pattern(spark):
    texts = [("2017-06-01 00:03:34",), ("2024-02-29 23:59:59",), ("1969-12-31 12:00:00",)]
    df = spark.createDataFrame(texts, "x string")
    ours = fn.parse_timestamp(F.col("x")).cast("string").alias("ours")
    pattern = F.try_to_timestamp("x", F.lit("yyyy-MM-dd HH:mm:ss")).cast("string").alias("pattern")
    for row in df.select("x", ours, pattern).collect():
        assert row.ours == row.pattern == row.x


def test_timestamps_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:  # this hour does not exist there
        parsed = lambda c: F.hour(fn.parse_timestamp(c))
        assert _one(spark, "2017-03-12 02:30:00", "string", parsed) == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_clock_parts(spark):
    df = spark.createDataFrame([("24:05:59",), ("8:02:03",), ("x",), (None,)], "t string")
    parts = df.select(*[fn.clock_part(F.col("t"), p) for p in ("hour", "minute", "second")])
    assert [tuple(r) for r in parts.collect()] == [
        (24, 5, 59),
        (None, None, 3),
        (None, None, None),
        (None, None, None),
    ]


def _adjusted(hour, expected):
    if hour is not None and (hour == 24 or (hour == 23 and expected == 0)):
        return hour - 24
    return hour


def test_adjusted_hour(spark):
    cases = list(product([None, 0, 5, 22, 23, 24, 25], [None, 0, 1, 23]))
    df = spark.createDataFrame(cases, "h int, e int")
    got = df.select("h", "e", fn.adjusted_hour(F.col("h"), F.col("e")).alias("a")).collect()
    assert all(r.a == _adjusted(r.h, r.e) for r in got)
    assert len(got) == len(cases)


def test_delay_is_null_if_a_part_is(spark):
    names = ["a", "b", "c", "d", "e", "f"]
    rows = [(1, 2, 3, 0, 0, 0), (0, 0, 1, -1, 59, 0), (1, 2, None, 0, 0, 0), (1, 2, 3, None, 0, 0)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    cols = [F.col(n) for n in names]
    delays = df.select(fn.delay_seconds(tuple(cols[:3]), tuple(cols[3:]))).collect()
    assert [r[0] for r in delays] == [3723, 61, None, None]


@pytest.mark.parametrize("seconds, minutes", [(-30.0, -1), (59.9, 0), (60.0, 1), (-60.0, -1), (None, None)])
def test_whole_minutes_round_down(spark, seconds, minutes):
    assert _one(spark, seconds, "double", fn.whole_minutes) == minutes
