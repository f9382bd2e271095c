from records import raw_frame

from stopwise import schemas
from stopwise.operators import cleaning, nulls
from stopwise.plans import lanes


def test_incomplete_rows_go(spark):
    raw = raw_frame(
        spark, {}, {"ExpectedArrivalTime": None}, {"ScheduledArrivalTime": None}, {"OriginName": None}
    )
    assert cleaning.drop_incomplete(raw).count() == 2


def test_dotted_names_are_replaced(spark):
    names = cleaning.rename_dotted(raw_frame(spark, {})).columns
    assert not any("." in n for n in names)
    assert "VehicleLocation_Latitude" in names


def test_means_fill_doubles_and_truncate_for_integers(spark):
    df = spark.createDataFrame(
        [(1, 1.0, None), (2, None, None), (None, 4.0, None), (2, 1.0, None)],
        "i int, d double, empty double",
    )
    filled = cleaning.impute_means(df).collect()
    assert [r.i for r in filled] == [1, 2, 1, 2]
    assert [r.d for r in filled] == [1.0, 2.0, 4.0, 1.0]
    assert all(r.empty is None for r in filled)
    literal = cleaning.impute_means(df, include_integers=False).collect()
    assert [r.i for r in literal] == [1, 2, None, 2]


def test_negative_integer_means_truncate_toward_zero(spark):
    df = spark.createDataFrame([(-1,), (-2,), (None,)], "i int")
    assert [r.i for r in cleaning.impute_means(df).collect()] == [-1, -2, -1]


def test_text_is_filled_except_arrival_times(spark):
    raw = raw_frame(spark, {"OriginName": None, "ScheduledArrivalTime": None})
    row = cleaning.fill_missing_text(cleaning.rename_dotted(raw)).first()
    assert row.OriginName == "" and row.ScheduledArrivalTime is None


def test_ingest_lane(spark):
    raw = raw_frame(spark, {}, {"ExpectedArrivalTime": "bad"}, {"DistanceFromStop": None})
    processed = lanes.ingest_lane(raw)
    assert processed.columns == schemas.FEATURE_ORDER
    good, bad, gap = processed.collect()
    assert (good.ScheduledArrivalTime_hour, good.Delay) == (0, 60)
    assert (good.OriginCoordinates, good.VehicleCoordinates) == (-34.0, -33.0)
    assert bad.Delay is None and bad.ExpectedArrivalTime_year is None
    assert bad.ScheduledArrivalTime_hour == 0
    assert gap.DistanceFromStop is None


def test_analysis_lane_fills_before_summing(spark):
    raw = raw_frame(
        spark,
        {"OriginLat": None, "DirectionRef": None},
        {"OriginLat": 42.0, "DirectionRef": 3},
        {"OriginLat": 1000.0, "ExpectedArrivalTime": None},
    )
    first, second = lanes.analysis_lane(raw).orderBy("DirectionRef", "OriginCoordinates").collect()
    assert first.OriginCoordinates == second.OriginCoordinates == -32.0
    assert first.DirectionRef == 3
    kept = lanes.analysis_lane(raw, include_integers=False)
    assert kept.filter("DirectionRef is null").count() == 1


def test_column_order_matches_the_contract():
    assert len(schemas.FEATURE_ORDER) == len(schemas.TABLE_ORDER) == 27
    assert set(schemas.FEATURE_ORDER) == set(schemas.TABLE_ORDER)
    assert len(schemas.KEY) == 11


def test_null_operators(spark):
    df = spark.createDataFrame(
        [(1, None, None), (None, "x", None), (None, None, None)], "a int, b string, c double"
    )
    assert nulls.drop_empty_rows(df).count() == 2
    counts = {r.column_name: (r.row_count, r.value_count) for r in nulls.null_column_counts(df).collect()}
    assert counts == {"a": (3, 1), "b": (3, 1), "c": (3, 0)}
    assert nulls.drop_empty_columns(df).columns == ["a", "b"]
    nulled = nulls.null_columns(df, ["a", "b"])
    assert nulled.dtypes == df.dtypes
    assert nulled.filter("a is not null or b is not null").isEmpty()
    doubles = nulls.as_doubles(df.selectExpr("a", "'1.5' b", "'B8' c"), ["a", "b", "c"]).first()
    assert (doubles.a, doubles.b, doubles.c) == (1.0, 1.5, None)
