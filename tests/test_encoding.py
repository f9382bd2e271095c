import random

import pytest
from pyspark.ml.feature import StringIndexer

from stopwise.operators import encoding


def _index(df, column="c"):
    return {r.label: r.label_index for r in encoding.label_index(df, [column]).collect()}


def test_frequency_then_alphabet(spark):
    df = spark.createDataFrame([(v,) for v in ["c", "c", "b", "a", "", "", None]], "c string")
    assert _index(df) == {"": 0, "c": 1, "a": 2, "b": 3}


def test_matches_the_library_indexer_over_many_slices(spark):
    rng = random.Random(2)
    values = [f"v{int(rng.paretovariate(0.5)) % 500}" for _ in range(3000)]
    df = spark.createDataFrame([(v, "x") for v in values], "c string, d string").repartition(6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = encoding.label_index(df, ["c", "d"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    ours = {r.label: r.label_index for r in got if r.column_name == "c"}
    labels = StringIndexer(inputCol="c", outputCol="i").fit(df).labels
    assert ours == {label: n for n, label in enumerate(labels)}
    assert [(r.label, r.label_index) for r in got if r.column_name == "d"] == [("x", 0)]


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_unseen_and_null_labels_get_the_label_count(spark, broadcast):
    seen = spark.createDataFrame([(v,) for v in ["c", "c", "b", "a", ""]], "c string")
    new = spark.createDataFrame([(v,) for v in ["c", "", "zzz", None]], "c string")
    index = encoding.label_index(seen, ["c"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        codes = {r.c: r.c_indexed for r in encoding.label_encode(new, ["c"], index).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert codes == {"c": 0.0, "": 1.0, "zzz": 4.0, None: 4.0}


def test_no_labels_at_all(spark):
    empty = spark.createDataFrame([(None,)], "c string")
    assert [r.c_indexed for r in encoding.label_encode(empty, ["c"]).collect()] == [0.0]
