import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stopwise.operators import correlation, pair_moments


def _frame(spark, pdf, parts=4):
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.itertuples(index=False)]
    schema = ", ".join(f"{c} double" for c in pdf.columns)
    return spark.createDataFrame(rows, schema).repartition(parts)


def _check(spark, pdf, parts=4, tolerance=1e-9):
    expected = pdf.corr().abs()
    got = correlation.correlation_pairs(_frame(spark, pdf, parts)).collect()
    seen = {(r.column_i, r.column_j): r.r for r in got}
    columns = list(pdf.columns)
    for a, x in enumerate(columns):
        for y in columns[a + 1 :]:
            want, have = expected.loc[x, y], seen.get((x, y))
            if np.isnan(want):
                assert have is None, (x, y, have)
            else:
                assert have == pytest.approx(want, abs=tolerance), (x, y)


def _random(n, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.normal(size=n)})
    pdf["c"] = pdf.a * 2 + rng.normal(size=n) * 0.1
    pdf["far"] = 1e6 + pdf.b * 0.01
    pdf["constant"] = 0.1
    pdf["empty"] = np.nan
    return pdf


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_matches_pandas(spark, parts):
    _check(spark, _random(500), parts, 1e-6)


def test_pairwise_gaps_match_pandas(spark):
    pdf = _random(400)
    rng = np.random.default_rng(5)
    for c in ("a", "b", "c", "far"):
        pdf.loc[rng.random(400) < 0.3, c] = np.nan
    _check(spark, pdf, 5, 1e-6)


def test_column_constant_over_the_shared_rows(spark):
    pdf = pd.DataFrame({"a": [0.1] * 9 + [7.0], "b": [*range(9), None]})
    _check(spark, pdf, 3)


def test_one_row_and_no_rows(spark):
    pdf = pd.DataFrame({"a": [1.0], "b": [2.0]})
    _check(spark, pdf, 1)
    assert correlation.correlation_pairs(_frame(spark, pdf).limit(0)).count() == 0


def test_infinite_values_give_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("inf"), 3.0), (2.0, 5.0)], "a double, b double")
    assert correlation.correlation_pairs(df).first().r is None


def test_text_counts_as_missing_and_numbers_in_text_count(spark):
    rows = [("1", 1, "x"), ("2", 2, "y"), ("B8", 9, "z"), ("4", 4, None)]
    pairs = correlation.correlation_pairs(spark.createDataFrame(rows, "a string, b int, c string"))
    got = {(r.column_i, r.column_j): (r.pair_rows, r.r) for r in pairs.collect()}
    assert got == {("a", "b"): (3, pytest.approx(1.0))}


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "i int, j int, column_i string, column_j string, r double")


def test_later_column_is_chosen_and_exempt_ones_only_cause(spark):
    pairs = _pairs(
        spark,
        [
            (0, 1, "a", "b", 0.95),
            (1, 2, "b", "c", 0.95),
            (0, 3, "a", "Delay", 0.99),
            (3, 4, "Delay", "d", 0.91),
            (0, 5, "a", "e", 0.9),
            (0, 6, "a", "f", None),
        ],
    )
    chosen = correlation.correlated_columns(pairs).orderBy("column_name").collect()
    assert [r.column_name for r in chosen] == ["b", "c", "d"]


def test_one_shuffle_and_no_row_explosion(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("a"), (-F.col("id")).alias("b"))
    plan = correlation.correlation_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "Generate" not in plan and "Expand" not in plan


def test_tasks_need_no_copy_of_the_package(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from stopwise.operators import correlation, pair_moments
from stopwise.session import build_session
spark = build_session("t", "local[2]", spark__ui__enabled="false")
df = spark.createDataFrame([(1, 2.0), (2, 4.5), (3, 6.0)], "a int, b double")
print("pairs", correlation.correlation_pairs(df).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120
    )
    assert "pairs 1" in ran.stdout, ran.stderr[-2000:]


def test_columns_with_values_in_the_same_rows_are_looked_at_once(monkeypatch):
    ends, calls = pair_moments._ends, []
    monkeypatch.setattr(pair_moments, "_ends", lambda low, high: calls.append(1) or ends(low, high))
    x = np.random.default_rng(2).normal(size=(200, 12))
    x[::3, 4] = x[::5, 7] = x[::5, 8] = x[:, 11] = np.nan
    moments = pair_moments.PairMoments(12)
    moments.add(x)
    assert len(calls) == 3
    for b in range(11):
        known = x[~np.isnan(x[:, b])]
        assert np.array_equal(moments.lo[:11, b], np.nanmin(known, axis=0)[:11])
        assert np.array_equal(moments.hi[:11, b], np.nanmax(known, axis=0)[:11])
    assert (moments.lo[:, 11] == np.inf).all() and (moments.hi[:, 11] == -np.inf).all()
