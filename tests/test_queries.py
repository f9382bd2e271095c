import pytest
from compare import compare, oracle_connection

import __spark_entry__ as registered

SF = "/root/testdata/sf0.001"
ORACLES = registered.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", ORACLES)
def test_matches_sql(spark, connection, name):
    assert compare(registered.queries()[name](spark, SF), connection, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registered.queries()) - set(ORACLES)))
def test_runs(spark, name):
    assert registered.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert registered.entry(spark).count() == 807


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["delay_seconds", "processed_records", "json_round_trip"])
def test_stateless_queries_neither_shuffle_nor_leave_the_jvm(spark, name):
    plan = _plan(registered.queries()[name](spark, SF))
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_only_needed_columns_are_scanned(spark):
    plan = _plan(registered.drop_empty_rows(spark, SF))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>" in plan
