import pytest
from pyspark.sql import functions as F

from holdfast.functions import expressions as E, groups
from holdfast.functions.fixed import LEAK_COLUMNS
from holdfast.operators import quality
from holdfast.sources.tables import settle

from .conftest import by, rows


def _checks(table):
    return {(r["check"], r["column"]): r["value"] for r in table.collect()}


def test_leak_columns_go_and_their_absence_warns(make_raw, spark):
    raw = make_raw({})
    leaky = raw.selectExpr("*", f"0.5 AS {LEAK_COLUMNS[0]}", "1 AS my_Naive_Bayes_2")
    assert quality.drop_leak_columns(leaky).columns == raw.columns
    with pytest.warns(UserWarning):
        quality.drop_leak_columns(raw)


def test_target_is_last_and_null_counts_as_retained(make_raw):
    raw = make_raw({"Attrition_Flag": "Attrited Customer"}, {"Attrition_Flag": "Existing Customer"}, {"Attrition_Flag": None})
    table = quality.encode_target(raw)
    assert table.columns[-1] == "churn" and "Attrition_Flag" not in table.columns
    assert by(table, "CLIENTNUM", "churn") == {1: 1, 2: 0, 3: 0}
    with pytest.raises(KeyError):
        quality.encode_target(table)


def test_audit_counts_nulls_and_equal_rows(make_raw):
    row = {"CLIENTNUM": 9, "Gender": None, "Credit_Limit": float("nan")}
    table = quality.quality_audit(make_raw(row, row, row, {}))
    found = _checks(table)
    assert found["rows", "*"] == 4 and found["duplicate_rows", "*"] == 2
    assert found["nulls", "Gender"] == 3 and found["nulls", "Credit_Limit"] == 3 and found["nulls_total", "*"] == 6
    assert found["empty_columns", "*"] == 0 and found["columns", "*"] == 21


def test_audit_of_an_empty_column_and_table(make_raw):
    raw = make_raw({"Gender": None}, {"Gender": None})
    assert _checks(quality.quality_audit(raw))["empty_columns", "*"] == 1
    empty = _checks(quality.quality_audit(raw.limit(0)))
    assert empty["rows", "*"] == 0 and empty["duplicate_rows", "*"] == 0 and empty["empty_columns", "*"] == 0


def test_key_uniqueness(make_raw):
    assert rows(quality.key_uniqueness(make_raw({}, {}))) == [{"n_rows": 2, "n_keys": 2, "is_unique": 1}]
    twice = quality.key_uniqueness(make_raw({"CLIENTNUM": 1}, {"CLIENTNUM": 1}, {"CLIENTNUM": None}))
    assert rows(twice) == [{"n_rows": 3, "n_keys": 1, "is_unique": 0}]


def _copies(make_raw):
    odd = {"CLIENTNUM": 7, "Gender": None, "Credit_Limit": float("nan"), "Total_Amt_Chng_Q4_Q1": -0.0}
    return make_raw(odd, {**odd, "Total_Amt_Chng_Q4_Q1": 0.0}, odd, {"CLIENTNUM": 7}, {"CLIENTNUM": 7}, {"CLIENTNUM": 8, "Gender": None}, {"CLIENTNUM": 8, "Education_Level": None})


@pytest.mark.parametrize("digest", [E.fingerprint, lambda columns: F.lit(1), lambda columns: F.xxhash64(*columns) % 2])
def test_duplicates_are_exact_whatever_the_digest(make_raw, digest):
    """Rows that share a digest without being equal do not count."""
    assert quality.duplicate_rows(_copies(make_raw), digest).first()["duplicates"] == 3
    assert quality.duplicate_rows(_copies(make_raw).limit(0), digest).first()["duplicates"] == 0


def test_duplicates_in_more_groups_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(groups.with_group, "__defaults__", (3,))
    table = spark.range(90).selectExpr("id % 30 AS a", "if(id % 30 < 5, null, 'x') AS b").unionByName(spark.range(200).selectExpr("99L AS a", "'hot' AS b"))
    assert quality.duplicate_rows(table).first()["duplicates"] == 60 + 199


def test_only_digests_are_shuffled(make_raw, monkeypatch):
    """The wide rows of a table without duplicates stay where they are."""
    seen = []
    monkeypatch.setattr(quality, "settle", lambda df, name: seen.append(df) or settle(df, name))
    table = make_raw(*[{} for _ in range(50)])
    assert quality.duplicate_rows(table).first()["duplicates"] == 0
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange" in line and "hashpartitioning" in line]
    assert shuffled and all("__digest" in line and "CLIENTNUM" not in line for line in shuffled)
