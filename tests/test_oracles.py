"""Every query with a SQL equivalent, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from holdfast.plans.oracles import ORACLES
from holdfast.plans.registry import QUERIES

from .conftest import DATA

DIRECTORY = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(DIRECTORY):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DIRECTORY}/{file}'")
    return connection


def _plain(frame):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return v if isinstance(v, str) else float(v)

    return sorted((tuple(map(cell, r)) for r in frame.itertuples(index=False)), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got = entry_points.queries()[name](spark, DIRECTORY)
    columns = sorted(got.columns)
    want = duck.execute(entry_points.oracle_sql()[name]).df()
    assert sorted(want.columns) == columns
    assert _plain(got.select(*[f"`{c}`" for c in columns]).toPandas()) == _plain(want[columns])


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() > 0


def test_only_models_have_no_sql():
    without = set(QUERIES) - set(ORACLES)
    assert without == {
        "model_metrics", "model_confusion", "model_business", "cv_comparison", "gain_importance", "shap_values",
        "shap_importance", "shap_beeswarm", "shap_waterfall_top", "shap_dependence", "shap_trend", "shap_checks",
        "score_customers", "stream_scores", "model_roc", "model_pr", "model_scorecard", "model_portfolio", "model_roi",
    }
