import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel

from holdfast.functions.fixed import FEATURES
from holdfast.operators import features as fe

from .conftest import by, rows


def test_null_and_unmapped_categories(make_customers):
    table = make_customers(
        {"Gender": None, "Education_Level": "PhD", "Marital_Status": None},
        {"Gender": "M", "Education_Level": "Unknown", "Marital_Status": "Married"},
        {"Gender": "F", "Education_Level": None, "Marital_Status": "Divorced"},
    )
    codes = rows(fe.encode_ordinals(fe.encode_gender(table)), "CLIENTNUM")
    assert [r["Gender"] for r in codes] == [0, 1, 0]
    assert [r["Education_Level"] for r in codes] == [None, -1, None]
    assert by(fe.count_unknowns(fe.encode_ordinals(table)), "feature", "unknowns") == {"Education_Level": 1, "Income_Category": 0}
    categories = fe.fit_categories(table)
    assert categories == {"Marital_Status": ["Married"], "Card_Category": []}
    flags = fe.encode_nominals(table, categories)
    assert by(flags, "CLIENTNUM", "Marital_Status_Married") == {1: 0, 2: 1, 3: 0}
    assert flags.columns[-1] == "Marital_Status_Married" and "Card_Category" not in flags.columns


def test_unseen_category_scores_as_the_dropped_one(make_customers):
    assert by(fe.encode_nominals(make_customers({"Card_Category": "Black"}), {"Card_Category": ["Gold"]}), "CLIENTNUM", "Card_Category_Gold") == {1: 0}


def test_too_many_categories_is_an_error(spark):
    table = spark.range(500).selectExpr("cast(id as string) AS c")
    with pytest.raises(ValueError):
        fe.fit_categories(table, ["c"])


def test_logs_come_before_the_engineered_columns(make_customers):
    table = make_customers({"Total_Trans_Amt": 0.0}, {"Total_Trans_Amt": 99.0, "Total_Trans_Ct": 9})
    logged = fe.log_columns(table)
    assert "Total_Trans_Amt" not in logged.columns
    assert by(logged, "CLIENTNUM", "Total_Trans_Amt_log")[1] == 0.0
    made = rows(fe.engineer(logged), "CLIENTNUM")
    assert made[1]["transaction_velocity"] == pytest.approx(math.log1p(99) / 10)
    assert made[1]["credit_usage_gap"] == pytest.approx(math.log1p(9000) - math.log1p(8000))
    assert made[1]["inactivity_risk"] == 6
    raw = rows(fe.engineer(table), "CLIENTNUM")
    assert raw[1]["transaction_velocity"] == pytest.approx(9.9) and raw[1]["credit_usage_gap"] == 1000.0


def test_scaling_uses_the_population_deviation_and_spares_constants(make_customers):
    table = make_customers({"Customer_Age": 30}, {"Customer_Age": 50})
    wide = fe.CustomerFeatures().fit(table).table(table)
    assert by(wide, "CLIENTNUM", "Customer_Age") == {1: -1.0, 2: 1.0}
    assert by(wide, "CLIENTNUM", "Months_on_book") == {1: 0.0, 2: 0.0}


def test_contract_order_and_standard_scores(study):
    model = fe.CustomerFeatures().fit(study.customers)
    assert model.feature_names == FEATURES
    wide = model.table(study.customers)
    assert wide.columns == ["CLIENTNUM", *FEATURES, "churn"]
    x = wide.toPandas()[FEATURES].to_numpy()
    np.testing.assert_allclose(x.mean(axis=0), 0, atol=1e-9)
    np.testing.assert_allclose(x.std(axis=0), 1, atol=1e-9)


def test_fit_on_training_rows_only(study):
    on_train = fe.CustomerFeatures(fitOn="split = 'train'").fit(study.divided)
    means = fe.CustomerFeatures().fit(study.train).getOrDefault("means")
    np.testing.assert_allclose(on_train.getOrDefault("means"), means)
    assert on_train.feature_names == FEATURES


def test_vector_equals_the_table_and_survives_saving(study, tmp_path):
    path = str(tmp_path / "m")
    Pipeline(stages=[fe.CustomerFeatures()]).fit(study.customers).write().overwrite().save(path)
    loaded = PipelineModel.load(path).stages[0]
    vectors = loaded.transform(study.customers)
    assert vectors.columns == [*study.customers.columns, "features"]
    wide = loaded.table(study.customers).orderBy("CLIENTNUM").toPandas()[FEATURES].to_numpy()
    made = np.array([r["features"].toArray() for r in vectors.orderBy("CLIENTNUM").collect()])
    np.testing.assert_array_equal(made, wide)


def test_null_feature_is_an_error_when_scoring(make_customers):
    good = make_customers({}, {"Customer_Age": 50})
    model = fe.CustomerFeatures().fit(good)
    with pytest.raises(Exception, match="feature is null"):
        model.transform(make_customers({"Education_Level": "PhD"})).collect()
