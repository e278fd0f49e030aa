import os

import pytest

from holdfast.operators import models
from holdfast.plans.retention import Study
from holdfast.session import local_session
from holdfast.sources import star

DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, memory="6g", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def study(spark):
    """A study of the 1,500 customers at sf0.01, with a small tree model."""
    raw = star.raw_customers(spark, f"{DATA}/sf0.01")
    return Study(raw, [models.logistic(), models.boosted(trees=20)])


RAW_ROW = {
    "CLIENTNUM": 1, "Attrition_Flag": "Existing Customer", "Customer_Age": 40, "Gender": "M", "Dependent_count": 2,
    "Education_Level": "Graduate", "Marital_Status": "Married", "Income_Category": "$60K - $80K", "Card_Category": "Blue",
    "Months_on_book": 36, "Total_Relationship_Count": 4, "Months_Inactive_12_mon": 2, "Contacts_Count_12_mon": 3,
    "Credit_Limit": 9000.0, "Total_Revolving_Bal": 1000, "Avg_Open_To_Buy": 8000.0, "Total_Amt_Chng_Q4_Q1": 0.7,
    "Total_Trans_Amt": 4000.0, "Total_Trans_Ct": 60, "Total_Ct_Chng_Q4_Q1": 0.6, "Avg_Utilization_Ratio": 0.111,
}


@pytest.fixture(scope="session")
def make_raw(spark):
    """A raw table from partial rows; what is not given is that of RAW_ROW."""
    from pyspark.sql.types import StructType

    from holdfast.sources.schema import RAW

    schema = StructType([field for field in RAW if not field.name.startswith("Naive")])

    def make(*rows):
        full = [{**RAW_ROW, "CLIENTNUM": i + 1, **row} for i, row in enumerate(rows)]
        return spark.createDataFrame([tuple(r[n] for n in schema.names) for r in full], schema)

    return make


@pytest.fixture(scope="session")
def make_customers(make_raw):
    from holdfast.operators.quality import encode_target

    return lambda *rows: encode_target(make_raw(*rows))


def rows(df, *order):
    """Rows as dicts, sorted."""
    return [r.asDict() for r in df.orderBy(*(order or df.columns)).collect()]


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}

