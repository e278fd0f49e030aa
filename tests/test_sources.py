import pytest
from pyspark.errors import AnalysisException

from holdfast.operators.quality import ingest
from holdfast.sources import star, tables
from holdfast.sources.schema import CUSTOMERS, RAW, missing_columns, numeric_columns, string_columns

from .conftest import DATA


def test_csv_scan_uses_the_declared_schema(spark, tmp_path):
    raw = star.raw_customers(spark, f"{DATA}/sf0.001")
    path = str(tmp_path / "raw")
    tables.write_csv(raw.coalesce(1), path)
    again = tables.read_csv(spark, path)
    assert [f.dataType for f in again.schema] == [f.dataType for f in RAW]
    assert sorted(map(str, again.collect())) == sorted(map(str, raw.collect()))


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        tables.read_csv(spark, str(tmp_path / "none.csv"))


def test_wrong_header_is_an_error(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text(",".join(["x"] * len(RAW)) + "\n" + ",".join(["1"] * len(RAW)) + "\n")
    with pytest.raises(Exception):
        tables.read_csv(spark, str(path)).collect()


def test_write_replaces_and_verifies(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.range(10).toDF("a"), path)
    assert tables.write_table(spark.range(4).toDF("a"), path).count() == 4


def test_contract_of_the_ingested_table(spark):
    table = ingest(star.raw_customers(spark, f"{DATA}/sf0.001"))
    assert table.columns == CUSTOMERS.names and table.columns[-1] == "churn"
    assert missing_columns(table, [*CUSTOMERS.names, "more"]) == ["more"]
    assert len(numeric_columns(table)) == 16 and len(string_columns(table)) == 5


def test_shared_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = tables.shared_folder(spark)
    assert folder == (named or tables.shared_folder(spark)) and spark.sparkContext.getCheckpointDir()
    assert tables.fresh_path(spark, "x") != tables.fresh_path(spark, "x")
