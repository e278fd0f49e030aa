import math

import pytest
from pyspark.sql import functions as F

from holdfast.operators import split

from .conftest import rows


def _sides(df):
    return {r["CLIENTNUM"]: r["split"] for r in df.select("CLIENTNUM", "split").collect()}


def test_quota_by_largest_remainder():
    assert split.test_quota({0: 8500, 1: 1627}, 0.2) == {0: 1701, 1: 325}
    assert split.test_quota({0: 1, 1: 1}, 0.2) == {0: 1, 1: 0}
    for sizes in ({0: 17, 1: 5}, {0: 7, 1: 7}, {0: 101, 1: 3}):
        quota = split.test_quota(sizes, 0.2)
        assert sum(quota.values()) == math.ceil(sum(sizes.values()) * 0.2)


def test_split_is_stratified_and_independent_of_partitioning(study):
    a = _sides(split.with_split(study.customers))
    b = _sides(split.with_split(study.customers.repartition(11)))
    assert a == b
    found = {r["split"]: r for r in split.split_balance(study.divided).collect()}
    assert found["test"]["n"] == 300 and found["train"]["n"] == 1200
    assert abs(found["test"]["rate"] - found["train"]["rate"]) < 2


def test_another_seed_gives_another_split(study):
    assert _sides(study.divided) != _sides(split.with_split(study.customers, seed=7))


def test_folds_differ_by_one_row_per_class(study):
    sizes = split.with_folds(study.train).groupBy("churn", "fold").count().collect()
    for c in (0, 1):
        n = [r["count"] for r in sizes if r["churn"] == c]
        assert len(n) == 5 and max(n) - min(n) <= 1


def test_tiny_strata(spark):
    table = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "CLIENTNUM long, churn int")
    sides = split.with_split(table)
    assert sides.filter("split = 'test'").count() == 1 and sides.count() == 3
    assert split.with_folds(table).filter("fold is null").count() == 0


def test_copies_of_an_id_stay_on_one_side(study):
    hot = study.customers.filter("CLIENTNUM = 17").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(700)))).drop("copy")
    sides = split.with_split(study.customers.unionByName(hot)).groupBy("CLIENTNUM").agg(F.count_distinct("split").alias("n"))
    assert sides.filter("n > 1").count() == 0


def test_leak_is_found(study):
    columns = ["Customer_Age", "Credit_Limit"]
    train, test = study.train, study.test
    clean = rows(split.leaked_rows(train, test, ["CLIENTNUM"]))[0]["n_shared"]
    leaked = rows(split.leaked_rows(train.unionByName(test.limit(3)), test, ["CLIENTNUM"]))[0]["n_shared"]
    assert (clean, leaked) == (0, 3)
    assert rows(split.leaked_rows(train, train, columns))[0]["n_shared"] == train.select(*columns).distinct().count()


def test_too_many_strata_is_an_error(spark):
    table = spark.range(300).selectExpr("id AS CLIENTNUM", "cast(id as int) AS churn")
    with pytest.raises(ValueError):
        split.with_split(table)
