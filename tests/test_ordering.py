import random

import pytest
from pyspark.sql import Window, functions as F

from holdfast.functions.ordering import hash_cuts, hash_key, running_totals, split_points


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    data = {(k, round(rng.choice([rng.random(), 0.5, rng.random() ** 8]), 4)) for k in "ab" for _ in range(400)}
    return spark.createDataFrame([(k, v, rng.randint(0, 5)) for k, v in sorted(data)], "k string, v double, n long")


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("borders", [[], [0.5], [0.1, 0.2, 0.5, 0.9], "found"])
def test_running_totals_do_not_depend_on_borders(values, borders, descending):
    if borders == "found":
        borders = split_points(values, "v", 16)
    got = running_totals(values, ["k"], "v", {"n": F.sum("n")}, ["n"], borders, descending)
    order = F.col("v").desc() if descending else F.col("v")
    window = Window.partitionBy("k").orderBy(order)
    want = values.withColumn("cum_n", F.sum("n").over(window)).withColumn(
        "total_n", F.sum("n").over(Window.partitionBy("k"))
    )
    columns = ["k", "v", "n", "cum_n", "total_n"]
    assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect())


def test_split_points_stay_few_and_sorted(values):
    points = split_points(values, "v", 8)
    assert points == sorted(set(points)) and len(points) <= 7


@pytest.mark.parametrize("kind", ["equal", "tail", "even"])
def test_split_points_fill_buckets_evenly(spark, kind):
    rng = random.Random(kind)
    data = {
        "equal": [0.25] * 4950 + [rng.random() for _ in range(50)],
        "tail": [rng.random() ** 12 * 1e6 for _ in range(5000)],
        "even": [rng.random() for _ in range(5000)],
    }[kind] + [float("nan"), float("inf"), None]
    points = split_points(spark.createDataFrame([(v,) for v in data], "v double"), "v", 10)
    assert points == sorted(set(points)) and len(points) <= 9
    finite = [v for v in data if v is not None and v - v == 0]
    cuts = [float("-inf"), *points, float("inf")]
    sizes = [len({v for v in finite if a <= v < b}) if kind == "equal" else sum(a <= v < b for v in finite) for a, b in zip(cuts, cuts[1:])]
    assert max(sizes) <= (60 if kind == "equal" else 900)


def test_hash_cuts_are_the_wanted_ranks(spark):
    table = spark.range(3000).select(F.col("id").alias("key"), (F.col("id") % 3 == 0).cast("int").alias("s"))
    cuts = hash_cuts(table, "key", "s", 7, lambda sizes: {s: [1, n // 2, n] for s, n in sizes.items()})
    for s in (0, 1):
        ordered = sorted((r[0], r[1]) for r in table.filter(F.col("s") == s).select(hash_key("key", 7), "key").collect())
        assert cuts[s] == [ordered[0], ordered[len(ordered) // 2 - 1], ordered[-1]]


def test_hash_cuts_count_copies_of_a_hot_id(spark):
    hot = spark.range(1000).select(F.lit(5).cast("long").alias("key"), F.lit(0).alias("s"))
    table = spark.range(2000).select(F.col("id").alias("key"), F.lit(0).alias("s")).unionByName(hot)
    at = sorted((r[0], r[1]) for r in table.select(hash_key("key", 1), "key").collect())
    cuts = hash_cuts(table, "key", "s", 1, lambda sizes: {s: [n // 3, n // 2] for s, n in sizes.items()})
    assert cuts[0] == sorted({at[3000 // 3 - 1], at[3000 // 2 - 1]})
