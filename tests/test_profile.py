import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from holdfast.functions import quantiles as quantile_search
from holdfast.operators import profile

from .conftest import by, rows


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value; a long tail; nulls and NaN."""
    rng = np.random.default_rng(5)
    x = np.concatenate([np.full(400, 7.0), rng.lognormal(1, 1.2, 800)])
    label = rng.integers(0, 2, len(x))
    data = [(int(i), int(c), float(v)) for i, (c, v) in enumerate(zip(label, x))]
    data += [(5000, 0, None), (5001, 1, float("nan")), (5002, None, 3.0), (5003, 7, 3.0)]
    return spark.createDataFrame(data, "CLIENTNUM long, churn int, x double")


def _class(df, c):
    pdf = df.toPandas()
    return pdf[(pdf.churn == c) & pdf.x.notna()].x.to_numpy()


def test_age_bands_are_closed_on_the_right(make_customers):
    ages = [25, 26, 35, 36, 45, 75, 76]
    table = make_customers(*[{"Customer_Age": a} for a in ages])
    found = by(profile.rate_by_age(table), "age_group", "n")
    assert found == {"26-35": 2, "36-45": 2, "66-75": 1}


def test_rates_leave_out_missing_keys_but_not_from_the_overall(make_customers):
    gone = {"Attrition_Flag": "Attrited Customer"}
    table = make_customers({"Card_Category": None, **gone}, {"Card_Category": "Blue"}, {"Card_Category": "Gold", **gone})
    found = rows(profile.rate_by(table, F.col("Card_Category"), "card"))
    assert [(r["card"], r["rate"], round(r["overall"], 6)) for r in found] == [("Blue", 0.0, 66.666667), ("Gold", 100.0, 66.666667)]


def test_segments_are_sorted_by_rate(make_customers):
    gone = {"Attrition_Flag": "Attrited Customer"}
    table = make_customers({"Card_Category": "Blue"}, {"Card_Category": "Gold", **gone}, {"Card_Category": "Silver"})
    found = [r["value"] for r in profile.rate_by_segment(table).collect() if r["segment"] == "Card_Category"]
    assert found == ["Gold", "Blue", "Silver"]


@pytest.mark.parametrize("bins", [1, 7, 25])
def test_histogram_agrees_with_numpy(skewed, bins):
    got = profile.histogram(skewed, ["x"], bins)
    for c in (0, 1):
        counts, edges = np.histogram(_class(skewed, c), bins=bins)
        density, _ = np.histogram(_class(skewed, c), bins=bins, density=True)
        mine = got.filter(F.col("by") == c).orderBy("bin").toPandas()
        assert mine.n.tolist() == counts.tolist()
        np.testing.assert_allclose(mine.density, density, rtol=1e-12)
        np.testing.assert_allclose([*mine.lo, mine.hi.iloc[-1]], edges, rtol=1e-12)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_distributions_by_any_column(spark, kind):
    rng = np.random.default_rng(4)
    data = [(str(k) if kind == "string" else int(k), float(v)) for k, v in zip(rng.integers(0, 7, 700), rng.normal(size=700))]
    table = spark.createDataFrame([*data, (None, 1.0)], f"k {kind}, x double")
    groups = {k: np.array([v for key, v in data if key == k]) for k, _ in data}
    found = profile.histogram(table, ["x"], 6, by="k").collect()
    assert {r["by"] for r in found} == set(groups) and len(groups) == 7
    for k, x in groups.items():
        assert [r["n"] for r in sorted(found, key=lambda r: r["bin"]) if r["by"] == k] == np.histogram(x, 6)[0].tolist()
    density = profile.kde(table, "x", by="k", points=30).collect()
    assert {r["by"] for r in density} == set(groups) and len(density) == 7 * 30
    assert len({r["by"] for r in profile.histogram(table, ["x"], 6, by="k", classes=(data[0][0],)).collect()}) == 1


def test_histogram_of_a_constant_and_without_classes(spark):
    table = spark.createDataFrame([(1, 2.0, 5), (0, 2.0, 6)], "churn int, a double, b int")
    found = rows(profile.histogram(table, ["a", "b"], 4, by=None), "feature", "bin")
    assert [r["n"] for r in found] == [2, 1, 0, 0, 1] and "by" not in found[0]
    assert found[0]["hi"] - found[0]["lo"] == 1.0


@pytest.mark.parametrize("cut", [None, 2.0])
def test_density_agrees_with_the_plain_sum(skewed, cut):
    got = profile.kde(skewed, "x", points=50, cut=cut)
    for c in (0, 1):
        x = _class(skewed, c)
        bw = x.std(ddof=1) * len(x) ** -0.2
        pad = (x.max() - x.min()) / 2 if cut is None else cut * bw
        grid = np.linspace(x.min() - pad, x.max() + pad, 50)
        want = np.exp(-(((grid[:, None] - x) / bw) ** 2) / 2).sum(axis=1) / (len(x) * bw * math.sqrt(2 * math.pi))
        mine = got.filter(F.col("by") == c).orderBy("point").toPandas()
        np.testing.assert_allclose(mine.g, grid, rtol=1e-10, atol=1e-10)
        np.testing.assert_allclose(mine.density, want, rtol=1e-9)


def test_density_needs_spread(spark):
    table = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 2.0)], "churn int, x double")
    assert profile.kde(table, "x").count() == 0


def test_box_agrees_with_numpy(skewed):
    got = {r["by"]: r for r in profile.box(skewed, "x").collect()}
    assert set(got) == {0, 1, 7}  # every class there is; rows without one belong to none
    for c in got:
        x = _class(skewed, c)
        q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        want = [q1, q2, q3, x[x >= low].min(), x[x <= high].max(), ((x < low) | (x > high)).sum()]
        mine = [got[c][n] for n in ("q1", "q2", "q3", "whisker_lo", "whisker_hi", "n_out")]
        np.testing.assert_allclose(mine, want, rtol=1e-12)


@pytest.fixture(scope="module")
def crowded(spark):
    """12,000 classes, one with a third of all rows, one value with a third of its rows."""
    rng = np.random.default_rng(8)
    keys = np.concatenate([np.repeat(np.arange(12_000), 3), np.full(18_000, 5)])
    x = np.where(rng.random(len(keys)) < 0.33, 2.5, np.round(rng.normal(keys % 7, 1, len(keys)), 3))
    table = spark.createDataFrame(pd.DataFrame({"k": keys, "x": x})).repartition(5)
    return table, {int(k): x[keys == k] for k in (0, 5, 77, 11_999)}


def test_boxes_of_very_many_classes(crowded):
    table, some = crowded
    got = {r["by"]: r for r in profile.box(table, "x", by="k").collect()}
    assert len(got) == 12_000
    for k, x in some.items():
        q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        want = [q1, q2, q3, x[x >= low].min(), x[x <= high].max(), ((x < low) | (x > high)).sum()]
        np.testing.assert_allclose([got[k][n] for n in ("q1", "q2", "q3", "whisker_lo", "whisker_hi", "n_out")], want, rtol=1e-12)


def test_densities_of_very_many_classes(crowded):
    table, some = crowded
    got = profile.kde(table, "x", by="k", points=8).filter(F.col("by").isin(*some)).toPandas()
    for k, x in some.items():
        mine = got[got.by == k].sort_values("point")
        bw = x.std(ddof=1) * len(x) ** -0.2
        want = np.exp(-(((mine.g.to_numpy()[:, None] - x) / bw) ** 2) / 2).sum(axis=1) / (len(x) * bw * math.sqrt(2 * math.pi)) if bw else []
        assert len(mine) == (8 if bw else 0)
        np.testing.assert_allclose(mine.density, want, rtol=1e-9, atol=2.2e-16 / bw if bw else 0)


@pytest.mark.parametrize("reach", [3.0, 8.5])
def test_what_lies_beyond_the_reach_of_kernels_is_bounded(skewed, reach):
    got = profile.kde(skewed, "x", points=200, reach=reach)
    for c in (0, 1):
        x = _class(skewed, c)
        bw = x.std(ddof=1) * len(x) ** -0.2
        mine = got.filter(F.col("by") == c).orderBy("point").toPandas()
        exact = np.exp(-(((mine.g.to_numpy()[:, None] - x) / bw) ** 2) / 2).sum(axis=1) / (len(x) * bw * math.sqrt(2 * math.pi))
        assert np.abs(mine.density - exact).max() <= math.exp(-(reach**2) / 2) / (math.sqrt(2 * math.pi) * bw) + 1e-15


def test_histograms_of_very_many_classes(crowded):
    table, some = crowded
    got = profile.histogram(table, ["x"], 4, by="k")
    for k, x in some.items():
        assert [r["n"] for r in got.filter(F.col("by") == k).orderBy("bin").collect()] == (np.histogram(x, 4)[0].tolist() if np.ptp(x) else [len(x)])


@pytest.mark.parametrize("kind", ["spread", "crowding", "infinite", "hot", "tiny"])
def test_quantiles_narrow_whatever_the_values(spark, monkeypatch, kind):
    monkeypatch.setattr(quantile_search, "BY_VALUE", 8)
    monkeypatch.setattr(quantile_search, "CELLS", 8)
    rng = np.random.default_rng(2)
    x = {
        "spread": rng.normal(size=500), "crowding": 10.0 ** rng.uniform(-300, 300, 500) * rng.choice([-1, 1], 500),
        "infinite": np.concatenate([[np.inf] * 20, [-np.inf] * 20, rng.normal(size=100)]),
        "hot": np.concatenate([np.full(300, 1.5), rng.normal(size=200)]), "tiny": np.arange(40) * 5e-324,
    }[kind]
    table = spark.createDataFrame(pd.DataFrame({"k": "a", "x": x})).repartition(3)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    row = quantile_search.quantiles(table, "k", "x", shares).first()
    held = np.clip(x, -1.7976931348623157e308, 1.7976931348623157e308)
    assert row["total"] == len(x)
    s, places = np.sort(held), [(len(x) - 1) * p for p in shares]
    want = [s[math.floor(p)] + (s[math.ceil(p)] - s[math.floor(p)]) * (p - math.floor(p)) for p in places]
    assert row["quantiles"] == want


def test_correlations_use_the_pairs_that_are_known(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(60, 4)), columns=list("abcd"))
    pdf["b"] += pdf["a"]
    pdf.loc[::7, "c"] = np.nan
    pdf["k"] = 1.0
    table = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in pdf.to_numpy().tolist()], "a double, b double, c double, d double, k double")
    want = pdf.corr()
    found = profile.correlations(table).collect()
    assert len(found) == 10
    for r in found:
        if "k" in (r["a"], r["b"]):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(want.loc[r["a"], r["b"]], abs=1e-12)


def test_correlations_of_far_off_values_and_many_tasks(spark, monkeypatch):
    """Values far from 0, every pattern of nulls, constants, and sums joined in groups."""
    monkeypatch.setattr(profile, "MERGED", 2)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)) + 1e8
    x[:, 4] = 1e8 + 1 / 3
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:100, 0] = np.nan
    pdf = pd.DataFrame(x, columns=list("abcde"))
    table = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in x.tolist()], "a double, b double, c double, d double, e double").repartition(6)
    want = pdf.corr()
    for r in profile.correlations(table).collect():
        assert r["r"] is None if "e" in (r["a"], r["b"]) else r["r"] == pytest.approx(want.loc[r["a"], r["b"]], abs=1e-6)
    assert [r["r"] for r in profile.correlations(table.limit(0)).collect()] == [None] * 10


def test_sample_is_the_same_after_repartitioning(study):
    a = profile.sample(study.customers, 50).select("CLIENTNUM").collect()
    b = profile.sample(study.customers.repartition(7), 50).select("CLIENTNUM").collect()
    assert a == b and len(a) == 50
    assert profile.sample(study.customers.limit(3), 50).count() == 3


def test_summary(make_customers):
    table = make_customers({"Attrition_Flag": "Attrited Customer", "Customer_Age": 30}, {"Customer_Age": 50})
    r = rows(profile.summary(table))[0]
    assert (r["total"], r["churned"], r["retained"], r["churn_rate"], r["avg_age"], r["features"]) == (2, 1, 1, 50.0, 40.0, 20)
