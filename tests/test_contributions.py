import numpy as np
import pytest

from holdfast.operators import contributions as c

NAMES = ["Total_Trans_Ct", "b", "k", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    value = rng.normal(size=(80, 4))
    value[:, 2] = 1.0
    shap = np.stack([value[:, 0] ** 3 + 0.5 * value[:, 1], -value[:, 1], np.zeros(80), value[:, 3] * 0.1], axis=1)
    rows = [(i, -0.5, v.tolist(), s.tolist()) for i, (v, s) in enumerate(zip(value, shap))]
    return value, shap, spark.createDataFrame(rows, "CLIENTNUM long, base double, value array<double>, shap array<double>")


def test_importance(data):
    _, shap, table = data
    found = c.importance(table, NAMES).collect()
    want = np.abs(shap).mean(axis=0)
    assert [r["feature"] for r in found] == [NAMES[i] for i in np.argsort(-want)]
    assert found[0]["mean_abs"] == pytest.approx(want.max()) and found[-1]["direction"] == "↓ Away from Churn"
    assert [r["rank"] for r in c.importance(table, NAMES, top=2).collect()] == [1, 2]


def test_beeswarm_collapses_the_rest(data):
    _, shap, table = data
    full = c.beeswarm(table, NAMES)
    assert full.count() == 320
    few = c.beeswarm(table, NAMES, top=3).toPandas()
    assert set(few.feature) == {"Total_Trans_Ct", "b", "Sum of 2 other features"}
    rest = few[few["rank"] == 3].sort_values("CLIENTNUM").shap
    np.testing.assert_allclose(rest, shap[:, 2] + shap[:, 3])


@pytest.mark.parametrize("top", [2, 3, 4, 15])
def test_waterfall_steps_join_up(data, top):
    _, shap, table = data
    steps = c.waterfall(table, NAMES, top=top).toPandas()
    for i, part in steps.groupby("CLIENTNUM"):
        part = part.sort_values("rank")
        assert len(part) == min(top, 4)
        np.testing.assert_allclose(part.end - part.start, part.shap, atol=1e-12)
        np.testing.assert_allclose(part.start.iloc[:-1], part.end.iloc[1:], atol=1e-12)
        assert part.start.iloc[-1] == -0.5 and part.end.iloc[0] == pytest.approx(-0.5 + shap[i].sum())


def test_interaction_skips_constants(data):
    value, shap, table = data
    slope, intercept = np.polyfit(value[:, 0], shap[:, 0], 1)
    residual = shap[:, 0] - slope * value[:, 0] - intercept
    want = {n: abs(np.corrcoef(residual, value[:, i])[0, 1]) for i, n in enumerate(NAMES) if n in "bd"}
    found = {r["feature"]: r for r in c.interaction(table, NAMES).collect()}
    assert set(found) == {"b", "d"}
    for name, r in want.items():
        assert found[name]["abs_r"] == pytest.approx(r) and found[name]["chosen"] == int(r == max(want.values()))
    points = c.dependence(table, NAMES).orderBy("CLIENTNUM").toPandas()
    chosen = max(want, key=want.get)
    np.testing.assert_allclose(points.interaction_value, value[:, NAMES.index(chosen)])


def test_target_falls_back_to_the_strongest(data):
    assert c.interaction(data[2], ["a", "b", "k", "d"]).first()["target"] == "a"


def test_constant_target_has_no_interaction_and_no_trend(data):
    assert c.interaction(data[2], NAMES, "k").count() == 0
    assert c.trend(data[2], NAMES, "k").count() == 0
    assert c.dependence(data[2], NAMES, "k").filter("interaction_feature is not null").count() == 0


def test_trend_is_the_cubic_fit(data):
    value, shap, table = data
    found = c.trend(table, NAMES).toPandas().sort_values("x")
    want = np.polyval(np.polyfit(value[:, 0], shap[:, 0], 3), found.x)
    np.testing.assert_allclose(found.y, want, atol=1e-9)
    assert len(found) == 200 and found.x.iloc[-1] == pytest.approx(value[:, 0].max())
