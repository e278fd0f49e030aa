import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from holdfast.functions.fixed import METRICS
from holdfast.operators import metrics

from .conftest import rows

TIES = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (0, 0.5), (1, 0.8)]


@pytest.fixture(scope="module")
def make_scored(spark):
    def make(pairs, model="m"):
        data = [(model, y, float(p), int(p >= 0.5)) for y, p in pairs]
        return spark.createDataFrame(data, "model string, label int, p double, prediction int")

    return make


def brute(pairs):
    """ROC-AUC by counting pairs and average precision by walking the thresholds."""
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    auc = wins / (len(pos) * len(neg)) if pos and neg else None
    ap, last = 0.0, 0.0
    for t in sorted({p for _, p in pairs}, reverse=True):
        tp = sum(p >= t for p in pos)
        recall = tp / len(pos) if pos else 0.0
        ap += (recall - last) * tp / (tp + sum(p >= t for p in neg))
        last = recall
    return auc, ap


def test_ties_across_classes(make_scored):
    r = rows(metrics.metric_rows(make_scored(TIES)))[0]
    assert r["roc_auc"] == 0.6667 and r["pr_auc"] == 0.5889
    assert (r["precision"], r["recall"], r["accuracy"]) == (0.6, 1.0, 0.6667)


def test_auc_agrees_with_spark(study):
    from holdfast.plans.registry import rule_scores

    scored = rule_scores(study.customers).filter("model = 'rule_activity'").withColumn("raw", F.col("p"))
    want = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="label", numBins=0).evaluate(scored)
    assert metrics.areas(scored).first()["roc_auc"] == pytest.approx(want, abs=1e-9)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6).map(lambda k: k / 6)), min_size=1, max_size=25))
def test_areas_agree_with_brute_force(make_scored, pairs):
    got = metrics.areas(make_scored(pairs)).first()
    auc, ap = brute(pairs)
    assert got["roc_auc"] == (None if auc is None else pytest.approx(auc))
    assert got["pr_auc"] == pytest.approx(ap)


def test_no_positive_prediction_and_single_class(make_scored):
    r = rows(metrics.metric_rows(make_scored([(1, 0.1), (0, 0.2)])))[0]
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.0, 0.0, 0.0, 0.5)
    r = rows(metrics.metric_rows(make_scored([(0, 0.1), (0, 0.7)])))[0]
    assert r["roc_auc"] is None and r["pr_auc"] == 0.0 and r["accuracy"] == 0.5


def test_curves_start_and_end(make_scored):
    roc = rows(metrics.roc_curve(make_scored(TIES)), "fpr", "tpr")
    assert (roc[0]["threshold"], roc[0]["fpr"], roc[0]["tpr"]) == (None, 0.0, 0.0)
    assert (roc[-1]["fpr"], roc[-1]["tpr"]) == (1.0, 1.0) and len(roc) == 5
    pr = rows(metrics.pr_curve(make_scored(TIES)), "recall")
    assert (pr[0]["precision"], pr[0]["recall"]) == (1.0, 0.0) and all(r["baseline"] == 0.5 for r in pr)


def test_hot_score_and_many_models(spark):
    """A third of all rows share one score."""
    table = spark.range(9000).selectExpr(
        "concat('m', id % 2) AS model", "cast(id % 5 = 0 as int) AS label",
        "if(id % 3 = 0, 0.5, (id * 7919 % 1000) / 1000) AS p",
    ).withColumn("prediction", (F.col("p") >= 0.5).cast("int"))
    got = {r["model"]: r for r in metrics.areas(table).collect()}
    for model in ("m0", "m1"):
        pairs = [(r["label"], r["p"]) for r in table.filter(F.col("model") == model).collect()]
        by_score = {}
        for y, p in pairs:
            by_score.setdefault(p, [0, 0])[y] += 1
        tp = fp = area = 0
        for p in sorted(by_score, reverse=True):
            n, k = by_score[p]
            area += n * (tp + k / 2)
            tp, fp = tp + k, fp + n
        assert got[model]["roc_auc"] == pytest.approx(area / (tp * fp))


def test_confusion_has_all_cells(make_scored):
    found = {(r["label"], r["prediction"]): (r["n"], r["row_share"]) for r in metrics.confusion(make_scored([(1, 0.9), (1, 0.1)])).collect()}
    assert found == {(0, 0): (0, 0.0), (0, 1): (0, 0.0), (1, 0): (1, 0.5), (1, 1): (1, 0.5)}


def test_scorecard_names_the_winner(make_scored):
    both = make_scored(TIES, "a").unionByName(make_scored([(1, 0.9), (0, 0.1)], "b"))
    card = {r["metric"]: r for r in metrics.scorecard(metrics.metric_rows(both), "a", "b").collect()}
    assert set(card) == set(METRICS)
    assert card["recall"]["winner"] == "tie" and card["roc_auc"]["winner"] == "b"
    assert card["roc_auc"]["delta"] == pytest.approx(0.3333)
    assert not math.isnan(card["f1"]["delta"])


def _shape(curve):
    return sorted((r["model"], r["fpr"], r["tpr"]) for r in curve.collect())


def _area(points):
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))


@pytest.mark.parametrize("borders", [[], [0.2, 0.21, 0.5, 0.77], [k / 50 for k in range(50)]])
def test_corners_are_the_same_curve_whatever_the_borders(spark, monkeypatch, borders):
    """Points between collinear neighbours go, also where the neighbours are in other buckets."""
    rng = np.random.default_rng(3)
    p = np.round(rng.random(600), 2)
    label = np.where(p > 0.8, 1, np.where(p < 0.3, 0, rng.integers(0, 2, 600)))
    scored = spark.createDataFrame([("m", int(c), float(v), int(v >= 0.5)) for c, v in zip(label, p)], "model string, label int, p double, prediction int")
    monkeypatch.setattr(metrics, "split_points", lambda *_: borders)
    full, corners = ([(f, t) for _, f, t in _shape(metrics.roc_curve(scored, corners=c))] for c in (False, True))
    assert set(corners) < set(full) and corners[0] == (0.0, 0.0) and corners[-1] == (1.0, 1.0)
    assert _area(corners) == pytest.approx(_area(full), abs=1e-12)
    turns = [(b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) for a, b, c in zip(corners, corners[1:], corners[2:])]
    assert all(abs(t) > 1e-9 for t in turns)


@pytest.mark.parametrize("cells", [5, 40])
def test_thinned_curves_are_bounded_and_close(spark, cells):
    rng = np.random.default_rng(4)
    p = rng.random(3000)
    label = (rng.random(3000) < p).astype(int)
    scored = spark.createDataFrame([("m", int(c), float(v), int(v >= 0.5)) for c, v in zip(label, p)], "model string, label int, p double, prediction int")
    full, thin = ([(f, t) for _, f, t in _shape(metrics.roc_curve(scored, cells=c))] for c in (None, cells))
    assert len(thin) <= cells + 2 and thin[0] == (0.0, 0.0) and thin[-1] == (1.0, 1.0)
    assert abs(_area(thin) - _area(full)) <= 4 / cells
    assert all(min(abs(a - f) + abs(b - t) for f, t in thin) <= 2 / cells for a, b in full)
    thin = metrics.pr_curve(scored, cells=cells).toPandas()
    assert len(thin) <= 3 * (cells + 1) + 1
    whole = metrics.pr_curve(scored).toPandas().dropna()
    parts = np.floor(whole.recall * cells)
    kept = thin.dropna().groupby(np.floor(thin.dropna().recall * cells)).precision.agg(["min", "max"])
    assert (whole.precision >= parts.map(kept["min"])).all() and (whole.precision <= parts.map(kept["max"])).all()
