import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.functions.fixed import FEATURES
from holdfast.operators import contributions, metrics, models
from holdfast.plans import registry
from holdfast.plans.retention import Study
from holdfast.streaming.scoring import explained_records, risk_records, stream_scores
from holdfast.sources import tables


def test_quality_gates(study):
    found = {r["model"]: r for r in metrics.metric_rows(study.scored).collect()}
    assert found["BoostedTrees"]["roc_auc"] > 0.90 and found["LogisticRegression"]["roc_auc"] > 0.80
    assert found["BoostedTrees"]["roc_auc"] > found["LogisticRegression"]["roc_auc"]


def test_scores_are_complete(study):
    assert study.scored.count() == 2 * 300
    assert study.scored.filter("p < 0 OR p > 1 OR p IS NULL OR prediction NOT IN (0, 1)").count() == 0
    assert study.scored.filter("(p > 0.5) <> (prediction = 1) AND abs(p - 0.5) > 1e-9").count() == 0


def test_logistic_solves_the_penalised_likelihood(study):
    """At the optimum, beta = C * sum of weighted residuals times x."""
    vectors = models.vector_table(study.features, study.train).collect()
    x = np.array([r["features"].toArray() for r in vectors])
    y = np.array([r["churn"] for r in vectors])
    w = np.where(y == 1, *reversed(models.balanced_weights(int((y == 0).sum()), int(y.sum()))))
    fitted = study.pipeline.stages[1]
    beta, b0 = fitted.coefficients.toArray(), fitted.intercept
    residual = w * (y - 1 / (1 + np.exp(-(x @ beta + b0))))
    assert np.abs(x.T @ residual - beta).max() < 0.05 and abs(residual.sum()) < 0.05


def test_weights(study):
    row = models.class_weights(study.train).first()
    neg, pos = row["n_retained"], row["n_churned"]
    assert (row["balanced_retained"], row["balanced_churned"]) == models.balanced_weights(neg, pos)
    assert row["imbalance"] == models.imbalance_weights(neg, pos)[1] == round(neg / pos, 4)


def test_saved_pipeline_scores_the_same(study, tmp_path):
    path = str(tmp_path / "pipeline")
    models.save_pipeline(study.pipeline, path)
    again = models.score(models.load_pipeline(path), study.test).select("CLIENTNUM", "model", "p")
    assert sorted(again.collect()) == sorted(study.scored.select("CLIENTNUM", "model", "p").collect())


def test_cross_validation_table(study):
    quick = [models.logistic(max_iter=20), models.boosted("Trees", trees=2, depth=3)]
    from holdfast.operators.split import with_folds

    vectors = models.vector_table(study.features, with_folds(study.train, 3), "fold")
    folds = models.cross_validate(quick, vectors, folds=3, parallelism=3)
    table = models.cv_comparison(folds, ["LogisticRegression", "Trees"]).toPandas().set_index("metric")
    assert sorted(table.index) == ["f1", "precision", "recall", "roc_auc"]
    want = folds.filter("model = 'Trees'").toPandas()
    assert table.loc["recall", "Trees_mean"] == pytest.approx(want.recall.mean(), abs=1e-4)
    assert table.loc["recall", "Trees_std"] == pytest.approx(want.recall.std(ddof=0), abs=1e-4)


def test_fits_take_one_wave_of_tasks(study, spark, monkeypatch):
    """A level of a tree waits for all partitions, so rows in one more than there are cores are dealt out anew."""
    cores = spark.sparkContext.defaultParallelism
    vectors = models.vector_table(study.features, study.train)
    assert models.one_wave(vectors) is vectors  # few partitions: the fit sees what it always saw
    crowded = vectors.repartition(cores + 1)
    spread = models.one_wave(crowded)
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == cores and max(sizes) - min(sizes) <= cores + 1
    assert sorted(spread.collect()) == sorted(vectors.collect())

    seen = []
    monkeypatch.setattr(models, "fit_all", lambda learners, rows: seen.append(rows.rdd.getNumPartitions()) or [])
    many = Study(study.raw, study.learners)
    many.customers = study.customers.repartition(cores + 1)
    assert many.train.rdd.getNumPartitions() > cores
    many.pipeline
    monkeypatch.setattr(models, "fit", lambda learner, rows: seen.append(rows.rdd.getNumPartitions()) or study.tree_model)
    folded = crowded.withColumn("fold", F.col("CLIENTNUM") % 2)
    models.cross_validate(study.learners[1:], folded, folds=2)
    assert seen == [cores] * 3


def test_fits_use_all_cores_when_few_partitions_hold_the_rows(study, spark, monkeypatch):
    """Rows in one partition of few are dealt out like those in too many, to as many cores as they can occupy."""
    cores = spark.sparkContext.defaultParallelism
    vectors = models.vector_table(study.features, study.train)
    heap = vectors.coalesce(1)
    assert models.one_wave(heap) is heap  # 1,200 rows are one task's work
    for rows_a_task, wanted in ((100, cores), (400, 3)):
        monkeypatch.setattr(models, "ROWS_A_TASK", rows_a_task)
        spread = models.one_wave(heap)
        parts = [[row.CLIENTNUM for row in part] for part in spread.rdd.glom().collect()]
        assert len(parts) == wanted and max(map(len, parts)) - min(map(len, parts)) <= wanted
        assert all(part == sorted(part) for part in parts)
        assert sorted(spread.collect()) == sorted(vectors.collect())
        assert models.one_wave(spread) is spread

    lopsided = vectors.repartition(2, F.col("CLIENTNUM") >= 0)
    assert lopsided.rdd.getNumPartitions() == 2 and models.one_wave(lopsided).rdd.getNumPartitions() == 3
    assert models.dealt_evenly(heap.limit(0)).count() == 0

    seen = []
    monkeypatch.setattr(models, "fit_all", lambda learners, rows: seen.append(rows.rdd.getNumPartitions()) or [])
    stored = Study(study.raw, study.learners)
    stored.customers = study.customers.coalesce(1)
    stored.pipeline
    assert seen == [3]


def test_explained_records_come_in_one_wave(study, spark):
    """Explaining one partition more than there are cores would take two rounds; of many more, the last hardly counts."""
    cores = spark.sparkContext.defaultParallelism
    kept = explained_records(study.customers, study.pipeline, study.nodes)
    dealt = explained_records(study.customers.repartition(cores + 1), study.pipeline, study.nodes)
    assert dealt.rdd.getNumPartitions() == cores
    columns = ["CLIENTNUM", F.round("log_odds", 9), F.size("shap"), F.size("steps")]
    assert sorted(dealt.select(*columns).collect()) == sorted(kept.select(*columns).collect())
    many = study.customers.repartition(4 * cores + 1)
    assert explained_records(many, study.pipeline, study.nodes).rdd.getNumPartitions() == 4 * cores + 1


def test_explanations(study):
    r = registry.shap_checks(study).first()
    assert r["n"] == 300 and r["n_bad"] == 0 and r["max_gap"] < 1e-6
    assert r["n_flat"] < 0.2 * len(FEATURES) and r["max_abs_mean"] < 2 and abs(r["base"]) < 20
    assert r["top_feature"] == "Total_Trans_Ct"


def test_gain_importance_is_a_share(study):
    full = models.gain_importance(study.nodes, FEATURES, top=26)
    assert full.count() == 26 and full.agg(F.sum("importance")).first()[0] == pytest.approx(1)
    top = models.gain_importance(study.nodes, FEATURES).collect()
    assert len(top) == 20 and top == full.limit(20).collect()


def test_waterfall_reaches_the_log_odds(study):
    steps = contributions.waterfall(study.explained, FEATURES)
    ends = steps.filter("rank = 1").join(study.explained, "CLIENTNUM")
    assert steps.count() == 15 * 300
    assert ends.filter("abs(`end` - log_odds) > 1e-6").count() == 0


def test_stream_equals_batch(study, spark):
    source, sink, checkpoint = (tables.fresh_path(spark, n) for n in ("in", "out", "log"))
    arrivals = study.customers.repartition(5)
    tables.write_table(arrivals, source)

    def run():
        stream_scores(spark, source, study.customers.schema, study.pipeline, 20.0, sink, checkpoint, 2).awaitTermination()
        return spark.read.parquet(sink).select("CLIENTNUM", "model", "p", "tier", F.to_json("actions"))

    batch = risk_records(study.customers, study.pipeline, 20.0).select("CLIENTNUM", "model", "p", "tier", F.to_json("actions"))
    assert sorted(run().collect()) == sorted(batch.collect())
    assert run().count() == batch.count()  # nothing new, nothing repeated


def test_scorer_accepts_every_category(study):
    odd = study.customers.limit(5).withColumns(
        {"Education_Level": F.lit("Unknown"), "Income_Category": F.lit("Unknown"), "Marital_Status": F.lit("Divorced")}
    )
    assert models.score(study.pipeline, odd).filter("p IS NOT NULL").count() == 10


def test_highest_risk_breaks_ties_by_key(spark):
    table = spark.createDataFrame([(3, 1, 0.9), (2, 1, 0.9), (1, 0, 0.99)], "CLIENTNUM long, label int, p double")
    assert contributions.highest_risk(table).first()["CLIENTNUM"] == 2


def test_exported_study_can_be_read_again(study, spark, tmp_path):
    study.export(str(tmp_path), cross_validation=False)
    train, test = (tables.read_table(spark, f"{tmp_path}/{side}") for side in ("train", "test"))
    assert train.columns == ["CLIENTNUM", *FEATURES, "churn"] and (train.count(), test.count()) == (1200, 300)
    assert train.join(test, "CLIENTNUM").count() == 0
    report = metrics.metric_rows(study.scored)
    stored = tables.read_report(spark, f"{tmp_path}/test_metrics", report.schema)
    assert sorted(stored.collect()) == sorted(report.collect())
    contributions_again = tables.read_table(spark, f"{tmp_path}/contributions")
    assert contributions_again.count() == 300 and "base" in contributions_again.columns
    assert models.load_pipeline(f"{tmp_path}/pipeline").stages[0].feature_names == FEATURES


def test_optimality_tells_a_fit_from_another(study):
    vectors = models.vector_table(study.features, study.train)
    fitted = models.optimality(study.pipeline.stages[1], vectors).first()
    assert (fitted["n_rows"], fitted["n_features"]) == (1200, 26) and fitted["max_gradient"] < 0.05
    hasty = models.fit(models.logistic(max_iter=2), vectors)
    assert models.optimality(hasty, vectors).first()["max_gradient"] > 1
