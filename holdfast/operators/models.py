"""The two classifiers: fitting, cross-validation, scoring and persistence."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from holdfast.functions.expressions import half_even
from holdfast.functions.fixed import CV_METRICS, FOLDS, ID, LABEL, LOGISTIC, SEED, TREES
from holdfast.operators import boosting
from holdfast.operators.features import CustomerFeaturesModel
from holdfast.operators.metrics import metric_rows
from holdfast.sources.tables import fresh_path, settle, shared_folder
from holdfast.sources.versions import resolve

WEIGHT = "weight"
ROWS_A_TASK = 20_000  # of fewer, a task's start takes as long as its part of a tree's level


@dataclass(frozen=True)
class Learner:
    """A classifier to be fitted once the class counts are known."""

    name: str
    build: Callable[[int, int], object]
    weight: Callable[[int, int], tuple[float, float]]  # (retained, churned)
    beside: int = 1  # fits of its kind that run side by side


def _named(classifier, name: str):
    """Give a classifier output columns of its own, so that two of them can score one scan."""
    return (
        classifier.setFeaturesCol("features").setLabelCol(LABEL).setWeightCol(WEIGHT)
        .setRawPredictionCol(f"raw_{name}").setProbabilityCol(f"probability_{name}").setPredictionCol(f"prediction_{name}")
    )


def balanced_weights(neg: int, pos: int) -> tuple[float, float]:
    return (neg + pos) / (2 * neg), (neg + pos) / (2 * pos)


def imbalance_weights(neg: int, pos: int) -> tuple[float, float]:
    """Churners weigh as much as there are retained customers per churner."""
    return 1.0, round(neg / pos, 4)


def logistic(name: str = "LogisticRegression", C: float = LOGISTIC["C"], max_iter: int = LOGISTIC["max_iter"]) -> Learner:
    """L2 logistic regression on balanced classes.

    Spark divides the loss by the sum of weights (the row count, as they are
    balanced), so the penalty is divided by it too.
    """
    def build(neg: int, pos: int) -> LogisticRegression:
        classifier = LogisticRegression(
            regParam=1 / (C * (neg + pos)), elasticNetParam=0.0, standardization=False, maxIter=max_iter
        )
        return _named(classifier, name)

    return Learner(name, build, balanced_weights)


def boosted(
    name: str = "BoostedTrees",
    trees: int = TREES["trees"],
    depth: int = TREES["depth"],
    step: float = TREES["step"],
    row_share: float = TREES["row_share"],
    column_share: float = TREES["column_share"],
    seed: int = SEED,
) -> Learner:
    """Gradient boosted trees; lineage is cut every ten trees through the checkpoint folder."""
    def build(neg: int, pos: int) -> GBTClassifier:
        classifier = GBTClassifier(
            maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=row_share,
            featureSubsetStrategy=str(column_share), seed=seed, checkpointInterval=10,
        )
        return _named(classifier, name)

    return Learner(name, build, imbalance_weights)


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Class counts and the weights both learners derive from them."""
    neg, pos = F.col("n_retained"), F.col("n_churned")
    return df.agg(
        F.count_if(F.col(label) == 0).alias("n_retained"), F.count_if(F.col(label) == 1).alias("n_churned")
    ).withColumns(
        {
            "balanced_retained": (neg + pos) / (2 * neg),
            "balanced_churned": (neg + pos) / (2 * pos),
            "imbalance": half_even(neg / pos, 4),
        }
    )


def fit(learner: Learner, vectors: DataFrame) -> Model:
    """Fit on a table with features and label. Trees of few rows are grown by one task, of more by a job for each level."""
    shared_folder(vectors.sparkSession)
    row = class_weights(vectors).first()
    neg, pos = row["n_retained"], row["n_churned"]
    retained, churned = learner.weight(neg, pos)
    weight = F.when(F.col(LABEL) == 1, churned).otherwise(retained)
    classifier, rows = learner.build(neg, pos), vectors.withColumn(WEIGHT, weight)
    if min(retained, churned) > 0 and boosting.can_fit(classifier, neg + pos, learner.beside):
        return boosting.fit(classifier, rows)
    return _without_summary(vectors.sparkSession, classifier.fit(rows))


def _without_summary(spark: SparkSession, model: Model) -> Model:
    """The same model, stored and read back if it still refers to its training data.

    A training summary holds the session and the training plan and would be
    shipped with every scoring task.
    """
    if not getattr(model, "hasSummary", False):
        return model
    path = fresh_path(spark, "model")
    model.write().overwrite().save(path)
    return type(model).load(path)


def _in_parallel(spark: SparkSession, work: Callable, items: list, threads: int) -> list:
    """Run driver-side calls side by side; their Spark jobs share the executors.

    Fitting is a chain of short jobs, so one fit alone leaves executors idle.
    """
    with ThreadPool(min(threads, len(items))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items)


def fit_all(learners: list[Learner], vectors: DataFrame) -> list[Model]:
    return _in_parallel(vectors.sparkSession, lambda learner: fit(learner, vectors), learners, len(learners))


def vector_table(features: CustomerFeaturesModel, df: DataFrame, *keep: str) -> DataFrame:
    return features.transform(df).select(ID, LABEL, *keep, "features")


def dealt_evenly(df: DataFrame, waves: int | None = None) -> DataFrame:
    """The rows in a partition a core, evenly, if they lie worse: in more partitions than there are cores, or so unevenly
    that the largest of fewer partitions holds a quarter more than its share.

    The latter happens to files of one row group, which no second task can read. Rows that are too few to occupy all
    cores are shared by fewer. With waves, rows in more waves of tasks than that stay as they are: the last, which
    leaves cores idle, hardly counts among many.
    """
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if parts > cores:
        return df if waves and parts > waves * cores else df.repartition(cores)
    sizes = df.groupBy(F.spark_partition_id()).count()
    row = sizes.agg(F.max("count").alias("most"), F.sum("count").alias("rows")).first()
    share = min(cores, (row["rows"] or 0) // ROWS_A_TASK)
    return df.repartition(share) if share and row["most"] * share > 1.25 * row["rows"] else df


def one_wave(vectors: DataFrame) -> DataFrame:
    """The rows dealt evenly, so that each level of each tree, which waits for all partitions of the table, takes one
    wave of tasks on all cores.

    Dealt rows are put in order, as the learner draws rows by their place in a partition.
    """
    dealt = dealt_evenly(vectors)
    return dealt if dealt is vectors else dealt.sortWithinPartitions(ID, LABEL, vector_to_array("features"))


def scoring_pipeline(features: CustomerFeaturesModel, models: list[Model]) -> PipelineModel:
    return PipelineModel([features, *models])


def _name(model: Model) -> str:
    return model.getProbabilityCol().removeprefix("probability_")


def score_array(models: list[Model]) -> Column:
    """Name, probability and class of each model, as an array."""
    return F.array(
        *[
            F.struct(
                F.lit(_name(m)).alias("model"),
                vector_to_array(m.getProbabilityCol())[1].alias("p"),
                F.col(m.getPredictionCol()).cast("int").alias("prediction"),
            )
            for m in models
        ]
    )


def _scores(models: list[Model]) -> Column:
    return F.inline(score_array(models))


def score(pipeline: PipelineModel, df: DataFrame) -> DataFrame:
    """Class and probability of each model: the given columns plus model, p, prediction.

    Features are computed once and all models score the same scan.
    """
    return pipeline.transform(df).select(*df.columns, _scores(pipeline.stages[1:]))


def cross_validate(learners: list[Learner], vectors: DataFrame, folds: int = FOLDS, parallelism: int = 10) -> DataFrame:
    """Metric rows per model and fold. vectors has id, label, fold and features.

    The fits run as concurrent Spark jobs; every held-out fold is scored once,
    into a table all metrics are read from.
    """
    vectors = one_wave(vectors).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        beside = max(1, min(folds, parallelism // len(learners)))
        jobs = [(replace(learner, beside=beside), fold) for learner in learners for fold in range(folds)]

        def held_out(job: tuple[Learner, int]) -> DataFrame:
            learner, fold = job
            model = fit(learner, vectors.filter(F.col("fold") != fold))
            scored = model.transform(vectors.filter(F.col("fold") == fold))
            return scored.select(ID, F.col(LABEL).alias("label"), "fold", _scores([model]))

        parts = _in_parallel(vectors.sparkSession, held_out, jobs, parallelism)
        scored = settle(reduce(DataFrame.unionByName, parts), "cv-scores")
    finally:
        vectors.unpersist()
    return metric_rows(scored, ["model", "fold"], digits=12)


def cv_comparison(fold_metrics: DataFrame, names: list[str]) -> DataFrame:
    """Mean and population deviation over folds, one row per metric, models side by side."""
    long = fold_metrics.unpivot(["model", "fold"], CV_METRICS, "metric", "value")
    return (
        long.groupBy("metric")
        .pivot("model", names)
        .agg(half_even(F.avg("value"), 4).alias("mean"), half_even(F.stddev_pop("value"), 4).alias("std"))
    )


def optimality(model: LogisticRegressionModel, vectors: DataFrame, C: float = LOGISTIC["C"], label: str = LABEL) -> DataFrame:
    """How far a balanced L2 logistic regression is from solving its penalised likelihood on these rows: one row with
    n_rows, n_features and max_gradient, the largest entry of beta - C * sum of weighted residuals times x, and of the
    residuals' sum, which the intercept makes 0."""
    row = class_weights(vectors, label).first()
    retained, churned = balanced_weights(row["n_retained"], row["n_churned"])
    beta = model.coefficients.toArray().tolist()
    x = vector_to_array("features")
    margin = sum((x[i] * b for i, b in enumerate(beta)), F.lit(float(model.intercept)))
    y = F.col(label).cast("double")
    residual = F.when(y == 1, churned).otherwise(retained) * (y - 1 / (1 + F.exp(-margin)))
    rows = vectors.select(x.alias("x"), residual.alias("r"))
    sums = [F.lit(b) - C * F.sum(F.col("r") * F.col("x")[i]) for i, b in enumerate(beta)]
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(beta)).alias("n_features"),
        F.array_max(F.array(*[F.abs(s) for s in [*sums, F.sum("r")]])).alias("max_gradient"),
    )


def save_pipeline(pipeline: PipelineModel, path: str) -> None:
    pipeline.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(resolve(SparkSession.active(), path))


def node_table(spark: SparkSession, model: GBTClassificationModel, path: str) -> DataFrame:
    """Save the tree model and return its nodes: one row per node, with tree weight."""
    model.write().overwrite().save(path)
    weights = F.array(*[F.lit(float(w)) for w in model.treeWeights])
    return spark.read.parquet(f"{path}/data").select(
        "treeID",
        weights[F.col("treeID")].alias("weight"),
        F.col("nodeData.id").alias("node"),
        F.col("nodeData.prediction").alias("prediction"),
        F.get("nodeData.impurityStats", F.lit(0)).alias("cover"),
        F.col("nodeData.gain").alias("gain"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("nodeData.split.numCategories").alias("categories"),
    )


def gain_importance(nodes: DataFrame, names: list[str], top: int = 20) -> DataFrame:
    """Average loss reduction of a feature's splits, as share of all features."""
    gain = F.col("gain") * F.col("cover")
    row = nodes.filter("left >= 0").agg(
        *[F.coalesce(F.avg(F.when(F.col("feature") == i, gain)), F.lit(0.0)).alias(f"g{i}") for i in range(len(names))]
    )
    total = sum((F.col(f"g{i}") for i in range(len(names))), F.lit(0.0))
    cells = [
        F.struct(F.lit(name).alias("feature"), F.try_divide(F.col(f"g{i}"), total).alias("importance"))
        for i, name in enumerate(names)
    ]
    return row.select(F.inline(F.array(*cells))).orderBy(F.col("importance").desc(), "feature").limit(top)


def measured_nodes(nodes: DataFrame, rows: DataFrame, vector: str = "features", label: str = LABEL) -> DataFrame:
    """The nodes with cover and gain as this table has them: rows that pass a node, and the fall in the label's
    variance by its split. A node no row passes has neither.

    Narrow but for the sums: each task sends its rows down all trees, level by level, and hands on three numbers a
    node. The ensemble's structure goes to the tasks; its size does not depend on the table.
    """
    shape = nodes.select("treeID", "node", "left", "right", "feature", "threshold").orderBy("treeID", "node").toArrow()
    tree_of, *arrays = (shape[c].to_numpy() for c in shape.column_names)
    trees = [(tree, *(a[tree_of == tree] for a in arrays)) for tree in np.unique(tree_of).tolist()]
    names = ["treeID", "node", "n", "total", "squares"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((3, int(node.max()) + 1)) for _, node, *_ in trees]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            y = batch.column(1).to_numpy().astype(np.float64)
            for (_, node, left, right, feature, threshold), total in zip(trees, sums):
                place = np.zeros(int(node.max()) + 1, np.int64)
                place[node] = np.arange(len(node))
                who, at = np.arange(len(y)), np.zeros(len(y), np.int64)
                while len(who):
                    for k, v in enumerate((None, y[who], y[who] ** 2)):
                        total[k] += np.bincount(at, v, total.shape[1])
                    here = place[at]
                    inner = left[here] >= 0
                    who, here = who[inner], here[inner]
                    at = np.where(x[who, feature[here]] <= threshold[here], left[here], right[here])
        for (tree, node, *_), total in zip(trees, sums):
            columns = [np.full(len(node), tree, np.int32), node.astype(np.int32), *(t[node] for t in total)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    data = rows.select(vector_to_array(vector).alias("x"), F.col(label).cast("int").alias("y"))
    sums = data.mapInArrow(work, "treeID int, node int, n double, total double, squares double").groupBy("treeID", "node")
    sums = sums.agg(*[F.sum(c).alias(c) for c in names[2:]]).filter("n > 0")
    spread = sums.select("treeID", "node", "n", (F.col("squares") - F.col("total") ** 2 / F.col("n")).alias("spread"))
    seen = nodes.drop("cover", "gain").join(spread, ["treeID", "node"], "left")
    part = spread.select("treeID", F.col("node").alias("child"), F.col("spread").alias("part"))
    sides = [seen.filter("left >= 0").select("treeID", "node", F.col(side).alias("child")) for side in ("left", "right")]
    inner = sides[0].unionByName(sides[1]).join(part, ["treeID", "child"], "left").groupBy("treeID", "node").agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("parts"))
    gain = F.when(F.col("parts").isNotNull() & F.col("n").isNotNull(), (F.col("spread") - F.col("parts")) / F.col("n"))
    return seen.join(inner, ["treeID", "node"], "left").select(
        "*", F.coalesce("n", F.lit(0.0)).alias("cover"), F.coalesce(gain, F.lit(0.0)).alias("gain")
    ).drop("n", "spread", "parts")
