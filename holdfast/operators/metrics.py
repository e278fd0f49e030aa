"""Exact classification metrics over a scored table (model, label, p, prediction).

Scores are grouped by value first, so a score shared by many customers is one
row afterwards; cumulative counts then run bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from holdfast.functions.expressions import half_even, ratio
from holdfast.functions.fixed import METRICS
from holdfast.functions.ordering import running_totals, split_points, with_following

KEYS = ["model"]


def cumulative(scored: DataFrame, keys: list[str] = KEYS, label: str = "label", borders: list[float] | None = None) -> DataFrame:
    """One row per distinct score, descending, with counts up to and including it.

    cut_tp and cut_fp count the rows of that score predicted positive.
    """
    borders = split_points(scored, "p") if borders is None else borders
    positive = F.col(label) == 1
    flagged = F.col("prediction") == 1
    measures = {
        "tp": F.count_if(positive),
        "fp": F.count_if(~positive),
        "cut_tp": F.count_if(positive & flagged),
        "cut_fp": F.count_if(~positive & flagged),
    }
    table = running_totals(scored, keys, "p", measures, ["tp", "fp"], borders, descending=True)
    return table.withColumns(
        {
            "cum_n": F.col("cum_tp") + F.col("cum_fp"),
            "tpr": ratio(F.col("cum_tp"), F.col("total_tp")),
            "fpr": ratio(F.col("cum_fp"), F.col("total_fp")),
            "precision": ratio(F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp")),
            "recall": ratio(F.col("cum_tp"), F.col("total_tp")),
        }
    )


def _roc_area() -> Column:
    """Trapezoid under the ROC step of one score, before division by the class totals."""
    return F.col("fp") * (F.col("cum_tp") - F.col("tp") / 2)


def _pr_area() -> Column:
    """Precision at one score weighted by the churners it adds."""
    return F.col("tp") * F.col("precision")


def _with_end(table: DataFrame, keys: list[str], point: dict[str, Column], end: dict[str, Column]) -> DataFrame:
    """One row per score, and one more per key next to its highest score."""
    def row(values: dict[str, Column]) -> Column:
        return F.struct(*[value.cast("double").alias(name) for name, value in values.items()])

    highest = F.col("cum_n") == F.col("tp") + F.col("fp")
    rows = F.when(highest, F.array(row(end), row(point))).otherwise(F.array(row(point)))
    return table.select(*keys, F.inline(rows))


def roc_curve(scored: DataFrame, keys: list[str] = KEYS, label: str = "label", corners: bool = False, cells: int | None = None) -> DataFrame:
    """Points of the ROC curve at every distinct score, with the start (0, 0).

    corners: without the points that lie on the straight line between their neighbours, across the borders of
    buckets too; the curve is the same. cells: one point at most for each of so many equal parts of fpr + tpr, the
    last in it, next to the start. Every point of the full curve then lies within 2 / cells of a kept one, in
    fpr + tpr, and the area between kept points differs by 4 / cells at most; areas() reads all scores anyway.
    """
    borders = split_points(scored, "p") if corners else None
    table = cumulative(scored, keys, label, borders)
    if corners:
        step = with_following(table, keys, "p", ["tp", "fp"], borders, descending=True)
        turn = F.col("tp").cast("double") * F.col("next_fp") - F.col("fp").cast("double") * F.col("next_tp")
        highest = F.col("cum_n") == F.col("tp") + F.col("fp")
        table = step.withColumn("corner", turn.isNull() | (turn != 0))
        # The start goes with the highest score's row, which stays to carry it even where it is no corner.
        table = table.filter(F.col("corner") | highest)
    point = {"threshold": F.col("p"), "fpr": F.col("fpr"), "tpr": F.col("tpr")}
    start = {"threshold": F.lit(None), "fpr": F.lit(0.0), "tpr": F.lit(0.0)}
    if corners:
        point["corner"] = F.col("corner").cast("double")
        start["corner"] = F.lit(1.0)
    curve = _with_end(table, keys, point, start)
    if corners:
        curve = curve.filter("corner = 1").drop("corner")
    if cells is None:
        return curve
    part = F.when(F.col("threshold").isNull(), -1).otherwise(F.floor((F.col("fpr") + F.col("tpr")) / 2 * cells))
    last = F.max_by(F.struct("threshold", "fpr", "tpr"), F.coalesce(-F.col("threshold"), F.lit(0.0)))
    return curve.groupBy(*keys, part.alias("part")).agg(last.alias("kept")).select(*keys, "kept.*")


def pr_curve(scored: DataFrame, keys: list[str] = KEYS, label: str = "label", cells: int | None = None) -> DataFrame:
    """Precision and recall at every distinct score, the end (1, 0) and the baseline rate.

    cells: for each of so many equal parts of recall only the last point and those of least and greatest precision
    (of equal ones the highest score), so that what is left out lies between them.
    """
    baseline = F.col("total_tp") / (F.col("total_tp") + F.col("total_fp"))
    point = {"threshold": F.col("p"), "precision": F.col("precision"), "recall": F.col("recall"), "baseline": baseline}
    end = {"threshold": F.lit(None), "precision": F.lit(1.0), "recall": F.lit(0.0), "baseline": baseline}
    curve = _with_end(cumulative(scored, keys, label), keys, point, end)
    if cells is None:
        return curve
    row = F.struct("threshold", "precision", "recall", "baseline")
    score = F.coalesce("threshold", F.lit(float("inf")))
    part = F.when(F.col("threshold").isNull(), -1).otherwise(F.floor(F.col("recall") * cells))
    kept = curve.groupBy(*keys, part.alias("part")).agg(
        F.array(F.min_by(row, score), F.min_by(row, F.struct("precision", -score)), F.max_by(row, F.struct("precision", score))).alias("kept")
    )
    return kept.select(*keys, F.inline(F.array_distinct("kept")))


def areas(scored: DataFrame, keys: list[str] = KEYS, label: str = "label") -> DataFrame:
    """ROC-AUC and average precision, unrounded; AUC is null for a single class."""
    return cumulative(scored, keys, label).groupBy(*keys).agg(
        F.try_divide(F.sum(_roc_area()), F.max(F.col("total_tp").cast("double") * F.col("total_fp"))).alias("roc_auc"),
        ratio(F.sum(_pr_area()), F.max("total_tp")).alias("pr_auc"),
    )


def metric_rows(scored: DataFrame, keys: list[str] = KEYS, label: str = "label", digits: int = 4) -> DataFrame:
    """All six metrics per model from one pass over the cumulative table."""
    sums = cumulative(scored, keys, label).groupBy(*keys).agg(
        F.sum(_roc_area()).alias("roc_area"),
        F.sum(_pr_area()).alias("pr_area"),
        F.max("total_tp").alias("pos"),
        F.max("total_fp").alias("neg"),
        F.sum("cut_tp").alias("tp"),
        F.sum("cut_fp").alias("fp"),
    )
    pos, neg, tp, fp = (F.col(c) for c in ("pos", "neg", "tp", "fp"))
    values = {
        "roc_auc": F.try_divide(F.col("roc_area"), pos.cast("double") * neg),
        "pr_auc": ratio(F.col("pr_area"), pos),
        "f1": ratio(2 * tp, tp + fp + pos),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, pos),
        "accuracy": ratio(tp + neg - fp, pos + neg),
    }
    return sums.select(*keys, *[half_even(values[m], digits).alias(m) for m in METRICS])


def confusion(scored: DataFrame, keys: list[str] = KEYS, label: str = "label") -> DataFrame:
    """All four cells per model with their share of the true class."""
    cells = [(actual, predicted) for actual in (0, 1) for predicted in (0, 1)]
    row = scored.groupBy(*keys).agg(
        *[
            F.count_if((F.col(label) == a) & (F.col("prediction") == p)).alias(f"n{a}{p}")
            for a, p in cells
        ]
    )
    parts = [
        F.struct(
            F.lit(a).alias("label"),
            F.lit(p).alias("prediction"),
            F.col(f"n{a}{p}").alias("n"),
            ratio(F.col(f"n{a}{p}"), F.col(f"n{a}0") + F.col(f"n{a}1")).alias("row_share"),
        )
        for a, p in cells
    ]
    return row.select(*keys, F.inline(F.array(*parts)))


def scorecard(metrics: DataFrame, baseline: str, challenger: str) -> DataFrame:
    """Metric rows of two models side by side, the gain over the baseline and the winner."""
    long = metrics.filter(F.col("model").isin(baseline, challenger)).unpivot("model", METRICS, "metric", "value")
    base = F.max(F.when(F.col("model") == baseline, F.col("value")))
    best = F.max(F.when(F.col("model") == challenger, F.col("value")))
    return (
        long.groupBy("metric")
        .agg(base.alias("baseline"), best.alias("challenger"))
        .withColumn("delta", half_even(F.col("challenger") - F.col("baseline"), 4))
        .withColumn(
            "winner",
            F.when(F.col("challenger") > F.col("baseline"), challenger)
            .when(F.col("challenger") < F.col("baseline"), baseline)
            .otherwise("tie"),
        )
    )
