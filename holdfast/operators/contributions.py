"""Reports over a contribution table: base, value and shap arrays per customer.

names gives the features in array order. Nothing here depends on how the
contributions were made.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from holdfast.functions.expressions import correlation
from holdfast.functions.fixed import ID

TARGET = "Total_Trans_Ct"
PAIRS_PER_AGGREGATE = 13  # wider aggregates leave compiled code


def _moments(shap: DataFrame):
    """Count, mean, absolute sum and variance of every contribution, from one scan."""
    summary = Summarizer.metrics("count", "mean", "normL1", "variance").summary(array_to_vector("shap"))
    return shap.agg(summary.alias("m")).first()["m"]


def _ranking(moments, names: list[str]) -> list[tuple[int, float, float]]:
    """(position, mean absolute contribution, mean contribution), strongest first."""
    rows = [(i, float(moments["normL1"][i]) / moments["count"], float(moments["mean"][i])) for i in range(len(names))]
    return sorted(rows, key=lambda row: (-round(row[1], 9), names[row[0]]))


def importance(shap: DataFrame, names: list[str], top: int | None = None) -> DataFrame:
    """Features ranked by mean absolute contribution, with the mean direction."""
    ranked = _ranking(_moments(shap), names)[:top]
    rows = [(rank, names[i], mean_abs, mean) for rank, (i, mean_abs, mean) in enumerate(ranked, 1)]
    table = shap.sparkSession.createDataFrame(rows, "rank int, feature string, mean_abs double, mean double")
    return table.withColumn("direction", F.when(F.col("mean") > 0, "↑ Toward Churn").otherwise("↓ Away from Churn"))


def beeswarm(shap: DataFrame, names: list[str], top: int = 15, key: str = ID) -> DataFrame:
    """Contribution and feature value per customer for the strongest features.

    The last of the top rows is the sum of all other features if there are more.
    The ranking is fixed first, so the rows themselves come from a projection.
    """
    order = [i for i, _, _ in _ranking(_moments(shap), names)]
    shown = order if len(names) <= top else order[: top - 1]
    rest = order[len(shown):]
    cells = [
        F.struct(
            F.lit(rank).alias("rank"), F.lit(names[i]).alias("feature"),
            F.col("value")[i].alias("value"), F.col("shap")[i].alias("shap"),
        )
        for rank, i in enumerate(shown, 1)
    ]
    if rest:
        cells.append(
            F.struct(
                F.lit(len(shown) + 1).alias("rank"), F.lit(f"Sum of {len(rest)} other features").alias("feature"),
                F.lit(None).cast("double").alias("value"), sum((F.col("shap")[i] for i in rest), F.lit(0.0)).alias("shap"),
            )
        )
    return shap.select(key, F.inline(F.array(*cells)))


def highest_risk(scored: DataFrame, label: str = "label", key: str = ID) -> DataFrame:
    """The actual churner with the highest probability; the smallest key on ties."""
    return scored.filter(F.col(label) == 1).orderBy(F.col("p").desc(), key).limit(1)


def waterfall(shap: DataFrame, names: list[str], top: int = 15, key: str = ID) -> DataFrame:
    """From the base to the prediction, strongest contribution last (rank 1).

    Computed inside the row, so any number of customers takes no shuffle.
    """
    laid, steps = _laid(shap, names, top, key)
    return laid.select(key, F.inline(F.array(*steps)))


def waterfalls(shap: DataFrame, names: list[str], top: int = 15, key: str = ID) -> DataFrame:
    """The waterfall of each row as an array of steps, next to its base and contributions."""
    laid, steps = _laid(shap, names, top, key)
    return laid.select(key, "base", "shap", F.array(*steps).alias("steps"))


def _laid(shap: DataFrame, names: list[str], top: int, key: str) -> tuple[DataFrame, list[Column]]:
    """Rows with their contributions in order, and the columns of the steps."""
    n = len(names)
    shown = n if n <= top else top - 1
    cells = [F.struct((-F.abs(F.col("shap")[i])).alias("order"), F.lit(i).alias("position")) for i in range(n)]
    laid = shap.withColumn("parts", F.sort_array(F.array(*cells)))
    laid = laid.select(
        key, "base", "value", "shap", *[F.col("parts")[r]["position"].alias(f"p{r}") for r in range(n)]
    )
    steps = [F.col("shap")[F.col(f"p{r}")] for r in range(shown)]
    if shown < n:
        steps.append(sum((F.col("shap")[F.col(f"p{r}")] for r in range(shown, n)), F.lit(0.0)))
    laid = laid.select("*", *[step.alias(f"s{r}") for r, step in enumerate(steps)])
    levels = [F.col("base")]  # from the base upwards
    for r in reversed(range(len(steps))):
        levels.append(levels[-1] + F.col(f"s{r}"))
    labels = F.array(*[F.lit(name) for name in names])

    def row(r: int) -> Column:
        at = len(steps) - r
        single = r < shown
        return F.struct(
            F.lit(r + 1).alias("rank"),
            (labels[F.col(f"p{r}")] if single else F.lit(f"{n - shown} other features")).alias("feature"),
            (F.col("value")[F.col(f"p{r}")] if single else F.lit(None).cast("double")).alias("value"),
            F.col(f"s{r}").alias("shap"), levels[at - 1].alias("start"), levels[at].alias("end"),
        )

    return laid, [row(r) for r in range(len(steps))]


def _target(shap: DataFrame, names: list[str], target: str) -> int:
    """Position of the target, or of the strongest feature if there is no such name."""
    return names.index(target) if target in names else _ranking(_moments(shap), names)[0][0]


def _residual_strength(shap: DataFrame, names: list[str], t: int) -> list[tuple[int, float]]:
    """(position, absolute correlation with what a line through the target leaves), strongest first."""
    x, y = F.col("value")[t], F.col("shap")[t]
    line = shap.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")).first()
    if line["slope"] is None:
        return []
    residual = y - (F.lit(line["intercept"]) + F.lit(line["slope"]) * x)
    table = shap.select("value", residual.alias("residual"))
    others = [i for i in range(len(names)) if i != t]
    rows = []
    for start in range(0, len(others), PAIRS_PER_AGGREGATE):
        part = others[start : start + PAIRS_PER_AGGREGATE]
        r = table.agg(*[correlation(F.col("residual"), F.col("value")[i]) for i in part]).first()
        rows += [(i, abs(v)) for i, v in zip(part, r) if v is not None and not np.isnan(v)]
    return sorted(rows, key=lambda row: (-round(row[1], 9), names[row[0]]))


def interaction(shap: DataFrame, names: list[str], target: str = TARGET) -> DataFrame:
    """How strongly each other feature explains what a line through the target leaves.

    Features without variance have no correlation and are left out.
    """
    t = _target(shap, names, target)
    strength = _residual_strength(shap, names, t)
    rows = [(names[t], names[i], r, int(place == 0)) for place, (i, r) in enumerate(strength)]
    return shap.sparkSession.createDataFrame(rows, "target string, feature string, abs_r double, chosen int")


def dependence(shap: DataFrame, names: list[str], target: str = TARGET, key: str = ID, keep: list[str] | None = None) -> DataFrame:
    """Target value and contribution per customer with the chosen interaction value, and further columns of the table."""
    t = _target(shap, names, target)
    strength = _residual_strength(shap, names, t)
    partner = strength[0][0] if strength else None
    return shap.select(
        key, *(keep or []), F.col("value")[t].alias("value"), F.col("shap")[t].alias("shap"),
        F.lit(None if partner is None else names[partner]).cast("string").alias("interaction_feature"),
        (F.lit(None).cast("double") if partner is None else F.col("value")[partner]).alias("interaction_value"),
    )


def trend(shap: DataFrame, names: list[str], target: str = TARGET, points: int = 200) -> DataFrame:
    """Least-squares cubic of the contribution over the target, on an even grid.

    Two scans give the centred power sums; the driver solves 4 equations.
    """
    t = _target(shap, names, target)
    data = shap.select(F.col("value")[t].alias("x"), F.col("shap")[t].alias("y"))
    shape = data.agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")
    ).first()
    spark = shap.sparkSession
    if not shape["sd"]:
        return spark.createDataFrame([], "x double, y double")
    z = (F.col("x") - shape["mean"]) / shape["sd"]
    power = lambda k: F.pow(z, F.lit(float(k)))
    sums = data.agg(
        *[F.avg(power(k)).alias(f"s{k}") for k in range(7)], *[F.avg(F.col("y") * power(k)).alias(f"t{k}") for k in range(4)]
    ).first()
    left = np.array([[sums[f"s{i + j}"] for j in range(4)] for i in range(4)])
    c = [float(v) for v in np.linalg.lstsq(left, np.array([sums[f"t{k}"] for k in range(4)]), rcond=None)[0]]
    step = (shape["high"] - shape["low"]) / (points - 1)
    grid = spark.range(points).select((F.lit(shape["low"]) + F.col("id") * step).alias("x"))
    u = (F.col("x") - shape["mean"]) / shape["sd"]
    return grid.withColumn("y", ((F.lit(c[3]) * u + c[2]) * u + c[1]) * u + c[0])


def additivity(shap: DataFrame, log_odds: str = "log_odds") -> DataFrame:
    """Largest gap between base + contributions and the model's log-odds, over all rows."""
    total = F.aggregate("shap", F.col("base"), lambda acc, v: acc + v)
    return shap.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(total - F.col(log_odds))).alias("max_gap"))


def quality(shap: DataFrame, names: list[str]) -> DataFrame:
    """Bad values, features without spread, largest mean and the strongest feature."""
    bad = F.size(F.filter("shap", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    moments = _moments(shap)
    return shap.agg(F.count(F.lit(1)).alias("n"), F.sum(bad).alias("n_bad"), F.max("base").alias("base")).withColumns(
        {
            "n_flat": F.lit(sum(v == 0 for v in moments["variance"].toArray().tolist())),
            "max_abs_mean": F.lit(float(np.abs(moments["mean"].toArray()).max())),
            "top_feature": F.lit(names[_ranking(moments, names)[0][0]]),
        }
    )
