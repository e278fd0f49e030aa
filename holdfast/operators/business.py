"""From scores to tiers, recommendations and money, grouped by any columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from holdfast.functions.expressions import half_even, ratio, whole
from holdfast.functions.fixed import (
    ACQUISITION_COST, LABEL, PORTFOLIO_SUCCESS, SCENARIO_COSTS, SCENARIO_SIZES, SCENARIO_SUCCESS, TIERS,
)


def rates(scored: DataFrame, by: list[str] | None = None, label: str = "label") -> DataFrame:
    """Positives, hits and false alarms with recall and precision at 4 digits."""
    positive, flagged = F.col(label) == 1, F.col("prediction") == 1
    counts = scored.groupBy("model", *(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(positive).alias("churners"),
        F.count_if(positive & flagged).alias("hits"),
        F.count_if(~positive & flagged).alias("false_hits"),
    )
    return counts.withColumns(
        {
            "recall": half_even(ratio(F.col("hits"), F.col("churners")), 4),
            "precision": half_even(ratio(F.col("hits"), F.col("hits") + F.col("false_hits")), 4),
        }
    )


def business_reading(
    scored: DataFrame, by: list[str] | None = None, cost: int = ACQUISITION_COST, from_rates: bool = True
) -> DataFrame:
    """Churners caught and missed, false alarms and retention value.

    from_rates derives the counts from the rounded rates, cut to whole numbers;
    otherwise they are the counts of the confusion matrix.
    """
    table = rates(scored, by)
    if from_rates:
        caught = whole(F.col("recall") * F.col("churners"))
        alarms = whole(ratio(caught, F.col("precision")) * (1 - F.col("precision")))
    else:
        caught, alarms = F.col("hits"), F.col("false_hits")
    return table.select(
        "model", *(by or []), "churners",
        caught.alias("caught"),
        (F.col("churners") - caught).alias("missed"),
        alarms.alias("false_alarms"),
        (caught * cost).alias("value"),
    )


def portfolio_value(
    customers: DataFrame, scored: DataFrame, by: list[str] | None = None, cost: int = ACQUISITION_COST,
    success: float = PORTFOLIO_SUCCESS,
) -> DataFrame:
    """Value of applying a model's recall to all churned customers at a given success rate."""
    found = rates(scored, by).select("model", *(by or []), "recall")
    churned = F.sum(F.col(LABEL).cast("long"))
    if by:
        table = found.join(customers.groupBy(*by).agg(churned.alias("churned")), by)
    else:
        table = found.withColumn("churned", customers.agg(churned).scalar())
    saved = whole(F.col("recall") * F.col("churned") * success)
    return table.select("model", *(by or []), "churned", "recall", saved.alias("saved"), (saved * cost).alias("value"))


def roi_scenarios(
    customers: DataFrame,
    scored: DataFrame,
    by: list[str] | None = None,
    sizes: list[int] = SCENARIO_SIZES,
    costs: list[int] = SCENARIO_COSTS,
    success: list[int] = SCENARIO_SUCCESS,
) -> DataFrame:
    """Expected churners, catches, saves and value for each portfolio scenario.

    The churn rate is that of all customers, the recall that of the scored ones.
    """
    def literals(values: list[int]) -> Column:
        return F.explode(F.array(*[F.lit(v).cast("long") for v in values]))

    found, rate = rates(scored, by), F.sum(F.col(LABEL).cast("double")) / F.count(LABEL)
    if by:
        found = found.join(customers.groupBy(*by).agg(rate.alias("churn_rate")), by)
    else:
        found = found.withColumn("churn_rate", customers.agg(rate).scalar())
    table = (
        found
        .withColumn("portfolio", literals(sizes))
        .withColumn("cac", literals(costs))
        .withColumn("success_pct", literals(success))
        .withColumn("est_churners", whole(F.col("portfolio") * F.col("churn_rate")))
        .withColumn("caught", whole(F.col("est_churners") * F.col("recall")))
        .withColumn("saved", whole(F.col("caught") * (F.col("success_pct") / 100)))
        .withColumn("roi", F.col("saved") * F.col("cac"))
    )
    return table.select(
        "model", *(by or []), "portfolio", "cac", "success_pct", "est_churners", "caught", "saved", "roi"
    )


def _by_tier(p: Column, field: int) -> Column:
    value = None
    for tier in TIERS[:-1]:
        hit = p >= tier[0]
        value = F.when(hit, tier[field]) if value is None else value.when(hit, tier[field])
    return value.otherwise(TIERS[-1][field])


def with_risk_tier(scored: DataFrame, base_rate: Column | float) -> DataFrame:
    """Add tier, message and the distance of the probability from the base rate (in points)."""
    p = F.col("p")
    base = base_rate if isinstance(base_rate, Column) else F.lit(base_rate)
    return scored.withColumns(
        {"tier": _by_tier(p, 1), "message": _by_tier(p, 2), "delta_points": p * 100 - base}
    )


def _advice(condition: Column, title: str, *body) -> Column:
    text = F.concat(*[part if isinstance(part, Column) else F.lit(part) for part in body])
    return F.when(condition, F.struct(F.lit(title).alias("title"), text.alias("body")))


def with_recommendations(scored: DataFrame) -> DataFrame:
    """Add the ordered array of retention actions, from the raw (unscaled) attributes."""
    count, idle = F.col("Total_Trans_Ct"), F.col("Months_Inactive_12_mon")
    calls, use = F.col("Contacts_Count_12_mon"), F.col("Avg_Utilization_Ratio")
    # Titles and texts shown to the retention team.
    rules = [
        _advice(count < 40, "Transaction Engagement",
                "Customer transacts fewer than 40 times per year. "
                "Offer bonus rewards or cashback on next 10 transactions."),
        _advice(idle >= 3, "Re-engagement Campaign",
                "Inactive for ", idle.cast("string"), " months. Send a personalised re-engagement offer."),
        _advice(calls >= 4, "Service Quality Review",
                "Contacted support ", calls.cast("string"), " times — dissatisfaction signal. "
                "Escalate to relationship manager."),
        _advice(use < 0.10, "Card Usage Incentive",
                "Utilisation is ", F.format_number(use, 2), " — near zero. "
                "Offer a targeted spend challenge with rewards."),
        _advice(F.col("p") < 0.30, "Maintain Relationship",
                "Low risk. Consider loyalty tier upgrade to deepen engagement."),
    ]
    otherwise = _advice(F.lit(True), "Standard Monitoring", "Schedule a quarterly relationship review.")
    fired = F.filter(F.array(*rules), lambda rule: rule.isNotNull())
    return scored.withColumn("actions", F.when(F.size(fired) > 0, fired).otherwise(F.array(otherwise)))


def campaign(scored: DataFrame, keep: list[str]) -> DataFrame:
    """One row per customer and recommended action, in the order of the rules."""
    return with_recommendations(scored).select(*keep, F.posexplode("actions").alias("position", "action")).select(
        *keep, "position", "action.title", "action.body"
    )
