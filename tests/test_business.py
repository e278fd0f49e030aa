import pytest
from pyspark.sql import functions as F

from holdfast.operators import business

from .conftest import by, rows


@pytest.fixture(scope="module")
def scored(spark):
    """325 churners of 2,026, 294 caught, 23 false alarms."""
    def part(n, label, prediction):
        return spark.range(n).selectExpr("'t' AS model", f"{label} AS label", f"{prediction} AS prediction", "id % 2 AS side")

    return part(294, 1, 1).unionByName(part(31, 1, 0)).unionByName(part(23, 0, 1)).unionByName(part(1678, 0, 0))


def test_counts_from_rounded_rates_are_cut(scored):
    r = rows(business.business_reading(scored))[0]
    assert (r["churners"], r["caught"], r["missed"], r["value"]) == (325, 293, 32, 87900)
    exact = rows(business.business_reading(scored, from_rates=False))[0]
    assert (exact["caught"], exact["missed"], exact["false_alarms"], exact["value"]) == (294, 31, 23, 88200)


def test_reading_without_hits_has_no_alarms(spark):
    table = spark.createDataFrame([("m", 1, 0), ("m", 0, 0)], "model string, label int, prediction int")
    r = rows(business.business_reading(table))[0]
    assert (r["caught"], r["missed"], r["false_alarms"]) == (0, 1, 0)


def test_value_by_group_adds_up(scored):
    parts = rows(business.business_reading(scored, ["side"], from_rates=False))
    assert sum(r["caught"] for r in parts) == 294 and len(parts) == 2


def test_portfolio_value(scored, spark):
    customers = spark.range(10_127).selectExpr("cast(id < 1627 as int) AS churn", "id % 2 AS side")
    r = rows(business.portfolio_value(customers, scored))[0]
    assert (r["churned"], r["recall"], r["saved"], r["value"]) == (1627, 0.9046, 294, 88200)
    assert len(rows(business.portfolio_value(customers, scored, ["side"]))) == 2


def test_roi_scenarios_cut_at_every_step(scored, spark):
    customers = spark.range(2026).selectExpr("cast(id < 325 as int) AS churn")
    table = business.roi_scenarios(customers, scored, sizes=[10_000], costs=[300], success=[30])
    r = rows(table)[0]
    est = int(10_000 * (325 / 2026))
    caught = int(est * 0.9046)
    assert (r["est_churners"], r["caught"], r["saved"], r["roi"]) == (est, caught, int(caught * 0.3), int(caught * 0.3) * 300)
    assert business.roi_scenarios(customers, scored).count() == 4 * 3 * 3


def test_tier_edges(spark):
    table = spark.createDataFrame([(0.2999,), (0.30,), (0.5999,), (0.60,), (1.0,)], "p double")
    tiers = business.with_risk_tier(table, 16.07)
    assert [r["tier"] for r in tiers.orderBy("p").collect()] == ["LOW RISK", "MEDIUM RISK", "MEDIUM RISK", "HIGH RISK", "HIGH RISK"]
    assert by(tiers, "p", "delta_points")[0.30] == pytest.approx(13.93)


@pytest.mark.parametrize(
    "count, idle, calls, use, p, titles",
    [
        (39, 3, 4, 0.0999, 0.29, ["Transaction Engagement", "Re-engagement Campaign", "Service Quality Review", "Card Usage Incentive", "Maintain Relationship"]),
        (40, 2, 3, 0.10, 0.30, ["Standard Monitoring"]),
        (40, 3, 3, 0.10, 0.30, ["Re-engagement Campaign"]),
        (10, 0, 6, 0.5, 0.9, ["Transaction Engagement", "Service Quality Review"]),
    ],
)
def test_rule_edges_and_order(spark, count, idle, calls, use, p, titles):
    names = "Total_Trans_Ct int, Months_Inactive_12_mon int, Contacts_Count_12_mon int, Avg_Utilization_Ratio double, p double"
    table = spark.createDataFrame([(count, idle, calls, use, p)], names).withColumn("id", F.lit(1))
    found = rows(business.campaign(table, ["id"]), "position")
    assert [r["title"] for r in found] == titles
    if "Re-engagement Campaign" in titles:
        body = next(r["body"] for r in found if r["title"] == "Re-engagement Campaign")
        assert body == f"Inactive for {idle} months. Send a personalised re-engagement offer."
