"""Raw customer attributes derived from customer, orders and lineitem tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from holdfast.functions.fixed import LEAK_COLUMNS, RAW_TARGET

RECENT_MONTHS = 40


def _pick(index: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in names]), (index + 1).cast("int"))


def order_activity(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One row per ordering customer: counts, amounts and months of activity."""
    lines = lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    horizon = orders.agg(F.max(month).alias("horizon")).scalar()
    dated = (
        orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", month.alias("month"))
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            "o_custkey", "o_totalprice", "month",
            (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
            F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
            (F.col("month") > horizon - RECENT_MONTHS).alias("recent"),
        )
    )

    def total(value: str, recent: bool) -> Column:
        kept = F.col("recent") if recent else ~F.col("recent")
        return F.sum(F.when(kept, F.col(value)).otherwise(0))

    return dated.groupBy("o_custkey").agg(
        F.sum("n_lines").alias("ct"),
        F.round(F.sum("o_totalprice"), 2).alias("amt"),
        (horizon - F.min("month")).alias("mob"),
        (horizon - F.max("month")).alias("inact"),
        F.count_if("urgent").alias("urgent"),
        total("n_lines", True).alias("ct_late"),
        total("n_lines", False).alias("ct_early"),
        total("o_totalprice", True).alias("amt_late"),
        total("o_totalprice", False).alias("amt_early"),
    )


TABLES = ("customer", "orders", "lineitem")


def source_paths(directory: str) -> list[str]:
    """The tables that raw customers are derived from."""
    return [f"{directory}/{name}.parquet" for name in TABLES]


def raw_customers(spark: SparkSession, directory: str) -> DataFrame:
    """The 23-column raw table of FIXTURES.md, leak columns included."""
    customer, orders, lineitem = (spark.read.parquet(path) for path in source_paths(directory))
    key = F.col("c_custkey")
    base = (
        customer.join(order_activity(orders, lineitem), key == F.col("o_custkey"), "left")
        .withColumns(
            {
                "ct": F.coalesce("ct", F.lit(0)),
                "amt": F.coalesce("amt", F.lit(0.0)),
                "mob": F.coalesce("mob", F.lit(0)),
                "inact": F.least(F.lit(6), F.coalesce("inact", F.lit(6))),
                "contacts": F.least(F.lit(6), F.coalesce("urgent", F.lit(0))),
                "credit": F.round(1500 + F.abs("c_acctbal") * 3, 2),
                "revolving": key * 97 % 1500,
                "ct_chng": F.when(F.col("ct_early") > 0, F.round(F.col("ct_late") / F.col("ct_early"), 3)).otherwise(0.0),
                "amt_chng": F.when(F.col("amt_early") > 0, F.round(F.col("amt_late") / F.col("amt_early"), 3)).otherwise(0.0),
            }
        )
    )
    quiet = (F.col("contacts") >= 3) | (F.col("inact") >= 6)
    leaves = ((F.col("ct") < 30) & quiet) | (F.col("ct") < 14)
    attrited = leaves != (key % 31 == 7)
    balance = F.col("c_acctbal")
    education = ["Uneducated", "High School", "College", "Graduate", "Post-Graduate", "Doctorate", "Unknown"]
    marital = F.create_map(
        *[F.lit(v) for v in ("AUTOMOBILE", "Married", "BUILDING", "Single", "FURNITURE", "Divorced", "MACHINERY", "Married")]
    )
    return base.select(
        key.alias("CLIENTNUM"),
        F.when(attrited, "Attrited Customer").otherwise("Existing Customer").alias(RAW_TARGET),
        (26 + key * 37 % 48).cast("int").alias("Customer_Age"),
        F.when(key % 2 == 0, "M").otherwise("F").alias("Gender"),
        (key * 13 % 6).cast("int").alias("Dependent_count"),
        _pick(key * 11 % 7, education).alias("Education_Level"),
        F.coalesce(marital[F.col("c_mktsegment")], F.lit("Unknown")).alias("Marital_Status"),
        F.when(balance < 0, "Unknown")
        .when(balance < 3500, "Less than $40K")
        .when(balance < 5500, "$40K - $60K")
        .when(balance < 7500, "$60K - $80K")
        .when(balance < 9000, "$80K - $120K")
        .otherwise("$120K +")
        .alias("Income_Category"),
        F.when(F.col("c_nationkey") < 18, "Blue")
        .when(F.col("c_nationkey") < 22, "Silver")
        .when(F.col("c_nationkey") < 24, "Gold")
        .otherwise("Platinum")
        .alias("Card_Category"),
        F.col("mob").cast("int").alias("Months_on_book"),
        (1 + key * 5 % 6).cast("int").alias("Total_Relationship_Count"),
        F.col("inact").cast("int").alias("Months_Inactive_12_mon"),
        F.col("contacts").cast("int").alias("Contacts_Count_12_mon"),
        F.col("credit").alias("Credit_Limit"),
        F.col("revolving").cast("int").alias("Total_Revolving_Bal"),
        F.round(F.col("credit") - F.col("revolving"), 2).alias("Avg_Open_To_Buy"),
        F.col("amt_chng").alias("Total_Amt_Chng_Q4_Q1"),
        F.col("amt").alias("Total_Trans_Amt"),
        F.col("ct").cast("int").alias("Total_Trans_Ct"),
        F.col("ct_chng").alias("Total_Ct_Chng_Q4_Q1"),
        F.round(F.col("revolving") / F.col("credit"), 3).alias("Avg_Utilization_Ratio"),
        F.when(attrited, 0.99).otherwise(0.01).alias(LEAK_COLUMNS[0]),
        F.when(attrited, 0.01).otherwise(0.99).alias(LEAK_COLUMNS[1]),
    )
