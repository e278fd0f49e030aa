"""DuckDB SQL giving the expected rows of the registered queries."""

from __future__ import annotations

# Fixed values, written out here once more: the SQL shares nothing with the engine.
AGE_EDGES = [25, 35, 45, 55, 65, 75]
AGE_LABELS = ["26-35", "36-45", "46-55", "56-65", "66-75"]
EDUCATION_CODES = {"Uneducated": 0, "High School": 1, "College": 2, "Graduate": 3, "Post-Graduate": 4, "Doctorate": 5, "Unknown": -1}
INCOME_CODES = {"Less than $40K": 0, "$40K - $60K": 1, "$60K - $80K": 2, "$80K - $120K": 3, "$120K +": 4, "Unknown": -1}
SEGMENTS = ["Income_Category", "Education_Level", "Card_Category", "Marital_Status"]
SEED = 42
SCENARIO_SIZES, SCENARIO_COSTS, SCENARIO_SUCCESS = [1_000, 10_000, 100_000, 500_000], [50, 300, 1_000], [10, 30, 60]
TIERS = [
    (0.6, "HIGH RISK", "Immediate intervention recommended."),
    (0.3, "MEDIUM RISK", "Monitor closely and consider proactive outreach."),
    (0.0, "LOW RISK", "Customer appears engaged. Continue standard service."),
]
TEXT = ["Gender", "Education_Level", "Marital_Status", "Income_Category", "Card_Category"]
COLUMNS = [
    "CLIENTNUM", "Customer_Age", "Gender", "Dependent_count", "Education_Level", "Marital_Status", "Income_Category", "Card_Category",
    "Months_on_book", "Total_Relationship_Count", "Months_Inactive_12_mon", "Contacts_Count_12_mon", "Credit_Limit",
    "Total_Revolving_Bal", "Avg_Open_To_Buy", "Total_Amt_Chng_Q4_Q1", "Total_Trans_Amt", "Total_Trans_Ct",
    "Total_Ct_Chng_Q4_Q1", "Avg_Utilization_Ratio", "churn",
]
NUMERIC = [c for c in COLUMNS if c not in TEXT]
DISTRIBUTIONS = [
    "Customer_Age", "Months_on_book", "Credit_Limit", "Total_Trans_Amt", "Total_Trans_Ct", "Avg_Utilization_Ratio",
    "Total_Revolving_Bal", "Total_Relationship_Count",
]
FEATURES = [
    "Customer_Age", "Gender", "Dependent_count", "Education_Level", "Income_Category", "Months_on_book", "Total_Relationship_Count",
    "Months_Inactive_12_mon", "Contacts_Count_12_mon", "Total_Revolving_Bal", "Total_Amt_Chng_Q4_Q1", "Total_Trans_Ct",
    "Total_Ct_Chng_Q4_Q1", "Avg_Utilization_Ratio", "Credit_Limit_log", "Avg_Open_To_Buy_log", "Total_Trans_Amt_log",
    "transaction_velocity", "inactivity_risk", "credit_usage_gap", "Marital_Status_Married", "Marital_Status_Single",
    "Marital_Status_Unknown", "Card_Category_Gold", "Card_Category_Platinum", "Card_Category_Silver",
]


def rule_weight(i: int) -> float:
    return ((7 * i) % 11 - 5) / 7


def rule_bend(i: int) -> float:
    return ((3 * i) % 5) / 13


def rule_shift(i: int) -> float:
    return (5 * i) % 7 - 2.5


RAW = """
hz AS (SELECT max(year(o_orderdate) * 12 + month(o_orderdate)) AS m FROM orders),
line AS (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_custkey, o_totalprice, o_orderpriority, coalesce(n_lines, 0) AS n_lines,
             year(o_orderdate) * 12 + month(o_orderdate) AS mo
      FROM orders LEFT JOIN line ON o_orderkey = l_orderkey),
agg AS (SELECT o_custkey, sum(n_lines) AS ct, round(sum(o_totalprice), 2) AS amt,
               min(mo) AS first_mo, max(mo) AS last_mo,
               sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent,
               sum(CASE WHEN mo > m - 40 THEN n_lines ELSE 0 END) AS ct_late,
               sum(CASE WHEN mo > m - 40 THEN 0 ELSE n_lines END) AS ct_early,
               sum(CASE WHEN mo > m - 40 THEN o_totalprice ELSE 0 END) AS amt_late,
               sum(CASE WHEN mo > m - 40 THEN 0 ELSE o_totalprice END) AS amt_early
        FROM o CROSS JOIN hz GROUP BY o_custkey),
base AS (SELECT c.*, m, coalesce(ct, 0) AS ct, coalesce(amt, 0.0) AS amt,
                coalesce(m - first_mo, 0) AS mob, least(6, coalesce(m - last_mo, 6)) AS inact,
                least(6, coalesce(urgent, 0)) AS contacts,
                round(1500 + abs(c_acctbal) * 3, 2) AS credit, (c_custkey * 97) % 1500 AS revolving,
                CASE WHEN ct_early > 0 THEN round(CAST(ct_late AS DOUBLE) / ct_early, 3) ELSE 0.0 END AS ct_chng,
                CASE WHEN amt_early > 0 THEN round(amt_late / amt_early, 3) ELSE 0.0 END AS amt_chng
         FROM customer c CROSS JOIN hz LEFT JOIN agg ON c_custkey = o_custkey),
customers AS (
SELECT c_custkey AS CLIENTNUM,
       CAST(26 + (c_custkey * 37) % 48 AS INT) AS Customer_Age,
       CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS Gender,
       CAST((c_custkey * 13) % 6 AS INT) AS Dependent_count,
       CASE (c_custkey * 11) % 7 WHEN 0 THEN 'Uneducated' WHEN 1 THEN 'High School' WHEN 2 THEN 'College'
            WHEN 3 THEN 'Graduate' WHEN 4 THEN 'Post-Graduate' WHEN 5 THEN 'Doctorate' ELSE 'Unknown' END AS Education_Level,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Married' WHEN 'BUILDING' THEN 'Single'
            WHEN 'FURNITURE' THEN 'Divorced' WHEN 'MACHINERY' THEN 'Married' ELSE 'Unknown' END AS Marital_Status,
       CASE WHEN c_acctbal < 0 THEN 'Unknown' WHEN c_acctbal < 3500 THEN 'Less than $40K'
            WHEN c_acctbal < 5500 THEN '$40K - $60K' WHEN c_acctbal < 7500 THEN '$60K - $80K'
            WHEN c_acctbal < 9000 THEN '$80K - $120K' ELSE '$120K +' END AS Income_Category,
       CASE WHEN c_nationkey < 18 THEN 'Blue' WHEN c_nationkey < 22 THEN 'Silver'
            WHEN c_nationkey < 24 THEN 'Gold' ELSE 'Platinum' END AS Card_Category,
       CAST(mob AS INT) AS Months_on_book,
       CAST(1 + (c_custkey * 5) % 6 AS INT) AS Total_Relationship_Count,
       CAST(inact AS INT) AS Months_Inactive_12_mon,
       CAST(contacts AS INT) AS Contacts_Count_12_mon,
       credit AS Credit_Limit,
       CAST(revolving AS INT) AS Total_Revolving_Bal,
       round(credit - revolving, 2) AS Avg_Open_To_Buy,
       amt_chng AS Total_Amt_Chng_Q4_Q1,
       amt AS Total_Trans_Amt,
       CAST(ct AS INT) AS Total_Trans_Ct,
       ct_chng AS Total_Ct_Chng_Q4_Q1,
       round(revolving / credit, 3) AS Avg_Utilization_Ratio,
       CASE WHEN (ct < 30 AND (contacts >= 3 OR inact >= 6) OR ct < 14) <> (c_custkey % 31 = 7)
            THEN 1 ELSE 0 END AS churn
FROM base)"""

STATUS = "CASE churn WHEN 1 THEN 'Churned' WHEN 0 THEN 'Retained' END"


def _codes(column: str, codes: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in codes.items()) + " END"


def _flag(column: str, value: str) -> str:
    return f"CASE WHEN {column} = '{value}' THEN 1 ELSE 0 END"


DUMMIES = {
    f"{c}_{v}": _flag(c, v)
    for c, values in {"Marital_Status": ["Married", "Single", "Unknown"], "Card_Category": ["Gold", "Platinum", "Silver"]}.items()
    for v in values
}
UNSCALED = {name: name for name in FEATURES} | {
    "Gender": _flag("Gender", "M"),
    "Education_Level": _codes("Education_Level", EDUCATION_CODES),
    "Income_Category": _codes("Income_Category", INCOME_CODES),
    "Credit_Limit_log": "ln(1 + Credit_Limit)",
    "Avg_Open_To_Buy_log": "ln(1 + Avg_Open_To_Buy)",
    "Total_Trans_Amt_log": "ln(1 + Total_Trans_Amt)",
    "transaction_velocity": "ln(1 + Total_Trans_Amt) / (Total_Trans_Ct + 1)",
    "inactivity_risk": "Months_Inactive_12_mon * Contacts_Count_12_mon",
    "credit_usage_gap": "ln(1 + Credit_Limit) - ln(1 + Avg_Open_To_Buy)",
} | DUMMIES

UNSCALED_CTE = "unscaled AS (SELECT CLIENTNUM, " + ", ".join(f"{e} AS {n}" for n, e in UNSCALED.items()) + ", churn FROM customers)"
SCALED_CTE = (
    UNSCALED_CTE
    + ", moments AS (SELECT "
    + ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in FEATURES)
    + " FROM unscaled), scaled AS (SELECT CLIENTNUM, "
    + ", ".join(f"round(({n} - m_{n}) / (CASE WHEN s_{n} = 0 THEN 1 ELSE s_{n} END), 6) AS {n}" for n in FEATURES)
    + ", churn FROM unscaled, moments)"
)


def _split_ctes(key: str = "CLIENTNUM", table: str = "customers") -> str:
    """Test rows: ceil(0.2 n) over the classes by largest remainder, in hash order."""
    return f"""
sizes AS (SELECT churn, count(*) AS n, sum(count(*)) OVER () AS total FROM {table} GROUP BY churn),
exact AS (SELECT churn, n, ceil(total * 0.2) AS target, n * ceil(total * 0.2) / total AS share FROM sizes),
remainders AS (SELECT churn, floor(share) AS low, target - sum(floor(share)) OVER () AS spare,
                      row_number() OVER (ORDER BY share - floor(share) DESC, churn) AS place FROM exact),
quota AS (SELECT churn, low + CASE WHEN place <= spare THEN 1 ELSE 0 END AS quota FROM remainders),
ranked AS (SELECT *, row_number() OVER (PARTITION BY churn
                  ORDER BY md5(CAST({key} AS VARCHAR) || ':{SEED}'), {key}) AS place FROM {table}),
divided AS (SELECT ranked.* EXCLUDE (place), CASE WHEN place <= quota THEN 'test' ELSE 'train' END AS split
            FROM ranked JOIN quota USING (churn))"""


def _with(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([RAW.strip(), *[c.strip() for c in ctes]]) + "\n" + body


def _histogram(columns: dict[str, str], bins: int, by: str | None = "churn") -> str:
    melted = " UNION ALL ".join(
        f"SELECT '{name}' AS feature, {by or 0} AS \"by\", CAST({x} AS DOUBLE) AS x FROM customers"
        for name, x in columns.items()
    )
    return _with(
        f"""SELECT feature, {'g."by",' if by else ''} CAST(g.bin AS INTEGER) AS bin,
       round(low + g.bin * width, 6) AS lo, round(low + (g.bin + 1) * width, 6) AS hi,
       coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / (total * width), 9) AS density
FROM grid g LEFT JOIN counts c USING (feature, "by", bin)""",
        f"melted AS ({melted})",
        f"""ranges AS (SELECT feature, "by", min(x) AS low, max(x) AS high, count(*) AS total,
            CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / {bins} ELSE 1 END AS width FROM melted GROUP BY ALL)""",
        f"""counts AS (SELECT m.feature, m."by", least(floor((x - low) / width), {bins - 1}) AS bin, count(*) AS n
            FROM melted m JOIN ranges r ON m.feature = r.feature AND m."by" = r."by" GROUP BY ALL)""",
        f"""grid AS (SELECT r.*, b.bin FROM ranges r, range({bins}) b(bin) WHERE high > low OR b.bin = 0)""",
    )


def _kde(column: str, points: int, pad: str, by: str = "churn") -> str:
    return _with(
        f"""SELECT "by", CAST(point AS INTEGER) AS point, round(g, 9) AS g,
       round(sum(n * exp(-((g - x) / bw) * ((g - x) / bw) / 2)) / (any_value(total) * any_value(bw) * sqrt(2 * pi())), 9) AS density
FROM grid JOIN vals USING ("by") GROUP BY "by", point, g""",
        f'vals AS (SELECT {by} AS "by", CAST({column} AS DOUBLE) AS x, count(*) AS n FROM customers GROUP BY ALL)',
        f"""shape AS (SELECT {by} AS "by", min({column}) AS low, max({column}) AS high, count(*) AS total,
            stddev_samp({column}) * pow(count(*), -0.2) AS bw FROM customers GROUP BY {by})""",
        f"""grid AS (SELECT "by", total, bw, point, low - {pad} + point * ((high + {pad} - (low - {pad})) / {points - 1}) AS g
            FROM shape, range({points}) p(point))""",
    )


def _box(column: str, by: str = "churn") -> str:
    return _with(
        f"""SELECT {by} AS "by", round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3,
       round(CAST(min({column}) FILTER ({column} >= q1 - 1.5 * (q3 - q1)) AS DOUBLE), 6) AS whisker_lo,
       round(CAST(max({column}) FILTER ({column} <= q3 + 1.5 * (q3 - q1)) AS DOUBLE), 6) AS whisker_hi,
       count(*) FILTER ({column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1)) AS n_out
FROM customers JOIN q USING ({by}) GROUP BY {by}, q1, q2, q3""",
        f"""q AS (SELECT {by}, CAST(quantile_cont({column}, 0.25) AS DOUBLE) AS q1,
            CAST(quantile_cont({column}, 0.5) AS DOUBLE) AS q2,
            CAST(quantile_cont({column}, 0.75) AS DOUBLE) AS q3 FROM customers GROUP BY {by})""",
    )


def _audit() -> str:
    checks = [
        ("rows", "*", "count(*)"), ("columns", "*", f"any_value({len(COLUMNS)})"),
        ("duplicate_rows", "*", "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customers))"),
        ("nulls_total", "*", " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in COLUMNS)),
        ("empty_columns", "*", " + ".join(f"CASE WHEN count(*) > 0 AND count({c}) = 0 THEN 1 ELSE 0 END" for c in COLUMNS)),
        ("numeric_columns", "*", f"any_value({len(NUMERIC)})"), ("text_columns", "*", f"any_value({len(TEXT)})"),
        *[("nulls", c, f"count(*) FILTER ({c} IS NULL)") for c in COLUMNS],
    ]
    return _with(
        " UNION ALL ".join(
            f"SELECT '{check}' AS \"check\", '{column}' AS \"column\", CAST({value} AS DOUBLE) AS value FROM customers"
            for check, column, value in checks
        )
    )


def _feature_audit() -> str:
    nulls = " + ".join(f"count(*) FILTER ({n} IS NULL)" for n in FEATURES)
    checks = [
        ("rows", "count(*)"), ("columns", f"any_value({len(FEATURES) + 1})"), ("numeric_columns", f"any_value({len(FEATURES) + 1})"),
        ("text_columns", "any_value(0)"), ("nulls_total", nulls), ("churn_rate", "round(avg(churn) * 100, 6)"),
    ]
    return _with(
        " UNION ALL ".join(
            f"SELECT '{check}' AS \"check\", '*' AS \"column\", CAST({value} AS DOUBLE) AS value FROM unscaled"
            for check, value in checks
        ),
        UNSCALED_CTE,
    )


AGE = "CASE " + " ".join(
    f"WHEN Customer_Age > {lo} AND Customer_Age <= {hi} THEN '{label}'" for lo, hi, label in zip(AGE_EDGES, AGE_EDGES[1:], AGE_LABELS)
) + " END"


def _rate(key: str, name: str) -> str:
    return _with(
        f"""SELECT {key} AS {name}, count(*) AS n, round(avg(churn) * 100, 6) AS rate,
       round((SELECT avg(churn) * 100 FROM customers), 6) AS overall
FROM customers WHERE {key} IS NOT NULL GROUP BY 1"""
    )


def _segments() -> str:
    return _with(
        " UNION ALL ".join(
            f"""SELECT '{s}' AS segment, {s} AS value, count(*) AS n, round(avg(churn) * 100, 6) AS rate,
            round((SELECT avg(churn) * 100 FROM customers), 6) AS overall FROM customers WHERE {s} IS NOT NULL GROUP BY {s}"""
            for s in SEGMENTS
        )
    )


def _correlations() -> str:
    names = [n for n in NUMERIC if n != "CLIENTNUM"]
    return _with(
        " UNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM customers"
            for i, a in enumerate(names) for b in names[:i]
        )
    )


FINGERPRINT = "md5(concat_ws('_', " + ", ".join(f"CAST({n} AS VARCHAR)" for n in FEATURES) + "))"

# Two rule scores with many ties, for every customer.
SCORES = """
rules AS (SELECT *, 'rule_count' AS model,
                 CAST(least(1000, greatest(0, 1000 - 15 * Total_Trans_Ct)) AS DOUBLE) / 1000 AS p FROM customers
          UNION ALL
          SELECT *, 'rule_activity',
                 CAST(least(1000, greatest(0, 900 - 14 * Total_Trans_Ct + 60 * Contacts_Count_12_mon
                                              + 30 * Months_Inactive_12_mon)) AS DOUBLE) / 1000 FROM customers),
scored AS (SELECT * RENAME (churn AS label), CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction FROM rules)"""

CUMULATIVE = """
per_score AS (SELECT model, p, sum(label) AS tp, count(*) - sum(label) AS fp FROM scored GROUP BY model, p),
running AS (SELECT *, sum(tp) OVER up AS cum_tp, sum(fp) OVER up AS cum_fp,
                   sum(tp) OVER (PARTITION BY model) AS pos, sum(fp) OVER (PARTITION BY model) AS neg
            FROM per_score WINDOW up AS (PARTITION BY model ORDER BY p DESC))"""

# AUC as the share of (churned, retained) pairs in the right order, ties half:
# mid-ranks, not the trapezoids the engine adds up.
AREAS = """
midranks AS (SELECT model, label, rank() OVER (PARTITION BY model ORDER BY p)
                    + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS r FROM scored),
auc AS (SELECT model, (sum(r) FILTER (label = 1) - CAST(sum(label) AS DOUBLE) * (sum(label) + 1) / 2)
                      / (CAST(sum(label) AS DOUBLE) * (count(*) - sum(label))) AS roc_auc FROM midranks GROUP BY model),
ap AS (SELECT model, sum(tp / pos * (cum_tp / (cum_tp + cum_fp))) AS pr_auc FROM running GROUP BY model)"""

COUNTS = """
counts AS (SELECT model, count(*) AS n, sum(label) AS pos, count(*) - sum(label) AS neg,
                  count(*) FILTER (label = 1 AND prediction = 1) AS tp,
                  count(*) FILTER (label = 0 AND prediction = 1) AS fp FROM scored GROUP BY model)"""

METRIC_ROWS = """
metric_rows AS (SELECT model, round_even(roc_auc, 4) AS roc_auc, round_even(pr_auc, 4) AS pr_auc,
       round_even(2 * tp / (tp + fp + pos), 4) AS f1,
       round_even(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision,
       round_even(tp / pos, 4) AS recall, round_even((tp + neg - fp) / (pos + neg), 4) AS accuracy
FROM counts JOIN auc USING (model) JOIN ap USING (model))"""


def _rates(by: str = "") -> str:
    group = f"model, {by}" if by else "model"
    return f"""
rates AS (SELECT {group}, count(*) AS n, CAST(sum(label) AS BIGINT) AS churners,
          count(*) FILTER (label = 1 AND prediction = 1) AS hits,
          count(*) FILTER (label = 0 AND prediction = 1) AS false_hits,
          coalesce(round_even(count(*) FILTER (label = 1 AND prediction = 1) / nullif(sum(label), 0), 4), 0) AS recall,
          coalesce(round_even(count(*) FILTER (label = 1 AND prediction = 1)
                              / nullif(count(*) FILTER (prediction = 1), 0), 4), 0) AS precision
          FROM scored GROUP BY {group})"""


def _confusion() -> str:
    cells = " UNION ALL ".join(
        f"""SELECT model, {a} AS label, {p} AS prediction,
        count(*) FILTER (label = {a} AND prediction = {p}) AS n,
        coalesce(count(*) FILTER (label = {a} AND prediction = {p}) / nullif(count(*) FILTER (label = {a}), 0), 0) AS row_share
        FROM scored GROUP BY model"""
        for a in (0, 1) for p in (0, 1)
    )
    return _with(cells, SCORES)


def _scorecard() -> str:
    return _with(
        """SELECT metric, b.value AS baseline, c.value AS challenger, round_even(c.value - b.value, 4) AS delta,
       CASE WHEN c.value > b.value THEN 'rule_activity' WHEN c.value < b.value THEN 'rule_count' ELSE 'tie' END AS winner
FROM long b JOIN long c USING (metric) WHERE b.model = 'rule_count' AND c.model = 'rule_activity'""",
        SCORES, CUMULATIVE, AREAS, COUNTS, METRIC_ROWS,
        "long AS (UNPIVOT metric_rows ON roc_auc, pr_auc, f1, precision, recall, accuracy INTO NAME metric VALUE value)",
    )


def _roi(by: str = "", scores: tuple[str, ...] = (SCORES,)) -> str:
    def values(numbers: list[int], name: str) -> str:
        return f"(SELECT unnest({numbers}) AS {name})"

    extra = f"{by}, " if by else ""
    return _with(
        f"""SELECT model, {extra}portfolio, cac, success_pct, est_churners, caught,
       CAST(trunc(caught * (success_pct / 100)) AS BIGINT) AS saved,
       CAST(trunc(caught * (success_pct / 100)) AS BIGINT) * cac AS roi FROM caught_cte""",
        *scores, _rates(by),
        f"all_customers AS (SELECT {extra}CAST(sum(churn) AS DOUBLE) / count(*) AS churn_rate FROM customers {'GROUP BY ' + by if by else ''})",
        f"""est AS (SELECT *, CAST(trunc(portfolio * churn_rate) AS BIGINT) AS est_churners
            FROM rates {f'JOIN all_customers USING ({by})' if by else 'CROSS JOIN all_customers'}, {values(SCENARIO_SIZES, 'portfolio')}, {values(SCENARIO_COSTS, 'cac')}, {values(SCENARIO_SUCCESS, 'success_pct')})""",
        "caught_cte AS (SELECT *, CAST(trunc(est_churners * recall) AS BIGINT) AS caught FROM est)",
    ).replace("unnest([", "unnest(CAST([").replace("]) AS", "] AS BIGINT[])) AS")


def _tier(field: int) -> str:
    return f"CASE WHEN p >= {TIERS[0][0]} THEN '{TIERS[0][field]}' WHEN p >= {TIERS[1][0]} THEN '{TIERS[1][field]}' ELSE '{TIERS[2][field]}' END"


RECOMMENDATIONS = """
rules_fired AS (
  SELECT CLIENTNUM, model, 1 AS rule, 'Transaction Engagement' AS title,
         'Customer transacts fewer than 40 times per year. Offer bonus rewards or cashback on next 10 transactions.' AS body
  FROM scored WHERE Total_Trans_Ct < 40
  UNION ALL
  SELECT CLIENTNUM, model, 2, 'Re-engagement Campaign',
         'Inactive for ' || Months_Inactive_12_mon || ' months. Send a personalised re-engagement offer.'
  FROM scored WHERE Months_Inactive_12_mon >= 3
  UNION ALL
  SELECT CLIENTNUM, model, 3, 'Service Quality Review',
         'Contacted support ' || Contacts_Count_12_mon || ' times — dissatisfaction signal. Escalate to relationship manager.'
  FROM scored WHERE Contacts_Count_12_mon >= 4
  UNION ALL
  SELECT CLIENTNUM, model, 4, 'Card Usage Incentive',
         'Utilisation is ' || printf('%.2f', Avg_Utilization_Ratio)
         || ' — near zero. Offer a targeted spend challenge with rewards.'
  FROM scored WHERE Avg_Utilization_Ratio < 0.10
  UNION ALL
  SELECT CLIENTNUM, model, 5, 'Maintain Relationship', 'Low risk. Consider loyalty tier upgrade to deepen engagement.'
  FROM scored WHERE p < 0.30),
advised AS (SELECT * FROM rules_fired
  UNION ALL
  SELECT CLIENTNUM, model, 1, 'Standard Monitoring', 'Schedule a quarterly relationship review.'
  FROM scored ANTI JOIN rules_fired USING (CLIENTNUM, model))"""

_N = len(FEATURES)
CONTRIBUTIONS = (
    SCALED_CTE
    + ", shap AS (SELECT CLIENTNUM, -1.5 AS base, ["
    + ", ".join(FEATURES)
    + "] AS value, ["
    + ", ".join(
        f"CAST('{rule_weight(i)}' AS DOUBLE) * {n} + CAST('{rule_bend(i)}' AS DOUBLE) * {n} * {FEATURES[(i + 1) % _N]} + CAST('{rule_shift(i)}' AS DOUBLE)"
        for i, n in enumerate(FEATURES)
    )
    + "] AS shap FROM scaled), feature_names AS (SELECT unnest(["
    + ", ".join(f"'{n}'" for n in FEATURES)
    + f"]) AS feature, unnest(range(1, {_N + 1})) AS position)"
    + ", long AS (SELECT CLIENTNUM, base, feature, position, value[position] AS value, shap[position] AS shap FROM shap, feature_names)"
)
IMPORTANCE = """
importance AS (SELECT feature, position, avg(abs(shap)) AS mean_abs, avg(shap) AS mean,
                      row_number() OVER (ORDER BY round(avg(abs(shap)), 9) DESC, feature) AS rank
               FROM long GROUP BY feature, position)"""


def _waterfall(top: int, only: str = "") -> str:
    shown = top - 1
    return _with(
        """SELECT CLIENTNUM, CAST(rank AS INTEGER) AS rank, feature, value, round(shap, 7) AS shap,
       round(base + sum(shap) OVER later, 7) AS "end", round(base + sum(shap) OVER later - shap, 7) AS start
FROM steps WINDOW later AS (PARTITION BY CLIENTNUM ORDER BY rank DESC)""",
        CONTRIBUTIONS,
        f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY CLIENTNUM ORDER BY abs(shap) DESC, position) AS rank
            FROM long {only})""",
        f"""steps AS (SELECT CLIENTNUM, base, rank, feature, value, shap FROM ordered WHERE rank <= {shown}
            UNION ALL
            SELECT CLIENTNUM, any_value(base), {top}, '{_N - shown} other features', NULL, sum(shap) FROM ordered
            WHERE rank > {shown} GROUP BY CLIENTNUM)""",
    )


def _interaction() -> str:
    others = [n for n in FEATURES if n != "Total_Trans_Ct"]
    pairs = " UNION ALL ".join(
        f"SELECT '{n}' AS feature, abs(corr(r, value[{FEATURES.index(n) + 1}])) AS abs_r FROM residuals" for n in others
    )
    t = FEATURES.index("Total_Trans_Ct") + 1
    return f"""
points AS (SELECT CLIENTNUM, value, value[{t}] AS x, shap[{t}] AS y FROM shap),
fit AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM points),
residuals AS (SELECT value, y - (intercept + slope * x) AS r FROM points, fit),
strengths AS ({pairs}),
chosen AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY round(abs_r, 9) DESC, feature) = 1 THEN 1 ELSE 0 END AS chosen
           FROM strengths WHERE abs_r IS NOT NULL AND NOT isnan(abs_r))"""


# Cubic by orthogonal polynomials built one degree at a time; the engine solves
# the normal equations instead.
TREND = """
p0 AS (SELECT x, y, 1.0 AS q0 FROM points),
a0 AS (SELECT avg(x) AS a0, avg(y) AS c0, count(*) AS h0 FROM p0),
p1 AS (SELECT x, y, x - a0 AS q1 FROM p0, a0),
a1 AS (SELECT sum(x * q1 * q1) / sum(q1 * q1) AS a1, sum(q1 * q1) / any_value(h0) AS b1,
              sum(y * q1) / sum(q1 * q1) AS c1, sum(q1 * q1) AS h1 FROM p1, a0),
p2 AS (SELECT x, y, q1, (x - a1) * q1 - b1 AS q2 FROM p1, a1),
a2 AS (SELECT sum(x * q2 * q2) / sum(q2 * q2) AS a2, sum(q2 * q2) / any_value(h1) AS b2,
              sum(y * q2) / sum(q2 * q2) AS c2 FROM p2, a1),
p3 AS (SELECT y, (x - a2) * q2 - b2 * q1 AS q3 FROM p2, a2),
a3 AS (SELECT sum(y * q3) / sum(q3 * q3) AS c3 FROM p3),
grid AS (SELECT low + i * ((high - low) / 199) AS x
         FROM (SELECT min(x) AS low, max(x) AS high FROM points), range(200) r(i))"""


#: Rows walk down the hand-written trees; nodes count the rows that pass them.
TREE_CTES = (
    """rows_in AS (SELECT CLIENTNUM AS id, churn AS y, [CAST(Total_Trans_Ct AS DOUBLE), CAST(Contacts_Count_12_mon AS DOUBLE),
                       CAST(Credit_Limit AS DOUBLE), CAST(Months_Inactive_12_mon AS DOUBLE)] AS f FROM customers)""",
    """nodes(tree, node, l, r, feature, threshold, leaf) AS (VALUES
        (0, 0, 1, 2, 0, 39.0, 0.0), (0, 1, 3, 4, 1, 1.0, 0.0), (0, 2, -1, -1, -1, 0.0, -1.6), (0, 3, 5, 6, 0, 25.0, 0.0),
        (0, 4, -1, -1, -1, 0.0, 1.8), (0, 5, -1, -1, -1, 0.0, 0.8), (0, 6, -1, -1, -1, 0.0, -0.4),
        (1, 0, 1, 2, 2, 14500.0, 0.0), (1, 1, 3, 4, 3, 4.0, 0.0), (1, 2, 5, 6, 0, 45.0, 0.0), (1, 3, -1, -1, -1, 0.0, -0.06),
        (1, 4, -1, -1, -1, 0.0, 0.14), (1, 5, -1, -1, -1, 0.0, 0.02), (1, 6, -1, -1, -1, 0.0, -0.1))""",
    """walk(id, tree, node) AS (
        SELECT id, tree, 0 FROM rows_in, (VALUES (0), (1)) t(tree)
        UNION ALL
        SELECT w.id, w.tree, CASE WHEN f[feature + 1] <= threshold THEN l ELSE r END
        FROM walk w JOIN nodes n ON w.tree = n.tree AND w.node = n.node JOIN rows_in i ON w.id = i.id WHERE l >= 0)""",
    """passed AS (SELECT tree, node, count(*) AS n, var_pop(y) AS spread FROM walk JOIN rows_in USING (id) GROUP BY tree, node)""",
)


def _fixed_shap() -> str:
    """Expected outputs for all 16 sets of known columns, and Shapley's formula over them."""
    names = ["Total_Trans_Ct", "Contacts_Count_12_mon", "Credit_Limit", "Months_Inactive_12_mon"]
    weight = "CASE bit_count(a.s) WHEN 0 THEN 6 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 6 END / 24.0"
    parts = ", ".join(
        f"round(sum(CASE WHEN (a.s & {1 << k}) = 0 AND b.s = (a.s | {1 << k}) THEN {weight} * (b.v - a.v) END), 9) AS shap_{name}"
        for k, name in enumerate(names)
    )
    sql = _with(
        f"""SELECT a.id AS CLIENTNUM, round(any_value(CASE WHEN a.s = 0 THEN a.v END), 9) AS base, {parts}
FROM expected a JOIN expected b ON a.id = b.id GROUP BY a.id""",
        *TREE_CTES,
        """known(id, s, tree, node, w) AS (
        SELECT id, s, tree, 0, CAST(1 AS DOUBLE) FROM rows_in, range(16) c(s), (VALUES (0), (1)) t(tree)
        UNION ALL
        SELECT k.id, k.s, k.tree, c.node,
               k.w * CASE WHEN (k.s >> n.feature) & 1 = 0 THEN c.n / CAST(p.n AS DOUBLE)
                          WHEN (f[n.feature + 1] <= n.threshold) = (c.node = n.l) THEN 1 ELSE 0 END
        FROM known k JOIN nodes n ON k.tree = n.tree AND k.node = n.node JOIN rows_in i ON k.id = i.id
             JOIN passed p ON p.tree = k.tree AND p.node = k.node
             JOIN passed c ON c.tree = k.tree AND (c.node = n.l OR c.node = n.r) WHERE n.l >= 0)""",
        """expected AS (SELECT id, s, sum(w * leaf) AS v FROM known k JOIN nodes n ON k.tree = n.tree AND k.node = n.node WHERE l < 0 GROUP BY id, s)""",
    )
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _fixed_gain() -> str:
    sql = _with(
        """SELECT name AS feature, round(coalesce(g, 0) / sum(coalesce(g, 0)) OVER (), 9) AS importance
FROM (VALUES (0, 'Total_Trans_Ct'), (1, 'Contacts_Count_12_mon'), (2, 'Credit_Limit'), (3, 'Months_Inactive_12_mon')) f(feature, name)
     LEFT JOIN by_feature USING (feature)""",
        *TREE_CTES,
        """by_feature AS (SELECT feature, avg(p.n * p.spread - coalesce(a.n * a.spread, 0) - coalesce(b.n * b.spread, 0)) AS g
        FROM nodes n JOIN passed p ON p.tree = n.tree AND p.node = n.node
             LEFT JOIN passed a ON a.tree = n.tree AND a.node = n.l LEFT JOIN passed b ON b.tree = n.tree AND b.node = n.r
        WHERE n.l >= 0 GROUP BY feature)""",
    )
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _cv() -> str:
    """Metrics of each rule and fold, then their mean and deviation; a rule's fold is a model of its own on the way."""
    parts = ", ".join(
        f"round_even(avg(v) FILTER (rule = '{r}'), 4) AS {r}_mean, round_even(stddev_pop(v) FILTER (rule = '{r}'), 4) AS {r}_std" for r in ("rule_count", "rule_activity")
    )
    return _with(
        f"SELECT metric, {parts} FROM long GROUP BY metric",
        _split_ctes(),
        f"""folded AS (SELECT *, ntile(5) OVER (PARTITION BY churn ORDER BY md5(CAST(CLIENTNUM AS VARCHAR) || ':{SEED + 1}'), CLIENTNUM) - 1 AS fold
            FROM divided WHERE split = 'train')""",
        SCORES.replace("FROM customers", "FROM folded").replace("SELECT * RENAME (churn AS label)", "SELECT * EXCLUDE (model) RENAME (churn AS label), model || ':' || fold AS model"),
        CUMULATIVE, AREAS, COUNTS,
        """by_fold AS (SELECT split_part(model, ':', 1) AS rule, roc_auc, 2 * tp / (tp + fp + pos) AS f1,
                   CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, tp / pos AS recall FROM counts JOIN auc USING (model))""",
        "long AS (UNPIVOT by_fold ON roc_auc, f1, precision, recall INTO NAME metric VALUE v)",
    )


#: Missing values, and rows that occur two or three times.
DIRTY = """customers AS (SELECT * EXCLUDE (copy) FROM (
    SELECT * REPLACE (CASE WHEN CLIENTNUM % 7 <> 0 THEN Credit_Limit END AS Credit_Limit,
                      CASE WHEN CLIENTNUM % 5 <> 0 THEN Total_Trans_Ct END AS Total_Trans_Ct,
                      CASE WHEN CLIENTNUM % 9 <> 0 THEN Gender END AS Gender),
           unnest(range(CASE WHEN CLIENTNUM % 33 = 0 THEN 3 WHEN CLIENTNUM % 11 = 0 THEN 2 ELSE 1 END)) AS copy FROM clean))"""


def _on_dirty(sql: str) -> str:
    """The same SQL over the dirty table."""
    raw = RAW.strip()
    return sql.replace(raw, raw.replace("customers AS (", "clean AS (") + ", " + DIRTY)


def _known(sql: str, column: str, by: str) -> str:
    """Without rows that lack the column or the class."""
    return sql.replace("FROM customers", f"FROM (SELECT * FROM customers WHERE {column} IS NOT NULL AND {by} IS NOT NULL)")


ORACLES: dict[str, str] = {
    "dirty_audit": _on_dirty(_audit()),
    "dirty_keys": _on_dirty(
        _with("SELECT count(*) AS n_rows, count(DISTINCT CLIENTNUM) AS n_keys, CASE WHEN count(*) = count(DISTINCT CLIENTNUM) THEN 1 ELSE 0 END AS is_unique FROM customers")
    ),
    "dirty_correlations": _on_dirty(_correlations()),
    "dirty_box": _on_dirty(_box("Total_Trans_Ct")),
    "box_by_age": _box("Total_Trans_Amt", "Customer_Age"),
    "dirty_kde": _on_dirty(_known(_kde("Total_Trans_Ct", 40, "(high - low) / 2", by="Gender"), "Total_Trans_Ct", "Gender")),
    "dirty_hist": _on_dirty(
        _histogram({c: c for c in ("Credit_Limit", "Total_Trans_Ct")}, 15, by="Gender").replace(
            "FROM melted", 'FROM (SELECT * FROM melted WHERE x IS NOT NULL AND "by" IS NOT NULL)'
        )
    ),
    "dirty_leak": _on_dirty(
        _with(
            """SELECT count(*) AS n_shared FROM (
    SELECT Customer_Age, Total_Trans_Ct, Credit_Limit FROM customers WHERE CLIENTNUM % 2 = 0
    INTERSECT SELECT Customer_Age, Total_Trans_Ct, Credit_Limit FROM customers WHERE CLIENTNUM % 3 = 0)"""
        )
    ),
    "cv_fixed_scores": _cv(),
    "model_logistic_optimum": _with("SELECT count(*) AS n_rows, 26 AS n_features, 1 AS at_optimum FROM divided WHERE split = 'train'", _split_ctes()),
    "shap_flags": _with(
        """SELECT count(*) AS n_explained, 0 AS n_bad, 1 AS adds_up, 1 AS base_in_range, 1 AS means_in_range, 1 AS mostly_spread
FROM divided WHERE split = 'test'""",
        _split_ctes(),
    ),
    "shap_fixed_trees": _fixed_shap(),
    "gain_fixed_trees": _fixed_gain(),
    "ingest_customers": _with("SELECT * FROM customers"),
    "table_roundtrip": _with(
        """SELECT count(*) AS n_rows, 0 AS n_missing_columns, CAST(sum(CLIENTNUM) AS BIGINT) AS id_sum,
       round(sum(Credit_Limit), 2) AS credit_sum, CAST(sum(churn) AS BIGINT) AS churned FROM customers"""
    ),
    "quality_audit": _audit(),
    "key_uniqueness": _with(
        """SELECT count(*) AS n_rows, count(DISTINCT CLIENTNUM) AS n_keys,
       CASE WHEN count(*) = count(DISTINCT CLIENTNUM) THEN 1 ELSE 0 END AS is_unique FROM customers"""
    ),
    "class_balance": _with(
        "SELECT churn, count(*) AS n, round(count(*) / (SELECT count(*) FROM customers) * 100, 6) AS share_pct FROM customers GROUP BY churn"
    ),
    "summary_stats": _with(
        """SELECT count(*) AS total, CAST(sum(churn) AS BIGINT) AS churned, count(*) FILTER (churn = 0) AS retained,
       round(avg(churn) * 100, 6) AS churn_rate, round(avg(Customer_Age), 6) AS avg_age,
       round(avg(Credit_Limit), 6) AS avg_credit_limit, round(avg(Total_Trans_Ct), 6) AS avg_transactions,
       round(avg(Avg_Utilization_Ratio), 6) AS avg_utilisation, 20 AS features FROM customers"""
    ),
    "churn_by_card": _rate("Card_Category", "Card_Category"),
    "churn_by_age_group": _rate(AGE, "age_group"),
    "churn_by_segment": _segments(),
    "contacts_by_status": _with(
        f"SELECT Contacts_Count_12_mon, {STATUS} AS Status, count(*) AS n FROM customers GROUP BY ALL"
    ),
    "hist_age": _histogram({"Customer_Age": "Customer_Age"}, 20),
    "hist_credit_raw_log": _histogram({"Credit_Limit": "Credit_Limit", "Credit_Limit_log": "ln(1 + Credit_Limit)"}, 30),
    "hist_numeric": _histogram({c: c for c in DISTRIBUTIONS}, 25),
    "hist_any": _histogram({c: c for c in NUMERIC if c not in ("CLIENTNUM", "churn")}, 30, by=None),
    "hist_by_inactivity": _histogram({c: c for c in ("Customer_Age", "Total_Trans_Ct")}, 10, by="Months_Inactive_12_mon"),
    "hist_by_gender": _histogram({c: c for c in ("Customer_Age", "Credit_Limit")}, 12, by="Gender"),
    "kde_by_gender": _kde("Customer_Age", 50, "(high - low) / 2", by="Gender"),
    "kde_age": _kde("Customer_Age", 1000, "(high - low) / 2"),
    "violin_utilisation": _kde("Avg_Utilization_Ratio", 100, "bw * 2"),
    "box_utilisation": _box("Avg_Utilization_Ratio"),
    "box_trans_ct": _box("Total_Trans_Ct"),
    "corr_lower_triangle": _correlations(),
    "sample_500": _with(
        f"""SELECT CLIENTNUM, Total_Trans_Ct, {STATUS} AS Status FROM customers
ORDER BY md5(CAST(CLIENTNUM AS VARCHAR) || ':{SEED}'), CLIENTNUM LIMIT 500"""
    ),
    "preview_all": _with("SELECT * FROM customers ORDER BY CLIENTNUM LIMIT 100"),
    "preview_churned": _with("SELECT * FROM customers WHERE churn = 1 ORDER BY CLIENTNUM LIMIT 100"),
    "encode_categoricals": _with(
        "SELECT CLIENTNUM, "
        + ", ".join(f"{UNSCALED[n]} AS {n}" for n in ["Gender", "Education_Level", "Income_Category", *DUMMIES])
        + " FROM customers"
    ),
    "unknown_categories": _with(
        """SELECT 'Education_Level' AS feature, count(*) FILTER (Education_Level = 'Unknown') AS unknowns FROM customers
UNION ALL SELECT 'Income_Category', count(*) FILTER (Income_Category = 'Unknown') FROM customers"""
    ),
    "log_and_engineered": _with(
        "SELECT CLIENTNUM, inactivity_risk, "
        + ", ".join(
            f"round({n}, 9) AS {n}"
            for n in ["Credit_Limit_log", "Avg_Open_To_Buy_log", "Total_Trans_Amt_log", "transaction_velocity", "credit_usage_gap"]
        )
        + " FROM unscaled",
        UNSCALED_CTE,
    ),
    "scaled_features": _with("SELECT * FROM scaled", SCALED_CTE),
    "feature_audit": _feature_audit(),
    "stratified_split": _with("SELECT CLIENTNUM, churn, split FROM divided", _split_ctes()),
    "split_balance": _with(
        """SELECT split, count(*) AS n, CAST(sum(churn) AS BIGINT) AS churned, round(avg(churn) * 100, 6) AS rate,
       round(count(*) / (SELECT count(*) FROM divided), 6) AS share FROM divided GROUP BY split""",
        _split_ctes(),
    ),
    "split_leakage": _with(
        f"""SELECT count(*) AS n_shared FROM (SELECT {FINGERPRINT} FROM divided WHERE split = 'train'
INTERSECT SELECT {FINGERPRINT} FROM divided WHERE split = 'test')""",
        SCALED_CTE, _split_ctes(table="scaled"),
    ),
    "cv_folds": _with(
        f"""SELECT CLIENTNUM, churn, CAST(ntile(5) OVER (PARTITION BY churn
       ORDER BY md5(CAST(CLIENTNUM AS VARCHAR) || ':{SEED + 1}'), CLIENTNUM) - 1 AS INTEGER) AS fold
FROM divided WHERE split = 'train'""",
        _split_ctes(),
    ),
    "class_weights": _with(
        """SELECT neg AS n_retained, pos AS n_churned, round((neg + pos) / (2 * neg), 9) AS balanced_retained,
       round((neg + pos) / (2 * pos), 9) AS balanced_churned, round_even(neg / pos, 4) AS imbalance
FROM (SELECT count(*) FILTER (churn = 0) AS neg, count(*) FILTER (churn = 1) AS pos FROM divided WHERE split = 'train')""",
        _split_ctes(),
    ),
    "confusion": _confusion(),
    "roc_curve": _with(
        """SELECT model, p AS threshold, cum_fp / neg AS fpr, cum_tp / pos AS tpr FROM running
UNION ALL SELECT DISTINCT model, NULL, 0, 0 FROM running""",
        SCORES, CUMULATIVE,
    ),
    "stream_sinks": _with(
        """SELECT 2 * count(*) FILTER (CLIENTNUM % 10 <> 0) AS n_records, count(*) FILTER (CLIENTNUM % 10 <> 0) AS n_scored,
       CAST(2 * sum(CLIENTNUM) FILTER (CLIENTNUM % 10 <> 0) AS BIGINT) AS id_sum, 0 AS n_not_adding_up,
       count(*) FILTER (CLIENTNUM % 10 = 0) AS n_rejected, count(*) FILTER (CLIENTNUM % 10 = 0) AS n_without_income FROM customers"""
    ),
    "model_artifacts": _with(
        """SELECT 'customers' AS artifact, count(*) AS n_rows FROM customers UNION ALL SELECT 'features', count(*) FROM customers
UNION ALL SELECT split, count(*) FROM divided GROUP BY split
UNION ALL SELECT 'scored', 2 * count(*) FROM divided WHERE split = 'test' UNION ALL SELECT 'contributions', count(*) FROM divided WHERE split = 'test'""",
        _split_ctes(),
    ),
    "monitor_two_ingests": _with(
        """SELECT count(*) AS n_rows, count(*) - count(CLIENTNUM) AS n_without_key,
       CASE WHEN count(DISTINCT CLIENTNUM) = count(*) THEN 1 ELSE 0 END AS may_be_unique, 1 AS keys_close,
       count(*) - count(Gender) AS n_missing_gender,
       greatest(count(*) FILTER (CLIENTNUM % 2 = 0), count(*) FILTER (CLIENTNUM % 2 = 1)) AS most_in_one_ingest FROM customers"""
    ),
    "roc_curve_corners": _with(
        """SELECT model, threshold, fpr, tpr FROM (
    SELECT model, p AS threshold, x / n AS fpr, y / m AS tpr,
           (x - lag(x, 1, 0) OVER w) * (lead(y) OVER w - y) - (y - lag(y, 1, 0) OVER w) * (lead(x) OVER w - x) AS turn
    FROM (SELECT model, p, CAST(cum_fp AS DOUBLE) AS x, CAST(cum_tp AS DOUBLE) AS y, neg AS n, pos AS m FROM running)
    WINDOW w AS (PARTITION BY model ORDER BY p DESC)) WHERE turn IS NULL OR turn <> 0
UNION ALL SELECT DISTINCT model, NULL, 0, 0 FROM running""",
        SCORES, CUMULATIVE,
    ),
    "roc_curve_cells": _with(
        """SELECT model, p AS threshold, fpr, tpr FROM (
    SELECT *, row_number() OVER (PARTITION BY model, floor((fpr + tpr) / 2 * 40) ORDER BY p) AS place
    FROM (SELECT model, p, cum_fp / neg AS fpr, cum_tp / pos AS tpr FROM running)) WHERE place = 1
UNION ALL SELECT DISTINCT model, NULL, 0, 0 FROM running""",
        SCORES, CUMULATIVE,
    ),
    "pr_curve_cells": _with(
        """SELECT model, p AS threshold, precision, recall, baseline FROM (
    SELECT *, row_number() OVER (PARTITION BY model, cell ORDER BY p) AS last,
           row_number() OVER (PARTITION BY model, cell ORDER BY precision, p DESC) AS least,
           row_number() OVER (PARTITION BY model, cell ORDER BY precision DESC, p DESC) AS most
    FROM (SELECT model, p, cum_tp / (cum_tp + cum_fp) AS precision, cum_tp / pos AS recall, pos / (pos + neg) AS baseline,
                 floor(cum_tp / pos * 20) AS cell FROM running)) WHERE 1 IN (last, least, most)
UNION ALL SELECT DISTINCT model, NULL, 1, 0, pos / (pos + neg) FROM running""",
        SCORES, CUMULATIVE,
    ),
    "pr_curve": _with(
        """SELECT model, p AS threshold, cum_tp / (cum_tp + cum_fp) AS precision, cum_tp / pos AS recall,
       pos / (pos + neg) AS baseline FROM running
UNION ALL SELECT DISTINCT model, NULL, 1, 0, pos / (pos + neg) FROM running""",
        SCORES, CUMULATIVE,
    ),
    "roc_auc": _with("SELECT model, round(roc_auc, 9) AS roc_auc FROM auc", SCORES, CUMULATIVE, AREAS),
    "avg_precision": _with("SELECT model, round(pr_auc, 9) AS pr_auc FROM ap", SCORES, CUMULATIVE, AREAS),
    "metric_row": _with("SELECT * FROM metric_rows", SCORES, CUMULATIVE, AREAS, COUNTS, METRIC_ROWS),
    "scorecard": _scorecard(),
    "business_reading": _with(
        """SELECT model, churners, caught, churners - caught AS missed,
       CASE WHEN precision > 0 THEN CAST(trunc(caught / precision * (1 - precision)) AS BIGINT) ELSE 0 END AS false_alarms,
       caught * 300 AS value FROM (SELECT *, CAST(trunc(recall * churners) AS BIGINT) AS caught FROM rates)""",
        SCORES, _rates(),
    ),
    "business_by_card": _with(
        """SELECT model, Card_Category, churners, hits AS caught, churners - hits AS missed, false_hits AS false_alarms,
       hits * 300 AS value FROM rates""",
        SCORES, _rates("Card_Category"),
    ),
    "portfolio_value": _with(
        """SELECT model, churned, recall, saved, saved * 300 AS value
FROM (SELECT *, CAST(trunc(recall * churned * CAST(0.20 AS DOUBLE)) AS BIGINT) AS saved FROM rates,
      (SELECT CAST(sum(churn) AS BIGINT) AS churned FROM customers))""",
        SCORES, _rates(),
    ),
    "portfolio_by_income": _with(
        """SELECT model, Income_Category, churned, recall, saved, saved * 300 AS value
FROM (SELECT *, CAST(trunc(recall * churned * CAST(0.20 AS DOUBLE)) AS BIGINT) AS saved FROM rates
      JOIN (SELECT Income_Category, CAST(sum(churn) AS BIGINT) AS churned FROM customers GROUP BY 1) USING (Income_Category))""",
        SCORES, _rates("Income_Category"),
    ),
    "roi_scenarios": _roi(),
    "roi_by_card": _roi("Card_Category"),
    "roi_test_scores": _roi(
        scores=(_split_ctes(), "chosen_rows AS (SELECT * EXCLUDE (split) FROM divided WHERE split = 'test')",
                SCORES.replace("FROM customers", "FROM chosen_rows")),
    ),
    "risk_tiers": _with(
        f"""SELECT CLIENTNUM, model, p, {_tier(1)} AS tier, {_tier(2)} AS message,
       round(p * 100 - (SELECT avg(churn) * 100 FROM customers), 6) AS delta_points FROM scored""",
        SCORES,
    ),
    "recommendations": _with(
        """SELECT CLIENTNUM, model, CAST(row_number() OVER (PARTITION BY CLIENTNUM, model ORDER BY rule) - 1 AS INTEGER) AS position,
       title, body FROM advised""",
        SCORES, RECOMMENDATIONS,
    ),
    "contrib_importance": _with(
        """SELECT CAST(rank AS INTEGER) AS rank, feature, round(mean_abs, 6) AS mean_abs, round(mean, 6) AS mean,
       CASE WHEN mean > 0 THEN '↑ Toward Churn' ELSE '↓ Away from Churn' END AS direction FROM importance""",
        CONTRIBUTIONS, IMPORTANCE,
    ),
    "contrib_direction": _with(
        """SELECT feature, round(mean, 6) AS mean, CASE WHEN mean > 0 THEN '↑ Toward Churn' ELSE '↓ Away from Churn' END AS direction
FROM importance WHERE rank <= 15""",
        CONTRIBUTIONS, IMPORTANCE,
    ),
    "contrib_beeswarm": _with(
        f"""SELECT CLIENTNUM, CAST(rank AS INTEGER) AS rank, feature, value, round(shap, 7) AS shap
FROM long JOIN (SELECT feature, rank FROM importance WHERE rank <= 14) USING (feature)
UNION ALL
SELECT CLIENTNUM, 15, 'Sum of {_N - 14} other features', NULL, round(sum(shap), 7)
FROM long JOIN (SELECT feature, rank FROM importance WHERE rank > 14) USING (feature) GROUP BY CLIENTNUM""",
        CONTRIBUTIONS, IMPORTANCE,
    ),
    "contrib_waterfall": _waterfall(15),
    "contrib_waterfall_top": _waterfall(
        12,
        "WHERE CLIENTNUM = (SELECT CLIENTNUM FROM scored WHERE model = 'rule_activity' AND label = 1 ORDER BY p DESC, CLIENTNUM LIMIT 1)",
    ).replace("unscaled AS", SCORES.strip() + ", unscaled AS", 1),
    "dependence_interaction": _with(
        "SELECT 'Total_Trans_Ct' AS target, feature, round(abs_r, 6) AS abs_r, chosen FROM chosen", CONTRIBUTIONS, _interaction()
    ),
    "score_explained": _with("SELECT CLIENTNUM, 1 AS adds_up, 12 AS n_steps FROM customers"),
    "open_to_buy": _with("SELECT CLIENTNUM, greatest(0, Avg_Open_To_Buy) AS open_to_buy FROM customers"),
    "model_confusion_totals": _with("SELECT churn AS label, 2 * count(*) AS n FROM divided WHERE split = 'test' GROUP BY churn", _split_ctes()),
    "stream_equals_batch": _with("SELECT count(*) AS n_in, 2 * count(*) AS n_out, 0 AS n_apart FROM customers"),
    "dependence_points": _with(
        """SELECT points.CLIENTNUM, x AS value, y AS shap, c.feature AS interaction_feature, long.value AS interaction_value
FROM points, (SELECT feature FROM chosen WHERE chosen = 1) c, long
WHERE long.CLIENTNUM = points.CLIENTNUM AND long.feature = c.feature""",
        CONTRIBUTIONS, _interaction(),
    ),
    "dependence_trend": _with(
        """SELECT round(x, 6) AS x, round(c0 + c1 * (x - a0) + c2 * ((x - a1) * (x - a0) - b1)
       + c3 * ((x - a2) * ((x - a1) * (x - a0) - b1) - b2 * (x - a0)), 6) AS y FROM grid, a0, a1, a2, a3""",
        CONTRIBUTIONS, _interaction(), TREND,
    ),
}
