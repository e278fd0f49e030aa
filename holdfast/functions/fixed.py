"""Fixed values of the customer-retention data contract."""

# Key, label and target spelling of the raw table.
ID = "CLIENTNUM"
LABEL = "churn"
RAW_TARGET = "Attrition_Flag"
CHURNED_VALUE = "Attrited Customer"
LEAK_MARKER = "Naive_Bayes"
LEAK_COLUMNS = [
    "Naive_Bayes_Classifier_Attrition_Flag_Card_Category_Contacts_Count_12_mon"
    "_Dependent_count_Education_Level_Months_Inactive_12_mon_1",
    "Naive_Bayes_Classifier_Attrition_Flag_Card_Category_Contacts_Count_12_mon"
    "_Dependent_count_Education_Level_Months_Inactive_12_mon_2",
]

# Codes of the ordered categories; -1 is an unknown.
EDUCATION_CODES = {
    "Uneducated": 0, "High School": 1, "College": 2, "Graduate": 3,
    "Post-Graduate": 4, "Doctorate": 5, "Unknown": -1,
}
INCOME_CODES = {
    "Less than $40K": 0, "$40K - $60K": 1, "$60K - $80K": 2,
    "$80K - $120K": 3, "$120K +": 4, "Unknown": -1,
}
ORDINAL_CODES = {"Education_Level": EDUCATION_CODES, "Income_Category": INCOME_CODES}

# Columns by treatment.
NOMINAL = ["Marital_Status", "Card_Category"]
LOGGED = ["Credit_Limit", "Avg_Open_To_Buy", "Total_Trans_Amt"]
SEGMENTS = ["Income_Category", "Education_Level", "Card_Category", "Marital_Status"]
DISTRIBUTIONS = [
    "Customer_Age", "Months_on_book", "Credit_Limit", "Total_Trans_Amt",
    "Total_Trans_Ct", "Avg_Utilization_Ratio", "Total_Revolving_Bal",
    "Total_Relationship_Count",
]

# Model input columns in contract order.
FEATURES = [
    "Customer_Age", "Gender", "Dependent_count", "Education_Level",
    "Income_Category", "Months_on_book", "Total_Relationship_Count",
    "Months_Inactive_12_mon", "Contacts_Count_12_mon", "Total_Revolving_Bal",
    "Total_Amt_Chng_Q4_Q1", "Total_Trans_Ct", "Total_Ct_Chng_Q4_Q1",
    "Avg_Utilization_Ratio", "Credit_Limit_log", "Avg_Open_To_Buy_log",
    "Total_Trans_Amt_log", "transaction_velocity", "inactivity_risk",
    "credit_usage_gap", "Marital_Status_Married", "Marital_Status_Single",
    "Marital_Status_Unknown", "Card_Category_Gold", "Card_Category_Platinum",
    "Card_Category_Silver",
]

# Age bands, open on the left and closed on the right.
AGE_EDGES = [25, 35, 45, 55, 65, 75]
AGE_LABELS = ["26-35", "36-45", "46-55", "56-65", "66-75"]

# Split, folds and learners.
SEED = 42
TEST_SHARE = 0.2
FOLDS = 5
LOGISTIC = {"C": 1.0, "max_iter": 1000}
TREES = {"trees": 500, "depth": 6, "step": 0.05, "row_share": 0.8, "column_share": 0.8}

# Risk tiers (lowest probability, name, message).
TIERS = [
    (0.60, "HIGH RISK", "Immediate intervention recommended."),
    (0.30, "MEDIUM RISK", "Monitor closely and consider proactive outreach."),
    (0.0, "LOW RISK", "Customer appears engaged. Continue standard service."),
]

# Money and intervention assumptions.
ACQUISITION_COST = 300
PORTFOLIO_SUCCESS = 0.20
SCENARIO_SIZES = [1_000, 10_000, 100_000, 500_000]
SCENARIO_COSTS = [50, 300, 1_000]
SCENARIO_SUCCESS = [10, 30, 60]

METRICS = ["roc_auc", "pr_auc", "f1", "precision", "recall", "accuracy"]
CV_METRICS = ["roc_auc", "f1", "precision", "recall"]
