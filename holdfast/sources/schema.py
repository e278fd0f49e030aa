"""Declared schemas; nothing is inferred from the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

from holdfast.functions.fixed import ID, LABEL, LEAK_COLUMNS, RAW_TARGET

_ATTRIBUTES = [
    (ID, T.LongType()),
    (RAW_TARGET, T.StringType()),
    ("Customer_Age", T.IntegerType()),
    ("Gender", T.StringType()),
    ("Dependent_count", T.IntegerType()),
    ("Education_Level", T.StringType()),
    ("Marital_Status", T.StringType()),
    ("Income_Category", T.StringType()),
    ("Card_Category", T.StringType()),
    ("Months_on_book", T.IntegerType()),
    ("Total_Relationship_Count", T.IntegerType()),
    ("Months_Inactive_12_mon", T.IntegerType()),
    ("Contacts_Count_12_mon", T.IntegerType()),
    ("Credit_Limit", T.DoubleType()),
    ("Total_Revolving_Bal", T.IntegerType()),
    ("Avg_Open_To_Buy", T.DoubleType()),
    ("Total_Amt_Chng_Q4_Q1", T.DoubleType()),
    ("Total_Trans_Amt", T.DoubleType()),
    ("Total_Trans_Ct", T.IntegerType()),
    ("Total_Ct_Chng_Q4_Q1", T.DoubleType()),
    ("Avg_Utilization_Ratio", T.DoubleType()),
]

RAW = T.StructType(
    [T.StructField(name, kind) for name, kind in _ATTRIBUTES]
    + [T.StructField(name, T.DoubleType()) for name in LEAK_COLUMNS]
)
CUSTOMERS = T.StructType(
    [T.StructField(name, kind) for name, kind in _ATTRIBUTES if name != RAW_TARGET]
    + [T.StructField(LABEL, T.IntegerType())]
)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def missing_columns(df: DataFrame, expected: list[str]) -> list[str]:
    """Expected columns the table lacks, in the expected order."""
    return [name for name in expected if name not in set(df.columns)]
