"""Feature engineering: one definition for training, batch and stream scoring."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from holdfast.functions import expressions as E
from holdfast.functions.fixed import ID, LABEL, LOGGED, NOMINAL, ORDINAL_CODES
from holdfast.sources.schema import numeric_columns

MAX_CATEGORIES = 100


Columns = dict[str, Column]
Step = Callable[[Columns], Columns]


def apply(df: DataFrame, *steps: Step) -> DataFrame:
    """Run steps over a table's columns, as one projection."""
    columns = {name: F.col(f"`{name}`") for name in df.columns}
    for step in steps:
        columns = step(columns)
    return df.select(*[column.alias(name) for name, column in columns.items()])


def _without(columns: Columns, names) -> Columns:
    return {name: column for name, column in columns.items() if name not in names}


def gender_code(columns: Columns) -> Columns:
    return {**columns, "Gender": E.indicator(columns["Gender"], "M")}


def ordinal_codes(columns: Columns) -> Columns:
    return {**columns, **{name: E.ordinal(columns[name], codes) for name, codes in ORDINAL_CODES.items()}}


def log_amounts(columns: Columns) -> Columns:
    """Replace the skewed amounts by <name>_log = log(1 + x); absent ones are skipped."""
    present = [name for name in LOGGED if name in columns]
    return {**_without(columns, present), **{f"{name}_log": F.log1p(columns[name]) for name in present}}


def engineered(columns: Columns) -> Columns:
    """Spend per transaction, inactivity risk and credit in use; log amounts where present."""
    def amount(name: str) -> Column:
        return columns[f"{name}_log" if f"{name}_log" in columns else name]

    return {
        **columns,
        "transaction_velocity": amount("Total_Trans_Amt") / (columns["Total_Trans_Ct"] + 1),
        "inactivity_risk": columns["Months_Inactive_12_mon"] * columns["Contacts_Count_12_mon"],
        "credit_usage_gap": amount("Credit_Limit") - amount("Avg_Open_To_Buy"),
    }


def nominal_flags(categories: dict[str, list[str]]) -> Step:
    """Replace each column by one 0/1 column per category, appended last."""
    def step(columns: Columns) -> Columns:
        flags = {f"{c}_{v}": E.indicator(columns[c], v) for c, values in categories.items() for v in values}
        return {**_without(columns, categories), **flags}

    return step


def drop_id(df: DataFrame) -> DataFrame:
    return df.drop(ID)


def encode_gender(df: DataFrame) -> DataFrame:
    return apply(df, gender_code)


def encode_ordinals(df: DataFrame) -> DataFrame:
    return apply(df, ordinal_codes)


def log_columns(df: DataFrame) -> DataFrame:
    return apply(df, log_amounts)


def engineer(df: DataFrame) -> DataFrame:
    return apply(df, engineered)


def encode_nominals(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    return apply(df, nominal_flags(categories))


def steps(categories: dict[str, list[str]]) -> list[Step]:
    """All steps before scaling, in their fixed order."""
    return [gender_code, ordinal_codes, log_amounts, engineered, nominal_flags(categories)]


def count_unknowns(encoded: DataFrame) -> DataFrame:
    """Rows with the unknown code, per ordinal column."""
    row = encoded.agg(*[F.count_if(F.col(name) == -1).alias(name) for name in ORDINAL_CODES])
    cells = [F.struct(F.lit(name).alias("feature"), F.col(name).alias("unknowns")) for name in ORDINAL_CODES]
    return row.select(F.inline(F.array(*cells)))


def fit_categories(df: DataFrame, columns: list[str] = NOMINAL) -> dict[str, list[str]]:
    """Sorted category values per column, without the first one of each.

    The distinct values come to the driver; more than MAX_CATEGORIES of them is
    an error, since each would become a column.
    """
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]
    limit = MAX_CATEGORIES * len(columns)
    found = df.select(F.inline(F.array(*cells))).filter("value is not null").distinct().limit(limit + 1).collect()
    values = {c: sorted(row["value"] for row in found if row["column"] == c) for c in columns}
    if len(found) > limit or any(len(v) > MAX_CATEGORIES for v in values.values()):
        raise ValueError(f"more than {MAX_CATEGORIES} categories in one of {columns}")
    return {c: v[1:] for c, v in values.items()}


def fit_scaling(df: DataFrame, names: list[str]) -> tuple[list[float], list[float]]:
    """Mean and population standard deviation per column, from one scan."""
    row = df.agg(
        F.array(*[F.avg(n) for n in names]).alias("means"), F.array(*[F.stddev_pop(n) for n in names]).alias("stds")
    ).first()
    return [m if m is not None else 0.0 for m in row["means"]], [s or 1.0 for s in row["stds"]]


def scaled(names: list[str], means: list[float], stds: list[float]) -> Step:
    """Replace the named columns by their standard scores."""
    def step(columns: Columns) -> Columns:
        return {**columns, **{n: (columns[n] - m) / s for n, m, s in zip(names, means, stds)}}

    return step


class _FeatureParams(Params):
    idCol = Param(Params._dummy(), "idCol", "key column, kept but not a feature", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column, not a feature", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column to add", TypeConverters.toString)
    fitOn = Param(Params._dummy(), "fitOn", "SQL condition of the rows to fit on", TypeConverters.toString)
    categories = Param(Params._dummy(), "categories", "fitted categories", TypeConverters.identity)
    names = Param(Params._dummy(), "names", "feature names in order", TypeConverters.toListString)
    means = Param(Params._dummy(), "means", "fitted means", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "fitted standard deviations", TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(idCol=ID, labelCol=LABEL, outputCol="features", fitOn="true")


class CustomerFeaturesModel(Model, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the scaled feature vector; the raw columns stay as they are."""

    @property
    def feature_names(self) -> list[str]:
        return self.getOrDefault("names")

    def _fitted(self) -> tuple[list[str], list[float], list[float]]:
        return tuple(self.getOrDefault(p) for p in ("names", "means", "stds"))

    def _steps(self) -> list[Step]:
        return [*steps(self.getOrDefault("categories")), scaled(*self._fitted())]

    def table(self, df: DataFrame, *keep: str) -> DataFrame:
        """Key, scaled features as named columns and, if present, the label; and columns to keep."""
        kept = [c for c in (self.getOrDefault("idCol"),) if c in df.columns]
        label = [c for c in (self.getOrDefault("labelCol"),) if c in df.columns]
        return apply(df, *self._steps()).select(*kept, *self.feature_names, *label, *keep)

    def with_missing(self, df: DataFrame, name: str = "missing") -> DataFrame:
        """Add the names of the features a row has no value for: missing values and unmapped categories."""
        def named(columns: Columns) -> Columns:
            made = columns
            for step in self._steps():
                made = step(made)
            gaps = F.array(*[F.when(made[n].isNull(), F.lit(n)) for n in self.feature_names])
            return {**columns, name: F.array_compact(gaps)}

        return apply(df, named)

    def _transform(self, df: DataFrame) -> DataFrame:
        def with_vector(columns: Columns) -> Columns:
            made = columns
            for step in self._steps():
                made = step(made)
            parts = [made[name] for name in self.feature_names]
            unknown = reduce(or_, [part.isNull() for part in parts])
            error = F.raise_error(F.lit("a feature is null: missing value or unmapped category"))
            vector = array_to_vector(F.array(*parts))
            return {**columns, self.getOrDefault("outputCol"): F.when(unknown, error).otherwise(vector)}

        return apply(df, with_vector)


class CustomerFeatures(Estimator, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns categories of all rows and scaling; fitOn limits the scaling to e.g. the training rows."""

    @keyword_only
    def __init__(self, *, idCol=ID, labelCol=LABEL, outputCol="features", fitOn="true"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> CustomerFeaturesModel:
        aside = (self.getOrDefault("idCol"), self.getOrDefault("labelCol"), "split", "fold")
        categories = fit_categories(df)
        wide = apply(df.filter(self.getOrDefault("fitOn")), *steps(categories))
        names = numeric_columns(wide, exclude=aside)
        means, stds = fit_scaling(wide, names)
        model = CustomerFeaturesModel()
        model._set(
            categories=categories, names=names, means=means, stds=stds,
            **{p: self.getOrDefault(p) for p in ("idCol", "labelCol", "outputCol", "fitOn")},
        )
        return model
