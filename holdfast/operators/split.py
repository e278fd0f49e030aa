"""Stratified train/test split and folds that depend on id and seed alone."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from holdfast.functions import expressions as E
from holdfast.functions.fixed import FEATURES, FOLDS, ID, LABEL, SEED, TEST_SHARE
from holdfast.functions.ordering import hash_cuts, with_cuts_passed
from holdfast.operators.quality import met_again


def test_quota(sizes: dict, share: float) -> dict:
    """Test rows per stratum: ceil(share * n) spread by largest remainder."""
    total = sum(sizes.values())
    target = math.ceil(total * share)
    exact = {s: n * target / total for s, n in sizes.items()}
    quota = {s: math.floor(v) for s, v in exact.items()}
    by_remainder = sorted(sizes, key=lambda s: (quota[s] - exact[s], str(s)))
    for s in by_remainder[: target - sum(quota.values())]:
        quota[s] += 1
    return quota


def with_split(
    df: DataFrame, share: float = TEST_SHARE, key: str = ID, label: str = LABEL, seed: int = SEED
) -> DataFrame:
    """Add split = test | train.

    The border of each stratum is found from hash-bucket counts; marking the
    rows is then a projection without shuffle. Rows sharing an id stay together.
    """
    def last_test_rank(sizes: dict) -> dict:
        return {s: [q] if q else [] for s, q in test_quota(sizes, share).items()}

    cuts = hash_cuts(df, key, label, seed, last_test_rank)
    is_test = F.col("split") == 0
    for s in (s for s, keys in cuts.items() if not keys):
        is_test = is_test & ~F.col(label).eqNullSafe(F.lit(s))
    marked = with_cuts_passed(df, "split", key, label, seed, cuts)
    return marked.withColumn("split", F.when(is_test, "test").otherwise("train"))


def with_folds(
    df: DataFrame, folds: int = FOLDS, key: str = ID, label: str = LABEL, seed: int = SEED + 1
) -> DataFrame:
    """Add fold = 0 .. folds-1; fold sizes within a stratum differ by one row at most."""
    def last_ranks(sizes: dict) -> dict:
        ranks = {}
        for s, n in sizes.items():
            ends = [n // folds * (f + 1) + min(f + 1, n % folds) for f in range(folds - 1)]
            ranks[s] = [e for e in ends if 0 < e < n]
        return ranks

    return with_cuts_passed(df, "fold", key, label, seed, hash_cuts(df, key, label, seed, last_ranks))


def split_balance(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows, share and churn rate of each side of the split."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("churned"), (F.avg(label) * 100).alias("rate")
    ).withColumn("share", F.col("n") / total)


def leaked_rows(train: DataFrame, test: DataFrame, columns: list[str] = FEATURES, digits: int = 6) -> DataFrame:
    """Number of distinct feature rows, at the given digits, found on both sides; 0 for a clean split.

    Digests that occur on both sides are found first, copies merged on the map side. The values of their rows are
    then compared, so that rows which only share a digest do not count.
    """
    values = E.rounded_values(columns, digits)
    sides = train.select(*values, F.lit(0).alias("__test")).unionByName(test.select(*values, F.lit(1).alias("__test")))
    names = [F.col(f"`{c}`") for c in columns]
    both = F.min("__test") < F.max("__test")
    rows = met_again(sides, names, among=both).groupBy("__digest", *names).agg(both.alias("shared"))
    return rows.agg(F.count_if("shared").alias("n_shared"))
