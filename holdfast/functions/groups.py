"""Joining rows to a table with one row per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SENT = 10_000  # groups that are broadcast


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, sent: int = SENT) -> DataFrame:
    """Rows with the columns of their group; rows without a group are left out.

    groups is a stored table, unique by key; `size` holds each group's number of rows. Up to `sent` groups are
    broadcast. Of more, those with a large share of all rows are, of which there are `sent` at most, and the rows of
    the others are joined by a shuffle in which no group stands out.
    """
    count, total = groups.agg(F.count("*"), F.sum(size)).first()
    if count <= sent:
        return rows.join(F.broadcast(groups), key)
    heavy = F.col(size) * sent >= total
    large = groups.filter(heavy)
    few = rows.join(F.broadcast(large), key)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti")
    return few.unionByName(rest.join(groups.filter(~heavy).hint("merge"), key))
