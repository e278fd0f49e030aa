"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from holdfast.sources.tables import drop_table, settle


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One contraction. links: (a, b) with a > b.

    Large: every node ties its larger neighbours to the smallest of itself and its neighbours. Small:
    every node ties itself and its smaller neighbours to the smallest of them. Neighbours are never gathered.
    """
    if large:
        sides = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        sides = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = sides.join(least.hint("shuffle_hash"), "u")  # both are dealt by u: nothing passes through the driver
    if large:
        found = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        found = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return found.where(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in links (a, b); component is the smallest id that can be reached.

    Contracts stars until nothing changes, a logarithmic number of rounds as a rule. Each round is stored, and the one before deleted.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") > F.col("b")).distinct()
    links, before = settle(links, "links"), None
    while True:
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        old, links = links, settle(_star(_star(links, large=True), large=False), "links")
        drop_table(old)
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(roots)
