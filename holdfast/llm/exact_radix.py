"""Exact duplicates by distributed MSD radix partitioning.

A text is read as its byte length followed by its bytes. Each round splits every group that is still
together by its next bytes, the digit; a group of one row is done, and so is a group whose texts have
ended, for their rows are equal byte by byte. No digest decides anything. Digits grow from round to
round, so a text of any length is through after a few rounds, and only rows that still share a group
with others carry on the rest of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from holdfast.sources.tables import drop_table, settle

FIRST_DIGIT, GROWTH = 64, 8  # bytes of the first digit; each further one is GROWTH times as long
SENT_BYTES = 32 * 1024 * 1024  # groups that are broadcast
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Text with A-Z in lower case and nothing else changed; null counts as empty."""
    return F.coalesce(F.translate(text, UPPER, LOWER), F.lit(""))


def _placed(rows: DataFrame, groups: DataFrame, count: int, width: int, total: int) -> DataFrame:
    """Rows with their group, if it has several rows.

    All groups are sent to the rows if they are small enough. Else those with a large share of the
    rows are sent, of which there cannot be many, and the others are joined by a shuffle.
    """
    key, room = ["group", "left", "digit"], max(1, SENT_BYTES // (width + 64))
    if count <= room:
        return rows.join(F.broadcast(groups), key, "left")
    heavy = F.col("n") * room >= total  # at most `room` groups can have that many rows
    first = rows.join(F.broadcast(groups.where(heavy)), key, "left")
    rest = first.where("n is null").drop("n", "keep", "next").join(groups.where(~heavy), key, "left")
    return first.where("n is not null").unionByName(rest)


def exact_duplicates(df: DataFrame, text: Column, id_column: str = "doc_id", also: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of df: the id, keep_id, group_size, kept, and the columns of `also`.

    Rows are equal if `text` (null: empty) has the same bytes. keep_id is the largest id among equal
    rows, group_size their number, kept tells whether the row has that id. Rows with a null id take
    part: they are kept only where no equal row has an id. Rows that repeat both id and text count
    each, and share their result. Other columns of df are not looked at; `also` names what to hand on.
    """
    also = also or {}
    data = F.coalesce(text, F.lit("")).cast("binary")
    rows = df.select(
        F.col(f"`{id_column}`").alias("id"), F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in also.items()]).alias("also"), data.alias("rest")
    ).select("id", "also", "rest", F.octet_length("rest").alias("left"), F.lit(0).cast("bigint").alias("group"))
    width, done = FIRST_DIGIT, []
    while True:
        now = rows.withColumn("digit", F.substring("rest", 1, width))
        met = now.groupBy("group", "left", "digit").agg(F.count("*").alias("n"), F.max("id").alias("keep"))
        groups = settle(met.where("n > 1").withColumn("next", F.monotonically_increasing_id()), "radix-groups")
        count, total = groups.agg(F.count("*"), F.sum("n")).first()
        placed = _placed(now, groups, count, width, total or 0)
        apart = F.col("n").isNull() | (F.col("left") <= width)
        stored = settle(
            placed.select(
                "id", "also", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
                F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"), apart.alias("done"),
                F.when(~apart, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
                (F.col("left") - width).alias("left"), F.col("next").alias("group"),
            ),
            "radix-rows",
        )
        drop_table(groups)
        done.append(stored.where("done"))
        rows = stored.where("not done").select("id", "also", "rest", "left", "group")
        if rows.isEmpty():
            break
        width *= GROWTH
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        F.col("id").alias(id_column), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        *[F.col("also").getField(n).alias(n) for n in also],
    )
