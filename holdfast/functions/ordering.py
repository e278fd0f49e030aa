"""Exact order statistics without a window over the whole table.

Spark computes an un-partitioned window in one task. The helpers here cut the
order into buckets first, so each window sees one bucket, and add what the
earlier buckets hold.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

HASH_DIGITS = 3  # 4,096 hash buckets
MAX_BUCKETS = 4_096
MAX_STRATA = 100


def bucket_count(df: DataFrame) -> int:
    """A few buckets per shuffle partition, so that hash placement stays even."""
    return min(MAX_BUCKETS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def split_points(df: DataFrame, column: str, buckets: int | None = None, rounds: int = 10) -> list[float]:
    """Borders that cut a column into about equally filled buckets.

    Like the borders of a range partitioner they decide only the balance of the
    work. Rows are counted on an even grid; cells that hold more than a bucket
    should are counted again on a finer one, some rounds at most. Counts are
    merged on the map side; the driver receives some counts per bucket.
    """
    buckets = buckets or bucket_count(df)
    value = F.col(column).cast("double")
    finite = df.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).select(value.alias("v"))
    low, high, total = finite.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not total or low == high:
        return []
    share, cells = total / buckets, [(low, high, total)]
    for _ in range(rounds):
        heavy = [c for c in cells if c[2] > share and c[0] < (c[0] + c[1]) / 2 < c[1]]
        if not heavy:
            break
        # There are no more heavy cells than buckets, so their parts are a few per bucket, 16 at most in the end.
        parts = [max(16, min(4 * buckets, int(4 * n / share))) for _, _, n in heavy]
        if len(heavy) > 1:
            edges = sorted({x for a, b, _ in heavy for x in (a, b)})
            placed = Bucketizer(splits=[-float("inf"), *edges, float("inf")], inputCol="v", outputCol="at").transform(finite)
            at = {1 + edges.index(a): k for k, (a, _, _) in enumerate(heavy)}
            number = F.create_map(*(F.lit(x) for pair in at.items() for x in pair))[F.col("at").cast("int")]
        else:
            placed, number = finite, F.lit(0)
        table = F.array(*(F.struct(F.lit(a).alias("a"), F.lit((b - a) / p).alias("w"), F.lit(p).alias("p"), F.lit(b).alias("b")) for (a, b, _), p in zip(heavy, parts)))
        own = placed.withColumn("k", number).where("k is not null").withColumn("cell", table[F.col("k")])
        step = F.least(F.floor((F.col("v") - F.col("cell.a")) / F.col("cell.w")), F.col("cell.p") - 1)
        inside = (F.col("v") >= F.col("cell.a")) & ((F.col("v") < F.col("cell.b")) | (F.col("cell.b") == high))
        counts = own.where(inside).groupBy("k", step.alias("i")).agg(F.count("*").alias("n")).collect()
        cells = [c for c in cells if c not in heavy]
        for r in counts:
            a, b, _ = heavy[r["k"]]
            width = (b - a) / parts[r["k"]]
            cells.append((a + r["i"] * width, a + (r["i"] + 1) * width, r["n"]))
    borders, held = [], 0
    for a, _, n in sorted(cells):
        if held >= (len(borders) + 1) * share and held < total:
            borders.append(a)
        held += n
    return borders


def _with_bucket(df: DataFrame, value: str, borders: list[float]) -> DataFrame:
    if not borders:
        return df.withColumn("bucket", F.lit(0))
    splits = [-float("inf"), *borders, float("inf")]
    cut = Bucketizer(splits=splits, inputCol=value, outputCol="bucket", handleInvalid="error")
    return cut.transform(df).withColumn("bucket", F.col("bucket").cast("int"))


def running_totals(
    df: DataFrame,
    keys: list[str],
    value: str,
    measures: dict[str, Column],
    running: list[str],
    borders: list[float],
    descending: bool = False,
) -> DataFrame:
    """One row per (keys, value) with the measures; running ones get cum_<m> and total_<m>.

    measures are additive aggregates (counts, sums). Rows sharing a value are
    merged on the map side, so a hot value is one row when the order matters.
    What earlier buckets hold comes from a second, tiny grouping of the rows by
    bucket. Any borders give the same result.
    """
    along = (lambda name: F.col(name).desc()) if descending else F.col
    sums = [column.alias(name) for name, column in measures.items()]
    group = [*keys, "bucket"]
    earlier = Window.partitionBy(*keys).orderBy(along("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*keys)
    offsets = (
        _with_bucket(df, value, borders)
        .groupBy(*group)
        .agg(*[column for column, name in zip(sums, measures) if name in running])
        .select(
            *group,
            *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"before_{m}") for m in running],
            *[F.sum(m).over(everything).alias(f"total_{m}") for m in running],
        )
    )
    within = Window.partitionBy(*group).orderBy(along(value)).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _with_bucket(df.groupBy(*keys, value).agg(*sums), value, borders)
        .withColumns({f"cum_{m}": F.sum(m).over(within) for m in running})
        .join(offsets, group)
        .withColumns({f"cum_{m}": F.col(f"cum_{m}") + F.col(f"before_{m}") for m in running})
        .drop("bucket", *[f"before_{m}" for m in running])
    )


def with_following(df: DataFrame, keys: list[str], value: str, measures: list[str], borders: list[float], descending: bool = False) -> DataFrame:
    """Add next_<m>: the measures of the row with the next value of its key; null at the last. Values are distinct.

    Each window sees one bucket; the first row of the buckets that follow comes from a grouping of a row per bucket.
    Any borders give the same result.
    """
    along = (lambda name: F.col(name).desc()) if descending else F.col
    first = F.max_by if descending else F.min_by
    placed = _with_bucket(df, value, borders)
    row = F.struct(*measures)
    within = Window.partitionBy(*keys, "bucket").orderBy(along(value))
    later = Window.partitionBy(*keys).orderBy(along("bucket"))
    heads = placed.groupBy(*keys, "bucket").agg(first(row, value).alias("head"))
    heads = heads.select(*keys, "bucket", F.lead("head").over(later).alias("beyond"))
    following = F.coalesce(F.lead(row).over(within), F.col("beyond"))
    out = placed.join(heads, [*keys, "bucket"]).withColumn("following", following)
    return out.withColumns({f"next_{m}": F.col("following").getField(m) for m in measures}).drop("bucket", "beyond", "following")


def hash_key(id_column: str, seed: int) -> Column:
    """Pseudo-random order that depends on the id and the seed alone."""
    return F.md5(F.concat_ws(":", F.col(id_column).cast("string"), F.lit(str(seed))))


def hash_cuts(
    df: DataFrame, id_column: str, stratum: str, seed: int, wanted: Callable[[dict], dict]
) -> dict[object, list[tuple]]:
    """Keys (hash, id) standing at wanted ranks of the hash order of each stratum.

    wanted maps {stratum: rows} to {stratum: ranks}, ranks counted from 1. All
    rows are only counted per hash bucket; a bucket is sorted only if it holds a
    wanted rank. Copies of an id are counted together and share one key, so a
    hot id does not fill a sort. The driver sees bucket counts and one key per
    rank.
    """
    hashed = df.select(
        F.col(stratum).alias("s"), hash_key(id_column, seed).alias("hash"), F.col(id_column).alias("id")
    ).withColumn("bucket", F.substring("hash", 1, HASH_DIGITS))
    counts = hashed.groupBy("s", "bucket").agg(F.count(F.lit(1)).alias("n"))
    found = counts.orderBy("s", "bucket").limit(MAX_STRATA * 16**HASH_DIGITS + 1).collect()
    if len({row["s"] for row in found}) > MAX_STRATA:
        raise ValueError(f"{stratum} has more than {MAX_STRATA} strata")
    sizes: dict = {}
    for row in found:
        sizes[row["s"]] = sizes.get(row["s"], 0) + row["n"]
    ranks = wanted(sizes)
    before: dict = dict.fromkeys(sizes, 0)
    spots: dict[tuple, list[int]] = {}
    for row in found:
        low, high = before[row["s"]], before[row["s"]] + row["n"]
        inside = [r - low for r in ranks[row["s"]] if low < r <= high]
        if inside:
            spots[row["s"], row["bucket"]] = inside
        before[row["s"]] = high
    if not spots:
        return {s: [] for s in sizes}

    def here(s, bucket):
        return F.col("s").eqNullSafe(F.lit(s)) & (F.col("bucket") == bucket)

    upto = Window.partitionBy("s", "bucket").orderBy("hash", "id").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        hashed.filter(reduce(or_, [here(*spot) for spot in spots]))
        .groupBy("s", "bucket", "hash", "id")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("last", F.sum("copies").over(upto))
    )
    first = F.col("last") - F.col("copies")
    hit = reduce(
        or_,
        [here(*spot) & ((first < r) & (F.col("last") >= r)) for spot, inside in spots.items() for r in inside],
    )
    cuts: dict = {s: [] for s in sizes}
    for row in placed.filter(hit).select("s", "hash", "id").collect():
        cuts[row["s"]].append((row["hash"], row["id"]))
    return {s: sorted(keys) for s, keys in cuts.items()}


def with_cuts_passed(
    df: DataFrame, name: str, id_column: str, stratum: str, seed: int, cuts: dict[object, list[tuple]]
) -> DataFrame:
    """Add how many cuts of its stratum a row lies beyond; a plain projection."""
    key = F.col("__hash")

    def beyond(cut) -> Column:
        return ((key > cut[0]) | ((key == cut[0]) & (F.col(id_column) > F.lit(cut[1])))).cast("int")

    passed = F.lit(None).cast("int")
    for s, keys in cuts.items():
        passed = F.when(
            F.col(stratum).eqNullSafe(F.lit(s)), sum((beyond(cut) for cut in keys), F.lit(0))
        ).otherwise(passed)
    return df.withColumn("__hash", hash_key(id_column, seed)).withColumn(name, passed).drop("__hash")
