"""Exact top-k by inner product with lists that are only read in order.

Candidates are dealt into blocks. In a block each dimension is a list sorted by component; for a query it is
read from the end with the largest contributions. The lists whose unread parts may still matter most are read
on. What has been read of a candidate, and the lengths of the unread parts of it and of the query, bound its
score from both sides. Reading stops when few candidates can still be among the best; only their scores are resolved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from holdfast.llm.vectors import best, by_size, is_query, matrix, usable
from holdfast.sources.tables import settle

FOUND = "query_id bigint, vec_id bigint, score bigint, place string"
RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"
WHOLE = 2.0**52  # from here on a double is a whole number


def whole(x: np.ndarray) -> list[int]:
    """floor(256 * x) of doubles of any size, exactly."""
    return [int(v) * 256 if abs(v) >= WHOLE else math.floor(256 * v) for v in x.tolist()]


def place(score: int) -> str:
    """Text that sorts like whole numbers of any size."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99_999 - len(digits):05d}" + "".join(chr(105 - ord(c)) for c in digits)


class Lists:
    """The sorted lists of a block: row numbers and components, ascending by component.

    Components are held as floor(256 * x) in double precision, divided by a power of two if they are so large that
    products could leave its range; `exact` are the vectors themselves. `wrong` bounds the error of a
    computed score for a query of length 1, besides 0.5.
    """

    def __init__(self, rows: np.ndarray):
        self.exact = rows = np.asarray(rows, np.float64)
        top = float(np.abs(rows).max(initial=0))
        self.shift = max(0, math.frexp(top)[1] - 400)
        scaled = np.ldexp(rows, -self.shift)
        self.rows = rows = np.floor(256 * rows) if not self.shift else 256 * scaled
        order = np.argsort(rows, axis=0, kind="stable").T
        self.order = np.ascontiguousarray(order)
        self.values = np.ascontiguousarray(np.take_along_axis(rows.T, order, axis=1))
        self.columns = np.ascontiguousarray(rows.T)
        self.norms = (self.columns**2).sum(0)
        self.wrong = float(np.sqrt(self.norms.max(initial=0))) * rows.shape[1] * 2.0**-46
        self.top = top

    def scores(self, chosen: np.ndarray, query: np.ndarray) -> list[int]:
        """Exact scores of some rows."""
        if 2.0**16 * (self.top + 1) * (float(np.abs(query).max(initial=0)) + 1) * len(query) < 2.0**62:  # a long holds all sums
            return (np.floor(256 * self.exact[chosen]).astype(np.int64) @ np.floor(256 * query).astype(np.int64)).tolist()
        q = whole(query)
        return [sum(a * b for a, b in zip(whole(row), q)) for row in self.exact[chosen]]


def search(lists: Lists, query: np.ndarray, k: int, own: np.ndarray, least: float = -np.inf, steps: int = 8, width: int = 12, few: int = 96, share: float = 0.1) -> tuple[np.ndarray, int]:
    """Rows that may be among the k best (all of them, and some more), and the number of entries read.

    query: the vector itself. own: rows that are no candidates. least: a score, as a double, that k candidates anywhere
    reach; rows that cannot are left out. The lists that matter most are read to their ends, until the others
    hold only `share` of the query's squared length; then parts of lists, a list in `steps`, `width` at a time.
    """
    n, size = lists.rows.shape
    if (~own).sum() <= k:
        return np.flatnonzero(~own), 0
    query = np.asarray(query, np.float64)
    shift = max(0, math.frexp(float(np.abs(query).max(initial=0)))[1] - 400)
    q = np.floor(256 * query) if not shift else 256 * np.ldexp(query, -shift)
    wrong = 0.5 + lists.wrong * float(np.sqrt((q**2).sum()))
    least = math.ldexp(least, -shift - lists.shift) - 2 * wrong - abs(math.ldexp(least, -shift - lists.shift)) * 2.0**-40 if math.isfinite(least) else -np.inf
    part = -(-n // steps)
    ahead = np.where(q > 0, q * lists.values[:, -1], q * lists.values[:, 0])  # largest contribution left in each list
    floor = np.where(q > 0, q * lists.values[:, 0], q * lists.values[:, -1])  # smallest one
    order = np.argsort(-np.abs(q), kind="stable")
    rest = (q**2).sum() - np.cumsum(q[order] ** 2)
    lead = order[: int(np.searchsorted(-rest, -share * (q**2).sum())) + 1]
    # All entries of a list are those of a column: they can be added without looking up their rows.
    total = lists.columns[lead].T @ q[lead]
    unread_x = lists.norms - np.einsum("dn,dn->n", lists.columns[lead], lists.columns[lead])
    unread_q = np.full(n, (q**2).sum() - (q[lead] ** 2).sum())
    read = np.zeros(size, np.int64)  # entries read of each list
    read[lead], ahead[lead], floor[lead] = n, 0, 0
    entries = n * len(lead)
    slack = 1 + 2.0**-40  # sums of squares are rounded too
    while True:
        # Cauchy-Schwarz for what is unread; `wrong` is beyond any rounding of the sums.
        apart = np.sqrt((np.maximum(unread_q, 0) + (q**2).sum() * 2.0**-45) * (np.maximum(unread_x, 0) + lists.norms * 2.0**-45)) * slack + wrong
        upper = total + np.minimum(apart, np.maximum(ahead, 0).sum() * slack + wrong)
        lower = total + np.maximum(-apart, np.minimum(floor, 0).sum() * slack - wrong)
        lower[own] = upper[own] = -np.inf
        left = upper >= max(least, np.partition(lower, n - k)[n - k])
        left &= ~own
        span = np.where(read < n, ahead - floor, 0.0)
        chosen = np.argsort(-span, kind="stable")[:width]
        chosen = chosen[span[chosen] > 0]
        if left.sum() <= max(few, 2 * k) or not len(chosen):
            return np.flatnonzero(left), entries
        rows, gain, q2, x2 = [], [], [], []
        for d in chosen.tolist():
            a, b = int(read[d]), min(n, int(read[d]) + part)
            at = slice(n - b, n - a) if q[d] > 0 else slice(a, b)
            rows.append(lists.order[d, at])
            gain.append(lists.values[d, at] * q[d])
            q2.append(np.full(b - a, q[d] ** 2))
            x2.append(lists.values[d, at] ** 2)
            read[d] = b
            nearest = n - b if q[d] > 0 else b - 1  # nothing unread contributes more than the last entry read
            ahead[d] = q[d] * lists.values[d, nearest] if b < n else 0.0
            floor[d] = floor[d] if b < n else 0.0
        where = np.concatenate(rows)
        entries += len(where)
        total += np.bincount(where, np.concatenate(gain), n)
        unread_q -= np.bincount(where, np.concatenate(q2), n)
        unread_x -= np.bincount(where, np.concatenate(x2), n)


def _blocks(rows: DataFrame, count: int, number: str, extra: list[str]) -> DataFrame:
    """Rows packed into `count` blocks, a row each."""
    grouped = rows.withColumn(number, F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")).groupBy(number)
    return grouped.agg(F.collect_list(F.struct("vec_id", "vec", *extra)).alias("_rows")).select(
        number, F.col("_rows.vec_id").alias("ids"), F.flatten("_rows.vec").alias("vecs"), *[F.col(f"_rows.{c}").alias(c) for c in extra]
    )


def _searched(blocks: DataFrame, queries: DataFrame, size: int, k: int, tasks: int) -> DataFrame:
    """The k best of each query in each block it is sent to.

    blocks: (c, s, ids, vecs), queries: (c, s, ids, vecs, least). A task takes the blocks (c, s) in turn, each ahead of the
    queries that meet it, and builds its lists once.
    """
    nothing = F.lit(None).cast("array<double>")
    both = blocks.select("c", "s", F.lit(0).alias("kind"), "ids", "vecs", nothing.alias("least")).unionAll(
        queries.select("c", "s", F.lit(1), "ids", "vecs", "least")
    )
    dealt = both.repartition(tasks, "c", "s").sortWithinPartitions("c", "s", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = ids = None
        for batch in batches:
            for at, kind in enumerate(batch["kind"].to_pylist()):
                vecs = batch["vecs"][at].values.to_numpy().reshape(-1, size)
                if kind == 0:
                    lists, ids = Lists(vecs), batch["ids"][at].values.to_numpy()
                    continue
                out: list[tuple] = []
                for query_id, query, least in zip(batch["ids"][at].values.to_numpy().tolist(), vecs, batch["least"][at].values.to_numpy()):
                    rows, _ = search(lists, query, k, ids == query_id, least)
                    scored = sorted(zip((-s for s in lists.scores(rows, query)), ids[rows].tolist()))[:k]
                    out += [(query_id, vec_id, -s if abs(s) < 2**63 else None, place(-s)) for s, vec_id in scored]
                columns = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["query_id", "vec_id", "score", "place"]
                )

    return dealt.select("c", "s", "kind", "ids", "vecs", "least").mapInArrow(run, FOUND)


def nearest(rows: DataFrame, size: int, every: int, k: int, block: int, query_block: int, together: int = 32) -> DataFrame:
    """Search of the queries among stored vectors of one size.

    First every query is searched in one block. The k-th score found there is a bound that k candidates reach, so that
    the other blocks only resolve rows that may beat it. In these `together` blocks of queries share a block's lists.
    """
    count, asked = rows.count(), rows.where(is_query(every)).count()
    parts, query_parts = max(1, -(-count // block)), max(1, -(-asked // query_block))
    blocks = settle(_blocks(rows.select("vec_id", "vec"), parts, "c", []), "blocks")
    asking = rows.where(is_query(every)).select("vec_id", "vec")
    home = F.pmod(F.col("q"), F.lit(parts)).cast("int")
    first = _blocks(asking.withColumn("least", F.lit(-float("inf"))), query_parts, "q", ["least"]).select(home.alias("c"), F.lit(0).alias("s"), "ids", "vecs", "least")
    found = settle(_searched(blocks.withColumn("s", F.lit(0)), first, size, k, parts), "found")
    if parts == 1:
        return best(found, k, by="place")
    # The k-th best score of a query in its block; a query with fewer candidates there, or scores beyond a long, has no bound.
    reached = found.groupBy("query_id").agg(F.count("score").alias("n"), F.min("score").cast("double").alias("score"))
    least = F.when(F.col("n") == k, F.col("score")).otherwise(-float("inf"))
    bounded = asking.join(reached.select(F.col("query_id").alias("vec_id"), least.alias("least")), "vec_id", "left")
    again = _blocks(bounded.withColumn("least", F.coalesce("least", F.lit(-float("inf")))), query_parts, "q", ["least"])
    groups = -(-query_parts // together)
    others = again.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).where(F.col("c") != home)
    others = others.select("c", (F.col("q") % groups).alias("s"), "ids", "vecs", "least")
    copied = blocks.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return best(found.unionAll(_searched(copied, others, size, k, parts * groups)), k, by="place")


def top_k(df: DataFrame, vector: str = "embedding", every: int = 50, k: int = 5, block: int = 8192, query_block: int = 512) -> DataFrame:
    """The k largest inner products of each query with all rows but its own: query_id, rank, vec_id, score.

    Components become floor(256 * x), whatever their size; scores are compared exactly, and one that a long cannot hold
    is null, its rank being right. Queries are the rows whose vec_id is divisible by `every`. A query
    has fewer rows if there are fewer candidates. Vectors are compared with those of their size. Unusable
    vectors take no part, see `usable`; ties go to the smaller vec_id. Rows with the query's vec_id count as its own.
    """
    rows = settle(usable(df, vector), "vectors")
    return by_size(rows, lambda some, size: nearest(some, size, every, k, block, query_block), RESULT)
