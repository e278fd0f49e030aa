"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

The trees are grown on a bounded sample and every row is put into a leaf of each tree. A query walks all
trees through one priority queue, nearest split first, until the leaves it has met hold enough rows. The
rows of those leaves are ranked by their exact cosine. Leaves of any size are dealt into blocks.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from holdfast.llm.vectors import best, by_size, is_query, matrix, usable
from holdfast.sources.tables import settle

FOUND = "query_id bigint, vec_id bigint, score double"
RESULT = "query_id bigint, rank int, vec_id bigint, score double"


@dataclass
class Tree:
    """Node k has children 2k+1 and 2k+2; nodes of the last level are leaves. Rows at most `border` along `normal` go left."""

    normal: np.ndarray
    border: np.ndarray
    depth: int

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        node = np.zeros(len(unit), np.int64)
        for _ in range(self.depth):
            side = np.einsum("nd,nd->n", unit, self.normal[node]) > self.border[node]
            node = 2 * node + 1 + side
        return node - (2**self.depth - 1)


def grow(sample: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    """Splits halfway along the line of two random rows, at the median."""
    inner = 2**depth - 1
    tree = Tree(np.zeros((inner, sample.shape[1])), np.zeros(inner), depth)
    members = {0: np.arange(len(sample))}
    for node in range(inner):
        mine = members.pop(node)
        line = np.zeros(sample.shape[1])
        if len(mine) > 1:
            a, b = sample[rng.choice(mine, 2, replace=False)]
            line = a - b
        if not line.any():
            line = rng.normal(size=sample.shape[1])
        line = line / np.linalg.norm(line)
        along = sample[mine] @ line
        tree.normal[node], tree.border[node] = line, np.median(along) if len(mine) else 0.0
        right = along > tree.border[node]
        members[2 * node + 1], members[2 * node + 2] = mine[~right], mine[right]
    return tree


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square is lost."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def walk(forest: list[Tree], unit: np.ndarray, held: list[np.ndarray], enough: float) -> list[tuple[int, int]]:
    """Leaves (tree, leaf) a query meets: by one queue over all trees, until they hold `enough` rows together.

    A branch not taken waits with its distance to the split, or the largest one on its way.
    """
    margins = [t.normal @ unit - t.border for t in forest]
    queue = [(0.0, tree, 0) for tree in range(len(forest))]
    met, rows = [], 0
    while queue and rows < enough:
        far, tree, node = heapq.heappop(queue)
        inner, margin = len(margins[tree]), margins[tree]
        while node < inner:
            right = margin[node] > 0
            heapq.heappush(queue, (max(far, abs(margin[node])), tree, 2 * node + (1 if right else 2)))
            node = 2 * node + (2 if right else 1)
        met.append((tree, node - inner))
        rows += held[tree][node - inner]
    return met


def fit(rows: DataFrame, trees: int, sample: int, leaf: int, seed: int) -> list[Tree]:
    """Forest grown on about `sample` rows at most, chosen by a hash of the id."""
    count = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, count))))
    unit = unit_rows(np.array([r["vec"] for r in chosen.orderBy("vec_id").select("vec").collect()]).reshape(-1, rows.first()["size"]))
    depth = max(0, int(np.log2(max(1, len(unit)) / leaf)))
    rng = np.random.default_rng(seed)
    return [grow(unit, depth, rng) for _ in range(trees)]


def put(rows: DataFrame, forest: list[Tree]) -> DataFrame:
    """Every row with its leaf in each tree."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(forest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = pickle.loads(shared.value)
        for batch in batches:
            unit = unit_rows(matrix(batch["vec"]))
            found = np.stack([t.leaves(unit) for t in trees], axis=1).astype(np.int32)
            leaves = pa.ListArray.from_arrays(np.arange(0, found.size + 1, len(trees), dtype=np.int32), found.ravel())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["vec"], leaves], ["vec_id", "vec", "leaves"])

    return rows.select("vec_id", "vec").mapInArrow(run, "vec_id bigint, vec array<double>, leaves array<int>")


def probe(queries: DataFrame, forest: list[Tree], held: list[np.ndarray], enough: float) -> DataFrame:
    """Every query with the leaves it meets."""
    shared = queries.sparkSession.sparkContext.broadcast(pickle.dumps((forest, held)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, rows_held = pickle.loads(shared.value)
        for batch in batches:
            met = [walk(trees, u, rows_held, enough) for u in unit_rows(matrix(batch["vec"]))]
            rows = np.repeat(np.arange(len(met)), [len(m) for m in met])
            tree, leaf = np.array([x for m in met for x in m], np.int32).reshape(-1, 2).T
            part = pa.RecordBatch.from_arrays([batch["vec_id"], batch["vec"]], ["vec_id", "vec"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(leaf), part["vec_id"], part["vec"]], ["tree", "leaf", "query_id", "query"])

    return queries.select("vec_id", "vec").mapInArrow(run, "tree int, leaf int, query_id bigint, query array<double>")


def rank_group(k: int):
    """The k nearest of each query among the rows of one leaf block."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not asked.num_rows or not rows.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        queries, vecs = unit_rows(matrix(asked["query"])), unit_rows(matrix(rows["vec"]))
        query_ids, ids = asked["query_id"].to_numpy(), rows["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, vecs = ids[order], vecs[order]
        near = np.round(queries @ vecs.T, 12)  # equal vectors have equal scores wherever they stand
        near[query_ids[:, None] == ids[None, :]] = -np.inf
        first = np.argsort(-near, axis=1, kind="stable")[:, :k]
        query, row = np.repeat(np.arange(len(queries)), first.shape[1]), first.ravel()
        there = np.isfinite(near[query, row])
        query, row = query[there], row[there]
        score = (queries[query] * vecs[row]).sum(1)
        return pa.table([pa.array(query_ids[query]), pa.array(ids[row]), pa.array(score)], names)

    return run


def search(rows: DataFrame, size: int, every: int, k: int, trees: int, sample: int, leaf: int, effort: float, block: int, seed: int) -> DataFrame:
    """Search of the queries among stored vectors of one size."""
    count = rows.count()
    forest = fit(rows, trees, sample, leaf, seed)
    leaves = 2 ** forest[0].depth
    placed = settle(put(rows, forest), "leaves")
    spread = placed.select("vec_id", "vec", F.posexplode("leaves").alias("tree", "leaf"))
    held = [np.zeros(leaves, np.int64) for _ in forest]
    for r in spread.groupBy("tree", "leaf").count().collect():  # trees x leaves rows at most
        held[r["tree"]][r["leaf"]] = r["count"]
    asked = settle(probe(rows.where(is_query(every)), forest, held, max(effort * count, 40 * k * trees)), "probes")
    # Leaves and the queries that meet them in blocks, so that no group outgrows a task.
    parts = spread.sparkSession.createDataFrame(
        [(t, n, max(1, -(-int(held[t][n]) // block)), 0) for t in range(trees) for n in range(leaves)], "tree int, leaf int, parts int, nothing int"
    ).drop("nothing")
    crowds = asked.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("crowds"))
    table = F.broadcast(settle(parts.join(crowds, ["tree", "leaf"]), "leaf-blocks"))  # trees x leaves rows at most
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mixed = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    key = ["tree", "leaf", "part", "crowd"]
    left = asked.join(table, ["tree", "leaf"]).withColumn("crowd", mixed("query_id", "crowds")).withColumn("part", each("parts"))
    right = spread.join(table, ["tree", "leaf"]).withColumn("part", mixed("vec_id", "parts")).withColumn("crowd", each("crowds"))
    found = (
        left.select(*key, "query_id", "query").groupBy(*key)
        .cogroup(right.select(*key, "vec_id", "vec").groupBy(*key))
        .applyInArrow(rank_group(k), FOUND)
    )
    return best(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)


def nearest(
    df: DataFrame, vector: str = "embedding", every: int = 50, k: int = 5, trees: int = 16, sample: int = 20_000,
    leaf: int = 256, effort: float = 0.8, block: int = 2048, seed: int = 11,
) -> DataFrame:
    """About the k nearest rows by cosine of each query, its own left out: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by `every`. The forest is grown on `sample` rows; all rows
    are indexed. A walk ends when the leaves met hold effort x all rows, a row counting once in each tree.
    Scores are exact; ties go to the smaller vec_id. Vectors are compared with those of their size.
    Unusable vectors take no part, see `usable`; rows with the query's vec_id count as its own.
    """
    rows = settle(usable(df, vector, nonzero=True), "vectors")
    return by_size(rows, lambda some, size: search(some, size, every, k, trees, sample, leaf, effort, block, seed), RESULT)
