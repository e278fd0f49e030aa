"""Exact Shapley values of boosted trees on the log-odds scale.

Each root-to-leaf path is a product game over its distinct features: a feature
inside the path's interval contributes 1, one outside 0, and an absent one the
share of training weight that followed the path. A feature's value is its own
change times the others' products, averaged over coalitions with weights
s! (d - 1 - s)! / d!. As these weights are the integrals of t**s (1 - t)**(d - 1 - s)
from 0 to 1, the average is the integral of one polynomial, the product of
zero * (1 - t) + inside * t over the other features. It has degree d - 1, so
Gauss-Legendre quadrature with d / 2 nodes is exact, and the work for a path is
quadratic in its length. Reference: Lundberg et al. 2018 (path-dependent tree
explanations).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from holdfast.sources.tables import settle

LOG_ODDS = 2.0  # the probability is sigmoid(2 * margin)
BROADCAST_BYTES = 256 * 1024 * 1024
BLOCK_ROWS = 256
BLOCK_PAIRS = 16_384  # paths times rows whose factors stay in the processor cache
ASKED = 7  # comparisons of a bundle; their outcomes make a number below 2**ASKED
BUNDLES = 512  # whose tables are built together
LOOKUP_ROWS = 2_048
LOOKUP_BYTES = 128 * 1024 * 1024  # tables a task keeps; of more, each is built anew for every batch

PATHS = "tree int, value double, share double, feature array<int>, low array<double>, high array<double>, zero array<double>"


@dataclass
class Paths:
    """Paths with the same number d of distinct features."""

    features: np.ndarray  # (paths, d)
    low: np.ndarray  # (paths, d): inside means low < x <= high
    high: np.ndarray
    zero: np.ndarray  # (paths, d): factor of an absent feature
    value: np.ndarray  # (paths,)
    place: np.ndarray | None = None  # (paths,): place of a path among all, near others of its tree

    def _arrays(self) -> tuple[np.ndarray, ...]:
        return self.features, self.low, self.high, self.zero, self.value

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in self._arrays())

    def part(self, start: int, stop: int) -> Paths:
        return self.chosen(slice(start, stop))

    def chosen(self, which: slice | np.ndarray) -> Paths:
        return Paths(*(a[which] for a in self._arrays()), None if self.place is None else self.place[which])


def _paths_of_tree(nodes: list[dict]) -> list[tuple]:
    """Rows of PATHS for one tree."""
    tree = {node["node"]: node for node in nodes}
    found, stack = [], [(tree[0], {}, 1.0)]
    while stack:
        node, seen, share = stack.pop()
        if node["left"] < 0:
            value = LOG_ODDS * node["weight"] * node["prediction"]
            low, high, zero = ([side[k] for side in seen.values()] for k in range(3))
            found.append((node["treeID"], value, share, list(seen), low, high, zero))
            continue
        if node["categories"] != -1:
            raise ValueError("categorical splits are not expected: all features are numbers")
        feature, threshold = node["feature"], node["threshold"]
        for child, left in ((tree[node["left"]], True), (tree[node["right"]], False)):
            part = child["cover"] / node["cover"]
            low, high, zero = seen.get(feature, (-np.inf, np.inf, 1.0))
            bounds = (low, min(high, threshold)) if left else (max(low, threshold), high)
            stack.append((child, {**seen, feature: (*bounds, zero * part)}, share * part))
    return found


def tree_paths(nodes: DataFrame) -> DataFrame:
    """Paths of an ensemble's trees, a tree at a time: what a leaf adds to the log-odds, the share of training
    weight that reaches it, and for each distinct feature on the way its interval and its factor when absent."""
    schema = pa.schema([("tree", pa.int32()), ("value", pa.float64()), ("share", pa.float64()), ("feature", pa.list_(pa.int32()))])
    for name in ("low", "high", "zero"):
        schema = schema.append(pa.field(name, pa.list_(pa.float64())))

    def work(tree: pa.Table) -> pa.Table:
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*_paths_of_tree(tree.to_pylist())), schema, strict=True)], schema=schema)

    return nodes.groupBy("treeID").applyInArrow(work, PATHS)


def collected_paths(paths: DataFrame) -> tuple[float, list[Paths]]:
    """Baseline and paths by length; what reaches the driver is bounded by the model."""
    table = paths.orderBy("tree").toArrow()
    value = table["value"].to_numpy()
    base, length = float(value @ table["share"].to_numpy()), pa.compute.list_value_length(table["feature"]).to_numpy()
    groups = []
    for d in sorted(set(length.tolist()) - {0}):
        own = np.flatnonzero(length == d)
        columns = [table[c].take(own).combine_chunks().flatten().to_numpy().reshape(-1, d) for c in ("feature", "low", "high", "zero")]
        groups.append(Paths(*columns, value[own], own))
    return base, groups


def path_values(inside: np.ndarray, zero: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Shapley values (d, paths, rows) of product games; inside (d, paths, rows) is 0 or 1, zero (paths, d)."""
    d = len(inside)
    nodes, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
    out, factors, after = np.zeros(inside.shape), np.empty(inside.shape), np.empty(inside.shape)
    for t, weight in zip((nodes + 1) / 2, weights / 2):
        np.multiply(inside, t, out=factors)
        factors += (zero.T * (1 - t))[:, :, None]
        after[d - 1] = weight
        for k in range(d - 1, 0, -1):  # products of the factors behind a feature, then of those before it
            np.multiply(after[k], factors[k], out=after[k - 1])
        before = factors[0]
        out[0] += after[0]
        for k in range(1, d):
            after[k] *= before
            out[k] += after[k]
            if k < d - 1:
                before = before * factors[k]
    out *= inside - zero.T[:, :, None]
    out *= value[None, :, None]
    return out


def contributions(x: np.ndarray, groups: list[Paths]) -> np.ndarray:
    """Shapley values (features, rows) for the feature matrix x (features, rows).

    A row meets a path in one of 2**d patterns of features inside. The polynomials are evaluated for all patterns
    or for all rows, whichever are fewer.
    """
    phi = np.zeros(x.shape)
    for group in groups:
        d = group.features.shape[1]
        patterns = 1 << d if d < 20 and 1 << d < x.shape[1] else 0
        size = max(1, BLOCK_PAIRS // min(x.shape[1], BLOCK_ROWS))
        bits = (np.arange(patterns) >> np.arange(d)[:, None]) & 1
        for start in range(0, len(group.value), size):
            paths = group.part(start, start + size)
            features, low, high = paths.features.T, paths.low.T[:, :, None], paths.high.T[:, :, None]
            place = np.zeros((len(x), features.size))
            place[features.ravel(), np.arange(features.size)] = 1.0
            if patterns:
                all_met = np.broadcast_to(bits[:, None, :], (d, len(paths.value), patterns)).astype(np.float64)
                table = path_values(all_met, paths.zero, paths.value).reshape(d, -1)
                offset = np.arange(len(paths.value))[:, None] * patterns
            for first in range(0, x.shape[1], BLOCK_ROWS):
                met = x[:, first : first + BLOCK_ROWS][features]  # (d, paths, rows)
                inside = (met > low) & (met <= high)
                if patterns:
                    which = offset + sum(inside[k].astype(np.int64) << k for k in range(d))
                    values = np.stack([table[k].take(which) for k in range(d)])
                else:
                    values = path_values(inside.astype(np.float64), paths.zero, paths.value)
                phi[:, first : first + BLOCK_ROWS] += place @ values.reshape(features.size, -1)
    return phi


class Lookup:
    """Contributions of many rows by tables.

    Paths that lie side by side in a tree ask mostly the same: four leaves below one node ask seven comparisons of
    a value with a threshold between them. Such a bundle has one table, of what each of its features gets under each
    pattern of outcomes, filled by the polynomials. A row then costs one look a bundle and feature instead of one a
    path and feature. Paths that ask more than ASKED comparisons by themselves are evaluated as in contributions.
    """

    def __init__(self, groups: list[Paths]):
        self.groups, self._asked, self._kept = groups, None, {}

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Shapley values (features, rows) for the feature matrix x (features, rows)."""
        plain = np.isfinite(x).all(axis=0)
        if not self.groups or not plain.any():
            return contributions(x, self.groups)
        if self._asked is None:  # for few rows too, so that the last digits do not depend on the batch
            self._prepare()
        phi = np.empty(x.shape)
        phi[:, plain] = self._looked_up(x[:, plain])
        if not plain.all():
            phi[:, ~plain] = contributions(x[:, ~plain], self.groups)
        return phi

    def _prepare(self) -> None:
        """Deal paths to bundles, side by side; comparisons are numbered by feature and threshold."""
        width = max(g.features.shape[1] for g in self.groups)
        parts = []
        for g in self.groups:
            room = ((0, 0), (0, width - g.features.shape[1]))
            # a feature that is always inside and has the factor 1 changes no other's value and gets none
            parts.append((
                np.pad(g.features, room, constant_values=-1), np.pad(g.low, room, constant_values=-np.inf),
                np.pad(g.high, room, constant_values=np.inf), np.pad(g.zero, room, constant_values=1.0), g.value,
                np.arange(len(g.value)) if g.place is None else g.place,
            ))
        features, low, high, zero, value, place = (np.concatenate(a) for a in zip(*parts))
        bounds = np.stack([low, high])
        real = np.isfinite(bounds)
        pairs = np.stack([np.broadcast_to(features, bounds.shape)[real], bounds[real]], axis=1)
        compared, number = np.unique(pairs, axis=0, return_inverse=True)
        self._feature, self._threshold = compared[:, 0].astype(np.int64), compared[:, 1]
        asks = np.full(bounds.shape, -1)
        asks[real] = number.ravel()
        bundles, rest, mine, seen = [], [], [], set()
        for p, own in sorted(enumerate(map(set, np.moveaxis(asks, 1, 0).reshape(len(value), -1).tolist())), key=lambda i: place[i[0]]):
            own.discard(-1)
            if len(own) > ASKED:
                rest.append(p)
                continue
            if mine and len(seen | own) > ASKED:
                bundles.append((mine, seen))
                mine, seen = [], set()
            mine.append(p)
            seen = seen | own
        if mine:
            bundles.append((mine, seen))
        left, self._rest, first = np.array(rest, np.int64), [], 0
        for g in self.groups:
            own = left[(left >= first) & (left < first + len(g.value))] - first
            self._rest += [g.chosen(own)] if len(own) else []
            first += len(g.value)
        self._paths = features, zero, value, asks
        self._bundles = [bundles[k : k + BUNDLES] for k in range(0, len(bundles), BUNDLES)]
        self._asked = [np.array([[*sorted(seen), *[0] * (ASKED - len(seen))] for _, seen in block]) for block in self._bundles]
        self._room = LOOKUP_BYTES

    def _tables(self, number: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Features of each bundle of a block, and what they get: (features, 2**ASKED) a bundle."""
        if number in self._kept:
            return self._kept[number]
        block = self._bundles[number]
        features, zero, value, asks = self._paths
        own = np.concatenate([mine for mine, _ in block])
        bundle = np.repeat(np.arange(len(block)), [len(mine) for mine, _ in block])
        bit = np.full(asks.shape[:1] + (len(own), asks.shape[2]), ASKED)
        for k in range(ASKED):  # where a path's comparison stands among those of its bundle
            bit[asks[:, own] == self._asked[number][bundle, k][None, :, None]] = k
        bit[asks[:, own] < 0] = ASKED
        outcome = (np.arange(1 << ASKED) >> np.arange(ASKED)[:, None]) & 1 == 1
        none = np.ones((1, 1 << ASKED), bool)
        above, below = np.concatenate([~outcome, none])[bit[0]], np.concatenate([outcome, none])[bit[1]]
        inside = np.ascontiguousarray((above & below).transpose(1, 0, 2), np.float64)  # (d, paths, patterns)
        values = path_values(inside, zero[own], value[own]).transpose(1, 0, 2).reshape(-1, 1 << ASKED)
        key = (bundle[:, None] * (features.max() + 1) + features[own]).ravel()
        used = np.flatnonzero(features[own].ravel() >= 0)
        used = used[np.argsort(key[used], kind="stable")]
        keys, starts = np.unique(key[used], return_index=True)
        sums = np.add.reduceat(values[used], starts, axis=0)
        cuts = np.searchsorted(keys // (features.max() + 1), np.arange(1, len(block)))
        made = np.split(keys % (features.max() + 1), cuts), np.split(sums, cuts)
        if sums.nbytes <= self._room:
            self._room -= sums.nbytes
            self._kept[number] = made
        return made

    def _looked_up(self, x: np.ndarray) -> np.ndarray:
        phi = contributions(x, self._rest)
        for number, asked in enumerate(self._asked):
            features, tables = self._tables(number)
            got = np.empty((max(map(len, features)), LOOKUP_ROWS))
            for first in range(0, x.shape[1], LOOKUP_ROWS):
                some = x[:, first : first + LOOKUP_ROWS]
                outcome = (some[self._feature] <= self._threshold[:, None]).view(np.uint8)
                which = np.zeros((len(asked), some.shape[1]), np.uint8)
                for k in range(ASKED):
                    which |= outcome[asked[:, k]] << k
                sums = phi[:, first : first + LOOKUP_ROWS].copy()
                for own, table, place in zip(features, tables, which):
                    part = got[: len(own), : len(place)]
                    table.take(place.astype(np.intp), axis=1, out=part, mode="clip")
                    sums[own] += part
                phi[:, first : first + LOOKUP_ROWS] = sums
        return phi


def _chunks(groups: list[Paths], limit: int) -> list[list[Paths]]:
    """Cut the paths into lists of at most limit bytes each."""
    chunks: list[list[Paths]] = [[]]
    room = limit
    for group in groups:
        per_path = max(1, group.nbytes // len(group.value))
        start = 0
        while start < len(group.value):
            fit = room // per_path
            if fit == 0 and chunks[-1]:
                chunks.append([])
                room = limit
                continue
            stop = min(len(group.value), start + max(1, fit))
            chunks[-1].append(group.part(start, stop))
            room -= per_path * (stop - start)
            start = stop
    return chunks


def explain(df: DataFrame, nodes: DataFrame | tuple[float, list[Paths]], vector: str = "features", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Add base, value (array) and shap (array) to a table with a feature vector.

    The work is narrow: every task explains its own rows against the broadcast
    paths. Shapley values add up over paths, so an ensemble too large for
    one broadcast is explained in several passes over a stored table. Instead of
    nodes their collected paths can be given, where several tables are explained.
    """
    spark = df.sparkSession
    base, groups = collected_paths(tree_paths(nodes)) if isinstance(nodes, DataFrame) else nodes
    kept = [c for c in df.columns if c != vector]
    out = df.select(
        *kept, F.lit(base).alias("base"), vector_to_array(vector).alias("value"), F.lit(None).cast("array<double>").alias("shap")
    )
    chunks = _chunks(groups, limit)
    for number, chunk in enumerate(chunks):
        shared = spark.sparkContext.broadcast(chunk)

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            explained = Lookup(shared.value)
            for batch in batches:
                rows = batch.num_rows
                if rows == 0:
                    continue
                x = batch.column("value").flatten().to_numpy().reshape(rows, -1).T.copy()
                phi = explained(x)
                earlier = batch.column("shap")
                if earlier.null_count == 0:
                    phi += earlier.flatten().to_numpy().reshape(rows, -1).T
                offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * x.shape[0])
                shap = pa.ListArray.from_arrays(offsets, pa.array(phi.T.reshape(-1)))
                position = batch.schema.get_field_index("shap")
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:position], shap, *batch.columns[position + 1:]], names=batch.schema.names
                )

        schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
        out = out.mapInArrow(add, schema)
        if number + 1 < len(chunks):
            out = settle(out, "shap-part")
    return out
