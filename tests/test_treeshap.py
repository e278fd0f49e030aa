import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from holdfast.operators import treeshap
from holdfast.operators.models import measured_nodes, node_table
from holdfast.sources.tables import fresh_path


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)).round(2)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] > 0.2) ^ (rng.random(300) < 0.05)).astype(int)
    table = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))], "CLIENTNUM long, churn int, a array<double>")
    table = table.select("CLIENTNUM", "churn", array_to_vector("a").alias("features")).cache()
    model = GBTClassifier(labelCol="churn", maxIter=6, maxDepth=4, seed=1).fit(table)
    nodes = node_table(spark, model, fresh_path(spark, "small-trees"))
    return table, model, nodes


def _value(tree, row, present):
    """Expected tree output when only the present features are known."""
    def walk(node):
        if node["left"] < 0:
            return node["prediction"]
        left, right = tree[node["left"]], tree[node["right"]]
        if node["feature"] in present:
            return walk(left if row[node["feature"]] <= node["threshold"] else right)
        return (left["cover"] * walk(left) + right["cover"] * walk(right)) / node["cover"]

    return walk(tree[0])


def _brute(nodes, row):
    trees = {}
    for n in nodes:
        trees.setdefault(n["treeID"], {})[n["node"]] = n
    game = {
        s: sum(2 * t[0]["weight"] * _value(t, row, s) for t in trees.values())
        for k in range(5) for s in map(frozenset, itertools.combinations(range(4), k))
    }
    phi = []
    for i in range(4):
        others = [s for s in game if i not in s]
        phi.append(sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (game[s | {i}] - game[s]) for s in others))
    return game[frozenset()], phi


def test_against_all_coalitions(small):
    table, _, nodes = small
    rows = nodes.collect()
    for r in treeshap.explain(table.limit(25), nodes).collect():
        base, phi = _brute(rows, r["value"])
        assert r["base"] == pytest.approx(base, abs=1e-9)
        np.testing.assert_allclose(r["shap"], phi, atol=1e-9)


def test_contributions_add_up_to_the_log_odds(small):
    table, model, nodes = small
    scored = model.transform(table).select("CLIENTNUM", vector_to_array("probability")[1].alias("p"), "features")
    out = treeshap.explain(scored, nodes).withColumn("total", F.aggregate("shap", F.col("base"), lambda a, v: a + v))
    gap = out.select(F.max(F.abs(F.col("total") - F.log(F.col("p") / (1 - F.col("p"))))).alias("g")).first()["g"]
    assert gap < 1e-6


def test_passes_and_partitioning_do_not_matter(small):
    table, _, nodes = small
    def values(df):
        return np.array([r["shap"] for r in df.orderBy("CLIENTNUM").collect()])

    once = values(treeshap.explain(table, nodes))
    np.testing.assert_allclose(values(treeshap.explain(table.repartition(5), nodes)), once, atol=1e-12)
    np.testing.assert_allclose(values(treeshap.explain(table, nodes, limit=2_000)), once, atol=1e-12)


def test_chunks_hold_every_path_once(small):
    _, groups = treeshap.collected_paths(treeshap.tree_paths(small[2]))
    chunks = treeshap._chunks(groups, 2_000)
    assert len(chunks) > 1
    assert sum(len(p.value) for c in chunks for p in c) == sum(len(p.value) for p in groups)
    assert all(sum(p.nbytes for p in c) <= 2_000 or len(c) == 1 for c in chunks)


def _games(d, inside, zero, value):
    """Shapley values of one product game by its definition, all coalitions in turn."""
    factor = [[zero[k], float(inside[k])] for k in range(d)]
    worth = {}
    for members in range(1 << d):
        worth[members] = value * math.prod(factor[k][(members >> k) & 1] for k in range(d))
    weight = [math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)]
    return [sum(weight[m.bit_count()] * (worth[m | 1 << j] - worth[m]) for m in worth if not m >> j & 1) for j in range(d)]


@pytest.mark.parametrize("d", [1, 2, 5, 12])
def test_polynomials_against_all_coalitions(d):
    rng = np.random.default_rng(d)
    inside, zero, value = rng.random((d, 3, 4)) < 0.6, rng.random((3, d)), rng.normal(size=3)
    zero[0, 0] = 0.0
    found = treeshap.path_values(inside.astype(float), zero, value)
    for p, r in itertools.product(range(3), range(4)):
        np.testing.assert_allclose(found[:, p, r], _games(d, inside[:, p, r], zero[p], value[p]), atol=1e-13)


@pytest.mark.parametrize("rows", [7, 700])
def test_patterns_and_rows_give_the_same(rows, monkeypatch):
    """Depth 12, fewer rows than patterns and more of them with shorter paths; additivity at each row."""
    monkeypatch.setattr(treeshap, "BLOCK_ROWS", 64)
    monkeypatch.setattr(treeshap, "BLOCK_PAIRS", 256)
    rng = np.random.default_rng(rows)
    x, groups = rng.normal(size=(14, rows)), []
    for d in (3, 8, 12):
        low = rng.normal(-1, 1, (20, d))
        features = np.array([rng.permutation(14)[:d] for _ in range(20)], np.int32)
        groups.append(treeshap.Paths(features, low, low + 2, rng.random((20, d)), rng.normal(size=20)))
    phi = treeshap.contributions(x, groups)
    total = np.zeros(rows)
    for g in groups:
        for f, lo, hi, zero, value in zip(*g._arrays()):
            total += value * (((x[f] > lo[:, None]) & (x[f] <= hi[:, None])).all(0) - zero.prod())
    np.testing.assert_allclose(phi.sum(0), total, atol=1e-12)


def _random_paths(rng, trees, depth, columns=9):
    """Paths of full trees that split at random columns and at one of eight thresholds each."""
    found = {}

    def walk(level, seen, number):
        if level == depth:
            found.setdefault(len(seen), []).append((list(seen), *zip(*seen.values()), rng.normal(), number))
            return
        f, t, part = int(rng.integers(columns)), float(rng.integers(8)) / 4 - 1, rng.random()
        low, high, zero = seen.get(f, (-np.inf, np.inf, 1.0))
        walk(level + 1, {**seen, f: (low, min(high, t), zero * part)}, 2 * number)
        walk(level + 1, {**seen, f: (max(low, t), high, zero * (1 - part))}, 2 * number + 1)

    for tree in range(trees):
        walk(0, {}, tree)
    return [
        treeshap.Paths(np.array(f, np.int32), *map(np.array, (low, high, zero, value, place)))
        for f, low, high, zero, value, place in (zip(*rows) for rows in found.values())
    ]


@pytest.mark.parametrize("kept", [0, 1 << 27])
@pytest.mark.parametrize("depth", [1, 3, 6, 9])
def test_tables_give_what_the_polynomials_give(depth, kept, monkeypatch):
    """Values on thresholds, values that are no finite numbers, paths of more comparisons than a table holds, and tables built anew."""
    monkeypatch.setattr(treeshap, "LOOKUP_BYTES", kept)
    monkeypatch.setattr(treeshap, "BUNDLES", 5)
    monkeypatch.setattr(treeshap, "LOOKUP_ROWS", 500)
    rng = np.random.default_rng(depth)
    groups = _random_paths(rng, 4, depth)
    found = treeshap.Lookup(groups)
    for rows in (2_300, 40):
        x = rng.choice([*(np.arange(8) / 4 - 1), *rng.normal(size=9)], (10, rows))
        x[3, 7], x[5, 8], x[2, 9] = np.nan, -np.inf, np.inf
        np.testing.assert_allclose(found(x), treeshap.contributions(x, groups), atol=1e-12)
        if depth <= 6:
            np.testing.assert_array_equal(treeshap.Lookup(groups)(x[:, :5]), found(x)[:, :5])


def test_polynomials_do_not_grow_with_the_rows(monkeypatch):
    """Rows cost a look a bundle and feature; polynomials are evaluated once for all batches of a task."""
    evaluated, real = [], treeshap.path_values
    monkeypatch.setattr(treeshap, "path_values", lambda inside, *more: evaluated.append(inside.size) or real(inside, *more))
    rng = np.random.default_rng(1)
    groups = _random_paths(rng, 3, 6)
    found = treeshap.Lookup(groups)
    found(rng.normal(size=(9, 1_100)))
    assert sum(evaluated) == 3 * 64 * max(g.features.shape[1] for g in groups) << treeshap.ASKED
    for _ in range(3):
        found(rng.normal(size=(9, 3_000)))
    assert sum(evaluated) == 3 * 64 * max(g.features.shape[1] for g in groups) << treeshap.ASKED
    looks = sum(len(f) for k in range(len(found._bundles)) for f in found._tables(k)[0])
    assert looks * 2 < sum(g.features.size for g in groups)


def test_explained_in_batches_by_tables(spark, small):
    """A table of more rows than tables are worth, against brute force at some of them."""
    table, _, nodes = small
    many = table.crossJoin(spark.range(10).withColumnRenamed("id", "copy")).coalesce(1)
    rows, seen = nodes.collect(), 0
    for r in treeshap.explain(many, nodes).filter("CLIENTNUM % 60 = 0 AND copy IN (0, 9)").collect():
        base, phi = _brute(rows, r["value"])
        np.testing.assert_allclose(r["shap"], phi, atol=1e-9)
        seen += 1
    assert seen == 10


def test_deep_trees(spark, small):
    """Trees of depth 12, all four features on most paths several times, against all coalitions."""
    table, _, _ = small
    model = GBTClassifier(labelCol="churn", maxIter=2, maxDepth=12, seed=3).fit(table)
    nodes = node_table(spark, model, fresh_path(spark, "deep-trees"))
    rows = nodes.collect()
    for r in treeshap.explain(table.limit(10), nodes).collect():
        base, phi = _brute(rows, r["value"])
        assert r["base"] == pytest.approx(base, abs=1e-9)
        np.testing.assert_allclose(r["shap"], phi, atol=1e-9)


def test_measured_nodes(small):
    """Covers and gains on another table, by sending its rows down one at a time."""
    table, _, nodes = small
    part = table.filter("CLIENTNUM % 3 = 0")
    rows = [(r["features"].toArray(), r["churn"]) for r in part.collect()]
    trees = {}
    for n in nodes.collect():
        trees.setdefault(n["treeID"], {})[n["node"]] = n
    met = {}
    for x, y in rows:
        for t, tree in trees.items():
            node = tree[0]
            while True:
                met.setdefault((t, node["node"]), []).append(y)
                if node["left"] < 0:
                    break
                node = tree[node["left"] if x[node["feature"]] <= node["threshold"] else node["right"]]
    spread = lambda ys: np.var(ys) * len(ys) if ys else 0.0
    found = measured_nodes(nodes, part).collect()
    assert len(found) == sum(map(len, trees.values()))
    for r in found:
        mine, tree = met.get((r["treeID"], r["node"]), []), r["treeID"]
        assert r["cover"] == len(mine)
        gain = (spread(mine) - spread(met.get((tree, r["left"]), [])) - spread(met.get((tree, r["right"]), []))) / len(mine) if mine and r["left"] >= 0 else 0.0
        assert r["gain"] == pytest.approx(gain, abs=1e-9)
