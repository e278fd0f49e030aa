import math

import numpy as np
import pytest

from holdfast.llm import rp_forest, topk
from tests.conftest import DATA


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Equal vectors, zero vectors, nulls, other sizes, repeated rows."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(200)]
    rows += [(200 + i, [0.5] * 8) for i in range(120)] + [(50, rows[50][1])]
    rows += [(400, None), (401, [1.0, None, *[0.0] * 6]), (402, [float("nan")] + [0.0] * 7), (450, [float("inf")] * 8), (404, [0.0] * 8), (None, [1.0] * 8), (405, [])]
    rows += [(500, [1.0, 2.0]), (501, [2.0, 1.0]), (550, [1.0])]
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")


def usable(df, zero=True):
    rows = {}
    for r in df.collect():
        v = r["embedding"]
        if r["vec_id"] is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            rows[r["vec_id"]] = np.array(v, float)
    return rows


def expected(rows, score, k=5):
    out = []
    for q, v in rows.items():
        if q % 50 == 0:
            best = sorted(((-score(v, w), i) for i, w in rows.items() if i != q and len(w) == len(v)))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_k(odd_vectors):
    ints = lambda v: np.floor(256 * v).astype(int)
    want = expected(usable(odd_vectors), lambda a, b: int(ints(a) @ ints(b)))
    for block in (16, 8192):
        found = sorted(tuple(r) for r in topk.top_k(odd_vectors, block=block, query_block=3).collect())
        assert found == want
    assert topk.top_k(odd_vectors.limit(0)).count() == 0


def exact(x):
    return int(x) * 256 if abs(x) >= 2.0**52 else math.floor(256 * x)


@pytest.mark.parametrize("size", [1e8, 1e15, 1e36])
def test_top_k_of_any_finite_size(spark, size):
    """Large components among small ones, scores beyond a long, huge ties; against whole numbers of any size."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(150)]
    rows += [(200 + i, [float(np.float32(x)) for x in rng.normal(size=6) * size]) for i in range(40)]
    rows += [(300 + i, [size, 0.0, -size, 1.0, 0.0, 0.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    held = {i: [exact(float(np.float32(x))) for x in v] for i, v in rows}
    want = []
    for q in sorted(i for i in held if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(held[q], w)), i) for i, w in held.items() if i != q)[:5]
        want += [(q, n, i, -s if abs(s) < 2**63 else None) for n, (s, i) in enumerate(best, 1)]
    for block in (32, 8192):
        assert sorted(tuple(r) for r in topk.top_k(df, block=block, query_block=2).collect()) == want


def test_doubles_near_the_largest(spark):
    df = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e-300, 5.0]), (2, [-1e300, 0.0]), (3, [1e300, 2.0]), (4, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in topk.top_k(df, k=4).orderBy("rank").collect()] == [3, 4, 1, 2]


def test_places_sort_like_numbers():
    numbers = [0, 1, -1, 9, 10, -9, -10, 99, -100, 2**63, -(2**63), 10**300, -(10**300), 10**300 + 1]
    assert sorted(numbers, key=topk.place) == sorted(numbers)


def test_a_bound_from_another_block_leaves_out_only_what_cannot_reach_it():
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(3000, 16))
    lists, query = topk.Lists(rows), rng.normal(size=16)
    score = np.array(lists.scores(np.arange(3000), query))
    own = np.zeros(3000, bool)
    for least in (-np.inf, float(np.sort(score)[-3]), float(score.max()), float(score.max()) + 1e6):
        kept, _ = topk.search(lists, query, 5, own, least)
        need = [i for i in np.argsort(-score, kind="stable")[:5].tolist() if score[i] >= least]
        assert set(need) <= set(kept.tolist())
    assert len(topk.search(lists, query, 5, own, 1e12)[0]) == 0


def test_reading_stops_early_and_bounds_hold():
    rng = np.random.default_rng(5)
    rows = np.floor(256 * rng.normal(size=(4000, 32)) * np.linspace(2, 0.1, 32)).astype(np.int32)
    lists = topk.Lists(rows)
    for q in range(0, 4000, 400):
        query, own = rows[q].astype(np.int64), np.arange(4000) == q
        kept, entries = topk.search(lists, query, 5, own)
        score = np.where(own, -(10**12), rows.astype(np.int64) @ query)
        assert set(np.argsort(-score, kind="stable")[:5]) <= set(kept.tolist()) and entries < 0.8 * rows.size


def test_forest_finds_all_where_leaves_hold_all(odd_vectors):
    cosine = lambda a, b: round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 10)
    found = rp_forest.nearest(odd_vectors, effort=100.0, leaf=16, block=32).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 10)) for r in found) == expected(usable(odd_vectors, False), cosine)
    assert rp_forest.nearest(odd_vectors.limit(0)).count() == 0


def test_recall(spark):
    df = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    rows = usable(df)
    ids, vecs = np.array(list(rows)), np.array(list(rows.values()))
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    hits = total = 0
    found = rp_forest.nearest(df).collect()
    for q in {r["query_id"] for r in found}:
        near = unit @ unit[ids == q][0]
        near[ids == q] = -2
        best = set(ids[np.argsort(-near)[:5]].tolist())
        hits += len(best & {r["vec_id"] for r in found if r["query_id"] == q})
        total += 5
    assert total == 5 * (ids % 50 == 0).sum() and hits >= 0.9 * total
