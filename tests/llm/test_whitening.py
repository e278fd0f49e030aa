import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import queries, whitening
from holdfast.sources.tables import fresh_path
from tests.conftest import DATA


def matrix_of(kind, size, rng):
    if kind == "flat":
        return np.cov(rng.normal(size=(4 * size, size)).T * 8).reshape(size, size)
    if kind == "falling":
        return np.cov((rng.normal(size=(4 * size, size)) * np.exp(-np.arange(size) / 15)).T)
    if kind == "pairs":
        return np.diag(np.repeat(np.arange(size // 2) + 1.0, 2))
    if kind == "low_rank":
        half = rng.normal(size=(size, 3))
        return half @ half.T
    turn = np.linalg.qr(rng.normal(size=(size, size)))[0]
    return turn @ np.diag(np.concatenate([[1e12], np.linspace(1, 2, size - 1)])) @ turn.T


@pytest.mark.parametrize("kind", ["flat", "falling", "pairs", "low_rank", "one_huge"])
@pytest.mark.parametrize("size", [2, 18, 64, 200])
def test_leading_pairs_to_double_precision(kind, size):
    a = matrix_of(kind, size, np.random.default_rng(size))
    blocks = []

    def product(block):
        blocks.append(block.shape[1])
        return a @ block

    values, vectors = whitening.leading(product, size, 16)
    k = min(16, size)
    exact = np.linalg.eigvalsh(a)[::-1][:k]
    assert np.abs(values - exact).max() <= 1e-13 * exact[0]
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() <= 1e-12 * exact[0]
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert max(blocks) <= k + 2  # blocks of vectors, never the whole matrix


def test_minres_solves_projected_equations():
    rng = np.random.default_rng(0)
    a, basis = matrix_of("flat", 30, rng), np.linalg.qr(rng.normal(size=(30, 4)))[0]
    project = np.eye(30) - basis @ basis.T
    rhs, shifts = project @ rng.normal(size=(30, 3)), np.array([-5.0, 0.0, 60.0])
    t = whitening._minres(lambda b: a @ b, shifts, basis, rhs, 60, 1e-12)
    left = project @ (a @ t - t * shifts) - rhs
    assert np.abs(left).max() < 1e-8 and np.abs(basis.T @ t).max() < 1e-12


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def check(spark, rows):
    """The query's rows for a table of (vec_id, vector) against numpy's eigenvectors."""
    path = fresh_path(spark, "vectors-in")
    frame = spark.createDataFrame([(i, v, 1, "w") for i, v in rows], "vec_id long, embedding array<float>, n int, whitened string")
    frame.repartition(3).write.parquet(f"{path}/embeddings.parquet")
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if usable(v)]
    got = queries.op11_whitening(spark, path).collect()
    fit = np.array(sorted({tuple(x) for _, x in kept}), np.int64)
    n, sums = len(fit), fit.sum(0)
    centred = (n * fit - sums) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    real = values > 1e-9 * max(values[0], 1e-300)
    values, vectors = values[real], vectors[:, real]
    assert len(got) == len(kept) * len(values)
    by_component = {}
    for r in got:
        by_component.setdefault(r["component"], []).append((r["vec_id"], r["deviation"], r["whitened"]))
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert abs(r["explained"] - values[r["component"] - 1] / np.trace(cov)) <= 1e-10
    for k, rows_of in by_component.items():
        want = [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums.tolist())), (np.array(x) * n - sums) / n @ vectors[:, k - 1] / math.sqrt(values[k - 1])) for i, x in kept]
        key = lambda r: (str(r[0]), r[1])
        a, b = sorted(rows_of, key=key), sorted(want, key=key)
        assert [r[:2] for r in a] == [r[:2] for r in b]
        if min(abs(values[k - 1] - values[j]) for j in range(len(values)) if j != k - 1) > 1e-6 * values[0] if len(values) > 1 else True:
            x, y = np.array([r[2] for r in a]), np.array([r[2] for r in b])
            assert min(np.abs(x - y).max(), np.abs(x + y).max()) < 1e-6
    return by_component


def test_query_against_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet").collect()]
    assert len(check(spark, rows)) == 16


def test_hot_copies_nulls_and_repeats(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=5)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(80)] + [rows[3], (None, rows[4][1]), (None, [1.0] * 5)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0]), (302, [float("nan")] * 5), (303, [float("-inf")] * 5), (304, [])]
    assert len(check(spark, rows)) == 5


def test_wide_numbers_are_held_and_deviations_exact(spark):
    rows = [(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [-3e30, 2.0]), (4, [5.0, 5.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(frame)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(frame, model).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1] is None and np.isfinite(model.values).all()
    x = np.array([(2**52 + 10**6, 10**6), (10**6, 10**6 + 64), (-(2**52) + 10**6, 10**6 + 128), (10**6 + 320, 10**6 + 320)], object)
    exact = ((4 * x - x.sum(0)) ** 2).sum(1)
    assert got == {i + 1: int(v) if v < 2**63 else None for i, v in enumerate(exact)}


def test_without_variance_rows_or_the_common_size(spark):
    kinds = "vec_id long, embedding array<float>"
    none = spark.createDataFrame([(1, None)], kinds)
    assert whitening.fit(none) is None and whitening.whiten(none, None).count() == 0
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(4)], kinds)
    model = whitening.fit(same)
    assert model.n == 1 and [r["whitened"] for r in whitening.whiten(same, model).collect()] == [[]] * 4
    ragged = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, [2.0, -1.0])], kinds)
    model = whitening.fit(ragged)
    assert sorted(r["vec_id"] for r in whitening.whiten(ragged, model).collect()) == [1, 2, 4]


def test_merging_partial_sums(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MERGED", 2)
    frame = spark.range(500).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * k) for k in range(1, 5)]).alias("embedding")).repartition(5)
    model = whitening.fit(frame)
    assert model.identity_error < 1e-9 and len(model.values) == 4
