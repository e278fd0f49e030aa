import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from holdfast.llm import periodic_runs, queries
from holdfast.sources.tables import fresh_path
from tests.conftest import DATA

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words, exponent=3, least=24):
    """(start, length, period) of all runs, every period tried at every place."""
    x, out = list(words), []
    for q in range(1, len(x) // exponent + 1):
        i = q
        while i < len(x):
            j = i
            while j < len(x) and x[j] == x[j - q]:
                j += 1
            start, end = i - q, j
            if end - start >= max(least, exponent * q) and not any(x[start + r : end] == x[start : end - r] for r in range(1, q)):
                out.append((start, end - start, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


documents = st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=14), st.integers(1, 9)).map(lambda t: t[0] * t[1]), max_size=6).map(lambda p: sum(p, []))


@settings(max_examples=150, deadline=None)
@given(st.lists(documents, min_size=1, max_size=4), st.integers(1, 40), st.sampled_from([(3, 24), (2, 2), (4, 5)]))
def test_any_appends_find_all_runs(docs, chunk, limits):
    held, periodic_runs.APPENDED = periodic_runs.APPENDED, chunk
    try:
        owner, found = periodic_runs.runs_of([np.array(d, np.int64) for d in docs], *limits)
    finally:
        periodic_runs.APPENDED = held
    got = [[tuple(r) for r in found.T[owner == k].tolist()] for k in range(len(docs))]
    assert got == [brute(d, *limits) for d in docs]


def test_squares_are_reported_as_soon_as_they_are_complete():
    """Word by word: a run is reported with the word that ends its first square, and only then."""
    words = [1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 6, 7, 8, 1, 9, 9, 4, 4]
    catchers = periodic_runs.Catchers(2, 2)
    reported = {}
    for at, word in enumerate(words):
        for s, e, p in catchers.append(np.array([word])).T.tolist():
            reported[(s, p)] = at
    assert reported == {(0, 8): 15, (17, 1): 18, (19, 1): 20}


def test_long_runs_of_one_word_and_large_periods():
    rng = np.random.default_rng(1)
    one, block = np.zeros(50_000, np.int64), rng.integers(1, 1000, 7_001)
    owner, found = periodic_runs.runs_of([one, np.tile(block, 4)[:-1], np.tile(block, 3)[:-1]])
    assert found.T.tolist() == [[0, 50_000, 1], [0, 4 * 7_001 - 1, 7_001]] and owner.tolist() == [0, 1]


def test_a_lying_sum_is_noticed(monkeypatch):
    """Even if two words had the same number, results are right."""
    mixed = periodic_runs._mixed
    monkeypatch.setattr(periodic_runs, "_mixed", lambda words, seed: mixed(words % 2 if seed == 1 else words, seed))
    words = np.array([0, 2, 4] * 20)
    assert periodic_runs.runs_of([words])[1].T.tolist() == [[0, 60, 3]]


def expected_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    head = (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
    return (*head, sha(listed), sha(collapse(words, runs)))


def test_query_against_brute_force(spark):
    folder = f"{DATA}/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if len(r["text"] or "") < 6_000]
    path = fresh_path(spark, "small")
    extra = [(None, "a " * 30), (None, None), (-10, None), (-11, ""), (-12, " \t\n\x0b"), (-13, "é x " * 40), (-14, "x\x1cy " * 24), (-15, "a b " * 12 + " "), (-16, "w " * 23)]
    spark.createDataFrame(docs + extra + extra[:1], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    rows = [tuple(r) for r in queries.op12_runs(spark, path).collect()]
    assert sorted(rows, key=str) == sorted((expected_row(*d) for d in docs + extra + extra[:1]), key=str)
    assert sum(r[1] > 0 for r in rows) > 10


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = periodic_runs.find_runs(odd_docs).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["collapsed"]) for r in rows), key=str) == sorted(
        ((r["doc_id"], len(WORD.findall(r["text"] or "")), " ".join(WORD.findall(r["text"] or ""))) for r in odd_docs.collect()), key=str
    )
    assert all(r["runs"] == [] and r["strongest"] is None for r in rows)
    assert periodic_runs.find_runs(no_docs).collect() == []
    clash = odd_docs.limit(1).selectExpr("doc_id as n_words", "'a a a a a a' as runs", "1 as data", "2 as id")
    row = periodic_runs.find_runs(clash, "runs", "n_words", 3, 3).select("runs", "collapsed").first()
    assert [tuple(r) for r in row["runs"]] == [(0, 6, 1)] and row["collapsed"] == "a"


@pytest.mark.parametrize("exponent", [0, 1])
def test_a_run_repeats(exponent):
    with pytest.raises(ValueError):
        periodic_runs.Catchers(exponent)
