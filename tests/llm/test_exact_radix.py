from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from holdfast.llm import exact_radix

DOCS = "doc_id long, text string, keep_id string, kept string, n int, digit string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "k", 1, "d") for i, t in rows], DOCS)


def expected(rows):
    """(doc_id, keep_id, group_size, kept) of every row, by comparing whole texts."""
    classes = defaultdict(list)
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for i, t in rows:
        classes[low(t)].append(i)
    out = []
    for ids in classes.values():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep) for i in ids]
    return sorted(out, key=str)


def found(df):
    got = exact_radix.exact_duplicates(df, exact_radix.normalised(F.col("text")))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=str)


LONG = "long text " * 30_000  # 300,000 bytes: five rounds
CASES = {
    "plain": [(1, "a"), (2, "A"), (3, "b"), (4, None), (5, ""), (6, " "), (7, "É"), (8, "é"), (9, "aa"), (10, "a\x00"), (11, "A\x00")],
    "nulls_and_repeats": [(None, "x"), (None, "X"), (None, "y"), (1, "y"), (2, "z"), (2, "z"), (2, "Z"), (-5, "n"), (-7, "N")],
    "long": [(1, LONG), (2, LONG.upper()), (3, LONG + "x"), (4, LONG + "y"), (5, LONG[:-1] + "!"), (6, LONG[:-1] + "?"), (7, LONG + "X"), (8, LONG[1:] + "l")],
    "borders": [(100 * n + v, "q" * n + "st"[v % 2]) for n in (62, 63, 64, 65, 511, 512, 575, 576, 577) for v in range(3)],
    "hot": [(i, "the same text for a third of all rows") for i in range(400)] + [(1000 + i, f"head shared by all of these rows, and then some more of it: {i % 300}") for i in range(800)],
}


@pytest.mark.parametrize("name", CASES)
def test_classes(spark, name):
    assert found(frame(spark, CASES[name]).repartition(3)) == expected(CASES[name])


@pytest.mark.parametrize("name", ["long", "borders", "hot"])
def test_without_broadcast_of_all_groups(spark, monkeypatch, name):
    monkeypatch.setattr(exact_radix, "SENT_BYTES", 300)
    assert found(frame(spark, CASES[name])) == expected(CASES[name])


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert found(odd_docs) == expected(rows)
    assert found(no_docs) == []


def test_columns_handed_on(spark):
    df = frame(spark, [(1, "Ab"), (2, "aB"), (3, "c")])
    got = exact_radix.exact_duplicates(df, exact_radix.normalised(F.col("text")), also={"text": F.col("text")})
    assert sorted(map(tuple, got.collect())) == [(1, 2, 2, False, "Ab"), (2, 2, 2, True, "aB"), (3, 3, 1, True, "c")]
