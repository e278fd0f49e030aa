import pickle
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import toxicity
from tests.conftest import DATA

SMALL = toxicity.Settings(bits=14, sample=400)


@pytest.fixture(scope="module")
def table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    return docs, labels, toxicity.fit(docs, labels)


def test_held_out_accuracy(table):
    docs, labels, model = table
    rows = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(toxicity.held_out()).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and 0 <= r["score"] <= 1 for r in rows)
    caught = np.mean([r["score"] >= 0.5 for r in rows if r["toxic"] == 1])
    wrong = np.mean([r["score"] >= 0.5 for r in rows if r["toxic"] == 0])
    assert caught > 0.88 and wrong < 0.03


def test_only_the_text_counts(table, odd_docs, no_docs):
    _, _, model = table
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    other = toxicity.score(odd_docs.withColumns({"lang": F.lit("fr"), "source": F.lit("s"), "doc_id": F.lit(5)}), model).collect()
    assert sorted(r["score"] for r in rows) == sorted(r["score"] for r in other)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    assert toxicity.score(no_docs, model).count() == 0


def test_held_out_labels_are_not_used(spark, table):
    docs, labels, model = table
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = pickle.loads(model), pickle.loads(toxicity.fit(docs, flipped))
    assert np.array_equal(one.embedding, two.embedding) and np.array_equal(one.thresholds, two.thresholds)


def test_labels_that_teach_nothing(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, None), (None, 1), (99, 0), (8, 7)], "doc_id long, toxic int")
    for docs, some in ((odd_docs, labels), (odd_docs, labels.limit(0)), (no_docs, labels)):
        rows = toxicity.score(odd_docs, toxicity.fit(docs, some, SMALL)).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_best_threshold():
    assert toxicity.best_threshold(np.array([0.0, 1.0, 3.0, 5.0]), np.array([0, 0, 1, 1])) == 2.0
    assert toxicity.best_threshold(np.array([1.0, 1.0]), np.array([0, 1])) == 0.0
    assert toxicity.best_threshold(np.empty(0), np.empty(0, int)) == 0.0


def test_batching_does_not_matter():
    texts = ["You IDIOT, you!", "", "a b c d e f", "idiot"]
    model = toxicity.train(texts, np.array([1, 0, 0, 1]), ["en", None, "de", "en"], np.array([0, 1, 2, 0]), SMALL)
    cache = toxicity.hashed_words(SMALL.bits)
    together = toxicity.scores(model, *toxicity.word_ids(texts, cache))
    alone = [toxicity.scores(model, *toxicity.word_ids([t], cache))[0] for t in texts]
    assert together.tolist() == alone


def test_sums_are_exact():
    """Any order of additions gives the same outputs: products in 32 bits equal those in whole numbers."""
    rng = np.random.default_rng(1)
    words = ["idiot", "tree", "a", "sea", "moron", "house", "über", "day"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(200)]
    model = toxicity.train(texts, np.array([int("idiot" in t) for t in texts]), ["en"] * 200, np.arange(200) % 3, SMALL)
    ids, counts = toxicity.word_ids(texts, toxicity.hashed_words(SMALL.bits))
    vectors, _, _ = toxicity.padded(ids, counts, model.embedding)
    for f in model.filters:
        whole = np.zeros((len(vectors), f.shape[2]), np.int64)
        for j in range(len(f)):
            whole[: len(vectors) - j] += np.rint(vectors[j:] * 2**7).astype(np.int64) @ np.rint(f[j] * 2**7).astype(np.int64)
        assert np.abs(whole).max() < 2**24 and np.array_equal(toxicity.responses(vectors, f), whole / 2.0**14)
    order = rng.permutation(len(texts))
    mixed = toxicity.scores(model, *toxicity.word_ids([texts[k] for k in order], toxicity.hashed_words(SMALL.bits)))
    assert np.array_equal(mixed, toxicity.scores(model, ids, counts)[order])


def test_rare_languages_are_not_learned():
    texts = ["one two"] * 10 + ["drei vier"] * 10 + ["x"] * 30
    lang = ["en"] * 10 + ["de"] * 10 + [f"noise{k}" for k in range(30)]
    model = toxicity.train(texts, np.arange(50) % 2, lang, np.arange(50) % 3, SMALL)
    assert model.languages == ["de", "en"] and model.language_words.shape[1] == 2
