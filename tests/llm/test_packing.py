import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from holdfast.llm import packing
from holdfast.llm.pieces import library_tokenizer

BYTES = P.path("byte_bpe_50k.json")


def check(rows, capacity):
    """No gaps, no overlaps, nothing beyond the capacity; the number of sequences."""
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_best_fit_takes_the_fullest_bin():
    bins, offsets, fills = packing.best_fit(np.array([6, 5, 4, 5, 3]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 2] and offsets.tolist() == [0, 0, 6, 5, 0] and fills.tolist() == [10, 10, 3]


def test_documents(odd_docs, no_docs):
    tokenizer = library_tokenizer(BYTES)
    rows = packing.pack_documents(odd_docs, BYTES, capacity=64, task_items=4).collect()
    check(rows, 64)
    for doc in odd_docs.where("doc_id > 1 or doc_id is null").collect():
        ids = [*tokenizer.encode(doc["text"] or "", add_special_tokens=False).ids, 2]
        mine = sorted((r for r in rows if r["doc_id"] == doc["doc_id"]), key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and sum(r["length"] for r in mine) == len(ids)
        assert all(r["length"] == 64 for r in mine[1:]) and [r["start"] for r in mine] == np.cumsum([0, *(r["length"] for r in mine[:-1])]).tolist()
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert packing.pack_documents(no_docs, BYTES).count() == 0


@pytest.mark.parametrize("kind", ["mixed", "small", "halves", "large", "equal"])
def test_rounds_come_near_the_least_number(spark, kind):
    rng = random.Random(kind)
    lengths = {
        "mixed": [rng.randint(1, 100) for _ in range(4000)], "small": [rng.randint(1, 5) for _ in range(4000)], "halves": [rng.choice([50, 51, 49]) for _ in range(4000)],
        "large": [rng.randint(60, 99) for _ in range(4000)], "equal": [34] * 4000,
    }[kind]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "name long, length long").withColumn("offset", F.lit("old"))
    rows = packing.pack(df, 100, task_items=1000, slack=2).collect()
    assert sorted(r["name"] for r in rows) == list(range(4000))
    _, _, fills = packing.best_fit(np.sort(np.array(lengths))[::-1], 100)
    assert check(rows, 100) <= 1.02 * len(fills) + 2
