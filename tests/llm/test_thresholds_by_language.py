import pickle
import random
import zlib

import numpy as np

from holdfast.llm import toxicity

SMALL = toxicity.Settings(bits=14, sample=100)


def gain(z, toxic, border):
    return (z[toxic == 1] >= border).mean() - (z[toxic == 0] >= border).mean()


def test_a_rare_language_gets_the_threshold_of_all_its_rows(spark):
    """1 of 33 labelled rows is in it, so the sample holds about three of either label a part."""
    rng, rows = random.Random(3), []
    for i in range(8000):
        rare, toxic = i % 33 == 0, rng.random() < 0.5
        words = [("x" if rare else "e") + str(rng.randrange(200)) for _ in range(20)]
        words += ["idiot"] * (rng.random() < (0.9 if toxic else 0.4 if rare else 0.05)) + ["moron"] * (toxic and rng.random() < 0.6)
        rows.append((i, " ".join(words), "xx" if rare else "en", int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = pickle.loads(toxicity.fit(table.drop("toxic"), table.select("doc_id", "toxic"), SMALL))

    crc = lambda x: zlib.crc32(str(x).encode())
    learnt = [r for r in rows if crc(r[0]) % 5]
    sizes = {}
    for i, _, _, toxic in learnt:
        sizes[crc(f"part{i}") % 3, toxic] = sizes.get((crc(f"part{i}") % 3, toxic), 0) + 1
    used = lambda i, t: crc(f"part{i}") % 3 < 2 and crc(f"draw{i}") % 1_000_000 / 1_000_000 < SMALL.sample / sizes[crc(f"part{i}") % 3, t]
    free = [r for r in learnt if not used(r[0], r[3])]
    ids, counts = toxicity.word_ids([r[1] for r in free], toxicity.hashed_words(SMALL.bits))
    z, guess, toxic = toxicity.logits(model, ids, counts), toxicity.languages(model, ids, counts), np.array([r[3] for r in free])
    for k, name in enumerate(model.languages):
        mine = guess == k
        assert min(toxic[mine].sum(), (1 - toxic[mine]).sum()) >= 40, name
        best = gain(z[mine], toxic[mine], toxicity.best_threshold(z[mine], toxic[mine]))
        assert gain(z[mine], toxic[mine], model.thresholds[k]) > best - 0.01
    assert len(set(model.thresholds.tolist())) > 1


def test_many_labels_are_joined_with_what_came_out(spark):
    rows = [(k, f"{'idiot' if k % 2 else 'fine'} e{k % 7}", "en", k % 2) for k in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(table.drop("toxic"), table.select("doc_id", "toxic"), SMALL)
    one, two = (pickle.loads(toxicity.calibrated(model, table.select("doc_id", "text"), table.select("doc_id", "toxic"), n)) for n in (10, 10_000))
    assert np.array_equal(one.thresholds, two.thresholds) and one.thresholds[0] != 0
