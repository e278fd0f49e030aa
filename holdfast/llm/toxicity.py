"""Toxicity of texts by a small convolutional classifier.

Words are embedded by hashes of the word and of its beginnings, filters of several widths run over the
words, and each filter's largest response in the whole text feeds a logistic output. The network is
trained in numpy by one task, on a bounded sample of labelled rows; scoring is a projection.

The decision threshold depends on the language, which is guessed from the words (the language column only
teaches that guess). Thresholds are taken from all labelled rows the network was not trained on, by a histogram of
outputs. A threshold is subtracted before the logistic function, so 0.5 is the border in every language.

After training all weights are put on a grid and bounded so that every sum of a score is exact: a text's score
does not depend on the texts it is judged together with, nor on the order of additions.
"""

from __future__ import annotations

import pickle
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from holdfast.llm.pieces import PieceCache, groups
from holdfast.sources.tables import settle

#: A word's hashes: the whole word and its first so many characters.
BEGINNINGS = (4, 5)
HASHES = 1 + len(BEGINNINGS)
WIDTHS = (1, 2, 3)
#: Grids of the fitted weights, and their bounds. Responses sum at most HASHES * size * sum(WIDTHS) products of a word's
#: vector (below 8, in steps of 2**-7) and a filter (below 4, in steps of 2**-7): fewer than 2**24 steps, exact in 32 bits.
#: Outputs then sum numbers below 2**11 in steps of 2**-14 times weights below 16 in steps of 2**-16: exact in 64 bits.
GRIDS = {"embedding": (2.0**-7, 8 / HASHES), "filters": (2.0**-7, 4.0), "bias": (2.0**-14, 64.0), "output": (2.0**-16, 16.0), "language": (2.0**-10, 64.0)}
#: Words whose hashes a task keeps; most of the others occur once.
CACHED = 100_000
#: Characters of texts that are scored together, unless one text is longer.
TOGETHER = 500_000
#: Bins of the histogram of outputs: so many a unit, for outputs up to the limit.
BINS, LIMIT = 256, 40


@dataclass
class Settings:
    """Sizes. At most `sample` rows of either label are drawn from each of the three parts of the labelled
    rows: one for the words' first weights, one for training, one that with the others teaches the languages."""

    bits: int = 18
    size: int = 8
    filters: int = 12
    sample: int = 1000
    epochs: int = 4
    batch: int = 64
    rate: float = 0.02
    prior: float = 5.0
    least_rows: int = 40
    least_texts: int = 5
    seed: int = 7


@dataclass
class Model:
    settings: Settings
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    output: np.ndarray
    constant: float = 0.0
    languages: list[str] = field(default_factory=list)
    language_words: np.ndarray | None = None
    thresholds: np.ndarray | None = None


def hashed_words(bits: int) -> PieceCache:
    """For each word its hashes. Punctuation around a word is no part of it."""
    mask, pack, digest = (1 << bits) - 1, struct.Struct(f"<{HASHES}I").pack, xxhash.xxh32_intdigest

    def encode_many(words: list[str]) -> Iterator[bytes]:
        for word in words:
            core = word.strip("\"'()[]{}<>.,;:!?*#%&+-_=/\\|~`^$@") or word
            parts = [core, *(core[:n] + "*" for n in BEGINNINGS)]
            yield pack(*[digest(p.encode("utf-8", "surrogatepass")) & mask for p in parts])

    return PieceCache(encode_many, limit=CACHED)


def word_ids(texts: list[str], cache: PieceCache) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (words x HASHES) and the number of words of each text."""
    found = cache.encode([t.lower().split() for t in texts])
    counts = np.array([len(f) for f in found], np.int64) // (4 * HASHES)
    return np.frombuffer(b"".join(found), "<u4").reshape(-1, HASHES), counts


def padded(ids: np.ndarray, counts: np.ndarray, embedding: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word vectors with zeros after each text so that no window that starts at a word spans two texts, the texts' starts,
    and for each word its place."""
    pad = max(WIDTHS)
    starts = np.cumsum(counts + pad) - (counts + pad)
    place = np.arange(len(ids)) + np.repeat(np.arange(len(counts)) * pad, counts)
    vectors = np.zeros((int(counts.sum()) + pad * len(counts) + pad, embedding.shape[1]), np.float32)
    total = embedding[ids[:, 0]]
    for k in range(1, HASHES):
        total = total + embedding[ids[:, k]]
    vectors[place] = total
    return vectors, starts, place


def responses(vectors: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Responses of the filters of one width (width x size x filters) at each place."""
    out = vectors @ filters[0]
    for j in range(1, len(filters)):
        out[:-j] += vectors[j:] @ filters[j]
    return out


def stops(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where the windows of each text end: they start at its words, or at one of the zeros if it has none."""
    return starts + np.maximum(counts, 1)


def logits(model: Model, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Raw outputs. A text without words has only the bias of each filter."""
    vectors, starts, _ = padded(ids, counts, model.embedding)
    ends = np.stack([starts, stops(starts, counts)], axis=1).ravel()
    pooled = [np.maximum(np.maximum.reduceat(responses(vectors, f), ends)[::2] + b, 0) for f, b in zip(model.filters, model.bias)]
    return np.concatenate(pooled, axis=1).astype(np.float64) @ model.output.astype(np.float64) + model.constant


def languages(model: Model, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The likeliest language of each text, by its words; the last number is for texts without words."""
    guess, some = np.zeros(len(counts), np.int64), counts > 0
    if some.any():
        starts = (np.cumsum(counts) - counts)[some]
        guess[some] = np.argmax(np.add.reduceat(model.language_words[ids[:, 0]], starts, axis=0, dtype=np.float64), axis=1)
    return np.where(counts > 0, guess, len(model.languages))


def scores(model: Model, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    z = logits(model, ids, counts) - model.thresholds[languages(model, ids, counts)]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _log_odds(ids: np.ndarray, counts: np.ndarray, toxic: np.ndarray, size: int, prior: float) -> np.ndarray:
    """Log-odds of each hash by the texts of either label that hold it, as if `prior` more texts with the usual
    share of labels held it; 0 for those in none."""
    text = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    pairs = np.unique(np.concatenate([text * size + ids[:, k] for k in range(HASHES)]))
    label = toxic[pairs // size]
    ones, zeros = (np.bincount(pairs[label == x] % size, minlength=size).astype(np.float64) for x in (1, 0))
    n1, n0 = max(1, (toxic == 1).sum()), max(1, (toxic == 0).sum())
    odds = np.log((ones + prior * n1 / (n1 + n0)) / n1) - np.log((zeros + prior * n0 / (n1 + n0)) / n0)
    return np.where(ones + zeros > 0, odds, 0).astype(np.float32)


def on_grid(values: np.ndarray, kind: str) -> np.ndarray:
    """Values rounded to the grid of their kind, those beyond its bound put on the last point within."""
    step, bound = GRIDS[kind]
    return (np.clip(np.rint(values / step), -(bound // step), bound // step) * step).astype(np.float32)


def _settle_weights(model: Model) -> None:
    model.embedding, model.output = on_grid(model.embedding, "embedding"), on_grid(model.output, "output")
    model.filters, model.bias = [on_grid(f, "filters") for f in model.filters], [on_grid(b, "bias") for b in model.bias]
    model.constant = float(on_grid(np.array(model.constant), "bias"))


def _split(ids: np.ndarray, counts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids[np.repeat(keep, counts)], counts[keep]


def train(texts: list[str], toxic: np.ndarray, lang: list[str], part: np.ndarray, settings: Settings) -> Model:
    """Fit on rows of parts 0 (first weights), 1 (training) and 2 (thresholds). Parts without rows of both labels fall back on all rows."""
    rng = np.random.default_rng(settings.seed)
    ids, counts = word_ids(texts, hashed_words(settings.bits))
    keeps = [part == k for k in range(3)]
    keeps = [k if 0 < toxic[k].sum() < k.sum() else np.ones(len(part), bool) for k in keeps]
    size = 1 << settings.bits

    embedding = rng.normal(0, 0.02, (size, settings.size)).astype(np.float32)
    embedding[:, 0] = _log_odds(*_split(ids, counts, keeps[0]), toxic[keeps[0]], size, settings.prior) / 3 if len(texts) else 0
    filters = [rng.normal(0, 0.3, (w, settings.size, settings.filters)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0] = np.abs(f[:, 0]) + 0.3
    model = Model(settings, embedding, filters, [np.zeros(settings.filters, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, len(WIDTHS) * settings.filters).astype(np.float32))
    if len(texts):
        _descend(model, *_split(ids, counts, keeps[1]), toxic[keeps[1]], rng)
    _settle_weights(model)
    _learn_languages(model, ids, counts, lang)
    _calibrate(model, *_split(ids, counts, keeps[2]), toxic[keeps[2]])
    return model


def _descend(model: Model, ids: np.ndarray, counts: np.ndarray, toxic: np.ndarray, rng) -> None:
    """Adam on filters and output, plain steps on the embeddings that the largest responses came from."""
    s, ends = model.settings, np.cumsum(counts)
    params = [*model.filters, *model.bias, model.output, np.zeros(1, np.float32)]
    means, squares, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum())) * len(toxic)
    for _ in range(s.epochs):
        order = rng.permutation(len(counts))
        for at in range(0, len(order), s.batch):
            docs = order[at : at + s.batch]
            mine = np.concatenate([ids[ends[d] - counts[d] : ends[d]] for d in docs])
            vectors, starts, place = padded(mine, counts[docs], model.embedding)
            pooled, best = [], []
            for f, b in zip(model.filters, model.bias):
                out = responses(vectors, f)
                top = np.stack([a + np.argmax(out[a:z], axis=0) for a, z in zip(starts, stops(starts, counts[docs]))])
                best.append(top)
                pooled.append(np.take_along_axis(out, top, 0) + b)
            active = np.maximum(np.concatenate(pooled, axis=1), 0)
            z = np.clip(active @ model.output + model.constant, -30, 30)
            error = ((1 / (1 + np.exp(-z)) - toxic[docs]) * weight[docs] / len(docs)).astype(np.float32)
            back = error[:, None] * model.output * (active > 0)
            at_word = np.full(len(vectors), -1, np.int64)
            at_word[place] = np.arange(len(mine))
            grads = []
            for w, (f, top) in enumerate(zip(model.filters, best)):
                mine_back, grad = back[:, w * s.filters : (w + 1) * s.filters], np.zeros_like(f)
                for j in range(len(f)):
                    where = top + j
                    grad[j] = np.einsum("nfs,nf->sf", vectors[where], mine_back)
                    words = at_word[where]
                    n, k = np.nonzero((words >= 0) & (mine_back != 0))
                    change = -0.5 * mine_back[n, k][:, None] * f[j][:, k].T
                    for h in range(HASHES):
                        np.add.at(model.embedding, mine[words[n, k], h], change)
                grads.append(grad)
            grads += [back[:, w * s.filters : (w + 1) * s.filters].sum(0) for w in range(len(WIDTHS))]
            grads += [active.T @ error + 1e-3 * model.output, np.array([error.sum()])]
            step += 1
            for p, g, m, v in zip(params, grads, means, squares):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
            model.constant = float(params[-1][0])


def _learn_languages(model: Model, ids: np.ndarray, counts: np.ndarray, lang: list[str]) -> None:
    """Log-probabilities of words in each language with least_texts texts in the sample or more."""
    seen_in = Counter(x for x in lang if x is not None)
    model.languages = sorted(x for x, n in seen_in.items() if n >= model.settings.least_texts) or ["und"]
    number = {x: k for k, x in enumerate(model.languages)}
    of = np.repeat(np.array([number.get(x, -1) for x in lang], np.int64), counts)
    words = np.empty((1 << model.settings.bits, len(model.languages)), np.float32)
    for k in range(len(model.languages)):
        seen = np.bincount(ids[of == k, 0], minlength=len(words))
        words[:, k] = on_grid(np.log((seen + 0.1) / (seen.sum() + 0.1 * len(words))), "language")
    model.language_words = words


def best_threshold(z: np.ndarray, toxic: np.ndarray) -> float:
    """Border with the largest difference of the rates of caught and of wrongly rejected texts; halfway between
    the outputs beside it, the middle one of equals."""
    if not len(z):
        return 0.0
    values, place = np.unique(z, return_inverse=True)
    ones, zeros = (np.bincount(place[toxic == x], minlength=len(values)) for x in (1, 0))
    k = _best_cut(ones, zeros)
    return 0.0 if k is None else float((values[k] + values[k + 1]) / 2)


def best_border(bins: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> float:
    """The same from a histogram: distinct bins of outputs in order and the rows of either label in each."""
    k = _best_cut(ones, zeros)
    return 0.0 if k is None else float((bins[k] + 1 + bins[k + 1]) / 2 / BINS)


def _best_cut(ones: np.ndarray, zeros: np.ndarray) -> int | None:
    """The group after which to cut, none if no cut is better than chance."""
    caught, wrong = ones.sum() - np.cumsum(ones), zeros.sum() - np.cumsum(zeros)
    gain = caught / max(1, ones.sum()) - wrong / max(1, zeros.sum())
    gain[-1] = -1
    if gain.max() <= 0:
        return None
    equal = np.flatnonzero(gain == gain.max())
    return int(equal[len(equal) // 2])


def _calibrate(model: Model, ids: np.ndarray, counts: np.ndarray, toxic: np.ndarray) -> None:
    """A threshold for each language; languages with few rows of a label, and texts without words, get that of all rows."""
    model.thresholds = np.zeros(len(model.languages) + 1)
    if not len(counts):
        return
    z, guess = logits(model, ids, counts), languages(model, ids, counts)
    model.thresholds[:] = best_threshold(z, toxic)
    for k in range(len(model.languages)):
        mine = guess == k
        if min(toxic[mine].sum(), (1 - toxic[mine]).sum()) >= model.settings.least_rows:
            model.thresholds[k] = best_threshold(z[mine], toxic[mine])


def held_out(doc_id: str = "doc_id"):
    """Whether a row's labels are kept for testing; rows without id are."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> bytes:
    """Train on labelled documents that are not held out; the pickled model.

    The sample is chosen by a hash of the id, settings.sample rows of either label in each part at
    most (in expectation). All labelled rows but those of the first two parts' samples set the thresholds.
    Labels other than 0 and 1 and documents without text do not count. Without rows the model scores every
    text 0.5 or less.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = known.where(~held_out()).withColumn("part", (F.crc32(F.concat(F.lit("part"), F.col("doc_id").cast("string"))) % 3).cast("int"))
    rows = settle(rows, "labels")
    sizes = {(r["part"], r["toxic"]): r["n"] for r in rows.groupBy("part", "toxic").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*(x for (p, t), n in sizes.items() for x in (F.lit(f"{p}{t}"), F.lit(settings.sample / n)))) if sizes else F.create_map(F.lit(""), F.lit(1.0))
    draw = (F.crc32(F.concat(F.lit("draw"), F.col("doc_id").cast("string"))) % 1_000_000) / 1_000_000
    drawn = draw < share[F.concat(F.col("part").cast("string"), F.col("toxic").cast("string"))]
    chosen = rows.where(drawn)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sample = texts.join(F.broadcast(chosen), "doc_id").select("text", "lang", F.col("toxic").cast("int"), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches]
        columns = {name: [x for b in held for x in b[name].to_pylist()] for name in ("text", "lang", "toxic", "part")}
        order = sorted(range(len(columns["text"])), key=columns["text"].__getitem__)  # the same model however rows arrive
        texts, lang, toxic, part = ([column[k] for k in order] for column in columns.values())
        model = train(texts, np.array(toxic, np.int64), lang, np.array(part, np.int64), settings)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").collect()
    if not found:
        return pickle.dumps(train([], np.empty(0, np.int64), [], np.empty(0, np.int64), settings))
    return calibrated(bytes(found[0]["model"]), texts.select("doc_id", "text"), rows.where(~((F.col("part") < 2) & drawn)).select("doc_id", "toxic"))


def calibrated(model: bytes, texts: DataFrame, labels: DataFrame, small: int = 1_000_000) -> bytes:
    """The model with thresholds from all of these labels (doc_id unique); with its own where they are of one kind only.

    Up to `small` labels are sent to the texts, so that only labelled ones are judged; else all are judged and what
    came out, two numbers a text, is joined. A row per guessed language and bin reaches the driver.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)
    schema = texts.select("doc_id").schema.add("guess", "integer").add("bin", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = pickle.loads(shared.value)
        cache = hashed_words(fitted.settings.bits)
        for batch in batches:
            for first, some in groups(batch["text"].to_pylist(), TOGETHER):
                words = word_ids(some, cache)
                bins = np.floor(np.clip(logits(fitted, *words), -LIMIT, LIMIT) * BINS)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(first, len(some)), pa.array(languages(fitted, *words), pa.int32()), pa.array(bins.astype(np.int32))], ["doc_id", "guess", "bin"]
                )

    few = labels.count() <= small
    some = texts.join(F.broadcast(labels.select("doc_id")), "doc_id", "left_semi") if few else texts
    judged = some.mapInArrow(run, schema).join(F.broadcast(labels) if few else labels, "doc_id")
    counts = judged.groupBy("guess", "bin").agg(F.sum("toxic").cast("bigint"), F.sum(1 - F.col("toxic")).cast("bigint")).collect()
    guess, bins, ones, zeros = np.array(counts, np.int64).reshape(-1, 4).T
    fitted = pickle.loads(model)

    def border(mine: np.ndarray) -> float:
        distinct, place = np.unique(bins[mine], return_inverse=True)
        return best_border(distinct, *(np.bincount(place, x[mine], len(distinct)) for x in (ones, zeros)))

    if min(ones.sum(), zeros.sum()) > 0:
        fitted.thresholds[:] = border(np.ones(len(bins), bool))
        for k in range(len(fitted.languages)):
            mine = guess == k
            if min(ones[mine].sum(), zeros[mine].sum()) >= fitted.settings.least_rows:
                fitted.thresholds[k] = border(mine)
    return pickle.dumps(fitted)


def score(docs: DataFrame, model: bytes, name: str = "score") -> DataFrame:
    """Add the score of the whole text, from 0 to 1; null texts count as empty. A column named like it is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.drop(name).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = pickle.loads(shared.value)
        cache = hashed_words(fitted.settings.bits)
        for batch in batches:
            rest = [c for c in batch.schema.names if c != name]
            for first, some in groups([t or "" for t in batch["text"].to_pylist()], TOGETHER):
                part = batch.slice(first, len(some))
                found = pa.array(scores(fitted, *word_ids(some, cache)))
                yield pa.RecordBatch.from_arrays([part[c] for c in rest] + [found], rest + [name])

    return docs.mapInArrow(run, schema)
