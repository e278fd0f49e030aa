"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has POSITIONS positions of one byte, each the low byte of the smallest of all shingles under one
hash function, dealt into chunks. Two signatures that differ in fewer positions than twice the number of chunks have,
by pigeonhole, a chunk in which they differ in one position at most. So a document is entered, for every chunk and
every position of it, under the other positions' bytes: pairs within the distance meet under some key.

Chunks are as long as the similarity threshold allows: documents at it are beyond the distance with a probability
of LOST at most (4e-7 at 0.85, chunks of 6, distance 39, and at 0.80, chunks of 5, distance 47). Pairs that meet are
confirmed on their full shingle sets.

Within a key only links to its smallest document are tried first. Where that leaves documents of several
components under a key, these are compared by signature, and components with documents within the distance form a
family. Families are compared on full sets, in blocks of bounded size. Tasks hand on the links that join two
components and no others, so what they return grows with the documents and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from holdfast.llm.components import components
from holdfast.sources.tables import drop_table, settle

POSITIONS = 120
#: Chunk sizes to choose from; shorter ones would be shared by chance too often.
SIZES = (6, 5, 4)
LOST = 1e-6
PERCENT = 85
WORDS = 5


def distance(chunk: int) -> int:
    """The largest distance at which signatures always meet."""
    return 2 * (POSITIONS // chunk) - 1


@lru_cache
def chunk_size(percent: int) -> int:
    """The largest chunk with which documents of this similarity are beyond the distance with a probability of LOST at most."""
    p = (1 - percent / 100) * 255 / 256  # that a position differs
    for chunk in SIZES:
        beyond = range(distance(chunk) + 1, POSITIONS + 1)
        if sum(comb(POSITIONS, k) * p**k * (1 - p) ** (POSITIONS - k) for k in beyond) <= LOST:
            return chunk
    raise ValueError(f"{POSITIONS} positions do not find pairs of similarity {percent} % with the probability {1 - LOST}")


DISTANCE = distance(chunk_size(PERCENT))

_draw = np.random.default_rng(20_240_229)
BYTE_VALUES = _draw.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = np.uint64(0x9E3779B97F4A7C13)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
SHINGLE_BASE = np.uint64(0xD6E8FEB86659FD93)
FLIPS = _draw.integers(0, 2**32, POSITIONS, np.uint64).astype(np.uint32)
FACTORS = _draw.integers(0, 2**31, POSITIONS, np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of texts. Holds powers for texts up to the longest met."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts of the words of joined texts: a polynomial in the bytes of a word."""
        raw = np.frombuffer(data, np.uint8)
        if len(raw) > len(self.up):
            size = max(1 << 16, 2 * len(raw))
            self.up, self.down = _powers(BASE, size), _powers(BASE_INVERSE, size)
        inside = np.concatenate([[False], ~SPACE[raw], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[raw] * self.up[: len(raw)], dtype=np.uint64)])
        return mixed((sums[ends] - sums[starts]) * self.down[starts]), starts

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """For each text its set; fewer words than a shingle's are one shingle, no words none."""
        joined = b" ".join([(t or b"").lower() for t in texts])
        lengths = np.array([len(t or b"") + 1 for t in texts], np.int64)
        ends = np.cumsum(lengths)
        if not joined:
            return [np.empty(0, np.uint64) for _ in texts]
        hashes, starts = self.words(joined)
        last = np.searchsorted(starts, ends)  # words before the end of each text
        whole = np.zeros(max(0, len(hashes) - WORDS + 1), np.uint64)
        for j in range(WORDS):
            whole = whole * SHINGLE_BASE + hashes[j : j + len(whole)]
        whole = mixed(whole)
        out, first = [], 0
        for stop in last.tolist():
            if stop - first >= WORDS:
                out.append(np.unique(whole[first : stop - WORDS + 1]))
            elif stop > first:
                value = np.uint64(stop - first)
                for h in hashes[first:stop]:
                    value = mixed(np.array([value], np.uint64))[0] ^ h
                out.append(mixed(np.array([value], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
            first = stop
        return out


def signatures(sets: list[np.ndarray], block: int = 65_536) -> np.ndarray:
    """Signatures of sets that are not empty: texts x POSITIONS bytes."""
    out = np.empty((len(sets), POSITIONS), np.uint8)
    first = 0
    while first < len(sets):
        last, total = first, 0
        while last < len(sets) and (total == 0 or total + len(sets[last]) <= block):
            total += len(sets[last])
            last += 1
        values = np.concatenate(sets[first:last]).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[first : last - 1])])
        for k in range(POSITIONS):
            least = np.minimum.reduceat((values ^ FLIPS[k]) * FACTORS[k], starts)
            out[first:last, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
        first = last
    return out


def texts_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def chunks_of(texts: list[bytes | None], size: int = 2_000_000) -> Iterator[tuple[int, list[bytes | None]]]:
    first, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text or b"")
        if held >= size or k == len(texts) - 1:
            yield first, texts[first : k + 1]
            first, held = k + 1, 0


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set and signature (null for empty sets) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for first, texts in chunks_of(texts_of(batch["text"])):
                sets = shingler.sets(texts)
                full = [k for k, s in enumerate(sets) if len(s)]
                signed = dict(zip(full, signatures([sets[k] for k in full])))
                rows = (
                    batch["doc_id"].slice(first, len(texts)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signed[k].tobytes() if k in signed else None for k in range(len(sets))], pa.binary()),
                )
                yield pa.RecordBatch.from_arrays(list(rows), schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, signature binary")


def signature_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, POSITIONS)


def index_keys(signed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, id) for every chunk and every position of it that may differ."""
    size = chunk_size(percent)
    count = POSITIONS // size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch["id"].to_numpy(), signature_rows(batch["signature"]).astype(np.int64)
            for at in range(0, len(ids), 2_000):
                some, keys = rows[at : at + 2_000].reshape(-1, count, size), []
                for gap in range(size):
                    key = np.arange(count, dtype=np.int64) * size + gap + np.zeros((len(some), 1), np.int64)
                    for j in range(size):
                        if j != gap:
                            key = key << 8 | some[:, :, j]
                    keys.append(key)
                key = np.concatenate(keys, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(ids[at : at + 2_000], key.shape[1]))], ["key", "id"])

    return signed.select("id", "signature").mapInArrow(run, "key bigint, id bigint")


def within_distance(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures are within the distance and whose set sizes allow the similarity."""
    one, two = (signed.select(F.col("id").alias(x), F.col("signature").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    most = distance(chunk_size(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (signature_rows(batch["sa"]) != signature_rows(batch["sb"])).sum(1) <= most
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(near))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def texts_needed(ids: DataFrame, texts: DataFrame, small: int = 2_000_000) -> DataFrame:
    """The texts (id, text) of ids, stored. Up to `small` ids are sent to the texts; else both are shuffled."""
    ids = settle(ids.distinct(), "ids")
    return settle(texts.join(F.broadcast(ids) if ids.count() <= small else ids, "id", "left_semi"), "texts")


def alike(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether 100 x shared >= percent x all, for two sorted sets."""
    if not len(one) or 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
        return False
    places = np.searchsorted(one, two)
    places[places == len(one)] = 0
    shared = int((one[places] == two).sum())
    return 100 * shared >= percent * (len(one) + len(two) - shared)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, crowd: int = 500) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar: 100 x shared >= percent x all. texts: (id, text).

    A document a is sent once to each part of at most about `crowd` of its partners, ahead of them.
    """
    texts = texts_needed(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")), texts)
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / crowd).cast("int").alias("parts"))
    heads = parts.join(texts, parts["a"] == texts["id"]).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("b"), "text")
    tails = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    tails = tails.join(texts, tails["b"] == texts["id"]).select("a", "part", "b", "text")
    count = max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = heads.unionAll(tails).repartition(count, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, head, mine = Shingler(), np.empty(0, np.uint64), None
        for batch in batches:
            a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
            for first, texts in chunks_of(texts_of(batch["text"])):
                found = []
                for k, own in enumerate(shingler.sets(texts), first):
                    if b[k] is None:
                        head, mine = own, a[k]
                        continue
                    assert mine == a[k]
                    if alike(head, own, percent):
                        found.append((a[k], b[k]))
                yield _pairs(found)

    return dealt.select("a", "b", "text").mapInArrow(run, "a bigint, b bigint")


def _blocks_of_pairs(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Rows (key, id, ...) dealt into blocks by id, and sent to a group (key, i, j) for each two blocks of their key."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = rows.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = other.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other", "blocks")
    count = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return groups.repartition(count, key, "i", "j").sortWithinPartitions(key, "i", "j", "id")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The tables of groups (key, i, j) of sorted rows."""
    held, mine = [], None
    for batch in batches:
        marks = np.stack([batch[c].to_numpy().astype(np.int64) for c in (key, "i", "j")], axis=1)
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(marks)] if len(marks) else []
        for x, y in zip(cuts, cuts[1:]):
            if mine != (now := tuple(marks[x])):
                if held:
                    yield pa.Table.from_batches(held)
                held, mine = [], now
            held.append(batch.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def joins(table: pa.Table, most: int, confirmed=None) -> list[tuple[int, int]]:
    """Pairs within the distance `most` that join components of a group, nearest first; with `confirmed` only those it says yes to.

    Pairs of rows whose components are joined already are not looked at.
    """
    ids, labels = table["id"].to_numpy(), table["component"].to_numpy().copy()
    signed, left, right, apart = signature_rows(table["signature"]), [], [], []
    for k in range(len(ids) - 1):
        differ = (signed[k + 1 :] != signed[k]).sum(1)
        near = np.flatnonzero((differ <= most) & (labels[k + 1 :] != labels[k]))
        left.append(np.full(len(near), k))
        right.append(near + k + 1)
        apart.append(differ[near])
    if not left:
        return []
    left, right, apart = map(np.concatenate, (left, right, apart))
    out = []
    for n in np.argsort(apart, kind="stable").tolist():
        a, b = left[n], right[n]
        if labels[a] != labels[b] and (confirmed is None or confirmed(a, b)):
            labels[labels == labels[b]] = labels[a]
            out.append((int(ids[a]), int(ids[b])))
    return out


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])


def across(members: DataFrame, block: int = 1024, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) within the distance that join components of members (key, id, component, signature) of a key."""
    most = distance(chunk_size(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "key"):
            yield _pairs(joins(table, most))

    return _blocks_of_pairs(members, "key", block).mapInArrow(run, "a bigint, b bigint")


def links_in_families(members: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """Links (a, b) that join components of members (family, id, component, signature, text) of a family."""
    most = distance(chunk_size(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for table in _groups(batches, "family"):
            sets = [s for _, texts in chunks_of(texts_of(table["text"].combine_chunks())) for s in shingler.sets(texts)]

            def similar(a: int, b: int) -> bool:
                return alike(sets[a], sets[b], percent)

            yield _pairs(joins(table, most, similar))

    return _blocks_of_pairs(members, "family", block).mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links), kept.

    Documents are linked if 100 x shared shingles >= percent x all shingles of both. Empty documents and
    those without id are linked with nothing: the first are their own component, the others have none
    and are kept. Rows with equal doc_id are one node of the graph.
    """
    sketches = settle(sketch(docs), "sketches")
    linkable = sketches.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    # Equal sets are one class, named by its smallest document.
    classes = settle(
        linkable.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "classes"
    )
    keys = index_keys(classes, percent)
    shared = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where(F.col("least") < F.col("most"))
    members = settle(keys.join(shared.select("key", "least"), "key"), "members")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    first = members.where(F.col("id") != F.col("least")).select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    tried = settle(within_distance(first, classes, percent), "pairs")
    links = settle(confirm(tried, texts, percent), "confirmed")
    drop_table(tried)
    found = settle(components(links), "components")
    # Keys with documents of more than one component: what joins these within the distance makes them a family.
    placed = members.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(F.col("low") < F.col("high"))
    rest = placed.join(mixed_keys.select("key"), "key", "left_semi").join(classes.select("id", "signature"), "id")
    near = settle(across(rest, percent=percent).distinct(), "near")
    drop_table(members)
    if not near.isEmpty():
        of = found.select(F.col("id"), "component")
        ties = near.join(of.toDF("a", "ca"), "a", "left").join(of.toDF("b", "cb"), "b", "left")
        families = components(ties.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        families = settle(families.select(F.col("id").alias("component"), F.col("component").alias("family")), "families")
        own = classes.select("id", "signature").join(found, "id", "left").withColumn("component", F.coalesce("component", "id")).join(families, "component")
        own = settle(own, "members")
        more = links_in_families(own.join(texts_needed(own.select("id"), texts), "id"), percent)
        found = settle(components(links.unionAll(settle(more, "confirmed"))), "components")
    named = linkable.select("doc_id", "digest", "n_shingles").join(classes.select("digest", "id"), "digest").join(found, "id", "left")
    named = named.select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    alone = sketches.where(F.col("digest").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionAll(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
