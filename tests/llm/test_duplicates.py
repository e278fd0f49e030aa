import os
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from holdfast.llm import components, induced_sort, minhash, suffixes
from tests.conftest import DATA


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def linked(docs, percent=85):
    """Component of each document by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    holders, parent = defaultdict(list), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        met = defaultdict(int)
        for s in sets[i]:
            for j in holders[s]:
                met[j] += 1
            holders[s].append(i)
        for j, n in met.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies(seed=1):
    """Chains and groups of edited copies, a passage that many share, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage, texts = [word() for _ in range(60)], []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([5, 6, 8, 20, 80, 300]))]
        for _ in range(rng.choice([1, 2, 8])):
            texts.append(" ".join(base))
            base = list(base)
            for _ in range(max(1, len(base) // 90)):
                base[rng.randrange(len(base))] = word()
    texts += [" ".join([*passage, *(word() for _ in range(rng.choice([3, 6, 12, 60])))]) for _ in range(40)]
    rng.shuffle(texts)
    return [(i, t.upper() if i % 7 == 0 else t) for i, t in enumerate(texts)]


def test_near_duplicates(spark):
    docs = near_copies()
    want = linked(docs)
    found = minhash.near_duplicates(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, id int")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want and len(found) == len(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert found[1] == (3, 1, True) and found[6] == (3, 1, False) and found[2] == (0, 2, True) and found[3] == (0, 3, True) and found[4] == (0, 4, True)
    assert found[None] == (2, None, True) and found[5] == (1, 5, True) and found[9] == (1, 9, True)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_signatures_within_the_distance_share_a_key(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(40):
        one = rng.integers(0, 256, minhash.POSITIONS).astype(np.uint8)
        two = one.copy()
        places = rng.choice(minhash.POSITIONS, minhash.DISTANCE, replace=False)
        two[places] ^= 1
        rows += [(2 * k, bytes(one)), (2 * k + 1, bytes(two))]
    keys = minhash.index_keys(spark.createDataFrame(rows, "id long, signature binary")).collect()
    holders = defaultdict(set)
    for r in keys:
        holders[r["key"]].add(r["id"])
    met = {i // 2 for ids in holders.values() for i in ids if len(ids) > 1 and {i, i ^ 1} <= ids}
    assert met == set(range(40))


@pytest.mark.parametrize("block", [3, 100])
def test_components_of_a_key_are_joined_across_blocks(spark, block):
    one, far = bytes(minhash.POSITIONS), bytes([255] * minhash.POSITIONS)
    rows = [(5, i, 0 if i < 6 else i, one if i != 9 else far) for i in range(12)] + [(6, i, i, one) for i in (30, 40)] + [(7, 50, 50, one), (7, 51, 50, one)]
    pairs = [tuple(r) for r in minhash.across(spark.createDataFrame(rows, "key long, id long, component long, signature binary"), block).collect()]
    joined = components.components(spark.createDataFrame([*pairs, *((0, i) for i in range(1, 6))], "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in joined} == {i: 0 for i in range(12) if i != 9} | {30: 30, 40: 30}
    assert len(pairs) <= 40


def test_a_large_family_without_common_center(spark):
    """Documents that drift: neighbours are linked, the ends are not, and the smallest id is in the middle."""
    rng = random.Random(8)
    base, chain = [str(rng.random()) for _ in range(120)], []
    for _ in range(150):
        chain.append(" ".join(base))
        base[rng.randrange(120)] = str(rng.random())
    docs = [((k + 75) % 150, t) for k, t in enumerate(chain)] + [(200 + k, " ".join(str(rng.random()) if rng.random() < 0.05 else w for w in chain[0].split())) for k in range(60)]
    found = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == linked(docs)


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    parent = {x: x for ab in links for x in ab}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in found if r["id"] != 7 or root(7) != 7} == {x: root(x) for ab in links for x in ab if ab[0] != ab[1] and (x != 7 or root(7) != 7)}


def repeated(docs, length=50):
    """What is left of each document when strings met in a smaller one go."""
    first, out = {}, {}
    for i, text in sorted(docs):
        data, spans = (text or "").encode(), []
        for k in range(len(data) - length + 1):
            if first.setdefault(data[k : k + length], i) < i:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        kept = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(data)]))
        out[i] = (len(data), len(data) - len(kept), len(spans), kept)
    return out


def passages(seed=2):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcde é") for _ in range(n))
    shared = [text(n) for n in (30, 48, 49, 50, 51, 80, 400)]
    docs = []
    for i in range(120):
        parts = [text(rng.randint(0, 120)) for _ in range(rng.randint(0, 3))] + [rng.choice(shared) for _ in range(rng.randint(0, 3))]
        rng.shuffle(parts)
        docs.append((i, "".join(parts)))
    docs += [(200 + i, "z" * (40 + 7 * i)) for i in range(8)] + [(300, docs[5][1]), (301, docs[5][1]), (302, None), (303, "")]
    return docs


@pytest.mark.parametrize("hot", [3, 20_000])
def test_repeats(spark, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    docs = passages()
    want = repeated(docs)
    rows = suffixes.remove_repeats(spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, kept string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows} == want and len(rows) == len(docs)


def test_repeats_of_odd_rows(odd_docs, no_docs):
    rows = suffixes.remove_repeats(odd_docs, decoded=True).collect()
    docs = {r["doc_id"]: r["text"] for r in odd_docs.where("doc_id is not null").collect()}
    want = repeated(list(docs.items()))
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0 and r["kept"] == r["text"].encode()
        else:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]]
            assert r["text"] is None or r["n_removed"] == 0 or r["text"] == bytes(r["kept"]).decode("utf-8", "ignore")
    assert suffixes.remove_repeats(no_docs).count() == 0


def test_repeats_of_the_test_documents(spark):
    table = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    want = repeated([(r["doc_id"], r["text"]) for r in table.collect()])
    for r in suffixes.remove_repeats(table).collect():
        assert hashlib.sha256(r["kept"]).digest() == hashlib.sha256(want[r["doc_id"]][3]).digest()


@pytest.mark.parametrize("room", [5, 100, 10**6])
def test_induced_sort(room):
    rng = random.Random(room)
    for _ in range(80):
        alphabet, depth = rng.choice([b"ab", b"abcd", b"\x00\xff\x01", bytes(range(97, 117))]), rng.choice([2, 3, 5, 8, 15, 20])
        strings = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 12))]
        strings += [s[3:20] + b"ab" for s in strings] if rng.random() < 0.5 else []
        owners, least = np.array([rng.randint(0, 50) for _ in strings]), {}
        for s, o in zip(strings, owners.tolist()):
            for k in range(len(s) - depth + 1):
                least[s[k : k + depth]] = min(least.get(s[k : k + depth], o), o)
        for s, found in zip(strings, induced_sort.least_owner(strings, owners, depth, room)):
            assert found.tolist() == [least[s[k : k + depth]] for k in range(len(s) - depth + 1)]


def test_seeds_are_put_in_order_of_their_first_characters():
    """Words of seven characters, tied ones only, against plain comparison; an END ends a common prefix."""
    rng = np.random.default_rng(8)
    for depth in (1, 6, 7, 8, 15, 50):
        strings = [bytes(rng.integers(0, 2, int(n), np.uint8)) * int(k) for n, k in zip(rng.integers(0, 40, 30), rng.integers(1, 4, 30))]
        text = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.uint16) + 1, 0) for s in strings]).astype(np.uint16)
        seeds = np.flatnonzero(text)
        ranked, common = induced_sort.seed_order(text, seeds, depth)
        heads = [bytes(text[p : p + depth].tolist()).split(b"\0")[0] for p in ranked.tolist()]
        assert sorted(ranked.tolist()) == seeds.tolist() and heads == sorted(heads)
        assert common[1:].tolist() == [len(os.path.commonprefix([a, b])) for a, b in zip(heads, heads[1:])]


def test_answers_of_a_shard_come_in_few_batches():
    """A shard's spans that share strings and one that shares none, from 130 batches of documents. Each row of answers
    was a record batch of its own."""
    length, shared = 50, [bytes([65 + k]) * 3 + bytes(range(90 + k, 170 + k)) for k in range(3)]
    spans = [[(shared[b % 3], b % 3, b), (b"%05d" % b + shared[b % 3], b % 3, b + 1), (hashlib.sha512(b"%d" % b).digest(), 10 + b, b)] for b in range(130)]
    rows, owners = [], {}
    for b, mine in enumerate(spans):
        texts, keys, docs = zip(*mine)
        sizes, places = suffixes._numbers([len(t) for t in texts]), suffixes._numbers([0, 1, 2])
        rows.append((f"{b}", 0, suffixes.squeezed(b"".join(texts)), sizes, suffixes._short(np.array(keys, np.uint64)), suffixes._numbers(docs), places))
        for text, _, doc in mine:
            for k in range(len(text) - length + 1):
                owners[text[k : k + length]] = min(doc, owners.get(text[k : k + length], doc))

    class Pieces:
        def repartition(self, *_):
            return self

        sortWithinPartitions = repartition

        def mapInArrow(self, run, _):
            schema = suffixes._schema("batch string, shard int, strings binary, lengths binary, keys binary, owners binary, places binary")
            return list(run(iter([suffixes._rows(schema, rows)])))

    batches = suffixes.sort(Pieces(), length, 1)
    assert len(batches) == 3 and sum(x.num_rows for x in batches) == 130
    for batch in batches:
        for name, *data in zip(*(batch[c].to_pylist() for c in ("batch", "runs", "starts", "owners"))):
            runs, starts, least = map(suffixes._from_numbers, data)
            ends = np.cumsum(runs)
            for (text, _, _), z, n in zip(spans[int(name)], ends.tolist(), runs.tolist()):
                strings = len(text) - length + 1
                found = np.repeat(least[z - n : z], np.diff([*starts[z - n : z].tolist(), strings])).tolist()
                assert starts[z - n] == 0 and found == [owners[text[k : k + length]] for k in range(strings)]
