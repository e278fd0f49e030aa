"""Piecewise encoding, the tree encoder, record files and section counts against the libraries themselves."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from holdfast.llm import byte_bpe, records, token_counts
from holdfast.llm.pieces import TextEncoder, byte_level_pieces, groups, library_tokenizer, merges_by_rank, rank_cache, rank_encoding

RANKS, MULTI = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_multi_50k.tiktoken")
BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ALPHABET = "ab é1'!. \n \t   ́sl漢\x00\x1c\x85　"


def some_texts(count, seed, longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(count)]


ALPHABETS = (ALPHABET, "ab '’́éÉß\x1c\t\nİ漢😀09.,!\x85 sİª²½ĳ\x00~dʰ", "abC 'sétlÉßmdrv\n09.,!ª²½ĳ~", "ab  '\t\n9.!")


def test_rank_pieces_give_the_librarys_tokens():
    encoding = rank_encoding(MULTI, P.PATTERN)
    for text in some_texts(1500, 1, 30):
        assert np.frombuffer(rank_cache(MULTI, P.PATTERN).encode([byte_level_pieces(text)])[0], "<u4").tolist() == encoding.encode_ordinary(text)


@pytest.mark.parametrize("by_rank", [True, False])
@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_text_encoder_gives_the_librarys_tokens(path, by_rank):
    rng = random.Random(5)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500) for letters in ALPHABETS]
    texts += ["", " ", "<|endoftext|> a", "'S it's 'tis we'll 'LL don't", "x" * 3000 + " " + "y" * 3000, "\n\n a  b", "plain words, and 12 numbers"]
    encoder = TextEncoder(path, "<u4", by_rank)
    want = [e.ids for e in library_tokenizer(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == want


def test_merging_by_rank_is_allowed_only_where_it_is_the_same(tmp_path):
    assert merges_by_rank(BYTES) and merges_by_rank(WORDS)
    letters = {c: k for k, c in enumerate("abc")}

    def file(name, merges, vocab):
        path = tmp_path / name
        path.write_text(json.dumps({"model": {"vocab": vocab, "merges": merges}}))
        return str(path)

    assert merges_by_rank(file("good", ["a b", "ab c"], letters | {"ab": 3, "abc": 4}))
    assert not merges_by_rank(file("falling", ["a b", "ab c"], letters | {"ab": 4, "abc": 3}))
    # "bc" comes first, so that "abc" is never formed from "ab" and "c", but by rank it would be from "a" and "bc".
    assert not merges_by_rank(file("unreachable", ["b c", "a b", "ab c"], letters | {"bc": 3, "ab": 4, "abc": 5}))


def test_cache_stays_bounded():
    cache = rank_cache(RANKS, P.PATTERN)
    cache.limit, before = 50, cache.limit
    try:
        for k in range(20):
            cache.encode([[f" w{k}x{j}" for j in range(20)] + ["y" * 100]])
            assert len(cache.known) <= 50 and "y" * 100 not in cache.known
    finally:
        cache.limit = before


def test_groups_cover_everything():
    texts = ["abc"] * 7 + [""] * 3
    assert [t for _, some in groups(texts, 6) for t in some] == texts and list(groups([])) == []


def test_tree_is_the_whole_encoding_for_any_halves():
    encoding = rank_encoding(MULTI, P.PATTERN)
    for leaf, window in ((1, 1), (7, 2), (16, 64)):
        encoder = byte_bpe.TreeEncoder(MULTI, P.PATTERN, leaf, window)
        for text in some_texts(500, leaf) + ["x" * 300, " " * 100, "it's we'll " * 20]:
            assert encoder.encode([text])[0].tolist() == encoding.encode_ordinary(text)


def test_encode_and_decode(odd_docs, no_docs):
    encoding = rank_encoding(MULTI, P.PATTERN)
    encoded = byte_bpe.encode(odd_docs, MULTI, P.PATTERN)
    assert sorted(encoded.columns) == sorted(odd_docs.columns)
    for r in encoded.collect():
        assert r["ids"] == encoding.encode_ordinary(r["text"] or "")
    out = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(odd_docs, MULTI, P.PATTERN), MULTI))
    want = sorted((r["doc_id"] or 0, hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in odd_docs.collect())
    assert sorted((r["doc_id"] or 0, r["decoded_sha256"]) for r in out.collect()) == want
    assert byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(no_docs, MULTI, P.PATTERN), MULTI)).count() == 0


def test_records(odd_docs, no_docs, tmp_path):
    tokenizer = library_tokenizer(WORDS)
    files = records.write_records(odd_docs, str(tmp_path / "r"), WORDS, file_bytes=3000)
    assert files.count() > 1
    found = sorted(records.read_records(files).collect(), key=lambda r: r["start"])
    want = sorted(((r["doc_id"], r["text"] or "") for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in found] == [i for i, _ in want]
    start = 0
    for row, (_, text) in zip(found, want):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (row["start"], row["n_tokens"], bytes(row["ids"])) == (start, len(ids), ids.tobytes())
        start += len(ids)
    name = files.orderBy("first_doc").collect()[-1]["file"]
    index = records.read_index(name)[::-1]
    shuffled = list(records.read_at(name, index[:, 2].tolist()))
    assert [d for d, _ in shuffled] == index[:, 1].tolist() and [len(i) for _, i in shuffled] == index[:, 3].tolist()
    assert records.round_trip(no_docs, WORDS).count() == 0


def test_damaged_records_are_found(tmp_path):
    path = tmp_path / "x"
    data = bytearray(records.framed(b"payload"))
    for place in (0, 9, 14, len(data) - 1):
        damaged = bytearray(data)
        damaged[place] ^= 1
        path.write_bytes(damaged)
        with open(path, "rb") as source, pytest.raises(ValueError):
            records.read_frame(source)
    assert records.masked(b"abc") != zlib.crc32(b"abc")


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_counts(odd_docs, no_docs, rule):
    tokenizer = library_tokenizer(BYTES)
    rows = token_counts.count_tokens(odd_docs, RANKS, P.PATTERN, rule).collect()
    for doc in odd_docs.where("doc_id > 1").collect():
        text = doc["text"] or ""
        mine = sorted((r for r in rows if r["doc_id"] == doc["doc_id"]), key=lambda r: r["section"])
        assert "".join(text[r["char_start"] : r["char_end"]] for r in mine) == text
        counts = [0] * len(mine)
        for a, b in tokenizer.encode(text, add_special_tokens=False).offsets:
            shares = [min(b, r["char_end"]) - max(a, r["char_start"]) for r in mine]
            first = next(k for k, s in enumerate(shares) if s > 0)
            counts[first if rule == "first" else shares.index(max(shares))] += 1
        assert counts == [r["n_tokens"] for r in mine]
    assert len([r for r in rows if r["doc_id"] == 1]) == 2
    assert token_counts.count_tokens(no_docs, RANKS, P.PATTERN).count() == 0


def test_crossing_tokens_follow_the_rule():
    starts, ends, borders = np.array([0, 2, 5]), np.array([2, 5, 9]), np.array([0, 4, 8, 9])
    assert [x.tolist() for x in token_counts.attribute(starts, ends, borders, "first")] == [[2, 1, 0], [1, 1, 0]]
    assert token_counts.attribute(np.array([3]), np.array([7]), np.array([0, 4, 9]), "most")[0].tolist() == [0, 1]
    assert token_counts.attribute(np.array([3]), np.array([5]), np.array([0, 4, 9]), "most")[0].tolist() == [1, 0]


def test_stores_by_the_names_of_hadoop():
    assert records.common_uri("s3a://bucket/a/b") == "s3://bucket/a/b"
    assert records.common_uri("hdfs://host/a") == "hdfs://host/a" and records.common_uri("/a/b") == "/a/b"
    assert records.store_of("file:///tmp/x")[1] == "/tmp/x"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        records.store_of("nosuchstore://store/x")
