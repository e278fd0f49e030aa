"""Encoding texts piece by piece with a tokenizer library, equal pieces once.

A text is cut only where no token can cross and no match of the tokenizer's pattern looks across,
so the pieces' tokens, one after the other, are the text's tokens.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex

#: What a word is for byte-level vocabularies, and for those with ends of words.
BYTE_LEVEL_MATCH = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same where white space is single spaces and newlines between other characters.
REGULAR_MATCH = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\n"
WORD_MATCH = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: A single space between two non-space characters: patterns of the byte-level family begin a match there.
SPACE_CUT = re.compile(r"(?<=\S)(?= \S)")


def byte_level_pieces(text: str) -> list[str]:
    """Pieces for ` ?\\p{L}+`-like patterns, where a word takes the one space before it.

    If all white space is single spaces and newlines between other characters, a piece is a newline
    or a word with its space. Otherwise runs of white space stay inside pieces.
    """
    if "\x00" in text or " ".join(text.split()) != text.replace("\n", " "):
        return SPACE_CUT.split(text)
    return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")


def spaceless_pieces(text: str) -> list[str]:
    """Pieces for patterns that drop white space: runs without a space or newline."""
    return [p for p in text.replace("\n", " ").split(" ") if p]


class PieceCache:
    """Tokens of pieces as bytes, for `limit` pieces at most; longer ones than `longest` are not kept.

    encode_many gives for a list of pieces the bytes that stand for the tokens of each.
    """

    def __init__(self, encode_many: Callable[[list[str]], Iterable[bytes]], limit: int = 700_000, longest: int = 64):
        self.encode_many, self.limit, self.longest = encode_many, limit, longest
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[list[str]]) -> list[bytes]:
        """The token bytes of each text, given as its pieces."""
        distinct = set().union(*texts)
        new = [p for p in distinct if p not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known, new = {}, list(distinct)
        known = self.known
        known.update(zip(new, self.encode_many(new), strict=True))
        found = [b"".join([known[p] for p in pieces]) for pieces in texts]
        for p in new:
            if len(p) > self.longest:
                del known[p]
        return found


def library_tokenizer(path: str):
    """A tokenizer file of the `tokenizers` library; special strings in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


#: Characters whose classes, lower case and normal form have not changed between versions of Unicode; no white space.
STABLE = "[!-~\xa1-\u012f\u0131-\u024f]+"
SPACED, PLAIN, USUAL = re.compile(f" {STABLE}"), re.compile(STABLE), re.compile(f"[\t-\r {STABLE[1:-2]}]*")
END = "\x00"  # stands for the end of a word


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: the byte's own if it can be printed,
    else the next one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def merges_of(path: str) -> tuple[dict[str, int], list[tuple[str, str]], str]:
    """Vocabulary, merges in order and end-of-word suffix of a tokenizer file."""
    with open(path) as source:
        model = json.load(source)["model"]
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    return model["vocab"], merges, model.get("end_of_word_suffix") or ""


@lru_cache(maxsize=4)
def merges_by_rank(path: str) -> bool:
    """Whether merging the neighbours whose joint token has the smallest id gives the tokens of the file's merges.

    It does if ids rise in the order of the merges and every token is what its own characters merge into: before a
    token can be formed from two neighbours, all earlier merges within it are done, as they are when it stands
    alone, so these neighbours are the two that its merge names. Takes a second; called on the driver.
    """
    vocab, merges, suffix = merges_of(path)
    order = {pair: k for k, pair in enumerate(merges)}
    ids = [vocab.get(x + y) if not suffix or not x.endswith(suffix) else None for x, y in merges]
    letters = max(n for t, n in vocab.items() if len(t.removesuffix(suffix) if suffix else t) == 1)
    if None in ids or ids != sorted(set(ids)) or (ids and ids[0] <= letters):
        return False
    for x, y in merges:
        whole = x + y
        parts = list(whole.removesuffix(suffix)) if suffix else list(whole)
        if suffix and whole.endswith(suffix):
            parts[-1] += suffix
        while len(parts) > 1:
            ranks = [order.get(pair, len(order)) for pair in zip(parts, parts[1:])]
            k = ranks.index(min(ranks))
            if ranks[k] == len(order):
                return False
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return True


class TextEncoder:
    """Encodes texts with a tokenizer file; the ids are those of the `tokenizers` library, as bytes of numpy type `width`.

    Texts of usual characters are merged by rank (see merges_by_rank) in one call a text. A vocabulary with an
    end-of-word suffix drops white space, and its words, lower-cased, end in a character of their own instead. Other
    texts are cut into pieces: those of usual characters are merged by rank, many of them put together into a text in
    which no token can cross from one to the next and dealt out again by their lengths in bytes; all
    others are encoded one by one by the library. Without by_rank all pieces are.
    """

    CHARS = 50_000  # of pieces put together

    def __init__(self, path: str, width: str, by_rank: bool):
        self.tokenizer, self.width, self.by_rank = library_tokenizer(path), np.dtype(width), by_rank
        vocab, _, suffix = merges_of(path)
        self.suffix, self.pieces = suffix, spaceless_pieces if suffix else byte_level_pieces
        self.cache = PieceCache(self._encode_pieces)
        if not by_rank:
            return
        number, ranks = byte_characters(), {}
        for token, rank in vocab.items():
            ended = bool(suffix) and token.endswith(suffix)
            data = bytes(number[c] for c in (token.removesuffix(suffix) if ended else token))
            if not (suffix and END.encode() in data and data != END.encode()):
                ranks[data + END.encode() * ended] = rank
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(data) for data in ranks]

        def encoding(pattern: str):
            import tiktoken

            return tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        if suffix:
            self.regular = encoding(f"[^{END}]+{END}")
            kinds = {k: "".join(c for c in map(chr, range(0x250)) if regex.fullmatch(rf"\p{{{k}}}", c)) for k in "LN"}
            self.signs, self.digits = re.compile(f"[^\\s{END}{kinds['L']}{kinds['N']}]+"), re.compile(f"[{kinds['N']}]")
            self.matches = regex.compile(WORD_MATCH)
        else:
            self.any, self.regular = encoding(BYTE_LEVEL_MATCH), encoding(REGULAR_MATCH)

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.width).tobytes()

    def _one_by_one(self, pieces: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _ended(self, text: str) -> str:
        """A text's words, lower-cased, each followed by END. Several ENDs count as one."""
        low = text.lower()
        if "'" in low:  # may begin a word's short form
            return END.join([*self.matches.findall(low), ""])
        low = self.digits.sub(rf"{END}\g<0>{END}", self.signs.sub(rf"{END}\g<0>{END}", low))
        return END.join([*low.split(), ""])

    def _joined(self, pieces: list[str], between: str) -> list[bytes]:
        """Ids of pieces with `between` between them, which is a token of its own, or nothing."""
        if self.suffix:
            pieces = [END.join([*filter(None, self._ended(p).split(END)), ""]) for p in pieces]
        sizes = np.array([len(p.encode()) for p in pieces], np.int64)
        ends = np.cumsum(sizes + len(between)) - len(between)
        ids = np.array(self.regular.encode_ordinary(between.join(pieces)), np.int64)
        borders = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        first, last = np.searchsorted(borders, ends - sizes), np.searchsorted(borders, ends)
        data, step = ids.astype(self.width).tobytes(), self.width.itemsize
        return [data[a:b] for a, b in zip((first * step).tolist(), (last * step).tolist())]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        if not self.by_rank:
            return self._one_by_one(pieces)
        spaced = [] if self.suffix else [p for p in pieces if SPACED.fullmatch(p)]
        plain = [p for p in pieces if PLAIN.fullmatch(p)]
        found: dict[str, bytes] = {}
        for some, between in ((spaced, ""), (plain, "" if self.suffix else "\n")):
            at = 0
            while at < len(some):
                to, chars = at, 0
                while to < len(some) and chars < self.CHARS:
                    chars += len(some[to]) + 1
                    to += 1
                found.update(zip(some[at:to], self._joined(some[at:to], between), strict=True))
                at = to
        alone = [p for p in pieces if p not in found]
        found.update(zip(alone, self._one_by_one(alone), strict=True))
        return [found[p] for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        found: list[bytes] = [b""] * len(texts)
        others = []
        for k, text in enumerate(texts):
            if not self.by_rank or not USUAL.fullmatch(text):
                others.append(k)
            elif self.suffix:
                found[k] = self._bytes(self.regular.encode_ordinary(self._ended(text)))
            else:
                regular = " ".join(text.split()) == text.replace("\n", " ")
                found[k] = self._bytes((self.regular if regular else self.any).encode_ordinary(text))
        for k, ids in zip(others, self.cache.encode([self.pieces(texts[k]) for k in others]) if others else [], strict=True):
            found[k] = ids
        return found


@lru_cache(maxsize=4)
def text_encoder(path: str, width: str, by_rank: bool) -> TextEncoder:
    """Encoder of a tokenizer file in this Python worker; by_rank: what merges_by_rank says of the file."""
    return TextEncoder(path, width, by_rank)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def rank_encoding(path: str, pattern: str):
    """tiktoken's encoding of a rank file, without special tokens."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def rank_cache(path: str, pattern: str) -> PieceCache:
    """Cache of a rank file in this Python worker; ids are little-endian 32-bit numbers."""
    encoding = rank_encoding(path, pattern)
    return PieceCache(lambda pieces: (np.array(encoding.encode_ordinary(p), "<u4").tobytes() for p in pieces))


def groups(texts: list[str], size: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about `size` characters together, with the place of the first."""
    first, chars = 0, 0
    for k, text in enumerate(texts):
        chars += len(text)
        if chars >= size:
            yield first, texts[first : k + 1]
            first, chars = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]
