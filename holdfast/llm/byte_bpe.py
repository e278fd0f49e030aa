"""Byte-level BPE as a reduction over a tree of halves.

Encoding maps text to a monoid: the tokens of two neighbours are joined by encoding anew a window
around their border. The window grows on either side until it ends at a place no match of the pattern
crosses or looks across; tokens beyond such a place cannot change. Decoding joins bytes up the tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from holdfast.llm.pieces import SPACE_CUT, byte_level_pieces, groups, rank_cache, rank_encoding, read_ranks

NONE = np.empty(0, "<u4")


def first_cut(text: str, start: int, end: int) -> int | None:
    """First place in (start, end) of text where both sides can be encoded on their own."""
    found = SPACE_CUT.search(text, start + 1, end)
    return found.start() if found else None


def last_cut(text: str, start: int, end: int) -> int | None:
    found = None
    for found in SPACE_CUT.finditer(text, start + 1, end):
        pass
    return found.start() if found else None


class TreeEncoder:
    """Encodes texts by halves. `leaf` is the number of characters below which a text is not halved."""

    def __init__(self, ranks: str, pattern: str, leaf: int = 8192, window: int = 64):
        self.cache, self.encoding = rank_cache(ranks, pattern), rank_encoding(ranks, pattern)
        self.leaf, self.window = leaf, window

    def leaves(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        if end - start <= self.leaf:
            return [(start, end)]
        middle = (start + end) // 2
        return self.leaves(text, start, middle) + self.leaves(text, middle, end)

    def left_stable(self, text: str, start: int, border: int) -> int:
        """Last cut before the border, or the start of the left text."""
        width = self.window
        while True:
            low = max(start, border - width)
            # A cut lies between two characters: the search may look at the one before the window.
            if (cut := last_cut(text, low, border)) is not None:
                return cut
            if low == start:
                return start
            width *= 2

    def right_stable(self, text: str, border: int, end: int) -> int:
        """First cut after the border, or the end of the right text."""
        width = self.window
        while True:
            high = min(end, border + width)
            if (cut := first_cut(text, border, high)) is not None:
                return cut
            if high == end:
                return end
            width *= 2

    def join(self, text: str, start: int, border: int, end: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Tokens of text[start:end] from those of its two parts."""
        a, b = self.left_stable(text, start, border), self.right_stable(text, border, end)
        lost = len(self.encoding.encode_ordinary(text[a:border]))
        gone = len(self.encoding.encode_ordinary(text[border:b]))
        anew = np.array(self.encoding.encode_ordinary(text[a:b]), "<u4")
        return np.concatenate([left[: len(left) - lost], anew, right[gone:]])

    def reduce(self, text: str, start: int, end: int, found: Iterator[bytes]) -> np.ndarray:
        if end - start <= self.leaf:
            data = next(found)
            return np.frombuffer(data, "<u4") if data else NONE
        middle = (start + end) // 2
        left = self.reduce(text, start, middle, found)
        return self.join(text, start, middle, end, left, self.reduce(text, middle, end, found))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        leaves = [byte_level_pieces(t[a:b]) for t in texts for a, b in self.leaves(t, 0, len(t))]
        found = iter(self.cache.encode(leaves))
        return [self.reduce(t, 0, len(t), found) for t in texts]


@lru_cache(maxsize=2)
def token_bytes(ranks: str) -> list[bytes]:
    """Bytes of each token id; an id without token has none."""
    found = read_ranks(ranks)
    table = [b""] * (max(found.values()) + 1)
    for token, rank in found.items():
        table[rank] = token
    return table


def decode_tree(ids: list[int], table: list[bytes], leaf: int = 4096) -> bytes:
    """Bytes of tokens, concatenated up a tree of halves."""
    if len(ids) <= leaf:
        return b"".join([table[i] for i in ids])
    middle = len(ids) // 2
    return decode_tree(ids[:middle], table, leaf) + decode_tree(ids[middle:], table, leaf)


def _with(df: DataFrame, name: str, kind) -> StructType:
    return StructType([f for f in df.schema.fields if f.name != name] + [StructField(name, kind)])


def _flush(batch: pa.RecordBatch, first: int, column: pa.Array, name: str) -> pa.RecordBatch:
    part = batch.slice(first, len(column))
    keep = [c for c in part.schema.names if c != name]
    return pa.RecordBatch.from_arrays([part[c] for c in keep] + [column], keep + [name])


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """Add the token ids of a text column; null and empty texts have none.

    Other columns are kept (the text only with keep_text); one named like `ids` is replaced. A text of
    any length is one row's work, of which only the windows at borders are encoded twice.
    """
    schema = _with(df, ids, ArrayType(IntegerType()))
    schema = schema if keep_text else StructType([f for f in schema if f.name != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TreeEncoder(ranks, pattern)
        for batch in batches:
            for first, some in groups([t or "" for t in batch[text].to_pylist()]):
                found = encoder.encode(some)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = pa.array(np.concatenate([NONE, *found]).view("<i4"))
                part = _flush(batch, first, pa.ListArray.from_arrays(pa.array(ends), flat), ids)
                yield part if keep_text else part.drop_columns([text])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """Add the bytes that token ids stand for; null ids give no bytes. A column named like `data` is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch[ids].slice(first, 500)
                yield _flush(batch, first, pa.array([decode_tree(x or [], table) for x in part.to_pylist()], pa.binary()), data)

    return df.mapInArrow(run, _with(df, data, BinaryType()))


def digests(df: DataFrame, ids: str = "ids", data: str = "data") -> DataFrame:
    """Number of tokens, and SHA-256 of the ids as text and of the decoded bytes."""
    return df.select(
        "doc_id",
        F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col(ids).cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col(data), 256).alias("decoded_sha256"),
    )
