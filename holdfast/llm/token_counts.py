"""Token counts of document sections: documents are encoded once, tokens are joined to sections by place.

A document's tokens and its sections both are sorted intervals of characters, so the interval join is
a merge inside the row. A token that crosses borders goes to one section by a stated rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from holdfast.llm.pieces import PieceCache, byte_level_pieces, groups, rank_encoding

RULES = ("first", "most")
COUNTS = "doc_id bigint, section int, char_start bigint, char_end bigint, n_tokens bigint, n_crossing bigint"
COUNTS_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("section", pa.int32()), *((n, pa.int64()) for n in ("char_start", "char_end", "n_tokens", "n_crossing"))]
)


@lru_cache(maxsize=4)
def width_cache(ranks: str, pattern: str) -> PieceCache:
    """For each piece the number of bytes of each of its tokens."""
    encoding = rank_encoding(ranks, pattern)

    def encode_many(pieces: list[str]) -> Iterator[bytes]:
        for p in pieces:
            yield np.array([len(encoding.decode_single_token_bytes(i)) for i in encoding.encode_ordinary(p)], "<u2").tobytes()

    return PieceCache(encode_many)


def char_spans(text: str, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters [start, end) that tokens of the given byte widths touch."""
    ends = np.cumsum(widths, dtype=np.int64)
    starts = ends - widths
    if text.isascii():
        return starts, ends
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1  # the character each byte is part of
    return char[starts], char[ends - 1] + 1


def line_sections(text: str) -> np.ndarray:
    """Starts of a text's lines; each line holds its newline. An empty text has one empty line."""
    starts, at = [0], text.find("\n")
    while at >= 0 and at + 1 < len(text):
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(starts, np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and border-crossing tokens of each section. borders: the sections' starts, then the text's end.

    Rule "first": the section of the token's first character. Rule "most": the section that holds most
    of its characters, the earlier one of equals.
    """
    sections = len(borders) - 1
    first = np.searchsorted(borders, starts, "right") - 1
    last = np.searchsorted(borders, ends, "left") - 1
    chosen, across = first.copy(), np.flatnonzero(last > first)
    if rule == "most":
        for k in across.tolist():
            inside = np.arange(first[k], last[k] + 1)
            held = np.minimum(borders[inside + 1], ends[k]) - np.maximum(borders[inside], starts[k])
            chosen[k] = inside[np.argmax(held)]
    return np.bincount(chosen, minlength=sections), np.bincount(chosen[across], minlength=sections)


def count_tokens(docs: DataFrame, ranks: str, pattern: str, rule: str = "most") -> DataFrame:
    """Per document and line: its characters [char_start, char_end), tokens and crossing tokens among them.

    The counts of a document's lines add up to its tokens. Null and empty texts have one empty line
    without tokens. Rows with equal doc_id are counted each on their own; other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = width_cache(ranks, pattern)
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), [t or "" for t in batch["text"].to_pylist()]
            for first, some in groups(texts, 1_000_000):
                columns: list[list] = [[] for _ in COUNTS_ARROW]
                for doc, text, found in zip(ids[first:], some, cache.encode([byte_level_pieces(t) for t in some])):
                    starts, ends = char_spans(text, np.frombuffer(found, "<u2"))
                    borders = np.append(line_sections(text), len(text))
                    counts = attribute(starts, ends, borders, rule) if len(starts) else [np.zeros(len(borders) - 1, np.int64)] * 2
                    sections = len(borders) - 1
                    whole = (pa.repeat(pa.scalar(doc, pa.int64()), sections), np.arange(sections, dtype=np.int32), borders[:-1], borders[1:], *counts)
                    for column, part in zip(columns, whole, strict=True):
                        column.append(part)
                doc_ids = pa.concat_arrays(columns[0])
                yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(np.concatenate(c)) for c in columns[1:])], schema=COUNTS_ARROW)

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(run, COUNTS)
