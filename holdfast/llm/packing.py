"""Best-fit packing of documents into sequences of a fixed number of tokens, by rounds over partitions.

Every task packs its own pieces by best fit, longest first. Nearly full bins are done; the others
become items of the next round, which deals them to fewer tasks. Only (id, length) pairs are moved.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from holdfast.llm.pieces import groups, merges_by_rank, text_encoder
from holdfast.sources.tables import fresh_path, settle

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACES = "item bigint, length bigint, bin bigint, bin_offset bigint, fill bigint"


def cut_lengths(tokens: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: the first holds what full pieces leave over."""
    first = tokens % capacity
    return [first] * (first > 0) + [capacity] * (tokens // capacity)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of all documents (doc_id, text) with the crc32 of their ids as unsigned 32-bit numbers.

    A null or empty text is the end id alone. Rows with equal doc_id are separate documents.
    """
    end, by_rank = np.array([end_id], "<u4").tobytes(), merges_by_rank(tokenizer)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer, "<u4", by_rank)
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), [t or "" for t in batch["text"].to_pylist()]
            for first, some in groups(texts):
                rows = []
                for doc, found in zip(ids[first:], encoder.encode(some)):
                    found, start = found + end, 0
                    for k, n in enumerate(cut_lengths(len(found) // 4, capacity)):
                        rows.append((doc, k, start, n, zlib.crc32(found[4 * start : 4 * (start + n)])))
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the bins' fills; items are placed in the given order.

    Bins are kept by free space; a bit per free space says whether any has it, so the fullest bin
    an item fits into is found without a search.
    """
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    there, fills = 0, []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, length in enumerate(lengths.tolist()):
        if fit := there >> length:
            space = length + (fit & -fit).bit_length() - 1
            which = free[space].pop()
            if not free[space]:
                there ^= 1 << space
        else:
            which, space = len(fills), capacity
            fills.append(0)
        bins[k], offsets[k] = which, capacity - space
        fills[which] += length
        if left := space - length:
            free[left].append(which)
            there |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def _round(items: DataFrame, number: int, tasks: int, capacity: int) -> DataFrame:
    """One round: the bin of every item (item, length). Bin numbers are unique over rounds and tasks."""
    names = [field.split()[0] for field in PLACES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema([("item", pa.int64()), ("length", pa.int64())]))
        item, length = (table[c].to_numpy() for c in ("item", "length"))
        order = np.lexsort((item, -length))
        item, length = item[order], length[order]
        bins, offsets, fills = best_fit(length, capacity)
        base = (number << 56) | (TaskContext.get().partitionId() << 32)
        for at in range(0, len(item), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (item[part], length[part], base + bins[part], offsets[part], fills[bins[part]])], names)

    return items.select("item", "length").repartition(tasks, "item").mapInArrow(run, PLACES)


def pack(pieces: DataFrame, capacity: int = 1024, task_items: int = 200_000, slack: int = 16) -> DataFrame:
    """Places for pieces (any columns, `length` from 1 to capacity): adds sequence_id and offset.

    Rounds end when no two of the open bins can be joined any more, or a round joins fewer than one in a hundred of
    them. A task holds about task_items items; bins with at most `slack` free places are done.
    A `sequence_id`, `offset` or `item` column of the input is replaced.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset", "item")
    at = fresh_path(spark, "pieces")
    pieces.withColumn("item", F.monotonically_increasing_id()).write.parquet(at)
    numbered = spark.read.parquet(at)
    items = numbered.where(F.col("length") < capacity)
    rounds: list[DataFrame] = []
    count = items.count()
    tasks = max(1, -(-count // task_items), min(spark.sparkContext.defaultParallelism, count // 5_000))
    while count:
        places = settle(_round(items, len(rounds) + 1, tasks, capacity), "places")
        rounds.append(places)
        open_bins = places.where((F.col("fill") < capacity - slack) & (F.col("bin_offset") == 0))
        bins, smallest = open_bins.agg(F.count("*"), F.min("fill")).first()
        mergeable = bins > 1 and open_bins.where(F.col("fill") <= capacity - smallest).count() > 1
        if tasks == 1 or not mergeable or (len(rounds) > 1 and bins > 0.99 * count):
            break
        items, count = open_bins.select(F.col("bin").alias("item"), F.col("fill").alias("length")), bins
        tasks = min(-(-tasks // 8), max(1, -(-bins // task_items)))
    if not rounds:
        return numbered.select(*pieces.columns, F.col("item").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    # What a bin of an earlier round became: its bin in the last round it was an item of.
    end = rounds[-1].select("item", "bin", "bin_offset")
    for places in reversed(rounds[:-1]):
        later = end.select(F.col("item").alias("bin"), F.col("bin").alias("last"), F.col("bin_offset").alias("shift"))
        end = places.join(later, "bin", "left").select(
            "item", F.coalesce("last", "bin").alias("bin"), (F.col("bin_offset") + F.coalesce("shift", F.lit(0))).alias("bin_offset")
        )
    return numbered.join(end, "item", "left").select(
        *pieces.columns,
        F.coalesce("bin", "item").alias("sequence_id"),
        F.coalesce("bin_offset", F.lit(0)).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, **options) -> DataFrame:
    """Pieces of documents with their sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    No documents give no rows.
    """
    return pack(token_pieces(docs, tokenizer, end_id, capacity), capacity, **options)
