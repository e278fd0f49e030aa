"""Token ids in files of length-delimited records, with an offset index beside each file.

A record is `length u64 | check(length) u32 | payload | check(payload) u32`, little-endian; the payload is
whether the document has an id (u8), the id (i64) and its token ids (u16 or u32, named in the file's first record). A check is the
masked crc32: rotated right by 15 bits, plus a constant, so that a checksum of data holding checksums
stays sound. The index holds (has id, id, offset, tokens) as i64 per document, for shuffled reads.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F

from holdfast.llm.pieces import groups, merges_by_rank, text_encoder
from holdfast.sources.tables import fresh_path, settle

#: Fixed values of the mask.
MASK_SHIFT = 15
MASK_DELTA = 0xA282EAD8

FILES = "file string, first_doc bigint, last_doc bigint, documents bigint, tokens bigint, bytes bigint"
FILES_ARROW = pa.schema([("file", pa.string()), *((n, pa.int64()) for n in ("first_doc", "last_doc", "documents", "tokens", "bytes"))])
FOUND = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def common_uri(uri: str) -> str:
    """A place in the terms of Arrow: Hadoop has names of its own for S3."""
    scheme, found, rest = uri.partition("://")
    return f"s3://{rest}" if found and scheme in ("s3a", "s3n") else uri


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and place of a file or folder."""
    try:
        return fs.FileSystem.from_uri(common_uri(uri))
    except (pa.ArrowInvalid, OSError) as error:
        raise ValueError(f"record files cannot be written to {uri}: spark.checkpoint.dir must name a folder that is mounted, or in hdfs, s3, gs or abfs") from error


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> MASK_SHIFT | crc << (32 - MASK_SHIFT)) + MASK_DELTA) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def read_frame(source) -> bytes | None:
    """The next record's payload of an open file; None at its end. Damage is an error."""
    head = source.read(12)
    if not head:
        return None
    length, check = struct.unpack("<QI", head)
    if masked(head[:8]) != check:
        raise ValueError("damaged record length")
    body = source.read(length + 4)
    if len(body) != length + 4 or masked(payload := body[:-4]) != struct.unpack("<I", body[-4:])[0]:
        raise ValueError("damaged record")
    return payload


class Writer:
    """One data file and its index, written under a name no other attempt uses."""

    def __init__(self, folder: str, width: str):
        self.store, place = store_of(folder)
        self.store.create_dir(place, recursive=True)
        self.file = f"{place}/{uuid.uuid4().hex}.records"
        self.uri = f"{folder}/{self.file.rsplit('/', 1)[1]}"
        self.out, self.at, self.index, self.width = self.store.open_output_stream(self.file), 0, [], np.dtype(width)
        self._put(framed(json.dumps({"width": width}).encode()))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc: int | None, ids: bytes) -> None:
        self.index.append((doc is not None, doc or 0, self.at, len(ids) // self.width.itemsize))
        self._put(framed(struct.pack("<?q", doc is not None, doc or 0) + ids))

    def close(self) -> pa.RecordBatch:
        self.out.close()
        index = np.array(self.index, "<i8").reshape(-1, 4)
        with self.store.open_output_stream(f"{self.file}.index") as out:
            out.write(framed(index.tobytes()))
        first, last = (int(row[1]) if row[0] else None for row in (index[0], index[-1]))
        row = (self.uri, first, last, len(index), int(index[:, 3].sum()), self.at)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, FILES_ARROW, strict=True)], schema=FILES_ARROW)


def read_index(file: str) -> np.ndarray:
    """(has id, id, offset, tokens) of a file's documents."""
    store, place = store_of(file)
    with store.open_input_stream(f"{place}.index") as source:
        return np.frombuffer(read_frame(source), "<i8").reshape(-1, 4)


def read_at(file: str, offsets: list[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents and ids at places of the index, in any order."""
    store, place = store_of(file)
    with store.open_input_file(place) as source:
        width = json.loads(read_frame(source))["width"]
        for offset in offsets:
            source.seek(offset)
            payload = read_frame(source)
            known, doc = struct.unpack("<?q", payload[:9])
            yield doc if known else None, np.frombuffer(payload[9:], width)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, width: str = "<u2", file_bytes: int = 128 << 20) -> DataFrame:
    """Encode documents (doc_id, text) and write them in ascending doc_id order; return the list of files.

    Null and empty texts are the end id alone. Rows without doc_id come first; rows with equal doc_id are
    written one after the other. No documents give no files. Files follow each other in doc_id order. A task that runs again
    writes new files; only those on the returned, stored list count.
    """
    store_of(folder)  # an error here and not in the tasks
    by_rank = merges_by_rank(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, writer = text_encoder(tokenizer, width, by_rank), np.array([end_id], width).tobytes(), None
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), [t or "" for t in batch["text"].to_pylist()]
            for first, some in groups(texts):
                for doc, found in zip(ids[first:], encoder.encode(some)):
                    writer = writer or Writer(folder, width)
                    writer.add(doc, found + end)
                    if writer.at >= file_bytes:
                        yield writer.close()
                        writer = None
        if writer:
            yield writer.close()

    narrow = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("_mix"))
    ordered = narrow.repartitionByRange("doc_id", "_mix").sortWithinPartitions("doc_id", "_mix", "text").drop("_mix")
    return settle(ordered.mapInArrow(run, FILES), "record-files")


def read_records(files: DataFrame) -> DataFrame:
    """Documents of the listed files: doc_id, start (ids of all documents before), n_tokens, ids (u32 bytes).

    A file is read in order by one task, record by record; every checksum is verified.
    """
    before = Window.orderBy("first_doc", "last_doc", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = files.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    count = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index, start, rows, held = read_index(row["file"]), row["before"], [], 0
                for (known, doc, _, tokens), (there, ids) in zip(index.tolist(), read_at(row["file"], index[:, 2].tolist()), strict=True):
                    if (doc if known else None) != there or tokens != len(ids):
                        raise ValueError(f"{row['file']}: index and records differ")
                    rows.append((there, start, tokens, ids.astype("<u4").tobytes()))
                    start, held = start + tokens, held + 4 * tokens
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return placed.repartition(count).mapInArrow(run, FOUND)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FOUND_ARROW, strict=True)], schema=FOUND_ARROW)


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write documents to record files in the shared folder and read them back."""
    return read_records(write_records(docs, fresh_path(docs.sparkSession, "records"), tokenizer, **options))
