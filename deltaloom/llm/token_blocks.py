"""Token ids in a compact binary format: patched frame-of-reference blocks.

A table of ids is a folder of Parquet files whose rows are segments: (part, seg, ids_before, n_docs, n_ids,
payload). Segments in the order of (part, seg) hold the documents in ascending order of their id. Spark's
writer commits them, so a lost executor leaves no half-written file, and any store that Spark writes will do.

A payload, little-endian:

    "PFB1", u32 block size, u64 ids, u32 documents, u32 blocks, u64 words of packed ids, u64 exceptions
    document ids  i64 x documents, and u8 x documents: 1 if the id is null
    lengths       u64 x documents: ids of each
    base          u32 x blocks: the least id of the block
    width         u8  x blocks: bits of a packed id
    start         u64 x blocks: the block's first packed word, so that any block can be read alone
    exceptions at u64 x blocks: the block's first exception
    packed        u64 x words: id minus base, its low bits
    positions     u8  x exceptions: place in the block
    outliers      u32 x exceptions: id minus base in full

The width of a block is that of the chosen percentile of its differences; whatever needs more bits is an exception.

A null text is an empty one: its end id alone. Rows with null ids come first; repeated ids are documents each for itself, in any order among
themselves. An empty table gives an empty folder. Columns other than the two named are not read. A very long text is encoded in segments.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, written
from .tokens import encoder

BLOCK = 128
PERCENTILE = 90
#: A segment is closed at so many ids; only a longer document makes a larger one.
SEGMENT_IDS = 1 << 20
_HEAD = struct.Struct("<4sIQIIQQ")


def _width(x: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(rows, 64) values under 2**width as (rows, width) words."""
    out = np.zeros((width, len(values)), np.uint64)
    cols = np.ascontiguousarray(values.T, np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[word] |= cols[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= cols[i] >> np.uint64(64 - shift)
    return out.T


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    cols, mask = np.ascontiguousarray(words.T), np.uint64((1 << width) - 1)
    out = np.empty((64, len(words)), np.uint32)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        got = cols[word] >> np.uint64(shift)
        if shift + width > 64:
            got |= cols[word + 1] << np.uint64(64 - shift)
        out[i] = got & mask
    return out.T


def encode_segment(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], percentile: int = PERCENTILE) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint32)
    grid[:n] = ids
    grid = grid.reshape(blocks, BLOCK)
    base = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    more = grid - base[:, None]
    at = min(BLOCK - 1, BLOCK * percentile // 100)
    width = _width(np.partition(more, at, axis=1)[:, at]) if blocks else np.zeros(0, np.uint8)
    words = width.astype(np.uint64) * np.uint64(BLOCK // 64)
    start = np.cumsum(words, dtype=np.uint64) - words
    packed = np.zeros(int(words.sum()), np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        low = (more[rows] & np.uint32((1 << w) - 1)).reshape(-1, 64)
        where = start[rows].astype(np.int64)[:, None] + np.arange(w * BLOCK // 64)
        packed[where] = _pack(low, w).reshape(len(rows), -1)
    row, place = np.nonzero(more.astype(np.uint64) >> width.astype(np.uint64)[:, None])
    first = np.searchsorted(row, np.arange(blocks)).astype(np.uint64)
    null = np.array([x is None for x in doc_ids], np.uint8)
    parts = [_HEAD.pack(b"PFB1", BLOCK, n, len(doc_ids), blocks, len(packed), len(row)), np.array([0 if x is None else x for x in doc_ids], "<i8"), null, np.array(lengths, "<u8"), base.astype("<u4"), width, start.astype("<u8"), first.astype("<u8"), packed.astype("<u8"), place.astype(np.uint8), more[row, place].astype("<u4")]
    return b"".join(x if isinstance(x, bytes) else x.tobytes() for x in parts)


def decode_segment(payload: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """ids, document ids, lengths."""
    magic, block, n, docs, blocks, n_words, outliers = _HEAD.unpack_from(payload)
    if magic != b"PFB1":
        raise ValueError("not a segment of token ids")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(payload, kind, count, at)
        at += got.nbytes
        return got

    doc_ids, null, lengths = take("<i8", docs), take("u1", docs), take("<u8", docs)
    base, width, start, first = take("<u4", blocks), take("u1", blocks), take("<u8", blocks), take("<u8", blocks)
    packed, place, value = take("<u8", n_words), take("u1", outliers), take("<u4", outliers)
    grid = np.zeros((blocks, block), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        where = start[rows].astype(np.int64)[:, None] + np.arange(w * block // 64)
        grid[rows] = _unpack(packed[where].reshape(-1, w), w).reshape(len(rows), block)
    row = np.repeat(np.arange(blocks), np.diff(np.append(first, outliers).astype(np.int64)))
    grid[row, place] = value
    grid += base[:, None]
    return grid.reshape(-1)[:n], [None if z else x for x, z in zip(doc_ids.tolist(), null, strict=True)], lengths.astype(np.int64)


def write_blocks(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", percentile: int = PERCENTILE) -> DataFrame:
    """The table of segments, written to the shared folder.

    Rows go in ascending order of id_col (an integer; nulls first), those of one id in the order of a hash of their text;
    the order is by range, so a crowded id is spread too. A null text has the end id alone.
    """
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = wanted.repartitionByRange("id", tie).sortWithinPartitions("id", tie)
    schema = "part int, seg int, ids_before long, n_docs long, n_ids long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seg, before = encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        end = own.value([end_id])
        kept: list[bytes] = []
        doc_ids: list[int | None] = []
        size = 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(kept), "<u4")
            row = (part, seg, before, len(kept), len(ids), encode_segment(ids, doc_ids, [len(x) // 4 for x in kept], percentile))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names)

        for batch in batches:
            for run in slices(batch, "text"):
                kept += [x + end for x in own.encode_all(run.column("text").to_pylist())]
                doc_ids += run.column("id").to_pylist()
                size += sum(map(len, kept[-run.num_rows :])) // 4
                if size >= SEGMENT_IDS:
                    yield closed()
                    seg, before, kept, doc_ids, size = seg + 1, before + size, [], [], 0
        if kept:
            yield closed()

    return written(ordered.mapInArrow(segments, schema), "token-blocks")


def read_blocks(segments: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """A row for each document: id_col, start (ids of all documents before it), n_tokens, ids_crc32, and if asked for its ids as binary.

    What goes to the driver is a number for each part, of which there are as many as partitions at writing.
    """
    totals = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts, total = {}, 0
    for part, n in totals:
        starts[part] = total
        total += n
    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, payload in zip(*(batch.column(k).to_pylist() for k in ("part", "ids_before", "payload")), strict=True):
                ids, doc_ids, lengths = decode_segment(payload)
                data, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
                each = [data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                start = starts[part] + before + ends - lengths
                cols = [pa.array(doc_ids, pa.int64()), pa.array(start, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(each, pa.binary())] * with_ids)], names)

    return segments.select("part", "ids_before", "payload").mapInArrow(read, schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_blocks(write_blocks(table(spark, sf_dir, "documents"), "word_bpe_49k.json", 2))
