"""Packing of documents into training sequences by shortest-pack-first over the histogram of lengths.

Each document is encoded, ended with an id, and cut into pieces of at most `limit` ids; all but the last are full.
The histogram of piece lengths (at most `limit` numbers) decides the packing on the driver: from the longest length
down, all pieces of a length are put into the packs with the most room, a pack being a pattern of lengths with a count,
and a count is split where only some of its packs get a piece. Pieces then find their sequence by rank among
those of their length.

A null text is an empty one: its piece is the end id alone. Repeated rows are packed each for itself, and rows with null ids too. An empty table
gives an empty result. Columns other than the two named are dropped, so no name can clash. Pieces that tie in all their figures are alike, and
either may take the other's place. A very long text is encoded in segments; its ids are held as a whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, table, written
from .tokens import KEPT, encoder

LIMIT = 2048
#: Groups in which the pieces of a length are ranked, by a hash: a third of all pieces may have one length.
SALTS = 1024


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, kept: int = KEPT) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens of each piece, and if asked for its ids as binary (little-endian u32)."""
    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = wanted.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + with_ids]
    step = 4 * limit

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, kept)
        end = own.value([end_id])
        for batch in batches:
            for run in slices(batch, "text"):
                row, start, size, crc, total, ids = [], [], [], [], [], []
                for i, data in enumerate(own.encode_all(run.column("text").to_pylist())):
                    data += end
                    for at in range(0, len(data), step):
                        piece = data[at : at + step]
                        row.append(i)
                        start.append(at // 4)
                        size.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(len(data) // 4)
                        if with_ids:
                            ids.append(piece)
                cols = [run.column("id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(ids, pa.binary())] * with_ids)], names)

    return wanted.mapInArrow(cut, schema)


def shortest_pack_first(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[int]]]:
    """Patterns as (count, lengths), such that the counts use up the histogram and no pattern is longer than limit."""
    room: list[list[tuple[int, list[int]]]] = [[] for _ in range(limit + 1)]  # patterns by the room they have left
    most = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 1 <= length <= limit:
            raise ValueError(f"a piece of {length} in sequences of {limit}")
        grown: list[tuple[int, int, list[int]]] = []
        gap = most
        while left and gap >= length:
            while left and room[gap]:
                count, pattern = room[gap].pop()
                used = min(count, left)
                if used < count:
                    room[gap].append((count - used, pattern))
                left -= used
                grown.append((gap - length, used, [*pattern, length]))
            if grown and left:  # those just grown may take another of this length
                for g, used, pattern in grown:
                    room[g].append((used, pattern))
                grown = []
            gap -= 1
        if left:
            each = limit // length  # a new pack takes as many of this length as fit
            full, rest = divmod(left, each)
            if full:
                grown.append((limit - each * length, full, [length] * each))
            if rest:
                grown.append((limit - rest * length, 1, [length] * rest))
        for g, used, pattern in grown:
            room[g].append((used, pattern))
            most = max(most, g)
    return [x for patterns in room for x in patterns]


def placement(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """For each slot of each pattern the ranks that it takes: length, first rank, first sequence, offset; sorted by length and rank."""
    taken: dict[int, int] = {}
    slots, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            first = taken.get(length, 0)
            slots.append((length, first, sequence, offset))
            taken[length] = first + count
            offset += length
        sequence += count
    cols = np.array(sorted(slots), np.int64).reshape(-1, 4).T
    return dict(zip(("length", "first", "sequence", "offset"), cols, strict=True))


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """pieces with sequence_id and offset. The pieces must be a written table: they are read three times."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = placement(shortest_pack_first(counts, limit))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(SALTS)))
    sizes = salted.groupBy("length", "salt").count()
    before = sizes.select("length", "salt", (F.sum("count").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, 0)) - F.col("count")).alias("before"))
    in_group = F.row_number().over(W.partitionBy("length", "salt").orderBy("id", "start", "ids_crc32", "doc_tokens")) - 1
    ranked = salted.withColumn("rank", in_group.cast("long")).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "salt")
    own = pieces.columns
    names = [*own, "sequence_id", "offset"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id long, offset long"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.int64(1 << 48)  # more ranks than pieces
        keys = slots["length"] * shift + slots["first"]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            at = np.searchsorted(keys, length * shift + rank, "right") - 1
            sequence = slots["sequence"][at] + rank - slots["first"][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in own), pa.array(sequence), pa.array(slots["offset"][at])], names)

    return ranked.select(*own, "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, kept: int = KEPT) -> DataFrame:
    """A row for each piece: id_col, start, length, ids_crc32, doc_tokens, (ids,) sequence_id, offset. kept: chunks that a Python worker may keep."""
    pieces = written(cut_pieces(docs, vocabulary, end_id, limit, id_col, text_col, with_ids, kept), "pieces")
    return pack(pieces, limit).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame, limit: int = LIMIT) -> DataFrame:
    """sequence_id, ids (binary), n_ids of each sequence, from a packed table with ids; at most `limit` pieces meet in a group."""
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_ids"))
    return grouped.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), "n_ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 1)
