"""The tensor-file container: 8-byte little-endian header length, JSON header, tensor bytes.

Files are listed, not loaded: rows carry paths and byte ranges, and the task that needs a tensor reads its range alone. So
a file of any size is read with the memory of one pair of tensors. What a file claims is checked before
anything is allocated, and whatever is wrong becomes a row with a reason, never a failed job.

Paths are opened by the executors: local ones must be on a file system that these share, URIs are read through Arrow. A path that
no executor can open is such a row too.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grouped
from . import files

# Limits of the format's reader.
MAX_FILE = 64 << 30
MAX_HEADER = 100 << 20
MAX_HASHED_HEADER = 256 << 20
MAX_NUMEL = 1_000_000_000
MAX_RANK = 1024
SUFFIXES = [".safetensors"]
WIDTHS = {"F32": 4, "F16": 2, "BF16": 2}
CHUNK = 4 << 20

HEADER_SCHEMA = "path string, length long, data_offset long, header string, error string"
ENTRY = "struct<dtype:string,shape:array<bigint>,data_offsets:array<bigint>>"


def guard(path: str) -> str | None:
    """Why a path may not be read, or None."""
    try:
        real = files.real(path)
        size = files.size_if_regular(real)
    except OSError as e:
        return f"unreadable: {e.strerror or e}"
    if size is None:
        return "not a regular file"
    if os.path.splitext(real)[1] not in SUFFIXES and os.path.splitext(path)[1] not in SUFFIXES:
        return "unsupported suffix"
    return "file too large" if size > MAX_FILE else None


def read_header(path: str) -> tuple[str, int, int]:
    """The header's text, where the data begins, and the file's size; ValueError if any of it can't be."""
    if why := guard(path):
        raise ValueError(why)
    with files.opened(path) as f:
        size = f.seek(0, os.SEEK_END)
        f.seek(0)
        head = f.read(8)
        if len(head) < 8:
            raise ValueError("file shorter than its header length")
        (n,) = struct.unpack("<Q", head)
        if n > MAX_HEADER or n + 8 > size:
            raise ValueError("header length out of range")
        text = f.read(n)
    try:
        if not isinstance(json.loads(text), dict):
            raise ValueError("header is not an object")
        return text.decode(), 8 + n, size
    except (UnicodeDecodeError, json.JSONDecodeError, RecursionError) as e:
        raise ValueError("header is not JSON") from e


def headers(paths: DataFrame) -> DataFrame:
    """HEADER_SCHEMA of a table with a column path; a file that can't be read has an error instead."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    text, at, size = read_header(path)
                    rows.append((path, size, at, text, None))
                except (ValueError, OSError) as e:
                    rows.append((path, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "length", "data_offset", "header", "error"])

    return paths.select("path").mapInPandas(read, HEADER_SCHEMA)


def entries(heads: DataFrame) -> DataFrame:
    """A row for each tensor of the header: path, length, data_offset, key, dtype, shape, data_offsets, raw."""
    doc = F.from_json("header", "map<string,string>")
    each = heads.where("error IS NULL").select("path", "length", "data_offset", F.explode(doc).alias("key", "raw")).where("key <> '__metadata__'")
    e = F.from_json("raw", ENTRY)
    return each.select("*", e["dtype"].alias("dtype"), e["shape"].alias("shape"), e["data_offsets"].alias("data_offsets"))


def metadata(heads: DataFrame) -> DataFrame:
    """path and the header's own map of strings, empty if there is none."""
    doc = F.from_json(F.get_json_object("header", "$.__metadata__"), "map<string,string>")
    return heads.where("error IS NULL").select("path", F.coalesce(doc, F.create_map().cast("map<string,string>")).alias("metadata"))


def numel(shape):
    return F.aggregate(shape, F.lit(1.0), lambda a, x: a * x)


def entry_problem(raw, dtype, shape, offsets, data_length):
    """The first check that a header entry fails; null if it is sound."""
    size = numel(shape)
    width = F.element_at(F.create_map(*(F.lit(x) for kv in WIDTHS.items() for x in kv)), dtype)
    start, end = F.get(offsets, F.lit(0)), F.get(offsets, F.lit(1))
    return (
        F.when(~F.coalesce(raw.rlike("^\\s*[{]"), F.lit(False)), "entry is not an object")
        .when(dtype.isNull() | ~dtype.isin(list(WIDTHS)), F.concat(F.lit("unsupported dtype "), F.coalesce(dtype, F.lit("none"))))
        .when(shape.isNull() | F.exists(shape, lambda x: x.isNull() | (x < 0)), "invalid shape")
        .when(size > MAX_NUMEL, "tensor too large")
        .when(offsets.isNull() | (F.size(offsets) != 2) | start.isNull() | end.isNull(), "invalid offsets")
        .when((start < 0) | (end < start) | (end > data_length), "offsets out of range")
        .when(F.when(dtype.isin(list(WIDTHS)), (end - start) != size * width), "byte length does not match the shape")
    )


def checked(tensors: DataFrame) -> DataFrame:
    """entries with `problem`."""
    return tensors.withColumn("problem", entry_problem(F.col("raw"), F.col("dtype"), F.col("shape"), F.col("data_offsets"), F.col("length") - F.col("data_offset")))


def inconsistent(tensors: DataFrame) -> DataFrame:
    """path and reason of files whose tensors do not tile their data: gaps, overlaps, or bytes left over."""
    o = lambda i: F.get(F.col("data_offsets"), F.lit(i))
    t = tensors.where(F.size("data_offsets") == 2).select("path", (F.col("length") - F.col("data_offset")).alias("size"), o(0).alias("s"), o(1).alias("e"))
    bad = t.withColumn("gap", grouped.apart("s", "e", ["path"])).groupBy("path").agg(F.max(F.col("gap").cast("int")).alias("gap"), F.max("e").alias("last"), F.first("size").alias("size"))
    return bad.where("gap = 1 OR last <> size").select("path", F.when(F.col("gap") == 1, "tensors do not follow each other").otherwise("data after the last tensor").alias("reason"))


def decode(raw: bytes, dtype: str, shape: list[int]) -> np.ndarray:
    """float32 values; a BF16 number is the upper half of one."""
    if dtype == "BF16":
        flat = (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
    else:
        flat = np.frombuffer(raw, {"F32": "<f4", "F16": "<f2"}[dtype]).astype(np.float32)
    return flat.reshape(shape)


def load(path: str, data_offset: int, dtype: str, shape, data_offsets) -> np.ndarray:
    a, b = int(data_offsets[0]), int(data_offsets[1])
    with files.opened(path) as f:
        f.seek(data_offset + a)
        raw = f.read(b - a)
    if len(raw) != b - a:
        raise ValueError("file ends within a tensor")
    return decode(raw, dtype, [int(x) for x in shape])


def write(path: str, tensors: dict[str, np.ndarray], meta: dict[str, str] | None = None, bf16: tuple[str, ...] = ()) -> None:
    """A file of float32 tensors (float16 as they are; those named as BF16 lose their lower half)."""
    header, at, data = ({"__metadata__": meta} if meta else {}), 0, []
    for key, value in tensors.items():
        value = np.ascontiguousarray(value)
        if key in bf16:
            raw, dtype = (value.astype("<f4").view(np.uint32) >> 16).astype("<u2").tobytes(), "BF16"
        elif value.dtype == np.float16:
            raw, dtype = value.astype("<f2").tobytes(), "F16"
        else:
            raw, dtype = value.astype("<f4").tobytes(), "F32"
        header[key] = {"dtype": dtype, "shape": list(value.shape), "data_offsets": [at, at + len(raw)]}
        at += len(raw)
        data.append(raw)
    text = json.dumps(header).encode()
    text += b" " * (-len(text) % 8)
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(text)) + text + b"".join(data))


def identity(paths: DataFrame) -> DataFrame:
    """path, content_hash, header_hash, file_size_bytes, state (to see later whether the file changed); hashes are null if it can't be read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    if guard(path):
                        raise OSError
                    state, whole = files.snapshot(path), hashlib.sha256()
                    with files.opened(path) as f:
                        (n,) = struct.unpack("<Q", f.read(8).ljust(8, b"\0"))
                        head = f.read(n) if n <= MAX_HASHED_HEADER else b""
                        f.seek(0)
                        while part := f.read(CHUNK):
                            whole.update(part)
                        size = f.tell()
                    rows.append((path, f"sha256:{whole.hexdigest()}", f"sha256:{hashlib.sha256(head).hexdigest()}", size, state))
                except OSError:
                    rows.append((path, None, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "content_hash", "header_hash", "file_size_bytes", "state"])

    return paths.select("path").mapInPandas(read, "path string, content_hash string, header_hash string, file_size_bytes long, state string")


def changed(identities: DataFrame) -> DataFrame:
    """path of files that are no longer what they were when they were hashed."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            def now(p: str) -> str | None:
                try:
                    return files.snapshot(p)
                except OSError:
                    return None

            yield pd.DataFrame({"path": batch["path"], "state_now": [now(p) for p in batch["path"]]})

    later = identities.select("path").mapInPandas(read, "path string, state_now string")
    return identities.join(later, "path").where(F.col("state").isNotNull() & ~F.col("state").eqNullSafe(F.col("state_now"))).select("path")
