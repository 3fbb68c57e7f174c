"""Files by local path or by the URI of a shared file system: their state, ranges of their bytes, and what stands beside them.

A URI (s3://, gs://, hdfs:// and what else Arrow knows) is read through Arrow's file systems, in ranges; anything else is a path of this
machine. What can't be reached is an OSError in either case.
"""

from __future__ import annotations

import itertools
import os
import stat
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs


def local(path: str) -> str:
    return path[5:] if path.startswith("file:") else path


def place(path: str) -> tuple[fs.FileSystem, str] | None:
    """The file system of a URI and the path in it; None for a local path."""
    if "://" not in path or path.startswith("file:"):
        return None
    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise OSError(f"no file system for {path.split('://')[0]}") from e


def _info(at: tuple[fs.FileSystem, str]) -> fs.FileInfo:
    info = at[0].get_file_info(at[1])
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(2, "No such file or directory")
    return info


def real(path: str) -> str:
    """The path with links followed; a URI has none."""
    if at := place(path):
        _info(at)
        return path
    return os.path.realpath(local(path), strict=True)


def size_if_regular(path: str) -> int | None:
    """None for folders, devices and the like."""
    if at := place(path):
        info = _info(at)
        return info.size if info.type == fs.FileType.File else None
    s = os.stat(local(path))
    return s.st_size if stat.S_ISREG(s.st_mode) else None


def snapshot(path: str) -> str:
    """What differs once a file has changed."""
    if at := place(path):
        info = _info(at)
        return f"{info.size}:{info.mtime_ns}"
    s = os.stat(local(path))
    return f"{s.st_dev}:{s.st_ino}:{s.st_size}:{s.st_mtime_ns}:{s.st_ctime_ns}"


def opened(path: str) -> BinaryIO:
    """For reading and seeking."""
    at = place(path)
    return at[0].open_input_file(at[1]) if at else open(local(path), "rb")


def names_beside(path: str, most: int) -> Iterator[str]:
    """Names of the regular files in the path's folder, among its first `most` entries, without its own."""
    if at := place(path):
        found = at[0].get_file_info(fs.FileSelector(at[1].rpartition("/")[0]))
        entries = ((i.base_name, i.type == fs.FileType.File) for i in found[:most])
        yield from (name for name, regular in entries if regular and name != at[1].rpartition("/")[2])
        return
    with os.scandir(os.path.dirname(local(path)) or ".") as it:
        for e in itertools.islice(it, most):
            if e.is_file() and e.name != os.path.basename(local(path)):
                yield e.name


def beside(path: str, name: str) -> str:
    return path.rpartition("/")[0] + "/" + name if "/" in path else name
