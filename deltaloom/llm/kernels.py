"""Word-level numpy kernels over the bytes of a slice of texts.

A word is a longest run of bytes other than space and \\x09-\\x0D, which in UTF-8 is the same as
`[^\\x20\\x09-\\x0D]+` on characters. Hashes have 64 bits and are the same on every machine and run.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes whose running hash sums exist at a time.
HASH_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@functools.cache
def _byte_values(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=U64)
    if lower:
        codes[65:91] += U64(32)
    return mix(codes + U64(0x51ED270B))


@functools.cache
def _space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


@functools.cache
def _punctuation() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
    return table


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept for slices of the usual size only."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = np.empty(max(n, 1), U64)
        found[0], have = 1, 1
        while have < n:
            step = U64(pow(base, have, 1 << 64))
            more = min(have, n - have)
            found[have : have + more] = found[:more] * step
            have += more
        if n <= 2 << 20:
            _powers[base] = found
    return found[:n]


class Texts:
    """The bytes of a string array with its word boundaries; null texts are empty. Folded, the letters from U+00C0 to U+00DE are small."""

    def __init__(self, texts: pa.Array, fold: bool = False) -> None:
        if texts.null_count:
            texts = texts.fill_null("")
        large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2] if len(texts) else None
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.buf = raw[offsets[0] : offsets[-1]]
        if fold and len(self.buf):
            self.buf = self.buf.copy()
            at = np.flatnonzero(self.buf[:-1] == 0xC3) + 1
            self.buf[at[(self.buf[at] < 0x9F) & (self.buf[at] != 0x97)]] += 0x20
        self.offsets = offsets - offsets[0]
        self.n = len(texts)
        inside = ~_space()[self.buf]
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        first = self.offsets[:-1]
        before[first[first < len(inside)]] = False
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        last = self.offsets[1:]
        after[last[last > 0] - 1] = False
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.n_words = np.bincount(self.doc, minlength=self.n).astype(np.int64)
        self.word_offsets = np.concatenate([[0], np.cumsum(self.n_words)])

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """A hash of each span of bytes; equal for equal bytes wherever they stand.

        The running sums come block by block and are kept at the spans' edges only, so a long text takes no more memory than a block does.
        """
        n, step = len(self.buf), min(HASH_BLOCK, len(self.buf) + 1)
        power, back = powers(_BASE, step + 1), powers(pow(_BASE, -1, 1 << 64), step + 1)
        first, last, shift = (np.zeros(len(starts), U64) for _ in range(3))
        total, scale, inverse = 0, 1, 1
        one = n < step
        for at in range(0, n + 1, step):
            part = self.buf[at : at + step]
            sums = np.zeros(len(part) + 1, U64)
            np.cumsum(_byte_values(lower)[part] * power[: len(part)], out=sums[1:])
            sums = sums * U64(scale) + U64(total)
            here = slice(None) if one else np.flatnonzero((starts >= at) & (starts < at + step))
            first[here], shift[here] = sums[starts[here] - at], back[starts[here] - at] * U64(inverse)
            here = slice(None) if one else np.flatnonzero((ends >= at) & (ends < at + step))
            last[here] = sums[ends[here] - at]
            total, scale, inverse = int(sums[-1]), scale * int(power[step]) % (1 << 64), inverse * int(back[step]) % (1 << 64)
        return mix((last - first) * shift + (ends - starts).astype(U64))

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        return self.hashes(self.starts, self.ends, lower)

    def trimmed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words without ASCII punctuation around them, and which words have anything else."""
        starts, ends, mark = self.starts.copy(), self.ends.copy(), _punctuation()
        for step, edge in ((-1, ends), (1, starts)):
            open_ = np.arange(len(edge))
            while len(open_):
                at = edge[open_] - 1 if step < 0 else edge[open_]
                open_ = open_[(starts[open_] < ends[open_]) & mark[self.buf[np.minimum(at, len(self.buf) - 1)]]]
                edge[open_] += step
        return starts, ends, starts < ends

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Flagged bytes of each text."""
        return runs(flags, self.offsets[:-1], self.offsets[1:] - self.offsets[:-1])


def runs(flags: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of flags over neighbouring runs that begin at starts; what stands between two runs must not be flagged."""
    out = np.zeros(len(starts), np.int64)
    some = np.flatnonzero(sizes > 0)
    if len(some):
        out[some] = np.add.reduceat(flags.view(np.uint8), starts[some], dtype=np.int64)
    return out


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` word hashes, at its first word; shorter by width - 1 than words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    factor = 1
    for j in range(width):
        total += words[j : j + n] * U64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    return mix(total)


def per_group(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags between neighbouring offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
