"""Token counts of whole texts by a whole-token shortcut.

Before any text is read, every string of the vocabulary is encoded alone; those that come back as one token
are whole. In a text, a pre-token that is whole counts as one without any merging; only the rest is merged,
by the library, and each such pre-token once in a while.

Null and empty texts have no bytes and no tokens. Repeated rows are counted each for itself, an empty table
gives an empty one, and columns other than the two named are dropped, so that no name can clash. A very long text is counted in segments.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table
from .tokens import KEPT, Encoder, load


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def prove_whole(encoder: Encoder) -> frozenset[str]:
    """The vocabulary's strings that encode alone as one token."""
    byte_of, strings = _byte_of(), []
    for piece in encoder.library.get_vocab(False):
        if encoder.at_end and not piece.endswith("</w>"):
            continue  # a word's beginning or middle never stands alone
        try:
            strings.append(bytes(byte_of[c] for c in (piece.removesuffix("</w>") if encoder.at_end else piece)).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    got = encoder.library.encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, got, strict=True) if len(e.ids) == 1)


class TokenCounter(Encoder):
    """The value of a chunk is its number of tokens."""

    def __init__(self, name: str, most: int = KEPT, proven: frozenset[str] | None = None) -> None:
        super().__init__(name, most)
        self.proven = prove_whole(self) if proven is None else proven

    joined = staticmethod(sum)

    def of_pretokens(self, pretokens: list[str]) -> dict[str, object]:
        out: dict[str, object] = dict.fromkeys(self.proven.intersection(pretokens), 1)
        rest = [x for x in pretokens if x not in out]
        run = [x for x in rest if self.alone(x)]
        if run and (found := self.cuts(run)) is not None:
            out.update(zip(run, np.diff(found[1]).tolist(), strict=True))
            rest = [x for x in rest if x not in out]
        if rest:
            out.update((x, len(e.ids)) for x, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True))
        return out

    def count_all(self, texts: list[str | None]) -> list[int]:
        return self.each(texts, sum, len)


@functools.cache
def proven_of(name: str) -> frozenset[str]:
    """The proof, made once by the driver."""
    return prove_whole(Encoder(name))


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of each row. One pass, no shuffle."""
    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = wanted.schema["id"].dataType
    proven = docs.sparkSession.sparkContext.broadcast(proven_of(vocabulary))  # bounded by the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(TokenCounter, vocabulary, proven=proven.value)
        for batch in batches:
            for part in slices(batch, "text"):
                n = own.count_all(part.column("text").to_pylist())
                size = pa.compute.binary_length(part.column("text")).fill_null(0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    out = wanted.mapInArrow(count, f"id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def query(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
