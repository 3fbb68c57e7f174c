"""Benchmark decontamination by template canonicalisation.

Words lose their case and the punctuation around them; numbers, names and units become typed placeholders, whose own words
are kept as slot values. Windows of WIDTH canonical words of documents meet those of benchmark items in a hash join. Along one alignment of
document and item, the slots must be consistent: each value of the item has always the same value in the document (two values may get the
same one). So a question whose numbers or names were replaced throughout is caught, and a template that only looks
alike is not. Alignments are taken from the one with the most windows on (of equal ones, the one that begins first in the document); one whose slots contradict
those taken is left out. An item is in a document if the alignments taken hold at least COVERAGE of its windows.

A number is a word that begins with a digit, or a number word; a unit is a unit word after a number; a name is a
capitalised word (A-Z, then not A-Z) within a sentence. A window needs literal words for more than half of it.

All windows also meet exactly, on the lower-case words themselves: a verbatim copy is found whatever its words are, and in any case of letters.
An item is found if its template windows or its exact windows reach COVERAGE, each of all windows of their sort.

Items of fewer than WIDTH words have one window of their own width; those of fewer than LEAST words are only met exactly. Items without a word and null
texts are never found. Documents are matched on their whole texts. Rows without a doc_id can't be reported. Repeated items and repeated rows
of a document are each one item and one document. Empty tables give an empty result. Other columns are ignored, whatever their names. A very
long text is one slice, with memory of some 40 times its bytes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, slices, table
from .kernels import Texts, mix, windows

WIDTH, LEAST = 8, 4
COVERAGE = 0.4
#: Added to the width in the hashes of exact windows.
EXACT = 1 << 32


def _sorts(width: int) -> tuple[bool, ...]:
    """Whether exact, of each sort of windows of a width."""
    return (False, True) if width >= LEAST else (True,)


#: The join's smaller side is broadcast only if it has at most so many windows.
MOST_BROADCAST = 200_000
#: A fixed number of bits marks the hashes of all item windows; document windows without a mark never leave the task.
MARK_BITS = 24
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "dozen", "half", "twice")
UNIT_WORDS = ("mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "lb", "lbs", "ounce", "ounces", "oz", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "usd", "eur", "percent", "degrees", "mph", "kmh")
NUMBER, NAME, UNIT = 1, 2, 3


@functools.cache
def _known(words: tuple[str, ...]) -> np.ndarray:
    return np.sort(Texts(pa.array(words)).word_hashes(True))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


class Canonical:
    """Canonical words of a slice: value (hash of the word), kind (0 literal), word (hash, or that of the placeholder), text, place in it."""

    def __init__(self, column: pa.Array) -> None:
        texts = Texts(column, fold=True)
        starts, ends, real = texts.trimmed()
        buf = texts.buf
        at = np.flatnonzero(real)
        start, end = starts[at], ends[at]
        self.n, self.text = texts.n, texts.doc[at]
        self.value = texts.hashes(start, end, lower=True)
        first, second = buf[start], buf[np.minimum(start + 1, len(buf) - 1)]
        number = ((first >= 48) & (first <= 57)) | _among(self.value, _known(NUMBER_WORDS)) if len(at) else np.zeros(0, bool)
        before = np.maximum(at - 1, 0)
        inner = np.zeros(len(at), bool)  # neither first in its text or line nor after the end of a sentence
        if len(at):
            lines = np.concatenate([[0], np.cumsum(buf == 10)])
            closing = buf[texts.ends[before] - 1]
            inner = (at > 0) & (texts.doc[before] == texts.doc[at]) & (lines[texts.starts[at]] == lines[texts.starts[before]]) & ~np.isin(closing, np.frombuffer(b".!?:;", np.uint8))
        name = (first >= 65) & (first <= 90) & (end - start > 1) & ~((second >= 65) & (second <= 90)) & inner & ~number
        after_number = np.zeros(len(at), bool)
        after_number[1:] = number[:-1] & (self.text[1:] == self.text[:-1])
        unit = after_number & _among(self.value, _known(UNIT_WORDS)) & ~number if len(at) else name
        self.kind = np.select([number, unit, name], [NUMBER, UNIT, NAME], 0)
        self.word = np.where(self.kind > 0, mix(self.kind.astype(np.uint64)), self.value)
        self.offsets = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=self.n))]).astype(np.int64)
        self.place = np.arange(len(at)) - self.offsets[self.text]

    def windows(self, width: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of windows within one text: of all if exact, else of those with literal words for more than half."""
        n = len(self.word) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        within = self.text[:n] == self.text[width - 1 :]
        if exact:
            first = np.flatnonzero(within)
            return first, windows(self.value, width)[first] ^ mix(np.array([width + EXACT], np.uint64))[0]
        literal = np.concatenate([[0], np.cumsum(self.kind == 0)])
        first = np.flatnonzero(within & (2 * (literal[width:] - literal[:n]) > width))
        return first, windows(self.word, width)[first] ^ mix(np.array([width], np.uint64))[0]

    def slots(self, first: np.ndarray, width: int, exact: bool) -> pa.Array:
        """The slot values of windows, in order; exact windows have none."""
        places = np.flatnonzero(self.kind) if not exact else np.zeros(0, np.int64)
        a, b = np.searchsorted(places, first), np.searchsorted(places, first + width)
        flat = np.concatenate([places[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]) if len(first) else places[:0]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(b - a)]), pa.int32()), pa.array(self.value[flat].view(np.int64)))


def item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, pos, h, slots, n_windows (of its sort), width, exact of every window of every item."""
    wanted = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    kind = wanted.schema["item"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, "text"):
                canon = Canonical(part.column("text"))
                size = np.diff(canon.offsets)
                for width, exact in ((w, e) for w in sorted({min(WIDTH, n) for n in size.tolist() if n}) for e in _sorts(w)):
                    first, h = canon.windows(width, exact)
                    own = (size >= WIDTH) if width == WIDTH else (size == width)
                    use = own[canon.text[first]]
                    first, h = first[use], h[use]
                    total = np.bincount(canon.text[first], minlength=canon.n)
                    cols = [part.column("item").take(pa.array(canon.text[first])), pa.array(canon.place[first]), pa.array(h.view(np.int64)), canon.slots(first, width, exact), pa.array(total[canon.text[first]]), pa.array(np.full(len(first), width, np.int32)), pa.array(np.full(len(first), exact))]
                    yield pa.RecordBatch.from_arrays(cols, ["item", "pos", "h", "slots", "n_windows", "width", "exact"])

    return wanted.mapInArrow(cut, f"item {kind}, pos long, h long, slots array<long>, n_windows long, width int, exact boolean")


def _marks(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << (MARK_BITS - 3), np.uint8)
    place = hashes >> np.uint64(64 - MARK_BITS)
    np.bitwise_or.at(bits, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
    return bits


def document_windows(docs: DataFrame, widths: list[int], marks: np.ndarray | None, id_col: str, text_col: str) -> DataFrame:
    """id, pos, h, slots of the windows of all documents whose hash is marked (all windows without marks)."""
    wanted = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = wanted.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, "text"):
                canon = Canonical(part.column("text"))
                for width, exact in ((w, e) for w in widths for e in _sorts(w)):
                    first, h = canon.windows(width, exact)
                    if marks is not None and len(h):
                        place = h >> np.uint64(64 - MARK_BITS)
                        use = np.flatnonzero((marks[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
                        first, h = first[use], h[use]
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(canon.text[first])), pa.array(canon.place[first]), pa.array(h.view(np.int64)), canon.slots(first, width, exact)], ["id", "pos", "h", "slots"])

    return wanted.mapInArrow(cut, f"id {kind}, pos long, h long, slots array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """id_col, item_col, n_windows (of the item, found), coverage, n_slots, n_changed (slots whose value is another), for each item in a document."""
    items = item_windows(benchmark.where(F.col(item_col).isNotNull()), item_col, item_text_col).distinct()
    n, widths = items.agg(F.count("*"), F.collect_set("width")).first()
    marks = None
    if n <= MOST_BROADCAST:  # else most marks would be set, and all windows meet in the join
        marks = _marks(np.array([r["h"] for r in items.select("h").distinct().collect()], np.int64).view(np.uint64))
        items = F.broadcast(items)
    found = document_windows(docs, sorted(widths), marks, id_col, text_col)
    items = items.select("item", F.col("pos").alias("at"), "h", F.col("slots").alias("item_slots"), "n_windows", "exact")
    met = found.join(items, "h").where(F.size("slots") == F.size("item_slots"))
    # one alignment of a document and an item: its windows, and its distinct pairs of slot values
    pairs = F.array_distinct(F.flatten(F.collect_set(F.arrays_zip(F.col("item_slots").alias("b"), F.col("slots").alias("d")))))
    lined = met.groupBy("id", "item", "exact", (F.col("pos") - F.col("at")).alias("shift")).agg(F.collect_set("at").alias("places"), F.first("n_windows").alias("total"), pairs.alias("pairs"))
    # within an alignment each value of the item has one value in the document; so it must have over all alignments that count
    one_each = lambda p: F.size(F.array_distinct(F.transform(p, lambda x: x["b"]))) == F.size(p)
    ordered = F.array_sort(F.collect_list(F.struct((-F.size("places")).alias("o"), "shift", "places", "pairs")))
    all_lined = lined.where(one_each(F.col("pairs"))).groupBy("id", "item", "exact").agg(F.max("total").alias("total"), ordered.alias("lines"))
    start = F.struct(F.array().cast("array<bigint>").alias("places"), F.array().cast("array<struct<b:bigint,d:bigint>>").alias("pairs"))
    both = lambda acc, x: F.get(F.transform(F.array(F.array_union(acc["pairs"], x["pairs"])), lambda p: F.when(one_each(p), F.struct(F.array_union(acc["places"], x["places"]).alias("places"), p.alias("pairs"))).otherwise(acc)), F.lit(0))
    taken = all_lined.withColumn("t", F.aggregate("lines", start, both))
    out = taken.select("id", "item", "exact", "total", F.size("t.places").cast("long").alias("n_windows"), F.size("t.pairs").cast("long").alias("n_slots"), F.size(F.filter("t.pairs", lambda p: p["b"] != p["d"])).cast("long").alias("n_changed"))
    share = F.col("n_windows") / F.col("total")
    # of two sorts that reach it, the template's figures
    best = out.where(share >= coverage).groupBy("id", "item").agg(F.min(F.struct("exact", "n_windows", share.alias("coverage"), "n_slots", "n_changed")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.n_windows", "b.coverage", "b.n_slots", "b.n_changed")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.join(contaminated(docs, benchmark, id_col).select(id_col).distinct(), id_col, "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
