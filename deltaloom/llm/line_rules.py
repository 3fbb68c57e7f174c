"""Line-first quality rules.

A text is judged line by line: a line fails for its punctuation (too many symbols or exclamation marks for its
words, or a short line that ends without any), as navigation (separators standing between few words), as
boilerplate (a fixed phrase in a line of at most PHRASE_LINE words, as running text has such phrases too), or because it repeats an earlier line or, in many places, the word before. Failing lines are removed. A document that
loses too much of its words with them is rejected, as is one that fails the base rules on its whole text.

Null and empty texts have no words and are rejected. Rows are judged each for itself, repeated ones alike, in one pass
without a shuffle; an empty table gives an empty one. Only the two named columns are read, so no name can clash; `cleaned` keeps all
columns under their own names, by place. Of equal lines the first stays. A very long text is judged as a whole; memory is some 20 times its bytes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, slices, table
from .kernels import Texts, mix, per_group, runs, windows

#: Base rules: fewest words, window of repeated words, most percent of words in repeated windows.
MIN_WORDS, WINDOW, MAX_REPEATED = 20, 8, 30
#: A line fails beyond so many symbols a word; under so many words without closing punctuation; with separators
#: for at least one in so many words.
SYMBOLS_PER_WORD, SHORT_LINE, SEPARATOR_SHARE = 0.5, 4, 3
#: And if more than this share of its words are equal to the word before.
STUTTER_SHARE = 1 / 3
#: A document is rejected if fewer than this percentage of its words remain.
MIN_KEPT = 50
#: Longest line, in words, that a phrase makes boilerplate.
PHRASE_LINE = 20
#: Two-word phrases of boilerplate lines.
BOILERPLATE = (
    "licensed under", "all rights", "rights reserved", "privacy policy", "cookie policy", "use cookies", "uses cookies",
    "terms of", "click here", "read more", "sign in", "log in", "subscribe to", "share this", "powered by", "skip to",
)
#: Counted by the contract's n_symbols; the line rule also counts ! and ?.
SYMBOLS = b"#*$%&|<>"
CLOSING = b".!?:;\"')]}"


@functools.cache
def _flags(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


@functools.cache
def _boilerplate() -> np.ndarray:
    texts = Texts(pa.array(BOILERPLATE))
    return np.unique(windows(texts.word_hashes(True), 2)[::2])


def _repeated_words(texts: Texts, words: np.ndarray, width: int) -> np.ndarray:
    """Words of each text that stand in a window which the text has twice or more."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(texts.n, np.int64)
    first = np.flatnonzero(texts.doc[:n] == texts.doc[width - 1 :])
    keys = windows(words, width)[first] ^ mix(texts.doc[first].astype(np.uint64) + np.uint64(1))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(texts.n, np.int64)
    at = first[twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys]
    cover = np.bincount(at, minlength=len(words) + width) - np.bincount(at + width, minlength=len(words) + width)
    return per_group(np.cumsum(cover)[: len(words)] > 0, texts.word_offsets)


class _Lines:
    def __init__(self, texts: Texts) -> None:
        buf, offsets = texts.buf, texts.offsets
        starts = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], np.flatnonzero(buf == 10) + 1]))
        self.starts = starts[starts < len(buf)]
        nxt = np.append(self.starts[1:], len(buf))[: len(self.starts)]
        self.ends = nxt - (buf[nxt - 1] == 10) if len(nxt) else nxt
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.of_word = np.searchsorted(self.starts, texts.starts, "right") - 1
        self.n_words = np.bincount(self.of_word, minlength=len(self.starts))

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Flagged bytes of each line; a line's end is not flagged."""
        return runs(flags, self.starts, np.ones(len(self.starts), np.int64))

    def repeats(self, texts: Texts) -> np.ndarray:
        """Whether a line with a word is equal to an earlier one of its text."""
        out = np.zeros(len(self.starts), bool)
        with_word = np.flatnonzero(self.n_words)
        keys = texts.hashes(self.starts[with_word], self.ends[with_word]) ^ mix(self.doc[with_word].astype(np.uint64) + np.uint64(1))
        first = np.unique(keys, return_index=True)[1]
        out[with_word] = True
        out[with_word[first]] = False
        return out


def judge(column: pa.Array, with_text: bool = True) -> tuple[dict[str, np.ndarray], pa.Array]:
    """Figures of each text, and if asked for the texts without their failing lines."""
    texts = Texts(column)
    words, lines = texts.word_hashes(), _Lines(texts)
    chars = texts.count(texts.inside & ((texts.buf & 0xC0) != 0x80))
    symbols = _flags(SYMBOLS)[texts.buf]
    repeats = lines.repeats(texts)
    repeated = _repeated_words(texts, words, WINDOW)
    # rules on lines with words
    n = lines.n_words
    has = n > 0
    last = np.zeros(len(n), np.int64)
    last[lines.of_word] = texts.ends - 1  # the line's last word wins
    closed = _flags(CLOSING)[texts.buf[last]] | (texts.buf[last] >= 0x80) if len(n) else np.zeros(0, bool)
    noisy = lines.count(symbols | _flags(b"!?")[texts.buf]) > SYMBOLS_PER_WORD * np.maximum(n, 1)
    punctuation = has & (noisy | (~closed & (n < SHORT_LINE)))
    apart = (texts.ends - texts.starts == 1) & _flags(b"|>/*")[texts.buf[texts.starts]] if len(texts.starts) else np.zeros(0, bool)
    separators = np.bincount(lines.of_word, weights=apart, minlength=len(n))
    navigation = (separators >= 2) & (separators * SEPARATOR_SHARE >= n)
    trimmed = texts.ends - (_flags(b".,;:!?")[texts.buf[texts.ends - 1]] & (texts.ends - texts.starts > 1)) if len(texts.ends) else texts.ends
    pairs = windows(texts.hashes(texts.starts, trimmed, True), 2)
    phrases = _boilerplate()
    hit = np.flatnonzero(phrases[np.minimum(np.searchsorted(phrases, pairs), len(phrases) - 1)] == pairs)
    hit = hit[lines.of_word[hit] == lines.of_word[hit + 1]] if len(hit) else hit
    boilerplate = np.zeros(len(n), bool)
    boilerplate[lines.of_word[hit]] = True
    boilerplate &= n <= PHRASE_LINE
    same = np.flatnonzero((words[1:] == words[:-1]) & (lines.of_word[1:] == lines.of_word[:-1])) + 1
    stutter = np.bincount(lines.of_word[same], minlength=len(n)) > STUTTER_SHARE * n
    failed = has & (punctuation | navigation | boilerplate | repeats | stutter)
    by_doc = lambda x: np.bincount(lines.doc, weights=x, minlength=texts.n).astype(np.int64)
    n_words = texts.n_words
    kept_words = n_words - by_doc(n * failed)
    base = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n_words)
    figures = {
        "n_words": n_words, "word_chars": chars, "n_symbols": texts.count(symbols), "n_dup_lines": by_doc(repeats), "n_repeat_words": repeated, "base_failed": base,
        "kept": ~base & (100 * kept_words >= MIN_KEPT * n_words), "kept_words": kept_words, "n_lines": by_doc(has),
        "n_punctuation": by_doc(punctuation), "n_navigation": by_doc(navigation), "n_boilerplate": by_doc(boilerplate), "n_stutter": by_doc(stutter & has),
    }
    return figures, _without(column, texts, lines, failed) if with_text else column


def _without(column: pa.Array, texts: Texts, lines: _Lines, failed: np.ndarray) -> pa.Array:
    """The texts without failing lines; those that lose nothing as they are."""
    touched = np.unique(lines.doc[failed])
    if not len(touched):
        return column
    out = column.to_pylist()
    raw, bounds = texts.buf.tobytes(), np.searchsorted(lines.doc, np.arange(texts.n + 1))
    for d in touched.tolist():
        keep = [raw[lines.starts[i] : lines.ends[i]] for i in range(bounds[d], bounds[d + 1]) if not failed[i]]
        out[d] = b"\n".join(keep).decode()
    return pa.array(out, pa.string())


#: What the figures are called, in order, and their types.
COLUMNS = {
    **dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "long"), **dict.fromkeys(("base_failed", "kept"), "boolean"),
    **dict.fromkeys(("kept_words", "n_lines", "n_punctuation", "n_navigation", "n_boilerplate", "n_stutter"), "long"),
}


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """The figures and verdict of each row, and if asked for its text without failing lines as clean_text."""
    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = wanted.schema["id"].dataType.simpleString()
    return wanted.mapInArrow(_judged(["id"], with_text), f"id {kind}, {_schema(with_text)}").withColumnRenamed("id", id_col)


def _schema(with_text: bool) -> str:
    return ", ".join([*(f"{k} {v}" for k, v in COLUMNS.items()), *(["clean_text string"] * with_text)])


def _judged(own: list[str], with_text: bool):
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, "text"):
                figures, clean = judge(part.column("text"), with_text)
                cols = [*(part.column(k) for k in own), *(pa.array(figures[k]) for k in COLUMNS), *([clean] * with_text)]
                yield pa.RecordBatch.from_arrays(cols, [*own, *COLUMNS, *(["clean_text"] * with_text)])

    return judged


def cleaned(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows that are not rejected, with their own columns; the text has lost its failing lines, and its length is anew."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    wanted = docs.toDF(*own).withColumn("text", F.col(own[docs.columns.index(text_col)]))
    schema = ", ".join([*(f"{k} {f.dataType.simpleString()}" for k, f in zip(own, docs.schema, strict=True)), _schema(True)])
    kept = wanted.mapInArrow(_judged(own, True), schema).where("kept")
    new = {text_col: F.col("clean_text"), **({length_col: F.char_length("clean_text").cast(docs.schema[length_col].dataType)} if length_col in docs.columns else {})}
    return kept.select(*(new.get(c, F.col(k)).alias(c) for k, c in zip(own, docs.columns, strict=True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents"))


_PHRASES = ", ".join(f"'{p}'" for p in BOILERPLATE)
#: The same figures and verdicts in SQL, line by line.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS MATERIALIZED (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d
), win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW}) x
), twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) x WHERE c > 1
), rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM twice) x GROUP BY doc_id
), lines AS MATERIALIZED (
  SELECT doc_id, o, l, regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+') AS lw FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS o FROM d) x
), worded AS MATERIALIZED (
  SELECT doc_id, o, l, lw, len(lw) AS n, row_number() OVER (PARTITION BY doc_id, l ORDER BY o) > 1 AS repeats, list_transform(lw, lambda x: CASE WHEN len(x) > 1 THEN regexp_replace(x, '[.,;:!?]$', '') ELSE x END) AS trimmed
  FROM lines WHERE len(lw) > 0
), judged AS (
  SELECT doc_id, n, repeats,
    len(regexp_extract_all(l, '[#*$%&|<>!?]')) > {SYMBOLS_PER_WORD} * n OR (n < {SHORT_LINE} AND NOT regexp_matches(lw[-1], '([.!?:;"'')\\]}}]|[^\\x00-\\x7F])$')) AS punctuation,
    len(list_filter(lw, lambda x: x IN ('|', '>', '/', '*'))) >= 2 AND len(list_filter(lw, lambda x: x IN ('|', '>', '/', '*'))) * {SEPARATOR_SHARE} >= n AS navigation,
    n <= {PHRASE_LINE} AND len(list_filter(range(1, n), lambda i: translate(trimmed[i] || ' ' || trimmed[i + 1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({_PHRASES}))) > 0 AS boilerplate,
    len(list_filter(range(1, n), lambda i: lw[i] = lw[i + 1])) > n / 3.0::DOUBLE AS stutter
  FROM worded
), s AS (
  SELECT doc_id, sum(repeats::INTEGER)::BIGINT AS n_dup_lines, sum(CASE WHEN repeats OR punctuation OR navigation OR boilerplate OR stutter THEN n ELSE 0 END)::BIGINT AS lost, count(*) AS n_lines,
    sum(punctuation::INTEGER)::BIGINT AS n_punctuation, sum(navigation::INTEGER)::BIGINT AS n_navigation, sum(boilerplate::INTEGER)::BIGINT AS n_boilerplate, sum(stutter::INTEGER)::BIGINT AS n_stutter FROM judged GROUP BY doc_id
), f AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(w)::BIGINT - coalesce(lost, 0) AS kept_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_punctuation, 0) AS n_punctuation, coalesce(n_navigation, 0) AS n_navigation, coalesce(n_boilerplate, 0) AS n_boilerplate, coalesce(n_stutter, 0) AS n_stutter
  FROM w LEFT JOIN s USING (doc_id) LEFT JOIN rep USING (doc_id)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 100 * kept_words >= {MIN_KEPT} * n_words AS kept FROM f
"""
