"""Toxicity as an ordinal grade, by cumulative-link regression on sparse words.

Severity has the grades 0 (not toxic) to 3. P(grade <= k) = logistic(t[k] - x.b): one weight vector b for all
grades, with ordered thresholds t. Features are sparse: whether a word, or a beginning of words, stands in the text once,
twice, three times at least. Words are lower-cased and without punctuation around them; beginnings have PREFIXES bytes.
Labels have two values, so the training grade of a toxic text is the third in which it falls among the toxic ones by the share of its words
that point to toxicity in the other half of the sample: neither its own label nor its own words choose what it is graded by.

The model is fitted on the driver on a bounded sample of labelled texts (PER_CLASS of each label, MOST_CHARS
characters of each); all texts are scored in full, in one pass without a shuffle.

Null and empty texts and texts without words have expected severity 0 and grade 0. Without labels of both kinds all
texts get 0. Repeated rows are scored each for itself, and equal texts alike. An empty table gives an empty one. Columns other than the two named
are dropped, so no name can clash. A very long text is scored as a whole, with memory of some 40 times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, slices, table
from .kernels import Texts
from .sampling import sample, without_copies

GRADES = 4
LEVELS = 3
PREFIXES = (4, 5, 6, 7, 8)
PER_CLASS = 1200
#: At most so many features; each is true of at least so many texts of the sample.
FEATURES, MIN_TEXTS = 800, 8
#: Log-odds and their z-value from which on a feature points to toxicity.
POINTING, POINTING_Z = 2.0, 5.0
RIDGE, ROUNDS, STEP = 1e-4, 600, 0.05


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _parts(texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, word) of all words, then of the beginnings of each length; and last the text of each word."""
    starts, ends, real = texts.trimmed()
    starts, ends, doc = starts[real], ends[real], texts.doc[real]
    spans = [(starts, ends, np.arange(len(starts)))]
    for n in PREFIXES:
        longer = np.flatnonzero(ends - starts > n)
        spans.append((starts[longer], starts[longer] + n, longer))
    flat = texts.hashes(np.concatenate([a for a, _, _ in spans]), np.concatenate([b for _, b, _ in spans]), lower=True)
    cuts = np.cumsum([len(a) for a, _, _ in spans])[:-1]
    return [(h, w) for h, (_, _, w) in zip(np.split(flat, cuts), spans, strict=True)] + [(doc, doc)]


class Ordinal:
    """hashes (sorted): the words and beginnings that are features; chosen: their levels that have a weight."""

    def __init__(self, hashes: np.ndarray, chosen: np.ndarray) -> None:
        self.hashes, self.chosen = hashes, chosen
        self.weights = np.zeros(int(chosen.sum()))
        self.thresholds = np.zeros(GRADES - 1)

    def counts(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, feature and count where a text has a feature."""
        *parts, (doc, _) = _parts(texts)
        keys = []
        for h, word in parts:
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == h)
            keys.append(doc[word[hit]] * len(self.hashes) + at[hit])
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        return key // len(self.hashes), key % len(self.hashes), n

    def linear(self, texts: Texts) -> np.ndarray:
        doc, feature, n = self.counts(texts)
        by_level = np.zeros(self.chosen.shape)
        by_level[self.chosen] = self.weights
        by_level = np.cumsum(by_level, axis=1)
        return np.bincount(doc, weights=by_level[feature, np.minimum(n, LEVELS) - 1], minlength=texts.n)

    def above(self, linear: np.ndarray) -> np.ndarray:
        """(texts, GRADES - 1): P(grade > k)."""
        return _logistic(linear[:, None] - self.thresholds)

    def fit(self, x: np.ndarray, grade: np.ndarray) -> None:
        """Adam on the negative log-likelihood; thresholds are a first one and positive steps."""
        free = np.concatenate([np.zeros(x.shape[1]), [0.5], np.zeros(GRADES - 2)])  # weights, the first threshold, logarithms of the steps
        m, v = np.zeros_like(free), np.zeros_like(free)
        k = x.shape[1]
        for t in range(1, ROUNDS + 1):
            steps = np.exp(free[k + 1 :])
            cuts = free[k] + np.concatenate([[0], np.cumsum(steps)])
            up = _logistic((x @ free[:k])[:, None] - cuts)  # P(grade > j)
            edge = np.concatenate([np.ones((len(x), 1)), up, np.zeros((len(x), 1))], axis=1)
            p = np.maximum(edge[np.arange(len(x)), grade] - edge[np.arange(len(x)), grade + 1], 1e-9)
            slope = up * (1 - up)
            d = np.zeros_like(up)  # of the log-likelihood by linear - cuts[j]
            for j in range(GRADES - 1):
                d[:, j] = slope[:, j] * ((grade == j + 1).astype(float) - (grade == j)) / p
            by_cut = -d.mean(axis=0)
            g = np.concatenate([x.T @ d.sum(axis=1) / len(x) - RIDGE * free[:k], [by_cut.sum()], [by_cut[j + 1 :].sum() * steps[j] for j in range(GRADES - 2)]])
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            free += STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights, self.thresholds = free[:k], free[k] + np.concatenate([[0], np.cumsum(np.exp(free[k + 1 :]))])


def train(labelled: list[tuple[str, int]], share: float | None = None) -> Ordinal | None:
    """None unless there are texts of both labels. The thresholds are moved to the toxic share of all labels, if it is given."""
    labelled = without_copies(labelled)
    toxic = np.array([bool(y) for _, y in labelled], bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        return None
    texts = Texts(pa.array([x for x, _ in labelled], pa.string()), fold=True)
    *parts, (doc, _) = _parts(texts)
    bounds = np.searchsorted(doc, np.arange(texts.n + 1))
    each = [[] for _ in range(texts.n)]  # a text at a time, so that only distinct features meet
    for h, word in parts:
        for d, (i, j) in enumerate(zip(*(np.searchsorted(word, b) for b in (bounds[:-1], bounds[1:])), strict=True)):
            each[d].append(h[i:j])
    found = [np.unique(np.concatenate(x), return_counts=True) for x in each]
    h = np.concatenate([x for x, _ in found])
    count = np.concatenate([n for _, n in found])
    row = np.repeat(np.arange(texts.n), [len(x) for x, _ in found])
    del each, found
    every, at, in_texts = np.unique(h, return_inverse=True, return_counts=True)
    sizes = np.bincount(row, weights=count, minlength=texts.n)
    # features of too few texts for any z-value, which are most, go first
    common = in_texts >= min(MIN_TEXTS, max(2, texts.n // 2 // 50))
    use = common[at]
    every, at, row, count = every[common], (np.cumsum(common) - 1)[at[use]], row[use], count[use]
    level = np.minimum(count, LEVELS)

    def evidence(use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds and z-values of toxicity by feature and level, from the texts in use."""
        in_toxic, in_all = np.zeros((len(every), LEVELS)), np.zeros((len(every), LEVELS))
        for k in range(LEVELS):
            reach = (level > k) & use[row]
            in_toxic[:, k] = np.bincount(at[reach], weights=toxic[row[reach]], minlength=len(every))
            in_all[:, k] = np.bincount(at[reach], minlength=len(every))
        a, b = in_toxic + 0.5, in_all - in_toxic + 0.5
        c, d = (toxic & use).sum() - in_toxic + 0.5, (~toxic & use).sum() - (in_all - in_toxic) + 0.5
        odds = np.log(a * d / (b * c))
        z = odds / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        z[in_all < min(MIN_TEXTS, max(2, use.sum() // 50))] = 0
        return odds, z

    _, z = evidence(np.ones(texts.n, bool))
    best = np.argsort(-np.abs(z), axis=None, kind="stable")[:FEATURES]
    chosen = np.zeros(z.shape, bool)
    chosen.flat[best[z.flat[best] != 0]] = True
    used = np.flatnonzero(chosen.any(axis=1))
    if not len(used):
        return None
    # severity: the share of what points to toxicity in the other half of the sample
    severity, half = np.zeros(texts.n), np.arange(texts.n) % 2 == 0
    for own in (half, ~half):
        odds, other = evidence(~own)
        points = (odds[:, 0] >= POINTING) & (other[:, 0] >= POINTING_Z)
        severity[own] = (np.bincount(row, weights=count * points[at], minlength=texts.n) / np.maximum(sizes, 1))[own]
    model = Ordinal(every[used], chosen[used])
    row, feature, n = model.counts(texts)
    column = np.cumsum(model.chosen.ravel()).reshape(model.chosen.shape) - 1
    x = np.zeros((texts.n, int(model.chosen.sum())))
    for k in range(LEVELS):
        hit = (n > k) & model.chosen[feature, k]
        x[row[hit], column[feature[hit], k]] = 1
    cuts = np.quantile(severity[toxic], [1 / 3, 2 / 3])
    model.fit(x, np.where(toxic, 1 + np.searchsorted(cuts, severity, "left"), 0))
    if share is not None:
        p, q = np.clip([toxic.mean(), share], 0.01, 0.99)
        model.thresholds = model.thresholds + np.log(p / (1 - p)) - np.log(q / (1 - q))
    return model


def toxicity(docs: DataFrame, model: Ordinal | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, severity (expected grade, 0 to 3), grade (the likeliest), p_toxic (that the grade is over 0), toxic (p_toxic >= 0.5)."""
    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = wanted.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column("text"), fold=True)
                above = np.zeros((texts.n, GRADES - 1)) if model is None else model.above(model.linear(texts)) * (texts.n_words > 0)[:, None]
                each = -np.diff(np.concatenate([np.ones((texts.n, 1)), above, np.zeros((texts.n, 1))], axis=1), axis=1)
                cols = [pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0].copy()), pa.array(above[:, 0] >= 0.5)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *cols], ["id", "severity", "grade", "p_toxic", "toxic"])

    return wanted.mapInArrow(score, f"id {kind}, severity double, grade int, p_toxic double, toxic boolean").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity(docs, train(sample(docs, "doc_id", "toxic", "text", PER_CLASS, labels=labels)))
