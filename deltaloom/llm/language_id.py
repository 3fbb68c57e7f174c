"""Language identification by a byte convolutional network.

A text's bytes are mapped to classes (letters without case, digits, white space, each byte of longer UTF-8 characters),
the whole text is cut into windows of fixed length that overlap by a filter's width, and every window goes through
convolutions of several widths, a rectifier, the maximum over all places, and softmax. The prediction is the mean of
the windows' probabilities, weighted by their bytes.

The input of a convolution is one-hot, so a filter's response is a sum of table entries: one for each byte in training,
one for each pair of bytes in prediction. It is trained by Adam on the driver, on a bounded sample of labelled texts.

A text that is null or has no letter is `und` with score 0, as is any text when no labelled row exists. Only text is an input;
labels are read for training from rows that aren't held out. Ties go to the label that sorts first. Repeated rows are predicted each for itself,
and equal texts alike. An empty table gives an empty one. Other columns are kept by place, so that no name can clash. A very long text is
predicted over all its windows, in one slice.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, slices, table
from .kernels import Texts
from .sampling import sample

WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 256
#: Training: texts of each language, characters of each, passes, step size.
PER_CLASS, CHARS, EPOCHS, STEP = 800, 300, 8, 0.02
#: In the pipeline, texts whose best language has less probability than this are rejected.
MIN_SCORE = 0.5
UNKNOWN = "und"


@functools.cache
def byte_classes() -> np.ndarray:
    """0 padding, 1 white space, 2 digits, 3 other ASCII, 4-29 letters, 30-93 continuation bytes, then the leading bytes of two, three and four."""
    out = np.full(256, 3, np.int64)
    out[[9, 10, 11, 12, 13, 32]] = 1
    out[48:58] = 2
    out[65:91] = out[97:123] = np.arange(4, 30)
    out[0x80:0xC0] = np.arange(30, 94)
    out[0xC0:0xE0] = np.arange(94, 126)
    out[0xE0:0xF0] = np.arange(126, 142)
    out[0xF0:] = 142
    return out


CLASSES = 143
STRIDE = WINDOW - max(WIDTHS) + 1


def text_windows(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, WINDOW) byte classes of all texts, the text of each window, and its bytes."""
    size = np.diff(texts.offsets)
    n = np.where(size > 0, np.maximum(1, -(-(size - WINDOW + STRIDE) // STRIDE)), 0)
    doc = np.repeat(np.arange(texts.n), n)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = texts.offsets[doc] + first * STRIDE
    length = np.minimum(WINDOW, texts.offsets[doc + 1] - start)
    padded = np.append(byte_classes().astype(np.uint8)[texts.buf], np.zeros(WINDOW, np.uint8))
    grid = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start] if len(start) else np.zeros((0, WINDOW), np.uint8)
    grid = np.where(np.arange(WINDOW) < length[:, None], grid, 0)
    return grid, doc, length


class Network:
    """tables[w]: (w, CLASSES, FILTERS), a filter's weight for each byte class at each of its places."""

    def __init__(self, labels: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = {w: rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def _responses(self, x: np.ndarray, w: int) -> np.ndarray:
        span = x.shape[1] - w + 1
        total = self.tables[w][0][x[:, :span]]
        for j in range(1, w):
            total += self.tables[w][j][x[:, j : j + span]]
        return total

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, step: float, batch: int = 128, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.tables.values(), self.bias, self.out, self.out_bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                xb, yb = x[rows], y[rows]
                pooled, places = [], []
                for i, w in enumerate(WIDTHS):
                    r = self._responses(xb, w)
                    place = r.argmax(axis=1)
                    places.append(place)
                    pooled.append(np.take_along_axis(r, place[:, None, :], 1)[:, 0] + self.bias[i])
                h = np.concatenate(pooled, axis=1)
                active = np.maximum(h, 0)
                z = active @ self.out + self.out_bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), yb] -= 1
                p /= len(rows)
                back = (p @ self.out.T) * (h > 0)
                grads = []
                cols = np.arange(FILTERS)
                for i, w in enumerate(WIDTHS):
                    g = np.zeros_like(self.tables[w])
                    part = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for j in range(w):
                        seen = np.take_along_axis(xb, places[i] + j, 1)
                        np.add.at(g[j], (seen, np.broadcast_to(cols, seen.shape)), part)
                    grads.append(g)
                grads += [back.sum(axis=0).reshape(len(WIDTHS), FILTERS), active.T @ p, p.sum(axis=0)]
                t += 1
                rate = step * (0.1 + 0.9 * (1 - epoch / epochs))
                for k, (param, g) in enumerate(zip(params, grads, strict=True)):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    param -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def pairs(self) -> "Pairs":
        return Pairs(self)


class Pairs:
    """The network with its tables summed over pairs of bytes, as 16-bit integers: what the executors get."""

    def __init__(self, net: Network) -> None:
        self.labels, self.bias, self.out, self.out_bias = net.labels, net.bias, net.out, net.out_bias
        most = max(w * float(np.abs(t).max()) for w, t in net.tables.items())
        self.scale = 32000 / max(most, 1e-6)
        self.tables = {w: [self._pair(t[j], t[j + 1]) if j + 1 < w else np.rint(t[j] * self.scale).astype(np.int16) for j in range(0, w, 2)] for w, t in net.tables.items()}

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.rint((a[:, None] + b[None]) * self.scale).astype(np.int16).reshape(CLASSES * CLASSES, FILTERS)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        pooled = []
        for at in range(0, len(x), 64):  # so that the responses stay in the processor's cache
            xb = x[at : at + 64].astype(np.int32)
            two = xb[:, :-1] * CLASSES + xb[:, 1:]
            part = []
            for i, w in enumerate(WIDTHS):
                span = WINDOW - w + 1
                total = None
                for k, t in enumerate(self.tables[w]):
                    index = two if len(t) > CLASSES else xb
                    got = t.take(index[:, 2 * k : 2 * k + span], axis=0)
                    total = got if total is None else np.add(total, got, out=total)
                part.append(total.max(axis=1) / np.float32(self.scale) + self.bias[i])
            pooled.append(np.concatenate(part, axis=1))
        h = np.maximum(np.concatenate(pooled), 0) if pooled else np.zeros((0, len(self.out)), np.float32)
        z = h @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def of_texts(self, column: pa.Array) -> np.ndarray:
        """(texts, labels) mean probabilities; zero for empty texts."""
        texts = Texts(column)
        x, doc, length = text_windows(texts)
        p = self.probabilities(x) * length[:, None]
        total = np.stack([np.bincount(doc, weights=p[:, k], minlength=texts.n) for k in range(len(self.labels))], axis=1)
        return total / np.maximum(np.diff(texts.offsets), 1)[:, None]


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = PER_CLASS) -> Pairs | None:
    """None without a labelled text."""
    got = [(x, y) for x, y in sample(rows, id_col, lang_col, text_col, per_class, CHARS) if x]
    if not got:
        return None
    labels = sorted({y for _, y in got})
    x, doc, length = text_windows(Texts(pa.array([t for t, _ in got])))
    y = np.array([labels.index(l) for _, l in got])[doc]
    use = length >= 16
    if not use.any():
        use[:] = True
    net = Network(labels)
    net.fit(x[use], y[use], EPOCHS, STEP)
    return net.pairs()


def _labelled(docs: DataFrame, model: Pairs | None, text_col: str) -> tuple[DataFrame, list[str]]:
    """docs under other names, with lang_pred and score, so that no column of docs can clash."""
    hidden = [f"c{i}" for i in range(len(docs.columns))]
    wanted = docs.toDF(*hidden).withColumn("text", F.col(hidden[docs.columns.index(text_col)]))
    schema = ", ".join([*(f"{k} {f.dataType.simpleString()}" for k, f in zip(hidden, docs.schema, strict=True)), "lang_pred string, score double"])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                letters = np.array([x is not None and any(map(str.isalpha, x)) for x in texts.to_pylist()], bool)
                if model is None:
                    names, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                else:
                    p = model.of_texts(texts)
                    best = p.argmax(axis=1)
                    names = [model.labels[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                    score = np.where(letters, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in hidden), pa.array(names, pa.string()), pa.array(score, pa.float64())], [*hidden, "lang_pred", "score"])

    return wanted.mapInArrow(label, schema), hidden


def predict(docs: DataFrame, model: Pairs | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, which replace columns of these names."""
    out, hidden = _labelled(docs, model, text_col)
    return out.select(*(F.col(k).alias(c) for k, c in zip(hidden, docs.columns, strict=True) if c not in ("lang_pred", "score")), "lang_pred", "score")


def known(docs: DataFrame, model: Pairs | None, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose language is known with at least min_score, as they are; without a model, those with a letter."""
    if model is None:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    out, hidden = _labelled(docs, model, text_col)
    good = out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return good.select(*(F.col(k).alias(c) for k, c in zip(hidden, docs.columns, strict=True)))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
