"""Document quality by hierarchical empirical Bayes.

A logistic classifier gives each document's evidence. Its probabilities are summed by path and by host; a path's
posterior mean is shrunk towards its host's, a host's towards the global one, each with a prior strength that the spread
between sites gives (method of moments). A document's odds are its own times those of its path over the global ones, as the
change of a prior has it. A document is left out of the sums of its own host and path, as its evidence counts already: so the
only document of a site has its own evidence alone, and a large site of bad documents changes much.

The classifier is fitted on the driver on the features of a bounded sample of labelled documents (PER_CLASS of each label, MOST_CHARS
characters of each); the features are computed on the executors. Everything else is grouped aggregation over all documents: first by path, then of
the paths by host; crowded hosts are summed before any shuffle.

Null texts are empty ones: their evidence is that of no words. A null host or path is a site of its own. Repeated rows
count each, and equal ones get equal results. Without labels of both kinds all evidence is 0.5. An empty table gives an empty one. Only the
columns named are used, so others may have any name. A very long text is scored as a whole, with memory of some 20 times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, slices, table, written
from .line_rules import judge
from .sampling import sampled

PER_CLASS = 2500
#: Documents are joined with their path's figures by broadcast if there are at most so many paths, else by shuffle.
MOST_BROADCAST = 50_000
EDGE = 1e-6


def features(column: pa.Array) -> np.ndarray:
    f = {k: v.astype(np.float64) for k, v in judge(column, with_text=False)[0].items()}
    n, lines = np.maximum(f["n_words"], 1), np.maximum(f["n_lines"], 1)
    cols = [np.log1p(f["n_words"]), f["word_chars"] / n, np.minimum(f["n_symbols"] / n, 3), f["n_repeat_words"] / n, f["n_dup_lines"] / lines, f["kept_words"] / n, f["n_punctuation"] / lines, f["n_navigation"] / lines, f["n_boilerplate"] / lines, f["n_stutter"] / lines, f["base_failed"]]
    return np.stack(cols, axis=1)


class Logistic:
    """Fitted by Newton's steps with a ridge, on standardised features; the intercept is moved to the labels' true share."""

    def __init__(self, x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-2) -> None:
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        keep = np.append(np.full(x.shape[1], ridge), 1e-6)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hess = (z * (p * (1 - p))[:, None]).T @ z / len(z) + np.diag(keep)
            w = w + np.clip(np.linalg.solve(hess, z.T @ (y - p) / len(z) - keep * w), -3, 3)
        sampled = y.mean()
        w[-1] += np.log(share / (1 - share)) - np.log(sampled / (1 - sampled))
        self.weights = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Logistic | None:
    """Fitted on the features of a sample, which are computed on the executors; None without labels of both kinds."""
    rows = sampled(docs, id_col, label_col, text_col, PER_CLASS, labels=labels)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, "text"):
                flat = features(part.column("text"))
                each = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("y"), each], ["k", "y", "f"])

    got = rows.select("k", F.col("y").cast("boolean").alias("y"), F.col("x").alias("text")).mapInArrow(compute, "k long, y boolean, f array<double>").collect()
    got = sorted({(r["k"], r["y"], tuple(r["f"])) for r in got})
    y = np.array([float(r[1]) for r in got])
    if not len(y) or y.min() == y.max():
        return None
    share = labels.where(F.col(label_col).isNotNull()).agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    return Logistic(np.array([r[2] for r in got]), y, min(max(share, 0.01), 0.99))


def evidence(docs: DataFrame, model: Logistic | None, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """id, host, path, p."""
    wanted = docs.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.col(text_col).alias("text"))
    kinds = {k: wanted.schema[k].dataType.simpleString() for k in ("id", "host", "path")}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, "text"):
                p = np.full(part.num_rows, 0.5) if model is None else np.clip(model(features(part.column("text"))), EDGE, 1 - EDGE)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kinds), pa.array(p)], [*kinds, "p"])

    return wanted.mapInArrow(score, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", p double")


def _strength(mean: Column, between: Column) -> Column:
    """Beta prior strength, mean * (1 - mean) / variance - 1, from the variance between sites."""
    return F.greatest(F.lit(1.0), F.least(F.lit(1e4), mean * (1 - mean) / F.greatest(between, F.lit(1e-9)) - 1))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """host, path, n, s (documents of the path, and their evidence), hn, hs (of its host), and the prior: mu, kh, kp, of each path of a table with host, path and p."""
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * (1 - F.col("p"))).alias("v")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("v").alias("hv"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ss"), F.count("*").alias("k"), F.sum(F.col("v") / F.col("n")).alias("noise"))
    hm = F.col("hs") / F.col("hn")
    total = hosts.agg(F.sum("hs").alias("S"), F.sum("hn").alias("N"), F.sum(F.col("hs") * hm).alias("HS"), F.sum(F.col("hv") / F.col("hn")).alias("hnoise"), F.sum("ss").alias("PS"), F.sum("noise").alias("pnoise"), F.count("*").alias("H"), F.sum("k").alias("P"))
    mu = F.col("S") / F.col("N")
    # variance between hosts around mu, and between paths around their hosts, without the noise of their documents
    between_hosts = (F.col("HS") - F.col("S") * mu - F.col("hnoise")) / F.col("N")
    between_paths = (F.col("PS") - F.col("HS") - F.col("pnoise")) / F.col("N")
    prior = total.select(mu.alias("mu"), _strength(mu, between_hosts).alias("kh"), _strength(mu, between_paths).alias("kp"))
    row = prior.first()
    if row is None or row["mu"] is None:
        mu_, kh, kp = 0.5, 1.0, 1.0
    else:
        mu_, kh, kp = row["mu"], row["kh"], row["kp"]
    sums = hosts.select(F.col("host").alias("h"), "hn", "hs")
    joined = paths.join(sums, paths["host"].eqNullSafe(sums["h"])).drop("h")
    return joined.select("host", "path", "n", "s", "hn", "hs", F.lit(mu_).alias("mu"), F.lit(kh).alias("kh"), F.lit(kp).alias("kp"))


def quality(docs: DataFrame, model: Logistic | None, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """id_col, host, path, p_document, host_mean, path_mean, quality (posterior probability), keep (it is at least the threshold)."""
    scored = written(evidence(docs, model, id_col, text_col, F.lit(None).cast("string") if host is None else host, F.lit(None).cast("string") if path is None else path), "evidence")
    sites = site_posteriors(scored).withColumnsRenamed({"host": "h", "path": "q"})
    if scored.select("host", "path").distinct().limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        sites = F.broadcast(sites)
    joined = scored.join(sites, scored["host"].eqNullSafe(sites["h"]) & scored["path"].eqNullSafe(sites["q"]), "left")
    logit = lambda c: F.ln(c / (1 - c))
    bound = lambda c: F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), c))
    # what the other documents of host and path say
    c = F.col
    means = joined.withColumn("host_mean", (c("kh") * c("mu") + c("hs") - c("p")) / (c("kh") + c("hn") - 1))
    means = means.withColumn("path_mean", (c("kp") * c("host_mean") + c("s") - c("p")) / (c("kp") + c("n") - 1))
    posterior = 1 / (1 + F.exp(-(logit(c("p")) + logit(bound(c("path_mean"))) - logit(bound(c("mu"))))))
    return means.select(c("id").alias(id_col), "host", "path", c("p").alias("p_document"), "host_mean", "path_mean", posterior.alias("quality")).withColumn("keep", c("quality") >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return quality(docs, model, host=F.col("source"), path=F.concat_ws("/", "source", "lang"))
