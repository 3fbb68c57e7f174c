"""Population profiles: fit a trend for each module and feature, calibrate on adapters, score by conformal p-values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from . import grouped

# Fixed values.
MIN_POINTS = 24
ALPHAS = {"block": 0.01, "review": 0.05}
#: A profile never blocks on its own.
REFERENCE_CAN_BLOCK = False


def fit_trend(points: DataFrame, keys: list[str], y: str, x1: str, x2: str, least: int = MIN_POINTS) -> DataFrame:
    """keys, n, c0, c1, c2 of least squares y = c0 + c1*x1 + c2*x2, from sums: one aggregation, whatever the number of points.

    The sums are taken around the group's means, so that the 2x2 system is as exact as a factorisation. Null for fewer than
    `least` points or when the regressors are collinear.
    """
    mean = points.groupBy(*keys).agg(F.avg(x1).alias("_a"), F.avg(x2).alias("_b"), F.avg(y).alias("_m"))
    u, v, w = F.col(x1) - F.col("_a"), F.col(x2) - F.col("_b"), F.col(y) - F.col("_m")
    s = points.join(mean, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.first("_a").alias("a"), F.first("_b").alias("b"), F.first("_m").alias("m"), F.sum(u * u).alias("uu"), F.sum(v * v).alias("vv"), F.sum(u * v).alias("uv"), F.sum(u * w).alias("uw"), F.sum(v * w).alias("vw"))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    ok = (F.col("n") >= least) & (det > 1e-12 * F.col("uu") * F.col("vv"))
    c1 = (F.col("uw") * F.col("vv") - F.col("vw") * F.col("uv")) / F.when(ok, det)
    c2 = (F.col("vw") * F.col("uu") - F.col("uw") * F.col("uv")) / F.when(ok, det)
    return s.select(*keys, "n", (F.col("m") - c1 * F.col("a") - c2 * F.col("b")).alias("c0"), c1.alias("c1"), c2.alias("c2"))


def points(dump: DataFrame) -> DataFrame:
    """repo, module, feature, value, rel_depth, log_rank of a feature dump (repo, family, n_layers, rank, modules): the first record of a repo, and rank > 0."""
    first = dump.withColumn("_n", F.row_number().over(W.partitionBy("repo").orderBy("ordinal"))).where("_n = 1 AND rank > 0")
    each = first.select("repo", "n_layers", F.ln(F.col("rank").cast("double")).alias("log_rank"), F.inline("modules"))
    values = F.explode(F.create_map(*(x for f, kind in stats.FEATURES.items() for x in (F.lit(f), stats.transform(F.try_element_at("f", F.lit(f)), kind))))).alias("feature", "value")
    return each.select("repo", F.col("m").alias("module"), stats.rel_depth(F.col("l"), F.col("n_layers")).alias("rel_depth"), "log_rank", values).where("value IS NOT NULL")


def fit(values: DataFrame, holdout: float = 0.3, everything: bool = False) -> DataFrame:
    """module, feature, c0, c1, c2, resid_med, resid_scale, n; on the fit split only, unless everything is asked for.

    The split is by a hash of the repo, so that it does not depend on partitions or order.
    """
    held = F.pmod(F.xxhash64("repo"), F.lit(1000)) < int(1000 * holdout)
    used = values if everything else values.where(~held)
    trend = fit_trend(used, ["module", "feature"], "value", "rel_depth", "log_rank").where("c0 IS NOT NULL")
    residual = F.col("value") - (F.col("c0") + F.col("c1") * F.col("rel_depth") + F.col("c2") * F.col("log_rank"))
    scale = grouped.robust_scale_of_many(used.join(trend, ["module", "feature"]).withColumn("residual", residual), ["module", "feature"], "residual")
    return trend.join(scale.select("module", "feature", F.col("med").alias("resid_med"), F.col("scale").alias("resid_scale")), ["module", "feature"])


def residual_z(values: DataFrame, profile: DataFrame) -> DataFrame:
    """values with z, where the profile knows the module and feature; a profile is a few thousand rows and joins by broadcast if Spark finds it small."""
    joined = values.join(profile.where("resid_scale > 0"), ["module", "feature"])
    z = (F.col("value") - (F.col("c0") + F.col("c1") * F.col("rel_depth") + F.col("c2") * F.col("log_rank")) - F.col("resid_med")) / F.col("resid_scale")
    return joined.withColumn("z", z)


def adapter_vector(z: DataFrame, id_col: str = "repo") -> DataFrame:
    """id_col, vector: for each feature, in order, the median z and the 90th percentile of |z|; 0, 0 for a feature not seen."""
    aggs = []
    for f in stats.FEATURES:
        own = F.when(F.col("feature") == f, F.col("z"))
        aggs += [F.coalesce(F.median(own), F.lit(0.0)).alias(f"{f}_m"), F.coalesce(F.percentile(F.abs(own), F.lit(0.9)), F.lit(0.0)).alias(f"{f}_p")]
    out = z.groupBy(id_col).agg(*aggs)
    return out.select(id_col, F.array(*(c for c in out.columns if c != id_col)).alias("vector"))


def shrunk(s: np.ndarray, fourth: float, n: int) -> tuple[np.ndarray, float]:
    """Covariance s of n rows shrunk towards a multiple of the identity (Ledoit and Wolf, 2004), and the shrinkage; fourth is the mean of the rows' squared squared lengths."""
    p = len(s)
    m = np.trace(s) / p
    distance = ((s - m * np.eye(p)) ** 2).sum() / p
    noise = min(distance, (fourth - (s**2).sum()) / n / p)
    rho = noise / distance if noise > 0 and distance > 0 else 0.0
    return (1 - rho) * s + rho * m * np.eye(p), rho


def ledoit_wolf(x: np.ndarray) -> tuple[np.ndarray, float]:
    """The shrunk covariance of the rows of x, and the shrinkage."""
    x = x - x.mean(axis=0)
    return shrunk(x.T @ x / len(x), ((x**2).sum(axis=1) ** 2).mean(), len(x))


def covariance(vectors: DataFrame, mean: list[float]) -> tuple[np.ndarray, float]:
    """Covariance around the mean, and the mean of the squared squared lengths, of a column `vector`: sums alone reach the driver."""
    p = len(mean)
    v = F.zip_with("vector", F.array(*map(F.lit, mean)), lambda x, m: x - m)
    away = vectors.select(*(v[i].alias(f"v{i}") for i in range(p)))
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    length = sum((F.col(f"v{i}") * F.col(f"v{i}") for i in range(p)), F.lit(0.0))
    *products, fourth = away.agg(*(F.avg(F.col(f"v{i}") * F.col(f"v{j}")) for i, j in pairs), F.avg(length * length)).first()
    s = np.zeros((p, p))
    for (i, j), x in zip(pairs, products, strict=True):
        s[i, j] = s[j, i] = x
    return s, fourth


def calibrate(vectors: DataFrame, id_col: str = "repo") -> tuple[list[float], list[list[float]], DataFrame]:
    """Centre, precision, and (id_col, d2) of the reference half. The other half is fitted on by sums and medians, whatever its size."""
    half = F.pmod(F.xxhash64(id_col, F.lit("half")), F.lit(2)) == 0
    fitted = vectors.where(half).select("vector")
    each = fitted.select(F.posexplode("vector").alias("pos", "v"))
    rows = grouped.joined(grouped.medians(each, ["pos"], "v"), each.groupBy("pos").agg(F.avg("v").alias("mean")), ["pos"]).orderBy("pos").collect()
    if not rows or rows[0]["n"] < 2:
        raise ValueError(f"{rows[0]['n'] if rows else 0} adapters to calibrate with")
    mu = [r["med"] for r in rows]
    precision = np.linalg.pinv(shrunk(*covariance(fitted, [r["mean"] for r in rows]), rows[0]["n"])[0])
    return mu, precision.tolist(), vectors.where(~half).select(id_col, distance(F.col("vector"), mu, precision.tolist()).alias("d2"))


def distance(vector: Column, mu: list[float], precision: list[list[float]]) -> Column:
    return stats.mahalanobis_sq(vector, F.array(*map(F.lit, mu)), F.array(*(F.array(*map(F.lit, row)) for row in precision)))


def conformal_p(scores: DataFrame, reference: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """scores (id, d2) with p_value = (1 + #{reference >= d2}) / (n + 1), from counts of both together."""
    keys = keys or []
    group = [F.lit(0).alias("_g")] if not keys else [F.col(k) for k in keys]
    names = keys or ["_g"]
    both = scores.select("*", *([group[0]] if not keys else [])).withColumn("_ref", F.lit(False)).unionByName(reference.select(*group, "d2").withColumn("_ref", F.lit(True)), allowMissingColumns=True)
    counted = grouped.count_at_least(both, names, "d2", F.col("_ref")).where(~F.col("_ref"))
    n = both.groupBy(*names).agg(F.count_if("_ref").alias("n_reference"))
    return grouped.joined(counted, n, names).withColumn("p_value", (1 + F.col("n_ge")) / (F.col("n_reference") + 1)).drop("_ref", "_g")


def loo_p(reference: DataFrame, keys: list[str]) -> DataFrame:
    """reference (keys, d2) with the p-value of each row against the others."""
    counted = grouped.count_at_least(reference, keys, "d2", F.lit(True))
    return grouped.joined(counted, reference.groupBy(*keys).agg(F.count("*").alias("_n")), keys).withColumn("p_value", F.col("n_ge") / F.col("_n")).drop("n_ge", "_n")


def loo_fpr(reference: DataFrame, keys: list[str], alphas: tuple[float, ...] = (0.01, 0.05, 0.1)) -> DataFrame:
    """keys, n, min_p and the share of rows with a leave-one-out p-value at most each alpha."""
    return loo_p(reference, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.min("p_value").alias("min_p"), *(F.avg((F.col("p_value") <= a).cast("double")).alias(f"fpr_{a:g}") for a in alphas))


def profile_of(base: Column, families: list[str]) -> Column:
    """The longest family key that the lower-cased base model name contains."""
    ordered = sorted(families, key=lambda k: (-len(k), k))
    return F.coalesce(*(F.when(F.contains(F.lower(F.coalesce(base, F.lit(""))), F.lit(k.lower())), F.lit(k)) for k in ordered)) if ordered else F.lit(None).cast("string")


def longest_contained(rows: DataFrame, name: str, families: DataFrame, key: str) -> DataFrame:
    """rows with the longest key of a table of keys that their name contains. The keys (profiles: tens) are aggregated to one array, so rows are read once and never multiplied."""
    keys = families.agg(F.array_sort(F.collect_set(F.struct((-F.length(key)).alias("n"), F.col(key).alias("k")))).alias("_keys"))
    hit = F.filter("_keys", lambda k: F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), F.lower(k["k"])))
    return rows.join(F.broadcast(keys)).withColumn(key, F.get(hit, F.lit(0))["k"]).drop("_keys")


def rank_diagnostic(values: DataFrame, rank: str, raw: str, residual: str) -> DataFrame:
    return values.groupBy(stats.rank_bucket(F.col(rank)).alias("bucket")).agg(F.count("*").alias("n"), F.median(raw).alias("raw_median"), F.median(residual).alias("residual_median"))
