"""Statistics as column expressions: of values, and of arrays in a row (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the comparison.
MAD_TO_SIGMA, MEANAD_TO_SIGMA = 1.4826, 1.2533
OUTLIER_Z, CONCENTRATION_Z = 3.5, 14.0
MIN_FAMILY, MIN_DETREND = 16, 6
EDGE_FIRST, EDGE_LAST = 3, 2
NOISE_FLOOR = 1e-3
FEATURES = {"log_rms": "id", "top1_e": "id", "srank_r": "id", "spec_h": "id", "excess_conc": "id", "kurt_dw": "log", "row_hoyer": "id", "row_top8": "log", "col_hoyer": "id"}
CONCENTRATION = ["kurt_dw", "row_top8", "row_hoyer"]
ALL_FEATURES = ["log_rms", "log_sigma1", "top1_e", "srank_r", "pr_r", "spec_h", "excess_conc", "kurt_dw", "row_hoyer", "row_gini", "row_top8", "col_hoyer"]


def d(x: float) -> Column:
    return F.lit(float(x))


def let(value: Column, body) -> Column:
    """body of the value, which is computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def finite(x: Column) -> Column:
    """x, or null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != d(float("inf"))), x)


def log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def transform(x: Column, kind: str) -> Column:
    return log(finite(x)) if kind == "log" else finite(x)


def total(xs: Column, of=lambda x: x) -> Column:
    return F.aggregate(xs, d(0), lambda a, x: a + of(x.cast("double")))


def hoyer(xs: Column) -> Column:
    """Of an array: 0 for equal entries, 1 for a single one; null for fewer than two or all zero."""
    n = lambda v: F.size(v).cast("double")
    of = lambda v, l2: F.when((n(v) >= 2) & (l2 > 0), (F.sqrt(n(v)) - total(v, F.abs) / l2) / (F.sqrt(n(v)) - 1))
    return let(xs, lambda v: let(F.sqrt(total(v, lambda x: x * x)), lambda l2: of(v, l2)))


def gini(xs: Column) -> Column:
    """Of an array of values that aren't negative; null for fewer than two or a sum of zero."""
    n = F.size(xs).cast("double")
    ordered = F.array_sort(F.transform(xs, lambda x: F.abs(x.cast("double"))))
    weighted = total(F.transform(ordered, lambda x, i: (2 * (i + 1) - n - 1) * x))
    s = total(xs)
    return F.when((n >= 2) & (s != 0), weighted / (n * s))


def top_share(xs: Column, k: int = 8) -> Column:
    """Share of the squares that the k largest hold; null if all are zero."""
    of = lambda squares, s: F.when(s > 0, total(F.slice(F.sort_array(squares, asc=False), 1, k)) / s)
    return let(F.transform(xs, lambda x: x.cast("double") * x.cast("double")), lambda squares: let(total(squares), lambda s: of(squares, s)))


def kurtosis(xs: Column) -> Column:
    """Pearson's, 3 for the normal distribution; null for a constant."""
    n = F.size(xs).cast("double")
    of = lambda dev: let(total(dev, lambda x: x * x) / n, lambda m2: F.when(m2 > 0, total(dev, lambda x: F.pow(x, d(4))) / n / (m2 * m2)))
    return let(let(total(xs) / n, lambda mean: F.transform(xs, lambda x: x.cast("double") - mean)), of)


def significant(sigma: Column) -> Column:
    """Singular values (descending) over the noise floor; none if the first is 0."""
    return F.filter(sigma, lambda x: (F.get(sigma, F.lit(0)) > 0) & (x >= d(NOISE_FLOOR) * F.get(sigma, F.lit(0))))


def _shares(sigma: Column) -> Column:
    s = total(sigma, lambda x: x * x)
    return F.transform(sigma, lambda x: x * x / s)


def top1_energy(sigma: Column) -> Column:
    s = total(sigma, lambda x: x * x)
    return F.when(s > 0, F.pow(F.get(sigma, F.lit(0)), d(2)) / s)


def stable_rank_share(sigma: Column) -> Column:
    return 1 / top1_energy(sigma) / F.size(sigma)


def participation_share(sigma: Column) -> Column:
    s2, s4 = total(sigma, lambda x: x * x), total(sigma, lambda x: x * x * x * x)
    return F.when(s2 > 0, s2 * s2 / s4 / F.size(sigma))


def spectral_entropy(sigma: Column) -> Column:
    kept = _shares(significant(sigma))
    h = total(kept, lambda e: F.when(e > 0, -e * F.ln(e)).otherwise(d(0)))
    return F.when((F.size(sigma) > 1) & (F.size(kept) > 0), h / F.ln(F.size(sigma).cast("double"))).otherwise(d(0))


def excess_concentration(sigma: Column, rows: Column, cols: Column) -> Column:
    r = F.size(sigma).cast("double")
    null = r / F.pow(1 + F.sqrt(r / F.greatest(F.least(rows, cols), F.lit(1))), d(2))
    return F.ln(null * top1_energy(sigma))


def log_rms(norm: Column, rows: Column, cols: Column) -> Column:
    return log(norm / F.sqrt(rows.cast("double") * cols))


def is_edge_layer(layer: Column, n_layers: Column) -> Column:
    return F.coalesce((layer < EDGE_FIRST) | (layer >= n_layers - EDGE_LAST), F.lit(False))


def concentration_z(a: Column, b: Column, c: Column) -> Column:
    """The least of three; null if any is missing."""
    return F.when(a.isNotNull() & b.isNotNull() & c.isNotNull(), F.least(a, b, c))


def rel_depth(layer: Column, n_layers: Column) -> Column:
    return F.when(n_layers > 1, F.coalesce(layer.cast("double") / (n_layers - 1), d(0))).otherwise(d(0))


def head_dim(width: Column) -> Column:
    return F.coalesce(*(F.when((width % h == 0) & (width >= 2 * h), F.lit(h)) for h in (128, 64, 256)))


def rank_bucket(rank: Column) -> Column:
    out = F.when(rank <= 8, "r<=8")
    for r in (16, 32, 64):
        out = out.when(rank <= r, f"r<={r}")
    return out.otherwise("r>64")


def ranking_score(distance: Column, p_value: Column) -> Column:
    return F.coalesce(distance, -F.ln(F.least(F.greatest(p_value, d(1e-12)), d(1))))


def vector_cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), d(0), lambda s, x: s + x)
    na, nb = F.sqrt(total(a, lambda x: x * x)), F.sqrt(total(b, lambda x: x * x))
    return F.when((na > 0) & (nb > 0), dot / (na * nb))


def mahalanobis_sq(x: Column, mu: Column, precision: Column) -> Column:
    """(x - mu)' P (x - mu), at least 0, of arrays."""
    dev = F.zip_with(x, mu, lambda a, b: a - b)
    rows = F.transform(precision, lambda row: total(F.zip_with(row, dev, lambda p, v: p * v)))
    return F.greatest(total(F.zip_with(dev, rows, lambda v, w: v * w)), d(0))
