"""Statistics of vectors and groups, robust comparison, ordered lists."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import compare, grouped
from .common import EMBEDDED_SQL, ENTRIES_SQL, FACTORS_SQL, LONG_SQL, MODULES_SQL, Z_SQL, Input, modules, of_updates, query, r6, table, update_of

COINS = Input("customer", ("c_custkey AS k", "c_mktsegment AS g", "abs(c_acctbal) AS v"))
ORDERS = Input("orders", ("o_custkey AS g", "o_orderkey AS k", "o_totalprice AS v"))


@query("hoyer", f"SELECT g, round((sqrt(count(v)) - sum(abs(v)) / sqrt(sum(v * v))) / (sqrt(count(v)) - 1), 6) AS hoyer FROM {ORDERS.sql} o GROUP BY g HAVING count(v) >= 2")
def hoyer(spark, d):
    return grouped.hoyer(ORDERS.df(spark, d), ["g"], "v").where("hoyer IS NOT NULL").select("g", r6("hoyer").alias("hoyer"))


@query("gini", f"SELECT g, round(sum((2 * i - n - 1) * v) / (any_value(n) * sum(v)), 6) AS gini FROM (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) AS i, count(*) OVER (PARTITION BY g) AS n FROM {ORDERS.sql} o) t GROUP BY g HAVING count(*) >= 2")
def gini(spark, d):
    return grouped.gini(ORDERS.df(spark, d), ["g"], "v").where("gini IS NOT NULL").select("g", r6("gini").alias("gini"))


@query("top_k_share", f"SELECT g, round(sum(CASE WHEN i <= 8 THEN v * v ELSE 0 END) / sum(v * v), 6) AS top_share FROM (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v DESC) AS i FROM {ORDERS.sql} o) t GROUP BY g")
def top_k_share(spark, d):
    return grouped.top_share(ORDERS.df(spark, d), ["g"], "v").select("g", r6("top_share").alias("top_share"))


@query("kurt_dw", f"SELECT vec_id, round(kurtosis_pop(w) + 3, 6) AS kurtosis FROM {ENTRIES_SQL} e GROUP BY vec_id HAVING var_pop(w) > 0")
def kurt(spark, d):
    got = of_updates(table(spark, d, "embeddings"), ["vec_id"], "vec_id long, kurtosis double", lambda r, u: [(r.vec_id, u.kurtosis())])
    return got.where("kurtosis IS NOT NULL").select("vec_id", r6("kurtosis").alias("kurtosis"))


@query("vector_features", f"SELECT vec_id, round(log_rms, 6) AS log_rms, round(kurt_dw, 6) AS kurt_dw, round(row_hoyer, 6) AS row_hoyer, round(row_top8, 6) AS row_top8, round(col_hoyer, 6) AS col_hoyer FROM {MODULES_SQL} m")
def vector_features(spark, d):
    return modules(spark, d).select(F.col("base").cast("long").alias("vec_id"), *(r6(f).alias(f) for f in ("log_rms", "kurt_dw", "row_hoyer", "row_top8", "col_hoyer")))


@query("row_norms", f"SELECT vec_id, i AS pos, round(sqrt(sum(w * w)), 6) AS norm FROM {ENTRIES_SQL} e GROUP BY vec_id, i")
def row_norms(spark, d):
    got = of_updates(table(spark, d, "embeddings"), ["vec_id"], "vec_id long, pos long, norm double", lambda r, u: [(r.vec_id, i, x) for i, x in enumerate(u.row_norms())])
    return got.select("vec_id", "pos", r6("norm").alias("norm"))


@query("col_norms", f"SELECT vec_id, j AS pos, round(sqrt(sum(w * w)), 6) AS norm FROM {ENTRIES_SQL} e GROUP BY vec_id, j")
def col_norms(spark, d):
    got = of_updates(table(spark, d, "embeddings"), ["vec_id"], "vec_id long, pos long, norm double", lambda r, u: [(r.vec_id, i, x) for i, x in enumerate(u.col_norms())])
    return got.select("vec_id", "pos", r6("norm").alias("norm"))


@query("gram", f"SELECT x.vec_id, x.k AS i, y.k AS j, sum(x.a * y.a) AS gram_a, sum(x.b * y.b) AS gram_b FROM {FACTORS_SQL} x JOIN {FACTORS_SQL} y ON x.vec_id = y.vec_id AND x.j = y.j GROUP BY ALL")
def gram(spark, d):
    """The Gram matrices of both factors of each update."""
    cells = lambda r, u: [(r.vec_id, i, j, u.gram_a[i, j], u.gram_b[i, j]) for i in range(u.rank) for j in range(u.rank)]
    return of_updates(table(spark, d, "embeddings"), ["vec_id"], "vec_id long, i long, j long, gram_a double, gram_b double", cells)


@query("fro_norm", f"SELECT vec_id, round(sqrt(sum(w * w)), 6) AS fro FROM {ENTRIES_SQL} e GROUP BY vec_id")
def fro_norm(spark, d):
    return of_updates(table(spark, d, "embeddings"), ["vec_id"], "vec_id long, fro double", lambda r, u: [(r.vec_id, u.norm())]).select("vec_id", r6("fro").alias("fro"))


SIGMA = Input("embeddings", ("vec_id", "embedding"))
SIG_SQL = "(SELECT vec_id, list_reverse_sort(list_transform(embedding, lambda v: abs(v::DOUBLE))) AS s FROM embeddings)"


@query("spectral_features", f"""
SELECT vec_id, round(s[1] * s[1] / e, 6) AS top1_e, round(e / (s[1] * s[1]) / 64, 6) AS srank_r, round(e * e / q / 64, 6) AS pr_r,
  round(list_sum(list_transform(k, lambda v: -(v * v / ke) * ln(v * v / ke))) / ln(64), 6) AS spec_h, round(ln(64 / pow(1 + sqrt(64 / 64), 2) / (e / (s[1] * s[1]))), 6) AS excess_conc, len(k)::BIGINT AS n_significant
FROM (SELECT *, list_sum(list_transform(s, lambda v: v * v)) AS e, list_sum(list_transform(s, lambda v: pow(v, 4))) AS q, list_sum(list_transform(k, lambda v: v * v)) AS ke
  FROM (SELECT vec_id, s, list_filter(s, lambda v: v >= 0.001 * s[1]) AS k FROM {SIG_SQL} a) b) c""")
def spectral(spark, d):
    """A vector's sorted absolute entries as if they were the singular values of a 64 x 64 update."""
    s = table(spark, d, "embeddings").select("vec_id", F.sort_array(F.transform("embedding", lambda v: F.abs(v.cast("double"))), asc=False).alias("s"))
    c, n = F.col("s"), F.lit(64)
    return s.select("vec_id", r6(stats.top1_energy(c)).alias("top1_e"), r6(stats.stable_rank_share(c)).alias("srank_r"), r6(stats.participation_share(c)).alias("pr_r"), r6(stats.spectral_entropy(c)).alias("spec_h"), r6(stats.excess_concentration(c, n, n)).alias("excess_conc"), F.size(stats.significant(c)).cast("long").alias("n_significant"))


@query("delta_cosine", f"""
SELECT x.vec_id AS a, y.vec_id AS b, round(sum(x.w * y.w) / (sqrt(sum(x.w * x.w)) * sqrt(sum(y.w * y.w))), 6) AS cosine
FROM {ENTRIES_SQL} x JOIN {ENTRIES_SQL} y ON x.label = y.label AND y.vec_id = x.vec_id + 1 AND x.i = y.i AND x.j = y.j GROUP BY ALL HAVING sum(x.w * x.w) * sum(y.w * y.w) > 0""")
def delta_cosine(spark, d):
    """Updates of one family that follow each other."""
    e = table(spark, d, "embeddings")
    b = e.select("label", (F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("other"))
    got = of_updates(e.join(b, ["label", "vec_id"]), ["vec_id", "b", "other"], "a long, b long, cosine double", lambda r, u: [(r.vec_id, r.b, u.cosine(update_of(r.other)))])
    return got.where("cosine IS NOT NULL").select("a", "b", r6("cosine").alias("cosine"))


@query("feature_transform", f"SELECT vec_id, feature, round(value, 6) AS value FROM {LONG_SQL} l")
def feature_transform(spark, d):
    return compare.long_features(modules(spark, d), ["base"]).select(F.col("base").cast("long").alias("vec_id"), "feature", r6("value").alias("value"))


MONTHS = Input("orders", ("o_orderpriority AS g", "extract(year FROM o_orderdate) * 12 + extract(month FROM o_orderdate) AS x", "o_totalprice AS v"))
MONTHLY_SQL = f"(SELECT g, x::BIGINT AS x, avg(v) AS y FROM {MONTHS.sql} m0 GROUP BY ALL)"


def _monthly(spark, d):
    return MONTHS.df(spark, d).groupBy("g", F.col("x").cast("long").alias("x")).agg(F.avg("v").alias("y"))


@query("robust_z", f"""
WITH p AS (SELECT * FROM {MONTHLY_SQL} p0), med AS (SELECT g, median(y) AS med FROM p GROUP BY g),
s AS (SELECT g, any_value(med) AS med, median(abs(y - med)) AS mad, avg(abs(y - med)) AS aad FROM p JOIN med USING (g) GROUP BY g)
SELECT g, x, round((y - med) / CASE WHEN mad > 0 THEN 1.4826 * mad ELSE 1.2533 * aad END, 6) AS z FROM p JOIN s USING (g) WHERE mad > 0 OR aad > 0""")
def robust_z(spark, d):
    return grouped.robust_z(_monthly(spark, d), ["g"], "y").select("g", "x", r6("z").alias("z"))


@query("robust_scale", f"""
WITH p AS (SELECT * FROM {ORDERS.sql} p0), med AS (SELECT g, median(v) AS med FROM p GROUP BY g)
SELECT g, round(any_value(med), 6) AS med, round(CASE WHEN median(abs(v - med)) > 0 THEN 1.4826 * median(abs(v - med)) ELSE 1.2533 * avg(abs(v - med)) END, 6) AS scale FROM p JOIN med USING (g) GROUP BY g""")
def robust_scale(spark, d):
    return grouped.robust_scale(ORDERS.df(spark, d), ["g"], "v").select("g", r6("med").alias("med"), r6("scale").alias("scale"))


@query("detrend_theil_sen", f"""
WITH p AS MATERIALIZED (SELECT * FROM {MONTHLY_SQL} p0), s AS (SELECT a.g, median((b.y - a.y) / (b.x - a.x)) AS slope FROM p a JOIN p b ON a.g = b.g AND b.x > a.x GROUP BY a.g),
m AS (SELECT g, median(x) AS mx, median(y) AS my FROM p GROUP BY g)
SELECT g, x, round(y - (my - slope * mx + slope * x), 5) AS residual FROM p JOIN s USING (g) JOIN m USING (g)""")
def detrend(spark, d):
    return grouped.detrended(_monthly(spark, d), ["g"], "x", "y").select("g", "x", F.round("residual", 5).alias("residual"))


@query("family_compare", Z_SQL + "SELECT vec_id, family, layer::INTEGER AS layer, feature, round(z, 6) AS z FROM z")
def family_compare(spark, d):
    return compare.family_z(modules(spark, d)).select(F.col("base").cast("long").alias("vec_id"), "family", "layer", "feature", r6("z").alias("z"))


CONC_SQL = Z_SQL + "SELECT vec_id, family, layer::INTEGER AS layer, round(max_abs_z, 6) AS max_abs_z, round(CASE WHEN nc = 3 THEN cz END, 6) AS concentration_z FROM m"


@query("concentration_z", CONC_SQL)
def concentration(spark, d):
    """Which member of a family is concentrated unlike its siblings, after the trend over depth: the flagship."""
    per = compare.module_z(compare.family_z(modules(spark, d)))
    return per.select(F.col("base").cast("long").alias("vec_id"), "family", "layer", r6("max_abs_z").alias("max_abs_z"), r6("concentration_z").alias("concentration_z"))


@query("intra_summary", Z_SQL + f"""
SELECT round((SELECT max(max_abs_z) FROM m), 6) AS max_robust_z, (SELECT count(*) FROM m WHERE max_abs_z > 3.5)::INTEGER AS n_outlier_modules, round((SELECT max(CASE WHEN nc = 3 THEN cz END) FROM m), 6) AS max_concentration_z,
  round((SELECT sum((2 * i - n - 1) * energy) / (any_value(n) * sum(energy)) FROM (SELECT energy, row_number() OVER (ORDER BY energy) AS i, count(*) OVER () AS n FROM {MODULES_SQL} q WHERE energy > 0) t), 6) AS energy_gini,
  round((SELECT median(log_rms) FILTER (WHERE kind = 'attention') - median(log_rms) FILTER (WHERE kind = 'mlp') FROM {MODULES_SQL} q), 6) AS attn_mlp_ratio,
  (SELECT count(*) FROM (SELECT 1 FROM m WHERE max_abs_z > 3.5 LIMIT 10) t)::INTEGER AS n_spikes""")
def intra_summary(spark, d):
    m = modules(spark, d)
    z = compare.family_z(m)
    s = compare.summary(m, z, compare.module_z(z))
    return s.select(r6("intra.max_robust_z").alias("max_robust_z"), "intra.n_outlier_modules", r6("intra.max_concentration_z").alias("max_concentration_z"), r6("intra.energy_gini").alias("energy_gini"), r6("intra.attn_mlp_ratio").alias("attn_mlp_ratio"), F.size("intra.depth_spikes").alias("n_spikes"))


@query("family_dispersion", f"WITH p AS (SELECT * FROM {MODULES_SQL} q), md AS (SELECT family, median(log_rms) AS md FROM p GROUP BY family HAVING count(*) >= 16) SELECT family, round(median(abs(log_rms - md)), 6) AS dispersion FROM p JOIN md USING (family) GROUP BY family")
def family_dispersion(spark, d):
    m = modules(spark, d)
    return grouped.dispersion(m, ["family"], "log_rms").select("family", r6("dispersion").alias("dispersion"))


@query("energy_gini", f"SELECT g, round(sum((2 * i - n - 1) * v) / (any_value(n) * sum(v)), 6) AS gini FROM (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) AS i, count(*) OVER (PARTITION BY g) AS n FROM {COINS.sql} c WHERE v > 0) t GROUP BY g")
def energy_gini(spark, d):
    return grouped.gini(COINS.df(spark, d).where("v > 0"), ["g"], "v").select("g", r6("gini").alias("gini"))


PARTS = Input("part", ("p_brand AS g", "p_type AS t", "ln(p_retailprice) AS v"))


@query("attn_mlp_ratio", f"WITH k AS (SELECT min(t) AS a, max(t) AS b FROM {PARTS.sql} p) SELECT g, round(median(v) FILTER (WHERE t = a) - median(v) FILTER (WHERE t = b), 6) AS attn_mlp_ratio FROM {PARTS.sql} p, k GROUP BY g")
def attn_mlp(spark, d):
    p = PARTS.df(spark, d)
    a, b = p.agg(F.min("t"), F.max("t")).first()
    return compare.attn_mlp_ratio(p, ["g"], "t", "v", (a, b)).select("g", r6("attn_mlp_ratio").alias("attn_mlp_ratio"))


@query("token_concentration", f"""
SELECT g, k, rank, round(v * v / s, 6) AS share FROM (SELECT g, k, v, row_number() OVER (PARTITION BY g ORDER BY v * v DESC, k DESC) AS rank, sum(v * v) OVER (PARTITION BY g) AS s FROM {COINS.sql} c) t WHERE rank <= 10""")
def token_concentration(spark, d):
    c = COINS.df(spark, d)
    total = c.groupBy("g").agg(F.sum(F.col("v") * F.col("v")).alias("s"))
    top = grouped.top_rows(c, ["g"], [F.desc(F.col("v") * F.col("v")), F.desc("k")], 10)
    return top.join(total, "g").select("g", "k", F.col("rank").cast("long").alias("rank"), r6(F.col("v") * F.col("v") / F.col("s")).alias("share"))


@query("dora_concentration", f"""
WITH m AS (SELECT g, median(v) AS med FROM {COINS.sql} c GROUP BY g) SELECT g, round((sqrt(count(*)) - sum(abs(v - med)) / sqrt(sum(pow(v - med, 2)))) / (sqrt(count(*)) - 1), 6) AS hoyer FROM {COINS.sql} c JOIN m USING (g) GROUP BY g""")
def dora(spark, d):
    c = COINS.df(spark, d)
    dev = c.join(c.groupBy("g").agg(F.median("v").alias("med")), "g").withColumn("dev", F.col("v") - F.col("med"))
    return grouped.hoyer(dev, ["g"], "dev").select("g", r6("hoyer").alias("hoyer"))


@query("topk_contributors", Z_SQL + "SELECT family, feature, vec_id, round(z, 6) AS z FROM z QUALIFY row_number() OVER (ORDER BY abs(z) DESC, vec_id, feature) <= 10")
def topk_contributors(spark, d):
    z = compare.family_z(modules(spark, d)).withColumn("vec_id", F.col("base").cast("long"))
    return z.orderBy(F.desc(F.abs("z")), "vec_id", "feature").limit(10).select("family", "feature", "vec_id", r6("z").alias("z"))


@query("topk_depth_spikes", Z_SQL + "SELECT vec_id, family, layer::INTEGER AS layer, round(arg_max(z, abs(z)), 6) AS z FROM z GROUP BY ALL HAVING max(abs(z)) > 3.5 ORDER BY max(abs(z)) DESC, vec_id LIMIT 10")
def topk_depth_spikes(spark, d):
    per = compare.module_z(compare.family_z(modules(spark, d))).withColumn("vec_id", F.col("base").cast("long"))
    return per.where(F.col("max_abs_z") > stats.OUTLIER_Z).orderBy(F.desc("max_abs_z"), "vec_id").limit(10).select("vec_id", "family", "layer", r6("top_z").alias("z"))


@query("topk_conc_spikes", Z_SQL + "SELECT vec_id, family, round(cz, 6) AS concentration_z FROM m WHERE nc = 3 ORDER BY cz DESC, vec_id LIMIT 10")
def topk_conc(spark, d):
    per = compare.module_z(compare.family_z(modules(spark, d))).withColumn("vec_id", F.col("base").cast("long"))
    return per.where("concentration_z IS NOT NULL").orderBy(F.desc("concentration_z"), "vec_id").limit(10).select("vec_id", "family", r6("concentration_z").alias("concentration_z"))


@query("topk_outlier_findings", Z_SQL + "SELECT vec_id, round(max_abs_z, 6) AS max_abs_z FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY max_abs_z DESC, vec_id) AS r FROM m) t WHERE r <= 5 AND NOT (nc = 3 AND cz >= 1.5) AND max_abs_z > 3.0")
def topk_outliers(spark, d):
    """The five largest of a family first, then without those that are concentrated: the order of the two steps counts."""
    per = compare.module_z(compare.family_z(modules(spark, d))).withColumn("vec_id", F.col("base").cast("long"))
    top = grouped.top_rows(per, ["family"], [F.desc("max_abs_z"), F.asc("vec_id")], 5)
    return top.where(~F.coalesce(F.col("concentration_z") >= 1.5, F.lit(False)) & (F.col("max_abs_z") > 3.0)).select("vec_id", r6("max_abs_z").alias("max_abs_z"))


@query("percentiles", f"SELECT g, count(v) AS n, round(avg(v), 6) AS mean, {', '.join(f'round(quantile_cont(v, {q / 100}), 6) AS p{q}' for q in (10, 25, 50, 75, 90, 95, 99))} FROM {COINS.sql} c GROUP BY g")
def percentiles(spark, d):
    out = grouped.percentiles(COINS.df(spark, d), ["g"], "v", [10, 25, 50, 75, 90, 95, 99])
    return out.select("g", "n", *(r6(c).alias(c) for c in out.columns if c not in ("g", "n")))


@query("is_edge_layer", f"SELECT vec_id, (layer < 3 OR layer >= n - 2) AS edge, round(layer / CASE WHEN n > 1 THEN n - 1 ELSE 1 END, 6) AS depth FROM (SELECT *, max(layer) OVER (PARTITION BY label) + 1 AS n FROM {EMBEDDED_SQL} e) t")
def edge(spark, d):
    m = modules(spark, d).withColumn("n", F.max("layer").over(W.partitionBy("path", "module")) + 1)
    return m.select(F.col("base").cast("long").alias("vec_id"), stats.is_edge_layer(F.col("layer"), F.col("n")).alias("edge"), r6(stats.rel_depth(F.col("layer"), F.col("n"))).alias("depth"))


@query("small_codes", "SELECT p_partkey, CASE WHEN p_size <= 8 THEN 'r<=8' WHEN p_size <= 16 THEN 'r<=16' WHEN p_size <= 32 THEN 'r<=32' WHEN p_size <= 64 THEN 'r<=64' ELSE 'r>64' END AS bucket, CASE WHEN p_size * 32 % 128 = 0 AND p_size * 32 >= 256 THEN 128 WHEN p_size * 32 % 64 = 0 AND p_size * 32 >= 128 THEN 64 WHEN p_size * 32 % 256 = 0 AND p_size * 32 >= 512 THEN 256 END::INTEGER AS head_dim, round(CASE WHEN p_size % 3 = 0 THEN p_size::DOUBLE ELSE -ln(least(greatest(p_size / 60.0::DOUBLE, 1e-12), 1)) END, 6) AS score FROM part")
def small_codes(spark, d):
    """Rank buckets, head sizes and ranking scores."""
    p = table(spark, d, "part")
    size = F.col("p_size")
    return p.select("p_partkey", stats.rank_bucket(size).alias("bucket"), stats.head_dim(size * 32).cast("int").alias("head_dim"), r6(stats.ranking_score(F.when(size % 3 == 0, size.cast("double")), size / F.lit(60.0))).alias("score"))


@query("non_finite_filter", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN NULL ELSE round(value, 6) END AS value FROM events")
def non_finite(spark, d):
    v = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", r6(stats.finite(v)).alias("value"))
