import numpy as np
from pyspark.sql import functions as F

from deltaloom.functions import stats
from deltaloom.operators import evaluate, grouped, profile


def test_profile_fit_calibrate_score(spark):
    rng = np.random.default_rng(1)
    rows = []
    for repo in range(80):
        modules = [("m", layer, None, "mlp", {f: float(np.exp(rng.normal())) if kind == "log" else float(rng.normal() + layer / 10) for f, kind in stats.FEATURES.items()}) for layer in range(12)]
        rows.append((f"r{repo}", "fam", "base", 12, int(4 * 2 ** (repo % 3)), modules, repo))
    dump = spark.createDataFrame(rows, "repo string, family string, base string, n_layers int, rank int, modules array<struct<m:string,l:int,e:int,k:string,f:map<string,double>>>, ordinal long")
    points = profile.points(dump).cache()
    fitted = profile.fit(points).cache()
    assert fitted.count() == len(stats.FEATURES)
    row = fitted.where("feature = 'log_rms'").first()
    assert 0.7 < row["c1"] < 1.5 and row["resid_scale"] > 0
    vectors = profile.adapter_vector(profile.residual_z(points, fitted)).cache()
    mu, precision, reference = profile.calibrate(vectors)
    reference = reference.cache()
    assert len(mu) == 18 and reference.count() > 10
    low = [0.0] * 18
    far = [50.0] * 18
    odd = spark.createDataFrame([("near", mu), ("far", far), ("zero", low)], "repo string, vector array<double>")
    d2 = odd.select("repo", profile.distance(odd["vector"], mu, precision).alias("d2"))
    p = {r["repo"]: r["p_value"] for r in profile.conformal_p(d2, reference).collect()}
    n = reference.count()
    assert p["far"] == 1 / (n + 1) and p["near"] == 1.0
    assert profile.loo_fpr(reference.selectExpr("'f' AS k", "d2"), ["k"]).first()["n"] == n


def test_ledoit_wolf_is_between_sample_and_identity():
    x = np.random.default_rng(2).normal(size=(30, 18))
    cov, rho = profile.ledoit_wolf(x)
    assert 0 < rho <= 1 and np.linalg.cond(cov) < np.linalg.cond(np.cov(x.T, bias=True))
    loop = sum(((np.outer(v, v) - (s := np.cov(x.T, bias=True))) ** 2).sum() for v in x - x.mean(0)) / 30**2 / 18
    s = np.cov(x.T, bias=True)
    d = ((s - np.trace(s) / 18 * np.eye(18)) ** 2).sum() / 18
    assert np.isclose(rho, min(loop, d) / d)


def test_evaluate(spark):
    rows = [(1, "a", 50.0, 0.001)] * 3 + [(0, None, 1.0, 0.8)] * 5 + [(1, None, 40.0, 0.002)]
    df = spark.createDataFrame([(*r, 0.01, 0.05) for r in rows], "label int, attack string, score double, p_value double, alpha_block double, alpha_review double")
    report = evaluate.arm_gate(evaluate.evaluate(df.selectExpr("'x' AS k", "*"), ["k"])).first()
    assert report["auroc"] == 1 and report["avg_precision"] == 1 and report["armed"]
    by = {r["cohort"]: r for r in evaluate.leave_one_attack_out(df).collect()}
    assert set(by) == {"a", "(untagged)"} and by["a"]["n"] == 8
    one = evaluate.auroc(df.where("label = 1").selectExpr("'x' AS k", "*"), ["k"]).first()
    assert one["auroc"] is None


def test_medians_and_counts_of_large_groups(spark):
    rng = np.random.default_rng(3)
    groups = {"wide": rng.normal(size=20_001), "even": rng.normal(size=12_000), "ties": rng.integers(0, 3, 9_000).astype(float), "one": np.array([2.5]), "two": np.array([1.0, 4.0]), None: rng.normal(size=7)}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7).cache()
    found = {r["k"]: r for r in grouped.robust_scale_of_many(df, ["k"], "v").collect()}
    assert {r["k"]: r["med"] for r in grouped.medians(df, ["k"], "v").collect()} == {k: float(np.median(xs)) for k, xs in groups.items()}
    for k, xs in groups.items():
        dev = np.abs(xs - np.median(xs))
        scale = stats.MAD_TO_SIGMA * np.median(dev) or stats.MEANAD_TO_SIGMA * dev.mean()
        assert np.isclose(found[k]["scale"], scale), k
    counted = grouped.count_at_least(df.withColumn("ref", F.col("v") > 0), ["k"], "v", F.col("ref")).collect()
    assert len(counted) == len(rows)
    for k, xs in groups.items():
        got = sorted((r["v"], r["n_ge"]) for r in counted if r["k"] == k and r["v"] is not None)
        ref = np.sort(xs[xs > 0])
        assert got == [(x, len(ref) - int(np.searchsorted(ref, x))) for x in np.sort(xs).tolist()], k


def test_calibration_from_sums(spark):
    x = np.random.default_rng(4).normal(size=(300, 18)) @ np.diag(np.arange(1, 19))
    df = spark.createDataFrame([(f"r{i}", row) for i, row in enumerate(x.tolist())], "repo string, vector array<double>")
    mu, precision, _ = profile.calibrate(df)
    half = [r[0] for r in df.where(F.pmod(F.xxhash64("repo", F.lit("half")), F.lit(2)) == 0).select("vector").collect()]
    assert np.array_equal(mu, np.median(half, axis=0))
    assert np.allclose(precision, np.linalg.pinv(profile.ledoit_wolf(np.array(half))[0]))
