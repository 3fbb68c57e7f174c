"""Whole scans of generated adapters. Rows only: their numbers come out of numpy on the executors."""

import uuid

from pyspark.sql import functions as F

from ..operators import evaluate, profile
from ..plans import batch, survey
from ..plans.scan import Profiles, Settings, scan
from ..sinks import reports
from ..sources import generate
from .common import query

#: Adapters of a query.
N = 14


def _folder(spark) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(found or '/tmp/checkpoints/deltaloom').removeprefix('file://')}/adapters-{uuid.uuid4().hex}"


def _made(spark, n: int = N, kinds: list[str] | None = None, layers: int = 16):
    folder = _folder(spark)
    work = batch.Workspace(spark, f"{folder}/tables")
    return work, work.written(generate.corpus(spark, f"{folder}/files", n, kinds, layers), "made")


@query("gen_corpus")
def gen_corpus(spark, d):
    """Labels of generated adapters."""
    return _made(spark, layers=2)[1].groupBy("label", "attack").agg(F.count("*").alias("n"))


@query("scan_adapters")
def scan_adapters(spark, d):
    """The end-to-end scan: status, verdict and findings of each adapter."""
    work, made = _made(spark)
    out = scan(made, Settings(mode="fast"), written=work.written).join(made, "path")
    codes = F.array_join(F.transform("verdict.reasons", lambda r: r["code"]), ",")
    return out.select(F.element_at(F.split("path", "/"), -2).alias("adapter"), "label", "status", F.col("verdict.action").alias("action"), codes.alias("codes"), F.col("anomaly.intra.max_concentration_z").alias("max_concentration_z"), F.col("coverage.n_modules_analyzed").alias("n_modules"), F.size("findings").alias("n_findings"))


@query("batch_run")
def batch_run(spark, d):
    """A batch, and again under another run id: everything comes from the cache."""
    work, made = _made(spark, 4, layers=2)
    paths = made.select("path", F.lit(0).cast("long").alias("ordinal"))
    first = batch.run(work, paths, Settings(run_id="a", mode="fast", include_modules=False))
    second = batch.run(work, paths, Settings(run_id="b", mode="fast", include_modules=False))
    return first.unionByName(second).groupBy("run_id", "outcome", "action").agg(F.count("*").alias("n"))


@query("reference_compare")
def reference_compare(spark, d):
    """A profile fitted on generated benign adapters, calibrated, and compared with others."""
    work, made = _made(spark, 60, ["benign", "benign", "benign", "benign", "concentrated_rows"], layers=16)
    results = work.written(scan(made, Settings(mode="full"), written=work.written).join(made, "path"), "scanned")
    modules = F.transform("modules", lambda m: F.struct(m["module"].alias("m"), m["layer"].alias("l"), m["expert"].alias("e"), m["kind"].alias("k"), F.map_from_arrays(F.array(*map(F.lit, profile.stats.FEATURES)), F.array(*(m["features"][f] for f in profile.stats.FEATURES))).alias("f")))
    rank = F.pmod(F.xxhash64("path"), F.lit(3)) + 7
    dump = results.where("label = 0").select(F.col("path").alias("repo"), F.lit(16).alias("n_layers"), rank.cast("int").alias("rank"), modules.alias("modules"), F.lit(0).alias("ordinal"))
    values = work.written(profile.points(dump), "points")
    trend = work.written(profile.fit(values), "trend")
    vectors = work.written(profile.adapter_vector(profile.residual_z(values, trend)), "vectors")
    mu, precision, scores = profile.calibrate(vectors)
    scores = work.written(scores, "scores")
    own = Profiles(trend.withColumn("family", F.lit("llama")), scores.select(F.lit("llama").alias("family"), "d2"), {"llama": (mu, precision)})
    again = scan(made, Settings(mode="full", run_id="scored"), own, work.written).join(made, "path")
    scored = evaluate.scored(again.withColumn("ordinal", F.lit(0)))
    return scored.groupBy("label").agg(F.count("*").alias("n"), F.count("p_value").alias("n_covered"), F.min("p_value").alias("min_p"), F.median("score").alias("median_distance"))


@query("report_documents")
def report_documents(spark, d):
    """JSON, text and SARIF of two scans, by length."""
    work, made = _made(spark, 2, ["benign", "concentrated_rows"])
    r = work.written(scan(made, Settings(mode="fast"), written=work.written), "r")
    parts = [f(r).select("scan_id", F.lit(k).alias("kind"), F.length(c).alias("length")) for k, f, c in (("json", reports.as_json, "document"), ("text", reports.as_text, "report"), ("sarif", reports.as_sarif, "document"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("survey_pipeline")
def survey_pipeline(spark, d):
    """Candidates, scans, flat rows and their distribution."""
    work, made = _made(spark, 7, layers=16)
    rows = survey.run(work, made.select(F.element_at(F.split("path", "/"), -2).alias("repo_id"), "path"), Settings(mode="fast", include_modules=False))
    report = survey.aggregate(rows)
    return report.codes.select(F.col("code").alias("value"), "n").unionByName(report.actions).unionByName(report.levels)
