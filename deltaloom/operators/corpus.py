"""Reports over a corpus of results, and the gates on benchmark figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
RED_FLAGS = ["FULL_WEIGHT_REPLACEMENT", "ROUTER_ADAPTED", "RANK_MISMATCH", "SIBLING_EXECUTABLE"]
TOP_FINDINGS = 5
SKIPPED = ["not_cached", "size_exceeded", "download_failed"]
PERCENTAGES = [10.0, 25.0, 50.0, 75.0, 90.0, 95.0, 99.0]
WARM_N, WARM_S, COLD_N, COLD_PER_MIN, MAX_MB = 1000, 120.0, 100, 100.0, 512.0
P95_RATIO, THROUGHPUT_RATIO, ERROR_POINTS = 2.0, 0.5, 0.05


def status_totals(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """attempted, succeeded, unsupported, failed, skipped."""
    s = F.col("status")
    return rows.groupBy(*(keys or [])).agg(F.count("*").alias("attempted"), F.count_if(s == "success").alias("succeeded"), F.count_if(s == "unsupported_architecture").alias("unsupported"), F.count_if(s == "analysis_failed").alias("failed"), F.count_if(s.isin(SKIPPED)).alias("skipped"))


def code_counts(rows: DataFrame, codes: str) -> DataFrame:
    """code, n: the adapters that carry each code, most first. Codes are distinct within an adapter before anything is shuffled."""
    return rows.select(F.explode(F.array_distinct(codes)).alias("code")).groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code")


def top_by(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def most_anomalous(rows: DataFrame, k: int) -> DataFrame:
    """By z; adapters without one have no place."""
    return top_by(rows.where("max_robust_z IS NOT NULL"), [F.desc("max_robust_z"), F.asc("repo_id")], k)


def structural_count(codes: Column) -> Column:
    return F.size(F.array_intersect(codes, F.array(*map(F.lit, RED_FLAGS))))


def most_suspicious(rows: DataFrame, k: int) -> DataFrame:
    """By structural codes, then by z."""
    return rows.withColumn("n_structural", structural_count(F.col("reason_codes"))).orderBy(F.desc("n_structural"), F.desc(F.coalesce("max_robust_z", F.lit(0.0))), "repo_id").limit(k)


def classify_record(status: Column, codes: Column, action: Column) -> Column:
    """Survey status of a result: unsupported methods are told by their reason code."""
    return F.when((status == "failed") & F.array_contains(codes, "UNSUPPORTED_PEFT_METHOD"), "unsupported_architecture").when((status == "failed") & F.array_contains(codes, "NO_LORA_PAIRS"), "unsupported_architecture").when(status == "failed", "analysis_failed").otherwise("success")


def route_record(cached: Column, size: Column, limit: Column, error: Column) -> Column:
    """Why a candidate isn't scanned; null if it is."""
    return F.when(~cached, "not_cached").when(size > limit, "size_exceeded").when(error.isNotNull(), "download_failed")


def first_of(entries: Column, n: int) -> Column:
    return F.slice(entries, 1, n)


def flat_record(results: DataFrame) -> DataFrame:
    """Survey rows of result documents."""
    titles = F.transform(first_of(F.col("findings"), TOP_FINDINGS), lambda f: F.left(F.concat(f["rule_id"], F.lit(": "), f["title"]), F.lit(120)))
    codes = F.transform(F.col("verdict.reasons"), lambda r: r["code"])
    return results.select(F.col("artifact.logical_id").alias("repo_id"), classify_record(F.col("status"), codes, F.col("verdict.action")).alias("status"), F.col("verdict.action").alias("action"), F.col("verdict.level").alias("level"), F.col("adapter.base_family").alias("base_family"), codes.alias("reason_codes"), F.col("anomaly.intra.max_robust_z").alias("max_robust_z"), F.col("scan.wall_time_ms").alias("wall_time_ms"), titles.alias("top_findings"))


def candidates(models: DataFrame, min_downloads: int, max_bytes: int, n: int) -> DataFrame:
    """The most popular models that have the file, within the size."""
    good = models.where((F.col("downloads") >= min_downloads) & F.col("has_file") & (F.col("size_bytes") <= max_bytes))
    return good.orderBy(F.desc("downloads"), "repo_id").limit(n)


def not_done(candidates_: DataFrame, done: DataFrame, key: str = "repo_id") -> DataFrame:
    return candidates_.join(done.select(key), key, "left_anti")


def acceptance(rows: DataFrame) -> DataFrame:
    """metrics (scenario, n, wall_s, per_min, mb_per_worker) with failures and passed."""
    failures = F.array_compact(F.array(
        F.when((F.col("scenario") == "warm") & (F.col("n") >= WARM_N) & (F.col("wall_s") > WARM_S), F.lit("wall")),
        F.when((F.col("scenario") == "cold") & (F.col("n") >= COLD_N) & (F.col("per_min") < COLD_PER_MIN), F.lit("throughput")),
        F.when(F.col("mb_per_worker") > MAX_MB, F.lit("memory"))))
    return rows.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def regression_gate(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """current (scenario, p95, per_min, error_rate) with failures against the last baseline row of its scenario; a row without one passes, as does one exactly at a limit."""
    base = baseline.groupBy("scenario").agg(F.max_by(F.struct("p95", "per_min", "error_rate"), "ordinal").alias("b"))
    c, b = F.col, lambda x: F.col(f"b.{x}")
    failures = F.array_compact(F.array(
        F.when((b("p95") > 0) & (c("p95") > P95_RATIO * b("p95")), F.lit("p95")),
        F.when((b("per_min") > 0) & (c("per_min") < THROUGHPUT_RATIO * b("per_min")), F.lit("throughput")),
        F.when(c("error_rate") > b("error_rate") + ERROR_POINTS, F.lit("errors"))))
    return current.join(base, "scenario", "left").withColumn("failures", failures).withColumn("passed", F.size("failures") == 0).drop("b")


def throughput(n: Column, wall_s: Column) -> Column:
    return F.round(F.try_divide(n.cast("double"), wall_s) * 60, 1)


def flat_csv(rows: DataFrame, lists: dict[str, int]) -> DataFrame:
    """Rows with list columns joined, at most so many entries of each."""
    return rows.withColumns({k: F.array_join(first_of(F.col(k), n), ",") for k, n in lists.items()})


def change_marker(new: Column, old: Column, higher_is_better: bool) -> Column:
    better = new > old if higher_is_better else new < old
    return F.when(new == old, "=").when(better, "+").otherwise("-")
