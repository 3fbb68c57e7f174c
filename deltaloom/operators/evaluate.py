"""How well scores tell attacks from benign adapters, overall and by attack. Columns: label 0/1, attack, score, p_value, alphas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the gate.
MIN_AUROC, MIN_TPR, MAX_FPR_RATIO = 0.90, 0.50, 1.5
UNTAGGED = "(untagged)"


def _by_score(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score, pos, neg: rows with equal scores are one step. What is sorted afterwards are distinct scores."""
    return rows.where(F.col("score").isNotNull()).groupBy(*keys, "score").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.sum(1 - F.col("label").cast("long")).alias("neg"))


def auroc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, auroc: the share of pairs of one positive and one negative that the scores put right, ties half; null without both."""
    w = W.partitionBy(*keys).orderBy("score")
    steps = _by_score(rows, keys).withColumn("below", F.coalesce(F.sum("neg").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    right = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / F.lit(2.0)))
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return steps.groupBy(*keys).agg(F.when((p > 0) & (n > 0), right / (p * n)).alias("auroc"))


def average_precision(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, avg_precision: sum of precision times the step of recall, over thresholds downwards."""
    w = W.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    steps = _by_score(rows, keys).select("*", F.sum("pos").over(w).alias("tp"), F.sum(F.col("pos") + F.col("neg")).over(w).alias("seen"))
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return steps.groupBy(*keys).agg(F.when((p > 0) & (n > 0), F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / p).alias("avg_precision"))


def rates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, counts, coverage, and the share of each label at or below the alphas."""
    covered = F.col("p_value").isNotNull()
    rate = lambda y, a: F.avg(F.when(covered & (F.col("label") == y), (F.col("p_value") <= F.col(a)).cast("double")))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_positive"), F.count_if(F.col("label") == 0).alias("n_negative"), F.count_if(covered).alias("n_covered"), F.avg(covered.cast("double")).alias("coverage"),
        rate(1, "alpha_block").alias("tpr_block"), rate(0, "alpha_block").alias("fpr_block"), rate(1, "alpha_review").alias("tpr_review"), rate(0, "alpha_review").alias("fpr_review"), F.max("alpha_block").alias("alpha_block"), F.max("alpha_review").alias("alpha_review"))


def evaluate(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rates(rows, keys).join(auroc(rows, keys), keys, "left").join(average_precision(rows, keys), keys, "left")


def cohorts(rows: DataFrame) -> DataFrame:
    """All benign rows with each attack's rows, as `cohort`; benign rows carry the array of attacks, which are few, so they are read once."""
    named = rows.withColumn("cohort", F.when(F.col("label") == 1, F.coalesce("attack", F.lit(UNTAGGED))))
    attacks = named.where("label = 1").agg(F.array_sort(F.collect_set("cohort")).alias("_all"))
    benign = rows.where("label = 0").join(F.broadcast(attacks)).select(*rows.columns, F.explode("_all").alias("cohort"))
    return named.where("label = 1").select(*rows.columns, "cohort").unionByName(benign)


def leave_one_attack_out(rows: DataFrame) -> DataFrame:
    return evaluate(cohorts(rows), ["cohort"])


def gate_reasons() -> Column:
    """What speaks against arming the block gate, for columns of evaluate(); null measures count as failed."""
    limit = MAX_FPR_RATIO * F.col("alpha_block")
    return F.array_compact(F.array(
        F.when(~F.coalesce(F.col("auroc") >= MIN_AUROC, F.lit(False)), F.lit("auroc")),
        F.when(~F.coalesce(F.col("tpr_block") >= MIN_TPR, F.lit(False)), F.lit("tpr_block")),
        F.when(~F.coalesce(F.col("fpr_block") <= limit, F.lit(False)), F.lit("fpr_block"))))


def arm_gate(report: DataFrame) -> DataFrame:
    """report with reasons and armed."""
    return report.withColumn("reasons", gate_reasons()).withColumn("armed", F.size("reasons") == 0)


def scored(results: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns to keep, adapter_id, label, attack, score, p_value, alphas of labelled result documents; without a reference, all measures are null."""
    r = lambda c: F.col(f"anomaly.reference.{c}")
    bad = F.when(~F.col("label").isin(0, 1), F.raise_error(F.lit("label must be 0 or 1")).cast("string"))
    return results.select(*keep, F.coalesce(bad, F.col("artifact.logical_id"), F.concat(F.lit("adapter-"), F.col("ordinal").cast("string"))).alias("adapter_id"), "label", F.when(F.col("label") == 1, F.col("attack")).alias("attack"), r("distance").alias("score"), r("p_value").alias("p_value"), r("alpha_block").alias("alpha_block"), r("alpha_review").alias("alpha_review"))
