"""Profiles, evaluation, rules, state, sinks and corpus reports."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import config, ids, stats
from ..operators import corpus, evaluate, grouped, lowrank, profile, rules, state
from ..sinks import reports
from .common import SCORED_SQL, Input, factors, query, r6, scored, table, values

LINES = Input("lineitem", ("l_returnflag AS g", "l_extendedprice AS y", "l_quantity AS u", "l_discount AS v", "l_suppkey AS s", "l_orderkey AS o", "l_linenumber AS n"))


@query("fit_trend", f"""
WITH p AS (SELECT g, y, u, v FROM {LINES.sql} l), m AS (SELECT g, avg(u) AS a, avg(v) AS b, avg(y) AS m FROM p GROUP BY g),
s AS (SELECT g, count(*) AS n, any_value(a) AS a, any_value(b) AS b, any_value(m) AS m, sum((u - a) * (u - a)) AS uu, sum((v - b) * (v - b)) AS vv, sum((u - a) * (v - b)) AS uv, sum((u - a) * (y - m)) AS uw, sum((v - b) * (y - m)) AS vw FROM p JOIN m USING (g) GROUP BY g),
c AS (SELECT *, (uw * vv - vw * uv) / (uu * vv - uv * uv) AS c1, (vw * uu - uw * uv) / (uu * vv - uv * uv) AS c2 FROM s)
SELECT g, n, round(m - c1 * a - c2 * b, 3) AS c0, round(c1, 3) AS c1, round(c2, 3) AS c2 FROM c WHERE n >= 24""")
def fit_trend(spark, d):
    return profile.fit_trend(LINES.df(spark, d), ["g"], "y", "u", "v").select("g", "n", *(F.round(c, 3).alias(c) for c in ("c0", "c1", "c2")))


POINTS_SQL = f"(SELECT o % 50 AS id, CASE n % 3 WHEN 0 THEN 'log_rms' WHEN 1 THEN 'kurt_dw' ELSE 'col_hoyer' END AS feature, (y - 30000) / 10000 AS z FROM {LINES.sql} l)"


@query("adapter_vector", f"SELECT id, {', '.join(f'round(coalesce(median(z) FILTER (WHERE feature = {f!r}), 0), 6) AS {f}_m, round(coalesce(quantile_cont(abs(z), 0.9) FILTER (WHERE feature = {f!r}), 0), 6) AS {f}_p' for f in stats.FEATURES)} FROM {POINTS_SQL} p GROUP BY id")
def adapter_vector(spark, d):
    p = LINES.df(spark, d).select((F.col("o") % 50).alias("id"), F.when(F.col("n") % 3 == 0, "log_rms").when(F.col("n") % 3 == 1, "kurt_dw").otherwise("col_hoyer").alias("feature"), ((F.col("y") - 30000) / 10000).alias("z"))
    v = profile.adapter_vector(p, "id")
    names = [f"{f}_{x}" for f in stats.FEATURES for x in "mp"]
    return v.select("id", *(r6(F.get("vector", F.lit(i))).alias(c) for i, c in enumerate(names)))


@query("robust_center", "SELECT label, pos, round(median(v), 6) AS mid FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) t GROUP BY ALL")
def robust_center(spark, d):
    return grouped.position_medians(table(spark, d, "embeddings"), ["label"], "embedding").withColumn("mid", r6("mid"))


MU = [(i % 5 - 2) / 100 for i in range(64)]
PREC = [[2.0 + i % 3 if i == j else 0.25 * (-1) ** min(i, j) if abs(i - j) == 1 else 0.0 for j in range(64)] for i in range(64)]
DEV = [f"(embedding[{i + 1}]::DOUBLE - ({m}))" for i, m in enumerate(MU)]
D2_SQL = "greatest(" + " + ".join(f"{DEV[i]} * {PREC[i][j]} * {DEV[j]}" for i in range(64) for j in range(64) if PREC[i][j]) + ", 0)"


@query("mahalanobis_sq", f"SELECT vec_id, round({D2_SQL}, 6) AS d2 FROM embeddings")
def mahalanobis(spark, d):
    return table(spark, d, "embeddings").select("vec_id", r6(profile.distance(F.col("embedding").cast("array<double>"), MU, PREC)).alias("d2"))


SCORES = Input("orders", ("o_orderkey AS k", "o_orderpriority AS family", "floor(o_totalprice / 100) AS d2", "o_orderkey % 3 = 0 AS is_ref"))


@query("conformal_p", f"SELECT k, family, round((1 + (SELECT count(*) FROM {SCORES.sql} r WHERE r.is_ref AND r.family = s.family AND r.d2 >= s.d2)) / (1.0 + (SELECT count(*) FROM {SCORES.sql} r WHERE r.is_ref AND r.family = s.family)), 6)::DOUBLE AS p_value FROM {SCORES.sql} s WHERE NOT is_ref")
def conformal_p(spark, d):
    s = SCORES.df(spark, d)
    return profile.conformal_p(s.where("NOT is_ref").select("k", "family", "d2"), s.where("is_ref").select("family", "d2"), ["family"]).select("k", "family", r6("p_value").alias("p_value"))


@query("range_count_ge", f"SELECT k, family, (SELECT count(*) FROM {SCORES.sql} r WHERE r.is_ref AND r.family = s.family AND r.d2 >= s.d2) AS n_ge FROM {SCORES.sql} s")
def range_count_ge(spark, d):
    return grouped.count_at_least(SCORES.df(spark, d), ["family"], "d2", F.col("is_ref")).select("k", "family", "n_ge")


@query("loo_fpr", f"SELECT family, count(*) AS n, round(min(p), 6) AS min_p, round(avg((p <= 0.01)::INTEGER), 6) AS f01, round(avg((p <= 0.05)::INTEGER), 6) AS f05, round(avg((p <= 0.1)::INTEGER), 6) AS f10 FROM (SELECT family, rank_ge / n::DOUBLE AS p FROM (SELECT family, count(*) OVER (PARTITION BY family ORDER BY d2 DESC RANGE UNBOUNDED PRECEDING) AS rank_ge, count(*) OVER (PARTITION BY family) AS n FROM {SCORES.sql} s) t) u GROUP BY family")
def loo_fpr(spark, d):
    out = profile.loo_fpr(SCORES.df(spark, d), ["family"])
    return out.select("family", "n", r6("min_p").alias("min_p"), r6("`fpr_0.01`").alias("f01"), r6("`fpr_0.05`").alias("f05"), r6("`fpr_0.1`").alias("f10"))


@query("rank_diagnostic", "SELECT CASE WHEN p_size <= 8 THEN 'r<=8' WHEN p_size <= 16 THEN 'r<=16' WHEN p_size <= 32 THEN 'r<=32' WHEN p_size <= 64 THEN 'r<=64' ELSE 'r>64' END AS bucket, count(*) AS n, round(median(p_retailprice), 6) AS raw_median, round(median(p_retailprice - p_size), 6) AS residual_median FROM part GROUP BY 1")
def rank_diagnostic(spark, d):
    p = table(spark, d, "part").withColumn("res", F.col("p_retailprice") - F.col("p_size"))
    return profile.rank_diagnostic(p, "p_size", "p_retailprice", "res").select("bucket", "n", r6("raw_median").alias("raw_median"), r6("residual_median").alias("residual_median"))


@query("scan_feature_dump", "SELECT count(*) AS n, round(sum(CASE WHEN n % 4 <> 0 THEN ln(y) ELSE 0 END), 3) AS total FROM (SELECT DISTINCT ON (l_suppkey) l_suppkey AS s, l_orderkey AS o, l_linenumber AS n, l_extendedprice AS y FROM lineitem ORDER BY l_suppkey, l_orderkey, l_linenumber, l_extendedprice) t WHERE n % 4 <> 0")
def scan_feature_dump(spark, d):
    """The first record of each supplier as a dump of one module with a log feature."""
    li = table(spark, d, "lineitem")
    module = F.struct(F.lit("m").alias("m"), F.lit(1).alias("l"), F.lit(None).cast("int").alias("e"), F.lit("mlp").alias("k"), F.create_map(F.lit("kurt_dw"), F.col("l_extendedprice")).alias("f"))
    dump = li.select(F.col("l_suppkey").alias("repo"), F.lit(2).alias("n_layers"), (F.col("l_linenumber") % 4).alias("rank"), F.array(module).alias("modules"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("ordinal"))
    v = profile.points(dump)
    return v.agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


AUROC_SQL = f"(SELECT {{k}} (sum(CASE WHEN label = 1 THEN mid END) - any_value(p) * (any_value(p) + 1) / 2.0) / (any_value(p) * any_value(n))::DOUBLE AS auroc FROM (SELECT *, rank() OVER ({{w}} ORDER BY score) + (count(*) OVER (PARTITION BY {{c}} score) - 1) / 2.0 AS mid, sum(label) OVER ({{w}}) AS p, count(*) OVER ({{w}}) - sum(label) OVER ({{w}}) AS n FROM {{t}} s) t {{g}})"


@query("auroc", f"SELECT attack, round(auroc, 6) AS auroc FROM {AUROC_SQL.format(k='attack,', w='PARTITION BY attack', c='attack,', t=SCORED_SQL, g='GROUP BY attack')} a")
def auroc(spark, d):
    return evaluate.auroc(scored(spark, d), ["attack"]).select("attack", r6("auroc").alias("auroc"))


AP_SQL = "(SELECT attack, sum(pos * tp / seen::DOUBLE) / sum(pos) AS ap FROM (SELECT attack, score, pos, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS seen FROM (SELECT attack, score, sum(label) AS pos, sum(1 - label) AS neg FROM {t} s GROUP BY ALL) a WINDOW w AS (PARTITION BY attack ORDER BY score DESC)) b GROUP BY attack)"


@query("avg_precision", f"SELECT attack, round(ap, 6) AS avg_precision FROM {AP_SQL.format(t=SCORED_SQL)} a")
def avg_precision(spark, d):
    return evaluate.average_precision(scored(spark, d), ["attack"]).select("attack", r6("avg_precision").alias("avg_precision"))


@query("rate_at_alpha", f"SELECT attack, count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_positive, round(avg((p_value <= alpha_block)::INTEGER) FILTER (WHERE label = 1), 6) AS tpr_block, round(avg((p_value <= alpha_review)::INTEGER) FILTER (WHERE label = 0), 6) AS fpr_review FROM {SCORED_SQL} s GROUP BY attack")
def rate_at_alpha(spark, d):
    return evaluate.rates(scored(spark, d), ["attack"]).select("attack", "n", "n_positive", r6("tpr_block").alias("tpr_block"), r6("fpr_review").alias("fpr_review"))


COHORT_SQL = f"(SELECT label, score, p_value, alpha_block, attack FROM {SCORED_SQL} s WHERE label = 1 UNION ALL SELECT b.label, b.score, b.p_value, b.alpha_block, a.attack FROM {SCORED_SQL} b, (SELECT DISTINCT attack FROM {SCORED_SQL} s WHERE label = 1) a WHERE b.label = 0)"


@query("leave_one_attack_out", f"SELECT c.attack AS cohort, count(*) AS n, round(any_value(a.auroc), 6) AS auroc, round(any_value(p.ap), 6) AS avg_precision, round(avg((p_value <= alpha_block)::INTEGER) FILTER (WHERE label = 0), 6) AS fpr_block FROM {COHORT_SQL} c JOIN {AUROC_SQL.format(k='attack,', w='PARTITION BY attack', c='attack,', t=COHORT_SQL, g='GROUP BY attack')} a USING (attack) JOIN {AP_SQL.format(t=COHORT_SQL)} p USING (attack) GROUP BY c.attack")
def leave_one_attack_out(spark, d):
    return evaluate.leave_one_attack_out(scored(spark, d)).select("cohort", "n", r6("auroc").alias("auroc"), r6("avg_precision").alias("avg_precision"), r6("fpr_block").alias("fpr_block"))


@query("union_benign_attack", f"SELECT attack AS cohort, label, count(*) AS n FROM {COHORT_SQL} c GROUP BY ALL")
def union_benign_attack(spark, d):
    return evaluate.cohorts(scored(spark, d)).groupBy("cohort", "label").agg(F.count("*").alias("n"))


GATES = Input("part", ("p_partkey AS n", "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size / 50.0 END AS auroc", "p_partkey % 11 / 10.0 AS tpr_block", "p_partkey % 13 / 100.0 AS fpr_block", "0.05 AS alpha_block"))


@query("arm_gate", f"SELECT n, concat_ws(',', CASE WHEN auroc IS NULL OR auroc < 0.9 THEN 'auroc' END, CASE WHEN tpr_block < 0.5 THEN 'tpr_block' END, CASE WHEN fpr_block > 1.5 * alpha_block THEN 'fpr_block' END) AS reasons, coalesce(auroc >= 0.9, false) AND tpr_block >= 0.5 AND fpr_block <= 1.5 * alpha_block AS armed FROM {GATES.sql} g")
def arm_gate(spark, d):
    return evaluate.arm_gate(GATES.df(spark, d)).select("n", F.array_join("reasons", ",").alias("reasons"), "armed")


# rules
CASES = Input("part", ("p_partkey AS n", "CASE p_partkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'degraded' ELSE 'ok' END AS status", "CASE WHEN p_partkey % 3 = 0 THEN 'strict' ELSE 'default' END AS policy", "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size / 500.0 END AS p", "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 2 END AS cz", "p_partkey % 7 = 0 AS flagged", "p_partkey % 8 <> 0 AS meta", "p_partkey % 9 = 0 AS limited"))


@query("rules_verdict", f"""
SELECT n, action, CASE WHEN action = 'block' AND p IS NOT NULL AND p <= 0.001 THEN 'CRITICAL' WHEN action = 'block' THEN 'HIGH' WHEN action = 'review' THEN 'MEDIUM' ELSE 'LOW' END AS level,
  concat_ws(',', CASE status WHEN 'failed' THEN 'PARSE_FAILED' WHEN 'degraded' THEN 'DEGRADED_PARSE' END, CASE WHEN p <= 0.05 THEN 'REFERENCE_P_BELOW_ALPHA' WHEN p IS NULL AND status <> 'failed' THEN 'NO_REFERENCE_PROFILE' END, CASE WHEN cz >= 14 THEN 'INTRA_OUTLIER' END,
    CASE WHEN flagged THEN 'ROUTER_ADAPTED' END, CASE WHEN flagged AND policy = 'strict' THEN 'STRICT_POLICY_STRUCTURAL' END, CASE WHEN NOT meta THEN 'MISSING_METADATA' END) AS reasons,
  action <> 'allow' OR NOT meta AS m2_recommended, CASE WHEN status <> 'ok' THEN 'low' WHEN p IS NULL OR limited THEN CASE WHEN cz IS NOT NULL THEN 'medium' ELSE 'low' END ELSE 'high' END AS confidence
FROM (SELECT *, CASE WHEN coalesce(p <= 0.01, false) OR (flagged AND policy = 'strict') THEN 'block' WHEN status <> 'ok' OR coalesce(p <= 0.05, false) OR coalesce(cz >= 14, false) OR flagged THEN 'review' ELSE 'allow' END AS action FROM {CASES.sql} c) t""")
def rules_verdict(spark, d):
    """With an armed reference, so that every rule can fire."""
    c = F.col
    ref = F.when(c("p").isNotNull(), F.struct(c("p").cast("double").alias("p_value"), F.lit(0.05).alias("alpha_review"), F.lit(0.01).alias("alpha_block"), F.lit(100).alias("n_reference")))
    intra = F.when(c("cz").isNotNull(), F.struct(c("cz").alias("max_concentration_z")))
    some = lambda cond, x: F.when(cond, F.array(F.lit(x))).otherwise(F.array().cast("array<string>"))
    v = rules.verdict({"status": c("status"), "policy": c("policy"), "intra": intra, "reference": ref, "red_flags": some(c("flagged"), "ROUTER_ADAPTED"), "metadata_present": c("meta"), "limits": some(c("limited"), "x"), "n_not": F.lit(1), "top_edge": F.lit(False), "failure_code": F.lit("PARSE_FAILED"), "failure_message": F.lit("x")}, can_block=True)
    return CASES.df(spark, d).select("n", v.alias("v")).select("n", "v.action", "v.level", F.array_join(F.transform("v.reasons", lambda r: r["code"]), ",").alias("reasons"), "v.m2_recommended", F.col("v.confidence.level").alias("confidence"))


@query("rules_confidence", f"SELECT n, CASE WHEN status <> 'ok' THEN 'low' WHEN p IS NULL OR limited THEN CASE WHEN cz IS NOT NULL THEN 'medium' ELSE 'low' END ELSE 'high' END AS confidence FROM {CASES.sql} c")
def rules_confidence(spark, d):
    c = F.col
    return CASES.df(spark, d).select("n", rules.confidence(c("status"), c("p").isNotNull(), c("limited"), c("cz").isNotNull()).alias("confidence"))


SHAPES = Input("part", ("p_partkey AS n", "CAST(p_size AS INTEGER) AS declared", "CAST(8 + p_partkey % 2 * 8 AS INTEGER) AS r1", "CAST(8 + p_partkey % 3 * 8 AS INTEGER) AS r2", "p_partkey % 5 = 0 AS no_config", "p_partkey % 4 = 0 AS full_head", "p_partkey % 6 = 0 AS router", "p_partkey % 7 = 0 AS code", "p_partkey % 11 = 0 AS dora", "p_partkey % 9 = 0 AS other_module"))


@query("rules_structural", f"""
SELECT n, concat_ws(',', CASE WHEN full_head THEN 'FULL_WEIGHT_REPLACEMENT' END, CASE WHEN router THEN 'ROUTER_ADAPTED' END, CASE WHEN mismatch THEN 'RANK_MISMATCH' END, CASE WHEN code THEN 'SIBLING_EXECUTABLE' END, CASE WHEN dora THEN 'DORA_PARTIAL_ANALYSIS' END, CASE WHEN NOT no_config AND other_module THEN 'TARGET_MODULES_MISMATCH' END) AS rules,
  ((full_head)::INTEGER + router::INTEGER + mismatch::INTEGER + code::INTEGER)::INTEGER AS n_red
FROM (SELECT *, NOT no_config AND NOT (r1 = r2 AND r1 = declared) AS mismatch FROM {SHAPES.sql} s) t""")
def rules_structural(spark, d):
    c = F.col
    empty = lambda t: F.array().cast(f"array<{t}>")
    place = lambda m, k: F.struct(F.lit(1).alias("layer"), F.lit(None).cast("int").alias("expert"), F.lit(m).alias("module"), F.lit(k).alias("kind"), F.lit("").alias("stack"))
    full = F.when(c("full_head"), F.array(F.struct(F.lit("k").alias("key"), F.array(F.lit(2).cast("long")).alias("shape"), place("lm_head", "lm_head").alias("location")))).otherwise(empty("struct<key:string,shape:array<bigint>,location:struct<layer:int,expert:int,module:string,kind:string,stack:string>>"))
    routers = F.when(c("router"), F.array(F.struct(F.lit("k").alias("key"), place("gate", "router").alias("location")))).otherwise(empty("struct<key:string,location:struct<layer:int,expert:int,module:string,kind:string,stack:string>>"))
    text = F.concat(F.lit('{"r": '), c("declared").cast("string"), F.lit(', "target_modules": ["q_proj"]}'))
    cfg = F.when(~c("no_config"), config.parse(text))
    row = {"config": c("config"), "problems": empty("string"), "siblings": F.when(c("code"), F.array(F.struct(F.lit("a.py").alias("name"), F.lit("code").alias("kind")))).otherwise(empty("struct<name:string,kind:string>")), "full": full, "routers": routers, "ranks": F.array_sort(F.array_distinct(F.array("r1", "r2"))), "has_dora": c("dora"), "unresolved": F.lit(False), "token_keys": empty("string"), "modules": F.when(c("other_module"), F.array(F.lit("v_proj"))).otherwise(F.array(F.lit("q_proj")))}
    found, flags, _ = rules.structural(row)
    return SHAPES.df(spark, d).withColumn("config", cfg).select("n", F.array_join(F.transform(found, lambda f: f["rule_id"]), ",").alias("rules"), F.size(flags).alias("n_red"))


@query("coverage_counts", "SELECT o_custkey AS k, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_ok, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n_not, CASE WHEN count(*) FILTER (WHERE o_orderstatus <> 'F') = 0 THEN 'ok' WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = 0 THEN 'failed' ELSE 'degraded' END AS status FROM orders GROUP BY o_custkey")
def coverage(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_ok"), F.count_if(F.col("o_orderstatus") != "F").alias("n_not"))
    return s.withColumn("status", rules.status(F.col("n_ok"), F.col("n_not")))


@query("adapter_info", "SELECT c_nationkey AS k, min(c_custkey % 50)::INTEGER AS rmin, max(c_custkey % 50)::INTEGER AS rmax, count(DISTINCT c_custkey % 50) AS n_ranks, max(c_custkey % 33) + 1 AS n_layers, CASE WHEN count(*) > 0 AND count(*) FILTER (WHERE c_acctbal < 0) = count(*) THEN 'init_only' WHEN count(*) FILTER (WHERE c_acctbal < 0) > 0 THEN 'partial' ELSE 'trained' END AS training_state FROM customer GROUP BY 1")
def adapter_info(spark, d):
    c = table(spark, d, "customer")
    r = (F.col("c_custkey") % 50).cast("int")
    out = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.min(r).alias("rmin"), F.max(r).alias("rmax"), F.size(F.array_sort(F.collect_set(r))).cast("long").alias("n_ranks"), (F.max(F.col("c_custkey") % 33) + 1).alias("n_layers"), F.count("*").alias("n_ok"), F.count_if(F.col("c_acctbal") < 0).alias("n_zero"))
    return out.select("k", "rmin", "rmax", "n_ranks", "n_layers", rules.training_state(F.col("n_ok"), F.col("n_zero")).alias("training_state"))


@query("set_unexpected_modules", "SELECT o_custkey AS k, array_to_string(list_sort(list_distinct(list(o_orderpriority) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')))), ',') AS unexpected FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) > 0")
def unexpected(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("m"))
    out = a.select("k", rules.unexpected(F.col("m"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("unexpected"))
    return out.where(F.size("unexpected") > 0).select("k", F.array_join("unexpected", ",").alias("unexpected"))


@query("set_modules_to_save", "SELECT o_custkey AS k, array_to_string(list_sort(list_distinct(list_concat(list(o_orderpriority), ['x', '2-HIGH']))), ',') AS saved FROM orders GROUP BY o_custkey")
def modules_to_save(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("m"))
    return a.select("k", F.array_join(rules.all_saved(F.col("m"), F.array(F.lit("x"), F.lit("2-HIGH"))), ",").alias("saved"))


@query("set_rank_mismatch", "SELECT l_orderkey AS k, list_sort(list_distinct(list(l_linenumber))) <> [1] AS mismatch FROM lineitem GROUP BY l_orderkey")
def rank_mismatch(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("m"))
    return a.select("k", rules.ranks_differ(F.col("m"), F.lit(1).cast(a.schema["m"].dataType.elementType)).alias("mismatch"))


@query("set_other_full", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def other_full(spark, d):
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("list_caps", "SELECT o_custkey AS k, array_to_string(list_sort(list(o_orderkey))[1:5], ',') AS listed, count(*) AS n FROM orders GROUP BY 1")
def list_caps(spark, d):
    """The first five by key: cut before they are collected."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").cast("long").alias("o"))
    top = grouped.top_rows(o, ["k"], [F.asc("o")], 5).groupBy("k").agg(F.array_sort(F.collect_list("o")).alias("listed"))
    return top.join(o.groupBy("k").agg(F.count("*").alias("n")), "k").select("k", F.array_join("listed", ",").alias("listed"), "n")


# state
EVENTS = Input("events", ("CAST(user_id AS VARCHAR) AS request_id", "event_id", "ts", "CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'leased' WHEN 'purchase' THEN 'persisted' WHEN 'error' THEN 'failed' ELSE 'running' END AS state", "CAST(event_id % 4 AS INTEGER) AS retry_count", "CAST(NULL AS VARCHAR) AS error_message", "value"))
LATEST_SQL = f"(SELECT request_id, arg_max(state, (ts, event_id)) AS state, arg_max(retry_count, (ts, event_id)) AS retry_count FROM {EVENTS.sql} e GROUP BY request_id)"


def _events(spark, d):
    import re

    cols = [re.sub(r"CAST\((.*) AS VARCHAR\)", r"CAST(\1 AS STRING)", c) for c in EVENTS.columns]
    return table(spark, d, "events").selectExpr(*cols)


@query("win_latest_state", f"SELECT request_id, state, retry_count FROM {LATEST_SQL} l")
def latest_state(spark, d):
    return state.latest(_events(spark, d), order=("ts", "event_id")).select("request_id", "state", "retry_count")


@query("state_counts", f"SELECT state, count(*) AS n FROM {EVENTS.sql} e GROUP BY state")
def state_counts(spark, d):
    return state.state_counts(_events(spark, d))


OPEN = "state NOT IN ('persisted', 'cached_hit', 'skipped_duplicate', 'failed')"


@query("state_resume", f"SELECT request_id, CASE WHEN {OPEN} THEN CASE WHEN retry_count + 1 >= 3 THEN 'failed' ELSE 'queued' END ELSE state END AS state, (retry_count + CASE WHEN {OPEN} THEN 1 ELSE 0 END)::INTEGER AS retry_count, CASE WHEN {OPEN} AND retry_count + 1 >= 3 THEN 'retry limit exceeded' END AS error_message FROM {LATEST_SQL} l")
def state_resume(spark, d):
    last = state.latest(_events(spark, d), order=("ts", "event_id"))
    return state.resume(last).select("request_id", "state", "retry_count", "error_message")


@query("anti_terminal", f"SELECT DISTINCT request_id FROM {EVENTS.sql} e WHERE request_id NOT IN (SELECT request_id FROM {LATEST_SQL} l WHERE state IN ('persisted', 'failed'))")
def anti_terminal(spark, d):
    e = _events(spark, d)
    return state.unfinished(e.select("request_id").distinct(), state.latest(e, order=("ts", "event_id")))


@query("anti_completed", "SELECT c_custkey AS repo_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_completed(spark, d):
    return corpus.not_done(table(spark, d, "customer").select(F.col("c_custkey").alias("repo_id")), table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("repo_id")))


@query("queue_fetch", f"SELECT request_id AS adapter_path, event_id FROM {EVENTS.sql} e WHERE state = 'queued' ORDER BY request_id, event_id LIMIT 256")
def queue_fetch(spark, d):
    m = _events(spark, d).withColumnRenamed("request_id", "adapter_path")
    return state.queue(m, order=("adapter_path", "event_id")).select("adapter_path", "event_id")


@query("state_upsert", "SELECT CAST(o_orderkey AS BIGINT) AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS state FROM orders")
def upsert(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_orderstatus").alias("state"))
    return state.upsert(o, o.where("k % 5 = 0").withColumn("state", F.lit("new")), ["k"])


@query("state_expired_leases", f"SELECT event_id FROM {EVENTS.sql} e WHERE state = 'leased' AND ts < TIMESTAMP '2024-01-10'")
def expired_leases(spark, d):
    return state.expired_leases(_events(spark, d).withColumn("lease_expires_at", F.col("ts")), F.expr("TIMESTAMP_NTZ '2024-01-10'")).select("event_id")


@query("cache_ttl_predicate", "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN false ELSE floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000) > event_id % 20 END AS expired FROM events")
def cache_ttl(spark, d):
    ttl = F.when(F.col("event_id") % 6 != 0, F.col("event_id") % 20)
    return table(spark, d, "events").select("event_id", ids.expired(F.col("ts"), F.expr("TIMESTAMP '2024-01-31'"), ttl).alias("expired"))


@query("semi_cache_hit", """
SELECT event_id, CASE WHEN c_custkey IS NULL THEN 'absent' WHEN c_custkey % 7 = 0 THEN 'version' WHEN c_custkey % 5 = 0 THEN 'expired' WHEN c_custkey % 4 = 0 THEN 'tampered' END AS miss
FROM events LEFT JOIN customer ON user_id = c_custkey AND c_custkey % 3 <> 0""")
def semi_cache_hit(spark, d):
    """Also the integrity check: the payload's hash."""
    req = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("content_hash"), F.lit("s").alias("config_hash"))
    k = F.col("c_custkey")
    c = table(spark, d, "customer").where(k % 3 != 0)
    payload = F.coalesce(F.col("c_name").cast("string"), F.lit("p")) if "c_name" in c.columns else F.lit("p")
    cache = c.select(k.cast("string").alias("content_hash"), F.lit("s").alias("config_hash"), F.when(k % 7 == 0, "1").otherwise("2").alias("schema_version"), F.lit(state.WRITER_VERSION).alias("writer_version"), F.expr("TIMESTAMP '2024-01-01'").alias("cached_at"), F.when(k % 5 == 0, 1).alias("ttl_days"), payload.alias("payload"), F.concat(F.lit("sha256:"), F.sha2(F.when(k % 4 == 0, F.lit("other")).otherwise(payload), 256)).alias("payload_hash"))
    return state.cache_probe(req, cache, F.expr("TIMESTAMP '2024-01-31'"), "2").select("event_id", "miss")


@query("cache_stats", "SELECT (SELECT count(*) FROM customer) AS entries, (SELECT count(*) FROM events WHERE event_type = 'view') AS hits")
def cache_stats(spark, d):
    return state.cache_stats(table(spark, d, "customer"), table(spark, d, "events").where("event_type = 'view'"))


@query("content_dedup", "SELECT doc_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY source, sha256(text)) THEN 'queued' ELSE 'skipped_duplicate' END AS state FROM documents")
def content_dedup(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("request_id"), F.col("source").alias("run_id"), ids.hashed(F.col("text")).alias("content_hash"))
    return state.without_duplicates(docs).select(F.col("request_id").alias("doc_id"), "state")


@query("sink_idempotent", "SELECT o_orderkey AS scan_id, CASE WHEN o_orderkey % 4 = 0 THEN 'new' WHEN o_orderkey % 5 = 0 THEN 'conflict' ELSE 'unchanged' END AS outcome FROM orders")
def sink_idempotent(spark, d):
    o = table(spark, d, "orders")
    doc = lambda status: F.struct(F.struct(F.col("o_orderkey").alias("scan_id"), F.col("o_orderdate").alias("started_at"), F.current_timestamp().alias("completed_at"), F.lit(1).alias("wall_time_ms")).alias("scan"), status.alias("status"))
    new = o.select(F.col("o_orderkey").alias("scan_id"), state.stable_hash(doc(F.col("o_orderstatus"))).alias("stable_hash"))
    other = F.when(F.col("o_orderkey") % 5 == 0, "changed").otherwise(F.col("o_orderstatus"))
    old = o.where("o_orderkey % 4 <> 0").withColumn("o_orderdate", F.lit(None).cast("timestamp")).select(F.col("o_orderkey").alias("scan_id"), state.stable_hash(doc(other)).alias("stable_hash"))
    return state.compare_with_stored(new, old)


RESULTS = Input("events", ("CAST(user_id AS VARCHAR) AS scan_id", "CAST(user_id % 3 AS VARCHAR) AS run_id", "CASE event_type WHEN 'click' THEN 'allow' WHEN 'view' THEN 'review' ELSE 'block' END AS action", "event_id AS completed_at"))


@query("sink_run_summary", f"SELECT run_id, count(*) AS n, count(*) FILTER (WHERE action = 'allow') AS allow, count(*) FILTER (WHERE action = 'review') AS review, count(*) FILTER (WHERE action = 'block') AS block FROM (SELECT scan_id, arg_max(run_id, completed_at) AS run_id, arg_max(action, completed_at) AS action FROM {RESULTS.sql} r GROUP BY scan_id) t GROUP BY run_id")
def sink_run_summary(spark, d):
    cols = [c.replace("VARCHAR", "STRING") for c in RESULTS.columns]
    return state.run_summary(table(spark, d, "events").selectExpr(*cols))


# corpus
SURVEY = Input("documents", ("doc_id AS repo_id", "CASE doc_id % 6 WHEN 0 THEN 'unsupported_architecture' WHEN 1 THEN 'analysis_failed' WHEN 2 THEN 'not_cached' WHEN 3 THEN 'size_exceeded' ELSE 'success' END AS status", "lang", "n_chars"))
CODE_NAMES = ["INTRA_OUTLIER", "ROUTER_ADAPTED", "RANK_MISMATCH", "MISSING_METADATA", "ROUTER_ADAPTED"]


@query("status_totals", f"SELECT lang, count(*) AS attempted, count(*) FILTER (WHERE status = 'success') AS succeeded, count(*) FILTER (WHERE status = 'unsupported_architecture') AS unsupported, count(*) FILTER (WHERE status = 'analysis_failed') AS failed, count(*) FILTER (WHERE status IN ('not_cached', 'size_exceeded')) AS skipped FROM {SURVEY.sql} s GROUP BY lang")
def status_totals(spark, d):
    return corpus.status_totals(SURVEY.df(spark, d), ["lang"])


@query("value_counts", "SELECT coalesce(CASE WHEN doc_id % 10 <> 0 THEN lang END, 'unknown') AS value, count(*) AS n FROM documents GROUP BY 1")
def value_counts(spark, d):
    return grouped.value_counts(table(spark, d, "documents").select(F.when(F.col("doc_id") % 10 != 0, F.col("lang")).alias("lang")), "lang")


CODED_SQL = f"(SELECT doc_id, n_chars, {CODE_NAMES}[1:1 + doc_id % 5]::VARCHAR[] AS codes FROM documents)"


def _coded(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars", F.slice(F.array(*map(F.lit, CODE_NAMES)), F.lit(1), (1 + F.col("doc_id") % 5).cast("int")).alias("codes"))


@query("reason_distribution", f"SELECT code, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(codes) AS code FROM {CODED_SQL} c) t GROUP BY code")
def reason_distribution(spark, d):
    return corpus.code_counts(_coded(spark, d), "codes")


@query("sort_reason_counts", f"SELECT row_number() OVER (ORDER BY n DESC, code)::INTEGER AS place, code FROM (SELECT code, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(codes) AS code FROM {CODED_SQL} c) t GROUP BY code) u")
def sort_reason_counts(spark, d):
    n = corpus.code_counts(_coded(spark, d), "codes")
    return n.select(F.row_number().over(W.orderBy(F.desc("n"), "code")).alias("place"), "code")


@query("topk_suspicious_struct", f"SELECT doc_id AS repo_id, len(list_distinct(list_filter(codes, lambda c: c IN ('ROUTER_ADAPTED', 'RANK_MISMATCH'))))::INTEGER AS n_structural FROM {CODED_SQL} c ORDER BY 2 DESC, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars END DESC, doc_id LIMIT 20")
def topk_suspicious_struct(spark, d):
    c = _coded(spark, d).select(F.col("doc_id").alias("repo_id"), F.col("codes").alias("reason_codes"), F.when(F.col("doc_id") % 7 != 0, F.col("n_chars").cast("double")).alias("max_robust_z"))
    return corpus.most_suspicious(c, 20).select("repo_id", "n_structural")


@query("topk_suspicious_z", "SELECT doc_id, n_chars FROM documents WHERE doc_id % 7 <> 0 ORDER BY n_chars DESC, doc_id LIMIT 20")
def topk_suspicious_z(spark, d):
    """Every seventh document has no z."""
    z = table(spark, d, "documents").select(F.col("doc_id").alias("repo_id"), F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")).alias("max_robust_z"))
    return corpus.most_anomalous(z, 20).select(F.col("repo_id").alias("doc_id"), F.col("max_robust_z").alias("n_chars"))


@query("structural_codes", f"SELECT doc_id, len(list_distinct(list_filter(codes, lambda c: c IN ('ROUTER_ADAPTED', 'RANK_MISMATCH', 'FULL_WEIGHT_REPLACEMENT', 'SIBLING_EXECUTABLE'))))::INTEGER AS n FROM {CODED_SQL} c")
def structural_codes(spark, d):
    return _coded(spark, d).select("doc_id", corpus.structural_count(F.col("codes")).alias("n"))


@query("record_classify", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND list_contains(codes, 'RANK_MISMATCH') THEN 'analysis_failed' WHEN doc_id % 3 = 0 THEN 'analysis_failed' ELSE 'success' END AS status, CASE WHEN doc_id % 4 = 0 THEN 'not_cached' WHEN n_chars > 3000 THEN 'size_exceeded' WHEN doc_id % 5 = 0 THEN 'download_failed' END AS route FROM {CODED_SQL} c")
def record_classify(spark, d):
    c = F.col
    s = corpus.classify_record(F.when(c("doc_id") % 3 == 0, "failed").otherwise("ok"), c("codes"), F.lit("review"))
    r = corpus.route_record(c("doc_id") % 4 != 0, c("n_chars"), F.lit(3000), F.when(c("doc_id") % 5 == 0, "x"))
    return _coded(spark, d).select("doc_id", s.alias("status"), r.alias("route"))


@query("scan_hub", "SELECT o_orderkey AS repo_id FROM orders WHERE o_totalprice >= 50000 AND o_orderkey % 3 <> 0 AND o_custkey <= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def scan_hub(spark, d):
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("repo_id"), F.col("o_totalprice").alias("downloads"), (F.col("o_orderkey") % 3 != 0).alias("has_file"), F.col("o_custkey").alias("size_bytes"))
    return corpus.candidates(m, 50000, 1000, 100).select("repo_id")


@query("report_csv", f"SELECT doc_id, array_to_string(codes[1:3], ',') AS codes FROM {CODED_SQL} c")
def report_csv(spark, d):
    return corpus.flat_csv(_coded(spark, d).select("doc_id", "codes"), {"codes": 3})


FOUND = Input("events", ("user_id AS scan_id", "event_id", "CASE event_type WHEN 'click' THEN 'LOW' WHEN 'view' THEN 'MEDIUM' WHEN 'purchase' THEN 'HIGH' ELSE 'CRITICAL' END AS severity", "concat('RULE_', event_type) AS rule_id"))


@query("sort_severity", f"SELECT scan_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY array_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'], severity), event_id)::INTEGER AS place FROM {FOUND.sql} f) t WHERE place <= 15")
def sort_severity(spark, d):
    f = FOUND.df(spark, d)
    top = grouped.top_rows(f, ["scan_id"], [ids.severity_rank(F.col("severity")).asc(), F.asc("event_id")], 15)
    return top.select("scan_id", "event_id", F.col("rank").alias("place"))


@query("report_sarif", f"SELECT scan_id, rule_id, arg_min(CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END, event_id) AS level, replace(concat('Rule ', upper(left(rule_id[6:], 1)), rule_id[7:]), ' ', '') AS name FROM {FOUND.sql} f GROUP BY scan_id, rule_id")
def report_sarif(spark, d):
    level = F.create_map(*(F.lit(x) for kv in ids.SARIF_LEVEL.items() for x in kv))
    rows = FOUND.df(spark, d).select("scan_id", "rule_id", F.col("event_id").alias("ordinal"), level[F.col("severity")].alias("level"))
    return reports.sarif_rules(rows).select("scan_id", "rule_id", "level", "name")


METRICS_SQL = "(SELECT c_custkey AS n0, CASE c_custkey % 3 WHEN 0 THEN 'warm' WHEN 1 THEN 'cold' ELSE 'other' END AS scenario, c_custkey AS n, abs(c_acctbal) / 50 AS wall_s, abs(c_acctbal) / 40 AS per_min, abs(c_acctbal) / 12 AS mb_per_worker FROM customer)"


@query("dod_check", f"SELECT n0, concat_ws(',', CASE WHEN scenario = 'warm' AND n >= 1000 AND wall_s > 120 THEN 'wall' END, CASE WHEN scenario = 'cold' AND n >= 100 AND per_min < 100 THEN 'throughput' END, CASE WHEN mb_per_worker > 512 THEN 'memory' END) AS failures FROM {METRICS_SQL} m")
def dod_check(spark, d):
    k, b = F.col("c_custkey"), F.abs("c_acctbal")
    m = table(spark, d, "customer").select(k.alias("n0"), F.when(k % 3 == 0, "warm").when(k % 3 == 1, "cold").otherwise("other").alias("scenario"), k.alias("n"), (b / 50).alias("wall_s"), (b / 40).alias("per_min"), (b / 12).alias("mb_per_worker"))
    return corpus.acceptance(m).select("n0", F.array_join("failures", ",").alias("failures"))


@query("regression_gate", """
SELECT c_custkey AS n0, concat_ws(',', CASE WHEN b95 > 0 AND p95 > 2 * b95 THEN 'p95' END, CASE WHEN bpm > 0 AND per_min < 0.5 * bpm THEN 'throughput' END, CASE WHEN err > berr + 0.05 THEN 'errors' END) AS failures
FROM (SELECT c_custkey, c_nationkey % 5 AS s, abs(c_acctbal) AS p95, abs(c_acctbal) / 10 AS per_min, c_custkey % 100 / 400.0 AS err FROM customer) c
LEFT JOIN (SELECT s_nationkey % 4 AS s, arg_max(abs(s_acctbal), s_suppkey) AS b95, arg_max(abs(s_acctbal) / 8, s_suppkey) AS bpm, arg_max(s_suppkey % 50 / 400.0, s_suppkey) AS berr FROM supplier GROUP BY 1) b USING (s)""")
def regression_gate(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    cur = c.select(F.col("c_custkey").alias("n0"), (F.col("c_nationkey") % 5).cast("string").alias("scenario"), F.abs("c_acctbal").alias("p95"), (F.abs("c_acctbal") / 10).alias("per_min"), (F.col("c_custkey") % 100 / F.lit(400.0)).alias("error_rate"))
    base = s.select((F.col("s_nationkey") % 4).cast("string").alias("scenario"), F.abs("s_acctbal").alias("p95"), (F.abs("s_acctbal") / 8).alias("per_min"), (F.col("s_suppkey") % 50 / F.lit(400.0)).alias("error_rate"), F.col("s_suppkey").alias("ordinal"))
    return corpus.regression_gate(cur, base).select("n0", F.array_join("failures", ",").alias("failures"))


@query("throughput", "SELECT o_custkey AS k, round(count(*) / (sum(o_totalprice) / 1000.0) * 60, 1) AS per_min FROM orders GROUP BY 1")
def throughput(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), (F.sum("o_totalprice") / F.lit(1000.0)).alias("s"))
    return o.select("k", corpus.throughput(F.col("n"), F.col("s")).alias("per_min"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS state, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    """The streaming operator on a table: the same expression serves both."""
    from ..streaming import ingest

    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("state"), "value")
    return ingest.state_windows(e, "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "state", "n", F.round("total", 4).alias("total"))


# numpy on executors
@query("spectrum", "SELECT label, round(sum(g * g), 4) AS s4, round(sum(CASE WHEN i = j THEN g END), 4) AS s2 FROM (SELECT a.label, a.p AS i, b.p AS j, sum(a.v * b.v) AS g FROM (SELECT label, vec_id, generate_subscripts(embedding, 1) AS p, unnest(embedding)::DOUBLE AS v FROM embeddings) a JOIN (SELECT label, vec_id, generate_subscripts(embedding, 1) AS p, unnest(embedding)::DOUBLE AS v FROM embeddings) b USING (label, vec_id) GROUP BY ALL) t GROUP BY label")
def spectrum(spark, d):
    """Singular values of each label's matrix, from factors A (the identity) and B (its vectors); checked by the traces of G and G squared."""
    found = lowrank.grams(table(spark, d, "embeddings"), "label", "embedding")

    def values_of(batches):
        for batch in batches:
            squares = [lowrank.singular_values(np.eye(n := math.isqrt(len(g))), np.reshape(g, (n, n))) ** 2 for g in batch["gram"]]
            yield pd.DataFrame({"label": batch["label"], "s2": [s.sum() for s in squares], "s4": [(s**2).sum() for s in squares]})

    kind = found.schema["label"].dataType.simpleString()
    out = found.mapInPandas(values_of, f"label {kind}, s2 double, s4 double")
    return out.select("label", F.round("s4", 4).alias("s4"), F.round("s2", 4).alias("s2"))


def _module_rows(key, pdf: pd.DataFrame) -> pd.DataFrame:
    v = np.array(pdf.sort_values("vec_id")["embedding"].tolist(), np.float32)
    out = []
    for block, (a, b) in enumerate(factors(v, 16)):
        b = np.ascontiguousarray(b.T)
        f = lowrank.features(lowrank.Update(a, b, 2.0))
        out.append({"label": key[0], "block": block, **f, "n_heads": len(lowrank.heads(a, np.repeat(b, 4, axis=0), 1.0, "q_proj") or [])})
    return pd.DataFrame(out)


@query("module_features")
def module_features(spark, d):
    """All twelve features of updates made of blocks of sixteen vectors of each label, and their heads; held against the explicit matrix in the tests."""
    rows = table(spark, d, "embeddings").select("label", "vec_id", "embedding")
    kind = rows.schema["label"].dataType.simpleString()
    return rows.groupBy("label").applyInPandas(_module_rows, f"label {kind}, block int, {', '.join(f'{f} double' for f in stats.ALL_FEATURES)}, n_heads long")


@query("ledoit_wolf")
def ledoit_wolf(spark, d):
    """Shrinkage of each label's vectors, and trace and condition of the shrunk covariance."""
    rows = table(spark, d, "embeddings").select("label", "vec_id", "embedding")

    def shrink(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values("vec_id")["embedding"].tolist(), float)
        cov, rho = profile.ledoit_wolf(x)
        return pd.DataFrame({"label": [key[0]], "shrinkage": [rho], "trace": [np.trace(cov)], "condition": [np.linalg.cond(cov)]})

    kind = rows.schema["label"].dataType.simpleString()
    return rows.groupBy("label").applyInPandas(shrink, f"label {kind}, shrinkage double, trace double, condition double")
