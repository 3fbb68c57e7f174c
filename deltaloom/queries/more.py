"""The smaller operators, each for itself."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import config, ids, names, stats
from ..operators import compare, corpus, evaluate, grouped, inventory, lowrank, profile, rules, state
from ..sources import documents, listing, tensorfile
from .common import ENTRIES_SQL, SCORED_SQL, Z_SQL, Input, factors, modules, of_updates, query, r6, scored, table, update_of
from .decisions import AUROC_SQL, CODED_SQL, EVENTS, LATEST_SQL, _coded, _events
from .vectors import COINS, ORDERS

SHAPES = Input("part", ("p_partkey AS n", "CAST(8 + p_partkey % 3 * 8 AS BIGINT) AS ra", "CAST(8 + p_partkey % 2 * 8 AS BIGINT) AS rb", "p_partkey % 11 = 0 AS flat", "p_partkey % 13 = 0 AS huge"))


@query("pair_problem", f"SELECT n, CASE WHEN flat THEN 'lora factors must be matrices' WHEN huge THEN CASE WHEN ra = 8 THEN 'rank out of range' ELSE 'rank out of range' END WHEN ra <> rb THEN 'rank of A and B differ' END AS problem FROM {SHAPES.sql} s")
def pair_problem(spark, d):
    big = F.lit(4096).cast("long")
    a = F.when(F.col("flat"), F.array("ra")).otherwise(F.array(F.when(F.col("huge"), big).otherwise(F.col("ra")), F.lit(64).cast("long")))
    b = F.array(F.lit(32).cast("long"), F.when(F.col("huge"), big).otherwise(F.col("rb")))
    return SHAPES.df(spark, d).select("n", inventory.pair_problem(a, b).alias("problem"))


@query("join_trend_lookup", "SELECT l_orderkey AS o, l_linenumber AS n, round((l_extendedprice - (100 + 1000 * l_quantity) - 5) / (s_suppkey % 4), 6) AS z FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 4 > 0")
def join_trend_lookup(spark, d):
    """Trends by supplier; those without a scale are left out."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("module"), F.lit("f").alias("feature"), F.lit(100.0).alias("c0"), F.lit(1000.0).alias("c1"), F.lit(0.0).alias("c2"), F.lit(5.0).alias("resid_med"), (F.col("s_suppkey") % 4).cast("double").alias("resid_scale"))
    v = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("module"), F.lit("f").alias("feature"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").cast("double").alias("rel_depth"), F.lit(0.0).alias("log_rank"))
    return profile.residual_z(v, s).select("o", "n", r6("z").alias("z"))


@query("join_finding_location", Z_SQL + "SELECT m.vec_id, e.label, round(max_abs_z, 6) AS z FROM m JOIN embeddings e USING (vec_id) WHERE max_abs_z > 2.5")
def join_finding_location(spark, d):
    per = compare.module_z(compare.family_z(modules(spark, d))).select(F.col("base").cast("long").alias("vec_id"), "max_abs_z")
    return per.where("max_abs_z > 2.5").join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id").select("vec_id", "label", r6("max_abs_z").alias("z"))


@query("module_max_abs_z", Z_SQL + "SELECT family, count(*) AS n, round(max(max_abs_z), 6) AS largest, count(*) FILTER (WHERE max_abs_z > 2) AS n_outliers FROM m GROUP BY family")
def module_max_abs_z(spark, d):
    per = compare.module_z(compare.family_z(modules(spark, d)))
    return per.groupBy("family").agg(F.count("*").alias("n"), r6(F.max("max_abs_z")).alias("largest"), F.count_if(F.col("max_abs_z") > 2).alias("n_outliers"))


@query("max_concentration_z", Z_SQL + "SELECT family, round(max(CASE WHEN nc = 3 THEN cz END), 6) AS z FROM m GROUP BY family")
def max_concentration_z(spark, d):
    per = compare.module_z(compare.family_z(modules(spark, d)))
    return per.groupBy("family").agg(r6(F.max("concentration_z")).alias("z"))


@query("topk_conc_findings", Z_SQL + ", e AS (SELECT vec_id, label, max(n) OVER (PARTITION BY label) AS depth, n - 1 AS layer FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) t) SELECT vec_id, round(cz, 6) AS z, (e.layer < 3 OR e.layer >= depth - 2) AS edge FROM m JOIN e USING (vec_id) WHERE nc = 3 AND cz >= 1.0 ORDER BY cz DESC, vec_id LIMIT 10")
def topk_conc_findings(spark, d):
    m = modules(spark, d)
    per = compare.module_z(compare.family_z(m))
    depth = m.select("base", grouped.depth("layer", ["path", "module"]).alias("depth"))
    found = per.where("concentration_z >= 1.0").join(depth, "base").withColumn("vec_id", F.col("base").cast("long"))
    return found.orderBy(F.desc("concentration_z"), "vec_id").limit(10).select("vec_id", r6("concentration_z").alias("z"), stats.is_edge_layer(F.col("layer"), F.col("depth")).alias("edge"))


@query("log_rms", "SELECT vec_id, round(ln(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) / sqrt(8.0 * 8)), 6) AS log_rms FROM embeddings")
def log_rms(spark, d):
    norm = F.sqrt(stats.total(F.col("embedding"), lambda v: v * v))
    return table(spark, d, "embeddings").select("vec_id", r6(stats.log_rms(norm, F.lit(8), F.lit(8))).alias("log_rms"))


@query("significant_sigma", "SELECT vec_id, len(list_filter(embedding, lambda v: v >= 0.001 * list_max(embedding)))::BIGINT AS n, round(ln(list_max(embedding)::DOUBLE), 6) AS log_sigma1 FROM embeddings")
def significant_sigma(spark, d):
    s = F.sort_array(F.col("embedding").cast("array<double>"), asc=False)
    e = table(spark, d, "embeddings").select("vec_id", s.alias("s"))
    return e.select("vec_id", F.size(stats.significant(F.col("s"))).cast("long").alias("n"), r6(stats.log(F.get("s", F.lit(0)))).alias("log_sigma1"))


@query("delta_inner", f"SELECT x.vec_id AS a, round(sum(x.w * y.w), 6) AS inner_product FROM {ENTRIES_SQL} x JOIN {ENTRIES_SQL} y ON y.vec_id = x.vec_id + 1 AND x.i = y.i AND x.j = y.j GROUP BY ALL")
def delta_inner(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return of_updates(e.join(b, "vec_id"), ["vec_id", "other"], "a long, inner_product double", lambda r, u: [(r.vec_id, u.inner(update_of(r.other)))]).select("a", r6("inner_product").alias("inner_product"))


@query("win_rank_gini", f"SELECT g, k, row_number() OVER (PARTITION BY g ORDER BY v, k)::INTEGER AS i FROM {COINS.sql} c")
def win_rank_gini(spark, d):
    return grouped.ranked(COINS.df(spark, d), ["g"], ["v", "k"], "i").select("g", "k", "i")


@query("win_first_per_key", f"SELECT g, min(k) AS k FROM {ORDERS.sql} o GROUP BY g")
def win_first_per_key(spark, d):
    return listing.first_per_key(ORDERS.df(spark, d), "g", "k").select("g", "k")


@query("win_edge_depth", "SELECT p_partkey AS n, max(p_size) OVER (PARTITION BY p_brand) + 1 AS depth FROM part")
def win_edge_depth(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("n"), grouped.depth("p_size", ["p_brand"]).alias("depth"))


@query("win_offsets_contiguous", "SELECT o_custkey AS f, count(*) FILTER (WHERE gap) AS n_gaps FROM (SELECT o_custkey, o_orderkey <> lag(o_orderkey, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS gap FROM orders) t GROUP BY o_custkey")
def win_offsets(spark, d):
    o = table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") - 1).alias("s"), F.col("o_orderkey").alias("e"))
    return o.withColumn("gap", grouped.apart("s", "e", ["o_custkey"])).groupBy(F.col("o_custkey").alias("f")).agg(F.count_if("gap").alias("n_gaps"))


@query("topk_tokens", "SELECT label, pos, r AS rank FROM (SELECT label, pos, row_number() OVER (PARTITION BY label ORDER BY e DESC, pos DESC)::INTEGER AS r FROM (SELECT label, pos, sum(v * v) AS e FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) t GROUP BY ALL) u) w WHERE r <= 10")
def topk_tokens(spark, d):
    """Of equal energies the later place comes first."""
    e = table(spark, d, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v")).groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.sum(F.col("v") * F.col("v")).alias("e"))
    return grouped.top_rows(e, ["label"], [F.desc("e"), F.desc("pos")], 10).select("label", "pos", "rank")


@query("token_delta_concentration", "SELECT label, round((sqrt(count(*)) - sum(n) / sqrt(sum(n * n))) / (sqrt(count(*)) - 1), 6) AS hoyer, count(*) AS n_tokens FROM (SELECT label, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS n FROM embeddings) t GROUP BY label")
def token_delta(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.sqrt(stats.total(F.col("embedding"), lambda v: v * v)).alias("n"))
    h = grouped.hoyer(rows, ["label"], "n")
    return h.join(rows.groupBy("label").agg(F.count("*").alias("n_tokens")), "label").select("label", r6("hoyer").alias("hoyer"), "n_tokens")


@query("scan_status", "SELECT p_partkey AS n, CASE WHEN p_size % 3 = 0 THEN 'ok' WHEN p_size % 5 = 0 THEN 'failed' ELSE 'degraded' END AS status FROM part")
def scan_status(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("n"), rules.status(F.col("p_size") % 5, F.col("p_size") % 3).alias("status"))


@query("evaluate", f"SELECT count(*) AS n, round((SELECT auroc FROM {AUROC_SQL.format(k='', w='', c='', t=SCORED_SQL, g='')} a), 6) AS auroc, round((SELECT sum(ap0) FROM (SELECT sum(pos * tp / seen::DOUBLE) / sum(pos) AS ap0 FROM (SELECT score, pos, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS seen FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM {SCORED_SQL} s GROUP BY ALL) a WINDOW w AS (ORDER BY score DESC)) b) c), 6) AS avg_precision FROM {SCORED_SQL} s")
def evaluate_all(spark, d):
    out = evaluate.evaluate(scored(spark, d).withColumn("cohort", F.lit("all")), ["cohort"])
    return out.select("n", r6("auroc").alias("auroc"), r6("avg_precision").alias("avg_precision"))


@query("esr_score", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('adapter-', doc_id) ELSE source END AS adapter_id, CASE WHEN doc_id % 2 = 1 THEN lang END AS attack, CASE WHEN doc_id % 5 <> 0 THEN n_chars::DOUBLE END AS score FROM documents")
def esr_score(spark, d):
    """Scored rows of result documents; those without a reference have no score."""
    c = F.col
    ref = F.when(c("doc_id") % 5 != 0, F.struct(c("n_chars").cast("double").alias("distance"), F.lit(0.5).alias("p_value"), F.lit(0.01).alias("alpha_block"), F.lit(0.05).alias("alpha_review")))
    r = table(spark, d, "documents").select("doc_id", F.struct(F.when(c("doc_id") % 3 != 0, c("source")).alias("logical_id")).alias("artifact"), F.struct(ref.alias("reference")).alias("anomaly"), (c("doc_id") % 2).cast("int").alias("label"), c("lang").alias("attack"), c("doc_id").alias("ordinal"))
    return evaluate.scored(r, ("doc_id",)).select("doc_id", "adapter_id", "attack", "score")


@query("state_machine", f"SELECT a.state AS before, b.state AS after, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ts, event_id) AS i FROM {EVENTS.sql} e) a JOIN (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ts, event_id) AS i FROM {EVENTS.sql} e) b ON a.request_id = b.request_id AND b.i = a.i + 1 GROUP BY ALL")
def state_machine(spark, d):
    """Transitions between states."""
    return state.transitions(_events(spark, d), order=("ts", "event_id"))


@query("state_cache_integrity", "SELECT doc_id, sha256(text) = sha256(CASE WHEN doc_id % 5 = 0 THEN concat(text, ' ') ELSE text END) AS intact FROM documents")
def cache_integrity(spark, d):
    stored = state.payload_hash(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    return table(spark, d, "documents").select("doc_id", state.intact(F.col("text"), stored).alias("intact"))


@query("state_hit_count", f"SELECT request_id, count(*) AS hits, max(event_id) AS last FROM {EVENTS.sql} e WHERE state = 'persisted' GROUP BY request_id")
def hit_count(spark, d):
    return state.hit_counts(_events(spark, d).where("state = 'persisted'"), ["request_id"], "event_id")


@query("sink_dispatch", f"SELECT CASE WHEN state = 'failed' THEN 'failed' WHEN retry_count = 0 THEN 'cached_hit' ELSE 'persisted' END AS sink, count(*) AS n FROM {LATEST_SQL} l GROUP BY 1")
def sink_dispatch(spark, d):
    last = state.latest(_events(spark, d), order=("ts", "event_id"))
    return last.groupBy(state.outcome(F.col("state"), F.col("retry_count") == 0).alias("sink")).agg(F.count("*").alias("n"))


@query("sink_cache", "SELECT DISTINCT 'sha256:' || sha256(text) AS content_hash, lang AS config_hash FROM documents WHERE doc_id % 7 <> 0")
def sink_cache(spark, d):
    """What is stored of results: failed ones are not, equal ones once."""
    r = table(spark, d, "documents").select(ids.hashed(F.col("text")).alias("content_hash"), F.col("lang").alias("config_hash"), F.when(F.col("doc_id") % 7 == 0, "failed").otherwise("ok").alias("status"), F.col("lang").alias("payload"))
    return state.cache_rows(r, F.current_timestamp(), "2").select("content_hash", "config_hash")


@query("record_route", "SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'not_cached' WHEN o_totalprice > 200000 THEN 'size_exceeded' WHEN o_orderkey % 9 = 0 THEN 'download_failed' END AS route FROM orders")
def record_route(spark, d):
    c = F.col
    return table(spark, d, "orders").select(c("o_orderkey").alias("k"), corpus.route_record(c("o_orderstatus") != "F", c("o_totalprice"), F.lit(200000), F.when(c("o_orderkey") % 9 == 0, "x")).alias("route"))


@query("record_flatten", f"SELECT doc_id, array_to_string(codes[1:5], ',') AS titles, len(codes)::INTEGER AS n FROM {CODED_SQL} c")
def record_flatten(spark, d):
    c = _coded(spark, d)
    return c.select("doc_id", F.array_join(corpus.first_of(F.col("codes"), corpus.TOP_FINDINGS), ",").alias("titles"), F.size("codes").alias("n"))


@query("report_text", "SELECT scan_id, string_agg(severity, ',' ORDER BY array_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'], severity), event_id) AS severities FROM (SELECT user_id AS scan_id, event_id, CASE event_type WHEN 'click' THEN 'LOW' WHEN 'view' THEN 'MEDIUM' WHEN 'purchase' THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM events) t GROUP BY scan_id")
def report_text(spark, d):
    """The order in which a report lists findings."""
    from ..sinks import reports

    e = table(spark, d, "events")
    sev = F.when(F.col("event_type") == "click", "LOW").when(F.col("event_type") == "view", "MEDIUM").when(F.col("event_type") == "purchase", "HIGH").otherwise("CRITICAL")
    f = e.groupBy(F.col("user_id").alias("scan_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", sev.alias("severity")))), lambda x: x).alias("f"))
    return f.select("scan_id", F.array_join(F.transform(reports.by_severity(F.col("f")), lambda x: x["severity"]), ",").alias("severities"))


@query("rules_combined", "SELECT doc_id, doc_id % 3 <> 0 AS behavioural_stage, CASE doc_id % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'review' ELSE 'block' END AS final_action FROM documents")
def rules_combined(spark, d):
    k = F.col("doc_id") % 3
    r = table(spark, d, "documents").select("doc_id", F.struct(F.col("doc_id").cast("string").alias("scan_id")).alias("scan"), F.struct((k != 0).alias("m2_recommended"), F.when(k == 0, "allow").when(k == 1, "review").otherwise("block").alias("action")).alias("verdict"))
    return rules.combined(r).select("doc_id", F.col("policy_gate.behavioural_stage").alias("behavioural_stage"), "final_action")


@query("rules_failure", "SELECT doc_id, CASE WHEN n_chars % 4 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN n_chars % 4 = 0 THEN 'review' ELSE 'allow' END AS action FROM documents")
def rules_failure(spark, d):
    """A file that can't be parsed is reviewed, whatever else is known of it; one without a finding is allowed."""
    c = F.lit
    failed = F.col("n_chars") % 4 == 0
    none = F.array().cast("array<string>")
    ref = c(None).cast("struct<p_value:double,alpha_review:double,alpha_block:double,n_reference:int>")
    v = rules.verdict({"status": F.when(failed, "failed").otherwise("ok"), "policy": c("default"), "intra": c(None).cast("struct<max_concentration_z:double>"), "reference": ref, "red_flags": none, "metadata_present": c(True), "limits": none, "n_not": c(0), "top_edge": c(False), "failure_code": F.when(failed, "PARSE_FAILED"), "failure_message": F.when(failed, "x")})
    return table(spark, d, "documents").select("doc_id", F.when(failed, "failed").otherwise("ok").alias("status"), v["action"].alias("action"))


@query("scan_config", "SELECT d.doc_id, p.url AS config FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id")
def scan_config(spark, d):
    """Configurations beside files: a left join, so that files without one stay."""
    files, found = table(spark, d, "documents").select("doc_id"), table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("config"))
    return files.join(found, "doc_id", "left").select("doc_id", "config")


@query("scan_eval_manifest", "SELECT c_custkey AS scan_path, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def scan_eval_manifest(spark, d):
    m = table(spark, d, "customer").select(F.col("c_custkey").alias("scan_path"))
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("path"), "o_orderkey")
    return documents.eval_rows(m, r).groupBy("scan_path").agg(F.count("o_orderkey").alias("n"))


@query("coerce_config_values", "SELECT p_partkey AS n, CASE p_partkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'a,b' WHEN 2 THEN '' ELSE 'b' END AS modules, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END::INTEGER AS n_patterns FROM part")
def coerce(spark, d):
    t = F.concat(F.lit('{"target_modules": '), F.when(F.col("n") % 4 == 0, '"a"').when(F.col("n") % 4 == 1, '["a", 1, "b", null]').when(F.col("n") % 4 == 2, "{}").otherwise('["b", true]'), F.lit(', "alpha_pattern": '), F.when(F.col("n") % 3 == 0, '{"x": 2, "y": -1, "z": true}').when(F.col("n") % 3 == 1, "[1]").otherwise("{}"), F.lit("}"))
    c = table(spark, d, "part").select(F.col("p_partkey").alias("n")).select("n", config.parse(t).alias("c"))
    return c.select("n", F.array_join("c.target_modules", ",").alias("modules"), F.size("c.alpha_pattern").alias("n_patterns"))


@query("family_match", "SELECT p_partkey AS n, contains(lower(coalesce(CASE WHEN p_partkey % 5 <> 0 THEN p_name END, '')), lower('A')) AS matches FROM part")
def family_match(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("n"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("base"))
    return p.select("n", profile.profile_of(F.col("base"), ["A"]).isNotNull().alias("matches"))


@query("from_dict_tolerant", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def tolerant(spark, d):
    """Unknown fields are dropped, missing ones are null."""
    return table(spark, d, "events").select("event_id", documents.tolerant("props", "k int, other string")["k"].alias("k"))


@query("eval_format", "SELECT o_orderkey AS k, CASE WHEN o_totalprice = o_custkey * 100 THEN '=' WHEN o_totalprice < o_custkey * 100 THEN '+' ELSE '-' END AS marker FROM orders")
def eval_format(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), corpus.change_marker(F.col("o_totalprice"), F.col("o_custkey") * 100, False).alias("marker"))


@query("error_factories", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'malformed' WHEN 1 THEN 'unsupported' ELSE 'degraded' END AS category, CASE event_id % 3 WHEN 2 THEN 'degraded' ELSE 'fatal' END AS severity FROM events")
def error_factories(spark, d):
    k = F.col("event_id") % 3
    cat = F.when(k == 0, "malformed").when(k == 1, "unsupported").otherwise("degraded")
    return table(spark, d, "events").select("event_id", cat.alias("category"), ids.error_severity(F.lit("OTHER"), cat).alias("severity"))


@query("report_aggregate", "SELECT 'lang' AS part, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def report_aggregate(spark, d):
    docs = table(spark, d, "documents")
    one = lambda c: grouped.value_counts(docs, c).select(F.lit(c).alias("part"), "value", "n")
    return one("lang").unionByName(one("source"))


@query("sliding_windows", "SELECT w AS start, event_type AS state, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) t GROUP BY ALL")
def sliding_windows(spark, d):
    from ..streaming import ingest

    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("state"), "value")
    return ingest.state_windows(e, "2 hours", slide="1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "state", "n")


@query("sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events) t) u GROUP BY user_id, s")
def sessions(spark, d):
    from ..streaming import ingest

    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return ingest.sessions(e, "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("head_features")
def head_features(spark, d):
    """Features of each head of projections made of blocks of eight vectors of each label."""
    rows = table(spark, d, "embeddings").select("label", "vec_id", "embedding")

    def heads(key, pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.array(pdf.sort_values("vec_id")["embedding"].tolist(), np.float32)
        found = [{"label": key[0], "block": k, **h} for k, (a, b) in enumerate(factors(v, 8)) for h in lowrank.heads(a, np.tile(b.T, (4, 1)), 1.0, "q_proj") or []]
        return pd.DataFrame(found, columns=["label", "block", "head", *stats.ALL_FEATURES])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.groupBy("label").applyInPandas(heads, f"label {kind}, block int, head int, {', '.join(f'{f} double' for f in stats.ALL_FEATURES)}")


@query("scan_load_bf16", "SELECT vec_id, list_sum(list_transform(embedding, lambda v: floor(v::DOUBLE * 256))) AS total, list_sum(list_transform(range(1, 65), lambda i: i * floor(embedding[i]::DOUBLE * 256))) AS placed FROM embeddings")
def bf16(spark, d):
    """Whole numbers of eight bits, which 16 bits hold exactly, encoded and decoded: their sum, and their sum by place."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")

    def cut(batches):
        for b in batches:
            x = [np.floor(np.asarray(v, np.float64) * 256).astype(np.float32) for v in b["embedding"]]
            back = [tensorfile.decode((v.view(np.uint32) >> 16).astype("<u2").tobytes(), "BF16", list(v.shape)).astype(float) for v in x]
            yield pd.DataFrame({"vec_id": b["vec_id"], "total": [v.sum() for v in back], "placed": [(v * np.arange(1, len(v) + 1)).sum() for v in back]})

    return rows.mapInPandas(cut, "vec_id long, total double, placed double")


@query("normalise_peft_type", "SELECT p_partkey AS n, nullif(replace(upper(trim(p_name)), '-', '_'), '') AS t FROM part")
def normal_type(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("n"), names.normal_type(F.col("p_name")).alias("t"))
