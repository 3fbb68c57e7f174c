"""The decision layer: findings, status, verdict and confidence as expressions over one row for each file.

A finding is a struct (rule_id, severity, title, message, evidence JSON, locations, remediation). Whatever fails leads to review, never to
allow: a row with an error, an unreadable file or no pairs comes out as failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids, names, stats
from .profile import REFERENCE_CAN_BLOCK

# Fixed values.
LISTED, SHOWN, TOP = 50, 20, 10
HOYER_REPORTED = 0.6
OUTLIERS_LISTED = 5
LEVELS = ["LOW", "MEDIUM", "HIGH"]
LOCATION = "struct<layer:int,module:string,head:int,expert:int,tensor_key:string>"
FINDING = f"struct<rule_id:string,severity:string,title:string,message:string,evidence:string,locations:array<{LOCATION}>,remediation:string>"
REASON = "struct<code:string,severity:string,message:string>"


def location(layer=None, module=None, expert=None, key=None) -> Column:
    none = lambda t: F.lit(None).cast(t)
    return F.struct((none("int") if layer is None else layer).alias("layer"), (none("string") if module is None else module).alias("module"), none("int").alias("head"), (none("int") if expert is None else expert).alias("expert"), (none("string") if key is None else key).alias("tensor_key"))


def finding(rule: str, severity: str, title, message, evidence: Column | None = None, locations: Column | None = None, remediation: str | None = None) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), text(title).alias("title"), text(message).alias("message"),
        (F.lit("{}") if evidence is None else F.to_json(evidence)).alias("evidence"),
        (F.array() if locations is None else locations).cast(f"array<{LOCATION}>").alias("locations"), F.lit(remediation).cast("string").alias("remediation")).cast(FINDING)


def unexpected(found: Column, declared: Column) -> Column:
    """Modules that are there but not declared, in order."""
    return F.array_sort(F.array_except(found, declared))


def all_saved(full: Column, declared: Column) -> Column:
    """Modules that are stored whole: those found and those declared, in order."""
    return F.array_sort(F.array_union(full, declared))


def ranks_differ(ranks: Column, declared: Column) -> Column:
    """Whether the ranks found, in order and each once, are anything but the declared one."""
    return ranks != F.array(declared)


def structural(row: dict[str, Column]) -> tuple[Column, Column, Column]:
    """findings, red flags and limits from: config, problems, siblings, full (array<struct<key,shape,location>>), routers (of pairs' locations with keys),
    ranks, has_dora, unresolved, modules (actual), token_keys."""
    cfg = row["config"]
    replaced = F.filter(row["full"], lambda w: w["location"]["kind"].isin("lm_head", "embedding", "router"))
    other = F.filter(row["full"], lambda w: ~w["location"]["kind"].isin("lm_head", "embedding", "router"))
    keys = lambda a: F.slice(F.transform(a, lambda w: w["key"]), 1, SHOWN)
    places = lambda a: F.slice(F.transform(a, lambda w: location(w["location"]["layer"], w["location"]["module"], w["location"]["expert"], w["key"])), 1, SHOWN)
    declared = cfg["r"]
    mismatch = declared.isNotNull() & (F.size(cfg["rank_pattern"]) == 0) & (F.size(row["ranks"]) > 0) & ranks_differ(row["ranks"], declared)
    extra = unexpected(row["modules"], cfg["target_modules"])
    unmatched = cfg.isNotNull() & (F.size(cfg["target_modules"]) > 0) & (F.size(extra) > 0) & ~F.array_contains(cfg["target_modules"], "all-linear")
    dora = row["has_dora"] | F.coalesce(cfg["use_dora"], F.lit(False))
    listed = lambda a: F.array_join(a, ", ")
    rules = [
        (F.size(replaced) > 0, finding("FULL_WEIGHT_REPLACEMENT", "MEDIUM", "A whole output, embedding or router matrix is replaced", F.concat(F.lit("Full matrices for "), listed(F.array_sort(F.array_distinct(F.transform(replaced, lambda w: w["location"]["module"]))))), F.struct(keys(replaced).alias("tensors"), F.slice(F.transform(replaced, lambda w: w["shape"]), 1, SHOWN).alias("shapes")), places(replaced), "Ask why the matrix is shipped; check the behaviour.")),
        (F.size(other) > 0, finding("FULL_WEIGHT_NOT_ANALYSED", "LOW", "Full weight matrices are not analysed", F.concat(F.size(other).cast("string"), F.lit(" full matrices")), F.struct(keys(other).alias("tensors")))),
        (F.size(row["routers"]) > 0, finding("ROUTER_ADAPTED", "MEDIUM", "The router of a mixture of experts is adapted", "A changed router can send chosen inputs to a chosen expert", None, places(row["routers"]), "Confirm the intent; check the behaviour.")),
        (mismatch, finding("RANK_MISMATCH", "MEDIUM", "Ranks differ from the declared one", F.concat(F.lit("declared "), declared.cast("string"), F.lit(", found "), listed(F.transform(row["ranks"], lambda r: r.cast("string")))), F.struct(declared.alias("declared_r"), row["ranks"].alias("actual_ranks")))),
        (F.size(row["siblings"]) > 0, finding("SIBLING_EXECUTABLE", "MEDIUM", "Code, pickles or archives stand beside the adapter", listed(F.slice(F.transform(row["siblings"], lambda s: s["name"]), 1, TOP)), F.struct(F.slice(row["siblings"], 1, LISTED).alias("files")), None, "Do not load them.")),
        (dora, finding("DORA_PARTIAL_ANALYSIS", "LOW", "DoRA is analysed in part", "Only the low-rank part is analysed without the base model")),
        (row["unresolved"], finding("UNRESOLVED_SCALE_PATTERN", "LOW", "A scale pattern is not resolved", "Patterns that aren't literal are never run; the default scale was used")),
        (F.size(row["problems"]) > 0, finding("CONFIG_FIELDS_IGNORED", "LOW", "Fields of the configuration were ignored", F.array_join(F.slice(row["problems"], 1, TOP), "; "))),
        (unmatched, finding("TARGET_MODULES_MISMATCH", "LOW", "Modules differ from target_modules", listed(extra), F.struct(F.array_sort(cfg["target_modules"]).alias("declared"), extra.alias("unexpected")))),
        (F.size(row["token_keys"]) > 0, finding("TRAINABLE_TOKENS", "LOW", "Single token embeddings are changed", "Token deltas are present", F.struct(F.slice(row["token_keys"], 1, SHOWN).alias("tensors")))),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), f) for c, f in rules)))
    flags = F.array_compact(F.array(*(F.when(F.coalesce(rules[i][0], F.lit(False)), F.lit(code)) for i, code in ((0, "FULL_WEIGHT_REPLACEMENT"), (2, "ROUTER_ADAPTED"), (3, "RANK_MISMATCH"), (4, "SIBLING_EXECUTABLE")))))
    limits = F.array_compact(F.array(
        F.when(F.coalesce(dora, F.lit(False)), F.lit("DoRA: the effective update depends on the base weights")),
        F.when(row["unresolved"], F.lit("patterns with regular expressions not resolved; default scale used")),
        F.when(cfg.isNull(), F.lit("no adapter_config.json: scale assumed alpha = r")),
        F.when(names.is_decomposition(cfg["init_lora_weights"]), F.concat(cfg["init_lora_weights"], F.lit(" init; profiles are calibrated on the default")))))
    return found, flags, limits


def concentration_findings(per_module: DataFrame, depth: DataFrame) -> DataFrame:
    """path, findings of modules over the concentration threshold (10 at most), edge of the first; with the outliers among the five largest |z| that are not among them."""
    placed = per_module.join(depth, ["path", "base"], "left").withColumn("edge", stats.is_edge_layer(F.col("layer"), F.col("n_layers")))
    w = W.partitionBy("path")
    over = F.coalesce(F.col("concentration_z") >= stats.CONCENTRATION_Z, F.lit(False))
    ranked = placed.withColumns({"over": over, "rc": F.row_number().over(w.orderBy(F.desc(F.when(over, F.col("concentration_z"))), "base")), "rm": F.row_number().over(w.orderBy(F.desc("max_abs_z"), "base"))})
    spike = finding("INTRA_CONCENTRATION_SPIKE", "MEDIUM", "An update is concentrated on a few outputs, unlike its family", F.format_string("%s in layer %s: concentration z = %.1f", F.split("base", "[.]")[F.size(F.split("base", "[.]")) - 1], F.coalesce(F.col("layer").cast("string"), F.lit("-")), F.col("concentration_z")), F.struct(F.round("concentration_z", 3).alias("concentration_z"), F.col("edge").alias("edge_layer"), *(F.round(F.try_element_at("z", F.lit(f)), 3).alias(f"z_{f}") for f in stats.CONCENTRATION)), F.array(location(F.col("layer"), F.col("module"), F.col("expert"), F.col("b_key"))), "Check the behaviour of this adapter.")
    outlier = finding("INTRA_OUTLIER", "LOW", "A module differs from its family in one feature", F.format_string("%s: %s robust z = %.1f", F.col("module"), F.col("top_feature"), F.col("top_z")), F.struct(F.col("top_feature").alias("feature"), F.round("top_z", 3).alias("z")), F.array(location(F.col("layer"), F.col("module"), F.col("expert"), F.col("b_key"))))
    is_spike, is_outlier = F.col("over") & (F.col("rc") <= TOP), ~F.col("over") & (F.col("rm") <= OUTLIERS_LISTED) & (F.col("max_abs_z") > stats.OUTLIER_Z)
    rows = ranked.where(is_spike | is_outlier).select("path", F.when(is_spike, F.col("rc")).otherwise(100 + F.col("rm")).alias("o"), F.when(is_spike, spike).otherwise(outlier).alias("f"), F.when(is_spike & (F.col("rc") == 1), F.col("edge")).alias("edge"))
    return rows.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "f"))), lambda s: s["f"]).alias("intra_findings"), F.coalesce(F.bool_or("edge"), F.lit(False)).alias("top_edge"))


def vector_findings(rows: DataFrame, rule: str) -> DataFrame:
    """path, findings of concentrated DoRA magnitudes or token deltas: the ten most concentrated."""
    w = W.partitionBy("path").orderBy(F.desc("hoyer"), "key")
    top = rows.where(F.col("hoyer") >= HOYER_REPORTED).withColumn("o", F.row_number().over(w)).where(F.col("o") <= TOP)
    base = names.base(F.col("key"))
    title = "Magnitudes concentrated on a few channels" if rule == "DORA_MAGNITUDE" else "A delta concentrated on a few tokens"
    shares = F.transform("top_shares", lambda s: F.round(s, 4))
    ids_name = "top_channels" if rule == "DORA_MAGNITUDE" else "top_token_rows"
    f = finding(rule, "LOW", title, F.format_string("%s: Hoyer %.2f; information only", names.module_name(base), F.col("hoyer")), F.struct(F.round("hoyer", 3).alias("hoyer"), F.col("top_ids").alias(ids_name), shares.alias("top_shares")), F.array(location(names.layer(base), names.module_name(base), None, F.col("key"))))
    return top.select("path", "o", f.alias("f")).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "f"))), lambda s: s["f"]).alias("found"))


def status(n_ok: Column, n_not: Column) -> Column:
    return F.when(n_not == 0, "ok").when(n_ok == 0, "failed").otherwise("degraded")


def reason(code, severity: str, message) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(text(code).alias("code"), F.lit(severity).alias("severity"), text(message).alias("message")).cast(REASON)


def verdict(row: dict[str, Column], can_block: bool = REFERENCE_CAN_BLOCK) -> Column:
    """struct(action, level, reasons, m2_recommended, confidence) from: status, policy, intra, reference, red_flags, metadata_present, limits, n_not, top_edge, failure_code, failure_message."""
    s, ref, intra, flags = row["status"], row["reference"], row["intra"], row["red_flags"]
    p = ref["p_value"]
    blocks = F.coalesce(F.lit(can_block) & (p <= ref["alpha_block"]), F.lit(False))
    reviews = F.coalesce(p <= ref["alpha_review"], F.lit(False)) & ~blocks
    spikes = F.coalesce(intra["max_concentration_z"] >= stats.CONCENTRATION_Z, F.lit(False))
    strict = (row["policy"] == "strict") & (F.size(flags) > 0)
    against = F.format_string("p = %.4g against %d benign adapters", p, ref["n_reference"].cast("long"))
    singles = [
        F.when(s == "failed", reason(row["failure_code"], "MEDIUM", row["failure_message"])).when(s == "degraded", reason("DEGRADED_PARSE", "MEDIUM", F.concat(row["n_not"].cast("string"), F.lit(" tensors not analysed")))),
        F.when(blocks, reason("REFERENCE_P_BELOW_ALPHA", "HIGH", against)).when(reviews, reason("REFERENCE_P_BELOW_ALPHA", "MEDIUM", against)).when(ref.isNull() & (s != "failed"), reason("NO_REFERENCE_PROFILE", "LOW", "No calibrated reference for this model family")),
        F.when(spikes, reason("INTRA_OUTLIER", "MEDIUM", F.concat(F.format_string("concentration z = %.1f", intra["max_concentration_z"]), F.when(row["top_edge"], F.lit("; a first or last layer, where this is common")).otherwise(F.lit(""))))),
    ]
    reasons = F.concat(
        F.array_compact(F.array(*singles)), F.transform(flags, lambda c: reason(c, "MEDIUM", "Structural red flag")),
        F.array_compact(F.array(F.when(strict, reason("STRICT_POLICY_STRUCTURAL", "HIGH", F.concat(F.lit("Strict policy: "), F.array_join(flags, ", ")))), F.when(~row["metadata_present"], reason("MISSING_METADATA", "LOW", "No metadata; provenance unknown")))))
    rank = F.when(blocks | strict, 2).when((s != "ok") | reviews | spikes | (F.size(flags) > 0), 1).otherwise(0)
    action = ids.action_of(rank)
    level = F.when((rank == 2) & F.coalesce(p <= ref["alpha_block"] / 10, F.lit(False)), "CRITICAL").otherwise(F.element_at(F.array(*map(F.lit, LEVELS)), rank + 1))
    limits = F.concat(row["limits"], F.array_compact(F.array(
        F.when(ref.isNull(), F.lit("no reference profile for this model family")),
        F.when(intra.isNotNull(), F.lit("intra-adapter thresholds are not yet calibrated")).when(s != "failed", F.lit("too few modules per family for intra-adapter comparison")),
        F.when(row["n_not"] > 0, F.concat(row["n_not"].cast("string"), F.lit(" tensors not analysed"))))))
    return F.struct(action.alias("action"), level.alias("level"), reasons.alias("reasons"), ((rank > 0) | ~row["metadata_present"]).alias("m2_recommended"), F.struct(confidence(s, ref.isNotNull(), F.size(row["limits"]) > 0, intra.isNotNull()).alias("level"), limits.alias("limiting_factors")).alias("confidence"))


def confidence(status_: Column, has_reference: Column, has_limits: Column, has_intra: Column) -> Column:
    return F.when(status_ != "ok", "low").when(~has_reference | has_limits, F.when(has_intra, "medium").otherwise("low")).otherwise("high")


def scaling(config: Column) -> Column:
    return F.when(config.isNull(), "unknown").when((F.size(config["rank_pattern"]) > 0) | (F.size(config["alpha_pattern"]) > 0), "pattern").when(config["use_rslora"], "rslora").otherwise("alpha_over_r")


def training_state(n_ok: Column, n_zero: Column) -> Column:
    return F.when((n_ok > 0) & (n_zero == n_ok), "init_only").when(n_zero > 0, "partial").when(n_ok > 0, "trained").otherwise("unknown")


def declared_rank(config_r: Column, metadata: Column) -> Column:
    from_meta = [F.when(F.try_element_at(metadata, F.lit(k)).rlike("^[0-9]+$"), F.try_element_at(metadata, F.lit(k)).try_cast("int")) for k in ("r", "rank", "lora_r")]
    return F.coalesce(config_r, *from_meta)


def violations(results: DataFrame) -> DataFrame:
    """Rows of result documents that break an invariant; there must be none."""
    a, r = F.col("verdict.action"), F.col("anomaly.reference")
    strict = F.exists("verdict.reasons", lambda x: x["code"] == "STRICT_POLICY_STRUCTURAL")
    rule = (
        F.when((F.col("status") != "ok") & (a == "allow"), "a scan that isn't ok must not allow")
        .when((F.col("scan.policy") == "default") & r.isNull() & (a == "block"), "the default policy may not block without a reference")
        .when((a == "block") & r.isNull() & ~strict, "a block needs a reason")
        .when(F.size("coverage.not_analyzed") > LISTED, "too many tensors listed")
        .when(F.col("coverage.n_modules_analyzed") > F.col("coverage.n_modules"), "coverage counts")
        .when(~F.col("scan.scan_id").rlike("^sha256:[0-9a-f]{64}$"), "scan_id")
    )
    return results.withColumn("violation", rule).where("violation IS NOT NULL")


def combined(results: DataFrame) -> DataFrame:
    """Results with the policy gate and the final verdict; the behavioural stage is a placeholder."""
    gate = F.struct(F.col("verdict.m2_recommended").alias("behavioural_stage"), F.when(F.col("verdict.m2_recommended"), "recommended").otherwise("not needed").alias("why"))
    return results.select("*", ids.hashed(F.col("scan.scan_id"), F.lit("combined")).alias("report_id"), gate.alias("policy_gate"), F.lit(None).cast("string").alias("behavioural"), F.col("verdict.action").alias("final_action"))
