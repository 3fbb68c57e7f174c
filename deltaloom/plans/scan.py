"""From paths of adapter files to one result document each: the whole scan as one plan.

Only two steps leave the JVM: bounded reads of headers and neighbouring files, and the features of pairs. All else are joins on (path, base), small
aggregates and expressions. A file that can't be read, has no pairs, or changes meanwhile is a failed document with action review.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import config as configs
from ..functions import ids, names, stats
from ..operators import compare, grouped, inventory, lowrank, profile, rules
from ..sources import listing, tensorfile

# Fixed values.
SCHEMA_VERSION, ANALYZER_VERSION = "2.0.0", "1.0.0"
REFERENCE = "struct<profile_id:string,profile_version:string,stratum:string,n_reference:int,distance:double,p_value:double,alpha_review:double,alpha_block:double>"


@dataclass(frozen=True)
class Settings:
    mode: str = "full"
    policy: str = "default"
    run_id: str = "run"
    include_modules: bool = True
    include_heads: bool = False


@dataclass(frozen=True)
class Profiles:
    """trend (family, module, feature, c0, c1, c2, resid_med, resid_scale), scores (family, d2), and centre and precision by family."""

    trend: DataFrame
    scores: DataFrame
    centres: dict[str, tuple[list[float], list[list[float]]]]
    version: str = "1"


def _array(col: str, kind: str):
    return F.coalesce(F.col(col), F.array().cast(f"array<{kind}>"))


def reference(modules: DataFrame, info: DataFrame, profiles: Profiles) -> DataFrame:
    """path, reference (struct) of files whose base model has a profile, with a rank and modules that the profile knows."""
    family = profile.profile_of(F.col("base_model"), list(profiles.centres))
    own = info.withColumn("profile_family", family).where("profile_family IS NOT NULL AND rank_declared IS NOT NULL")
    values = compare.long_features(modules, ["path", "module", "layer"]).join(own.select("path", "profile_family", "rank_declared", "n_layers"), "path")
    placed = values.withColumns({"rel_depth": stats.rel_depth(F.col("layer"), F.col("n_layers")), "log_rank": F.ln(F.col("rank_declared").cast("double"))})
    trend = profiles.trend.withColumnRenamed("family", "profile_family")
    joined = placed.join(trend.where("resid_scale > 0"), ["profile_family", "module", "feature"])
    z = (F.col("value") - (F.col("c0") + F.col("c1") * F.col("rel_depth") + F.col("c2") * F.col("log_rank")) - F.col("resid_med")) / F.col("resid_scale")
    vectors = profile.adapter_vector(joined.withColumn("z", z), "path").join(own.select("path", "profile_family"), "path")
    d2 = F.coalesce(*(F.when(F.col("profile_family") == k, profile.distance(F.col("vector"), mu, p)) for k, (mu, p) in profiles.centres.items()))
    scored = profile.conformal_p(vectors.select("path", "profile_family", d2.alias("d2")), profiles.scores.withColumnRenamed("family", "profile_family"), ["profile_family"])
    ref = F.struct(F.col("profile_family").alias("profile_id"), F.lit(profiles.version).alias("profile_version"), F.col("profile_family").alias("stratum"), F.col("n_reference").cast("int").alias("n_reference"), F.col("d2").alias("distance"), "p_value", F.lit(profile.ALPHAS["review"]).alias("alpha_review"), F.lit(profile.ALPHAS["block"]).alias("alpha_block"))
    return scored.select("path", ref.cast(REFERENCE).alias("reference"))


def scan(paths: DataFrame, settings: Settings = Settings(), profiles: Profiles | None = None, written=lambda df, name: df) -> DataFrame:
    """One result document for each row of paths (column path).

    written(df, name) may store an intermediate table and read it again; with it, the headers and the features of pairs are made once and survive
    lost executors. Without it they are recomputed where they are used twice, which only tests should do.
    """
    paths = paths.select("path").distinct()
    began = F.current_timestamp()
    heads = written(tensorfile.headers(paths), "headers")
    near = written(listing.configs(listing.beside(paths)), "configs")
    identity = written(tensorfile.identity(paths), "identity")
    meta = tensorfile.metadata(heads)
    tensors = inventory.classified(tensorfile.checked(tensorfile.entries(heads)))
    broken_files = tensorfile.inconsistent(tensors.where("problem IS NULL"))
    tensors = written(tensors.join(broken_files.select("path"), "path", "left_anti"), "tensors")
    paired = inventory.pairs(tensors)
    sound = paired.where("reason IS NULL").join(near.select("path", "config"), "path")
    c = F.col("config")
    scale = configs.scale(F.col("base"), F.col("rank"), c.isNotNull(), c["lora_alpha"], c["alpha_pattern"], c["rank_pattern"], F.coalesce(c["use_rslora"], F.lit(False)))
    sound = written(sound.withColumn("s", scale).select("*", F.col("s.scale").alias("scale"), F.col("s.unresolved").alias("unresolved")).drop("s", "config"), "pairs")
    features = written(lowrank.module_features(sound, settings.include_heads), "features")
    modules = features.join(sound.select("path", "base", "location", "rank", "scale", "transposed", F.col("a.key").alias("a_key"), F.col("b.key").alias("b_key"), F.col("a.shape").alias("shape_a"), F.col("b.shape").alias("shape_b")), ["path", "base"])
    modules = written(compare.with_family(modules.select("*", "location.*").drop("location")), "modules")
    ok = modules.where("status = 'ok'")
    z = written(compare.family_z(ok), "z")
    per_module = written(compare.module_z(z), "module-z")
    intra = compare.summary(ok, z, per_module)
    depth = ok.select("path", "base", "module", "b_key", grouped.depth("layer", ["path", "stack"]).alias("n_layers"))
    intra_findings = rules.concentration_findings(per_module, depth)
    vectors = written(lowrank.vectors(tensors, "dora").withColumn("kind", F.lit("dora")).unionByName(lowrank.vectors(tensors, "token_delta").withColumn("kind", F.lit("token_delta"))), "vectors")
    dora = rules.vector_findings(vectors.where("kind = 'dora'"), "DORA_MAGNITUDE").withColumnRenamed("found", "dora_findings")
    deltas = rules.vector_findings(vectors.where("kind = 'token_delta'"), "TRAINABLE_TOKEN_DELTA").withColumnRenamed("found", "delta_findings")
    # what was not analysed
    missed = inventory.not_analysed(tensors, paired)
    unread = modules.where("status = 'not_analyzed'").select("path", F.explode(F.array("a_key", "b_key")).alias("tensor_key"), F.col("error").alias("reason"), F.lit("malformed").alias("category"))
    bad_vectors = vectors.where("error IS NOT NULL").select("path", F.col("key").alias("tensor_key"), F.col("error").alias("reason"), F.lit("malformed").alias("category"))
    infinite = modules.where("status = 'non_finite'").select("path", F.concat("base", F.lit(".lora_A/lora_B")).alias("tensor_key"), F.lit("NaN or Inf weights").alias("reason"), F.lit("malformed").alias("category"))
    all_missed = missed.unionByName(unread).unionByName(bad_vectors).withColumn("w", F.lit(1)).unionByName(infinite.withColumn("w", F.lit(2)))
    entry = F.struct("w", "tensor_key", "reason", "category")
    w = W.partitionBy("path").orderBy("w", "tensor_key")
    listed = all_missed.withColumn("o", F.row_number().over(w)).groupBy("path").agg(F.sum("w").cast("int").alias("n_not"), F.transform(F.array_sort(F.collect_list(F.when(F.col("o") <= rules.LISTED, entry))), lambda s: s.dropFields("w")).alias("not_analyzed"))
    # one row for each file
    at = lambda cond, e: F.array_sort(F.collect_list(F.when(cond, e)))
    place = F.struct("key", "shape", names.location(F.col("base")).alias("location"))
    of_tensors = tensors.groupBy("path").agg(F.count("*").cast("int").alias("n_tensors"), at(F.col("bucket") == "full", place).alias("full"), F.bool_or(F.col("bucket") == "dora").alias("has_dora"), at(F.col("bucket") == "token_delta", F.col("key")).alias("token_keys"), F.collect_set("key").alias("all_keys"))
    of_pairs = sound.groupBy("path").agg(F.count("*").cast("int").alias("n_modules"), F.array_sort(F.collect_set("rank")).alias("ranks"), F.array_sort(F.collect_set("location.module")).alias("target_actual"), F.max("location.layer").alias("max_layer"), F.max("location.expert").alias("max_expert"), at(F.col("location.kind") == "router", F.struct(F.col("a.key").alias("key"), "location")).alias("routers"), F.bool_or("unresolved").alias("unresolved"))
    zero = F.col("fro") == 0
    top_tokens = F.struct("module", F.col("top_ids").alias("top_token_ids"), "top_shares", F.coalesce("row_hoyer", F.lit(0.0)).alias("hoyer"), F.coalesce("row_gini", F.lit(0.0)).alias("gini"))
    of_modules = modules.groupBy("path").agg(F.count_if(F.col("status") == "ok").cast("int").alias("n_ok"), F.count_if((F.col("status") == "ok") & zero).cast("int").alias("n_zero"), F.slice(F.array_sort(F.collect_list(F.when(F.col("status") == "non_finite", F.col("base")))), 1, rules.LISTED).alias("non_finite_modules"), F.array_sort(F.collect_list(F.when(F.col("top_ids").isNotNull(), top_tokens))).alias("token_concentration"))
    of_vectors = vectors.groupBy("path").agg(F.count_if(F.col("error").isNull()).cast("int").alias("n_vectors"))
    row = paths.join(heads.select("path", "error"), "path", "left").join(near, "path", "left").join(identity, "path", "left").join(meta, "path", "left")
    for part in (broken_files.withColumnRenamed("reason", "broken"), of_tensors, of_pairs, of_modules, of_vectors, listed, intra, intra_findings, dora, deltas):
        row = row.join(part, "path", "left")
    row = row.join(tensorfile.changed(identity).withColumn("has_changed", F.lit(True)), "path", "left")
    row = row.withColumns({"full": _array("full", "struct<key:string,shape:array<bigint>,location:struct<layer:int,expert:int,module:string,kind:string,stack:string>>"), "routers": _array("routers", "struct<key:string,location:struct<layer:int,expert:int,module:string,kind:string,stack:string>>"), "ranks": _array("ranks", "int"), "target_actual": _array("target_actual", "string"), "token_keys": _array("token_keys", "string"), "all_keys": _array("all_keys", "string"), "siblings": _array("siblings", "struct<name:string,kind:string>"), "problems": _array("problems", "string"), "not_analyzed": _array("not_analyzed", "struct<tensor_key:string,reason:string,category:string>"), "n_not": F.coalesce("n_not", F.lit(0)), "n_ok": F.coalesce("n_ok", F.lit(0)), "n_modules": F.coalesce("n_modules", F.lit(0)), "n_zero": F.coalesce("n_zero", F.lit(0)), "n_vectors": F.coalesce("n_vectors", F.lit(0)), "has_dora": F.coalesce("has_dora", F.lit(False)), "unresolved": F.coalesce("unresolved", F.lit(False)), "top_edge": F.coalesce("top_edge", F.lit(False)), "metadata": F.coalesce("metadata", F.create_map().cast("map<string,string>"))})
    method = names.other_method(F.col("config.peft_type"), F.col("all_keys"))
    failure = F.when(F.col("has_changed"), "file changed during the scan").when(F.col("error").isNotNull(), F.col("error")).when(F.col("broken").isNotNull(), F.col("broken")).when((F.col("n_modules") == 0) & method.isNull(), "no lora_a/lora_b pair in the file")
    row = row.withColumns({"method": F.when((F.col("n_modules") == 0) & F.col("error").isNull() & F.col("broken").isNull(), method), "failure": failure})
    state = F.when(F.col("failure").isNotNull() | F.col("method").isNotNull(), "failed").otherwise(rules.status(F.col("n_ok"), F.col("n_not")))
    row = row.withColumn("status", state)
    base_model = F.coalesce(F.col("config.base_model_name_or_path"), F.try_element_at("metadata", F.lit("base_model_name_or_path")))
    row = row.withColumns({"base_model": base_model, "rank_declared": rules.declared_rank(F.col("config.r"), F.col("metadata")), "n_layers": F.col("max_layer") + 1})
    if profiles is not None and settings.mode == "full":
        row = written(row, "files")
        row = row.join(reference(ok, row.where("failure IS NULL").select("path", "base_model", "rank_declared", "n_layers"), profiles), "path", "left")
    else:
        row = row.withColumn("reference", F.lit(None).cast(REFERENCE))
    found, flags, limits = rules.structural({k: F.col(k) for k in ("config", "problems", "siblings", "full", "routers", "ranks", "has_dora", "unresolved", "token_keys")} | {"modules": F.col("target_actual")})
    failed = F.col("failure").isNotNull() | F.col("method").isNotNull()
    none = F.array().cast(f"array<{rules.FINDING}>")
    token_findings = F.transform("token_concentration", lambda t: rules.finding("TOKEN_CONCENTRATION", "LOW", F.concat(F.lit("Update of "), t["module"], F.lit(" by token")), F.format_string("The first %d tokens hold %.1f%% of the energy", F.size(t["top_token_ids"]).cast("long"), 100 * F.aggregate(t["top_shares"], F.lit(0.0), lambda a, x: a + x)), F.struct(t["top_token_ids"].alias("top_token_ids"), F.transform(t["top_shares"], lambda s: F.round(s, 4)).alias("top_shares"))))
    unsupported = F.array(rules.finding("UNSUPPORTED_PEFT_METHOD", "MEDIUM", "The adapter's method is not analysed", F.concat(F.lit("recognised as "), F.col("method"))))
    empty = lambda x: F.coalesce(x, none)
    findings = F.when(F.col("method").isNotNull(), unsupported).when(failed, none).otherwise(F.concat(found, empty(F.col("intra_findings")), empty(token_findings), empty(F.col("dora_findings")), empty(F.col("delta_findings"))))
    row = row.withColumns({"red_flags": F.when(failed, F.array().cast("array<string>")).otherwise(flags), "limits": F.when(failed, F.array().cast("array<string>")).otherwise(limits), "findings": findings})
    verdict = rules.verdict({"status": F.col("status"), "policy": F.lit(settings.policy), "intra": F.when(~failed, F.col("intra")), "reference": F.when(~failed, F.col("reference")), "red_flags": F.col("red_flags"), "metadata_present": (F.size("metadata") > 0) | F.col("config").isNotNull() | failed, "limits": F.col("limits"), "n_not": F.when(failed, F.lit(0)).otherwise(F.col("n_not")), "top_edge": F.col("top_edge"), "failure_code": F.when(F.col("method").isNotNull(), "UNSUPPORTED_PEFT_METHOD").otherwise("PARSE_FAILED"), "failure_message": F.when(F.col("method").isNotNull(), F.concat(F.lit("not a LoRA adapter: "), F.col("method"))).otherwise(F.coalesce("failure", F.lit("could not be parsed")))})
    config_hash = F.lit(f"mode={settings.mode};policy={settings.policy};analyzer={ANALYZER_VERSION}")
    cfg = F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", config_hash, F.coalesce("config_text", F.lit("")), F.array_join(F.transform("siblings", lambda s: s["name"]), ",")), 256))
    file = F.element_at(F.split("path", "/"), -1)
    provenance = F.struct(F.lit("local").alias("kind"), "path", F.lit(None).cast("string").alias("hf_repo_id"), F.lit(None).cast("string").alias("hf_revision"), F.when(F.col("config_text").isNotNull(), F.lit(listing.CONFIG_NAME)).alias("config_file"), F.col("siblings").alias("sibling_files"))
    artifact = F.when(F.col("content_hash").isNotNull(), F.struct("content_hash", "header_hash", ids.logical_id(F.lit(None).cast("string"), F.lit(None).cast("string"), file, F.col("path")).alias("logical_id"), "file_size_bytes", provenance.alias("provenance")))
    adapter = F.when(~failed, F.struct(
        F.lit("peft_lora").alias("format"), F.coalesce("config.peft_type", F.try_element_at("metadata", F.lit("peft_type"))).alias("peft_type"), F.col("base_model").alias("base_model_declared"), names.base_family(F.col("base_model")).alias("base_family"), F.when(F.col("base_model").isNotNull(), "config").otherwise("unknown").alias("base_family_source"),
        F.col("n_layers").alias("n_model_layers"), "rank_declared", F.struct(F.array_min("ranks").alias("min"), F.array_max("ranks").alias("max"), F.col("ranks").alias("distinct")).alias("rank_actual"), F.col("config.lora_alpha").alias("lora_alpha"), rules.scaling(F.col("config")).alias("scaling"), F.col("config.init_lora_weights").alias("init_method"),
        (F.col("has_dora") | F.coalesce("config.use_dora", F.lit(False))).alias("use_dora"), _array("config.target_modules", "string").alias("target_modules_declared"), F.col("target_actual").alias("target_modules_actual"),
        rules.all_saved(F.transform("full", lambda x: x["location"]["module"]), _array("config.modules_to_save", "string")).alias("modules_to_save"), ((F.size("token_keys") > 0) | F.coalesce("config.trainable_token_indices", F.lit(False))).alias("trainable_token_indices"),
        F.when(F.col("max_expert").isNotNull(), F.struct((F.col("max_expert") + 1).alias("n_experts"), (F.size("routers") > 0).alias("router_adapted"))).alias("moe"), rules.training_state(F.col("n_ok"), F.col("n_zero")).alias("training_state"), (F.size("metadata") > 0).alias("metadata_present"), F.col("config").isNotNull().alias("config_present")))
    coverage = F.struct(F.coalesce("n_tensors", F.lit(0)).alias("n_tensors_total"), (2 * F.col("n_ok") + F.col("n_vectors")).cast("int").alias("n_tensors_analyzed"), "n_modules", F.col("n_ok").alias("n_modules_analyzed"), F.col("n_not").cast("int").alias("n_not_analyzed"), "not_analyzed", _array("non_finite_modules", "string").alias("non_finite_modules"))
    anomaly = F.struct(F.when(~failed, F.col("intra")).alias("intra"), F.when(~failed, F.col("reference")).alias("reference"), "token_concentration", F.when(~failed, F.col("top_contributors")).alias("top_contributors"))
    errors = F.when(F.col("failure").isNotNull(), F.array(F.struct(F.lit("malformed").alias("category"), F.lit("INVALID_SAFETENSORS").alias("code"), F.col("failure").alias("message"), F.lit(None).cast("string").alias("detail"), F.lit("parse").alias("phase"), F.lit("fatal").alias("severity")))).otherwise(F.array().cast("array<struct<category:string,code:string,message:string,detail:string,phase:string,severity:string>>"))
    content = F.coalesce("content_hash", ids.hashed(F.col("path")))
    times = F.struct(ids.scan_id(content, cfg, F.lit(SCHEMA_VERSION)).alias("scan_id"), F.lit(settings.run_id).alias("run_id"), F.lit(ANALYZER_VERSION).alias("analyzer_version"), cfg.alias("config_hash"), F.lit(settings.mode).alias("mode"), F.lit(settings.policy).alias("policy"), began.alias("started_at"), F.current_timestamp().alias("completed_at"), F.lit(0).cast("long").alias("wall_time_ms"))
    out = row.select("path", F.lit(SCHEMA_VERSION).alias("schema_version"), times.alias("scan"), artifact.alias("artifact"), adapter.alias("adapter"), "status", coverage.alias("coverage"), verdict.alias("verdict"), anomaly.alias("anomaly"), "findings", errors.alias("errors"))
    if not settings.include_modules:
        return out.withColumn("modules", F.lit(None).cast("array<struct<module:string>>"))
    record = F.struct("layer", "expert", "base", "module", "kind", "shape_a", "shape_b", "rank", "scale", "status", F.struct(*stats.ALL_FEATURES).alias("features"), F.coalesce("z", F.create_map().cast("map<string,double>")).alias("z"), "heads")
    records = modules.join(per_module.select("path", "base", "z"), ["path", "base"], "left").groupBy("path").agg(F.array_sort(F.collect_list(record), lambda a, b: F.when(F.coalesce(a["layer"], F.lit(-1)) != F.coalesce(b["layer"], F.lit(-1)), F.coalesce(a["layer"], F.lit(-1)) - F.coalesce(b["layer"], F.lit(-1))).when(F.coalesce(a["expert"], F.lit(-1)) != F.coalesce(b["expert"], F.lit(-1)), F.coalesce(a["expert"], F.lit(-1)) - F.coalesce(b["expert"], F.lit(-1))).when(a["base"] < b["base"], -1).otherwise(F.when(a["base"] > b["base"], 1).otherwise(0))).alias("modules"))
    return out.join(records, "path", "left")
