"""Adapter configurations: validation of an untrusted JSON text, and the scale of a module. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
METACHARACTERS = "[\\\\^$*+?{}\\[\\]()|]"
MAX_BYTES = 1_000_000
STRINGS = ["peft_type", "base_model_name_or_path"]
SCALE_SOURCES = ("pattern", "config", "default_alpha_equals_r")


def is_literal(pattern: Column) -> Column:
    """A pattern that means itself; others are never run."""
    return ~pattern.rlike(METACHARACTERS)


def matches(path: Column, pattern: Column) -> Column:
    return is_literal(pattern) & ((path == pattern) | F.endswith(path, F.concat(F.lit("."), pattern)))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _field(doc: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(doc, f"$.{name}", kind)


def _raw(doc: Column, name: str) -> Column:
    return F.try_variant_get(doc, f"$.{name}", "variant")


def _is_number(v: Column) -> Column:
    return _kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def parse(text: Column) -> Column:
    """struct of the known fields and `problems`; fields of the wrong kind are null and reported. Null if the text isn't a JSON object."""
    doc = F.try_parse_json(text)

    def number(name: str, least: float, whole: bool) -> tuple[Column, Column]:
        raw, value = _raw(doc, name), _field(doc, name, "double")
        ok = raw.isNotNull() & ~F.is_variant_null(raw) & _is_number(raw) & (value >= least if whole else value > least) & (value < F.lit(float("inf"))) & (value == F.floor(value) if whole else F.lit(True))
        return F.when(ok, value), raw.isNotNull() & ~F.is_variant_null(raw) & ~F.coalesce(ok, F.lit(False))

    def string(name: str) -> tuple[Column, Column]:
        raw = _raw(doc, name)
        ok = _kind(raw) == "STRING"
        return F.when(ok, _field(doc, name, "string")), raw.isNotNull() & ~F.is_variant_null(raw) & ~F.coalesce(ok, F.lit(False))

    def strings(name: str) -> tuple[Column, Column]:
        raw = _raw(doc, name)
        one, many = _kind(raw) == "STRING", _kind(raw).startswith("ARRAY")
        kept = F.transform(F.filter(_field(doc, name, "array<variant>"), lambda v: _kind(v) == "STRING"), lambda v: v.cast("string"))
        value = F.when(one, F.array(_field(doc, name, "string"))).when(many, kept).otherwise(F.array().cast("array<string>"))
        return F.coalesce(value, F.array().cast("array<string>")), raw.isNotNull() & ~F.is_variant_null(raw) & ~F.coalesce(one | many, F.lit(False))

    def numbers(name: str, least: float, whole: bool) -> tuple[Column, Column]:
        raw = _raw(doc, name)
        values = F.coalesce(_field(doc, name, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
        good = lambda v: _is_number(v) & (v.cast("double") >= least if whole else v.cast("double") > least) & (v.cast("double") < F.lit(float("inf")))
        valid = F.transform_values(F.map_filter(values, lambda _, v: F.coalesce(good(v), F.lit(False))), lambda _, v: v.cast("double"))
        # a variant's fields are sorted, the first pattern that matches counts: keys in the order of the text
        ordered = F.coalesce(F.map_keys(F.from_json(F.get_json_object(text, f"$.{name}"), "map<string,string>")), F.array().cast("array<string>"))
        kept = F.map_from_entries(F.transform(F.filter(F.array_distinct(ordered), lambda k: F.map_contains_key(valid, k)), lambda k: F.struct(k, F.try_element_at(valid, k))))
        return kept, (raw.isNotNull() & ~F.is_variant_null(raw) & ~F.coalesce(_kind(raw).startswith("OBJECT"), F.lit(False))) | (F.size(kept) < F.size(values))

    def flag(name: str) -> tuple[Column, Column]:
        raw = _raw(doc, name)
        ok = _kind(raw) == "BOOLEAN"
        return F.coalesce(F.when(ok, _field(doc, name, "boolean")), F.lit(False)), raw.isNotNull() & ~F.is_variant_null(raw) & ~F.coalesce(ok, F.lit(False))

    init = _raw(doc, "init_lora_weights")
    got = {
        "peft_type": string("peft_type"),
        "base_model_name_or_path": string("base_model_name_or_path"),
        "r": number("r", 1, True),
        "lora_alpha": number("lora_alpha", 0, False),
        "use_rslora": flag("use_rslora"),
        "use_dora": flag("use_dora"),
        "rank_pattern": numbers("rank_pattern", 1, True),
        "alpha_pattern": numbers("alpha_pattern", 0, False),
        "target_modules": strings("target_modules"),
        "modules_to_save": strings("modules_to_save"),
    }
    fields = [v.cast("int").alias(k) if k == "r" else v.alias(k) for k, (v, _) in got.items()]
    fields.append(F.when(_kind(init) == "STRING", _field(doc, "init_lora_weights", "string")).alias("init_lora_weights"))
    tokens = _raw(doc, "trainable_token_indices")
    fields.append((tokens.isNotNull() & ~F.is_variant_null(tokens) & ~F.coalesce(_field(doc, "trainable_token_indices", "boolean") == F.lit(False), F.lit(False))).alias("trainable_token_indices"))
    problems = F.array_compact(F.array(*(F.when(bad, F.lit(f"{k}: invalid value ignored")) for k, (_, bad) in got.items())))
    return F.when((F.octet_length(text) <= MAX_BYTES) & _kind(doc).startswith("OBJECT"), F.struct(*fields, problems.alias("problems")))


def scale(path: Column, rank: Column, has_config: Column, lora_alpha: Column, alpha_pattern: Column, rank_pattern: Column, rslora: Column) -> Column:
    """struct(scale, rank, alpha, source, unresolved): alpha over the rank, or over its root.

    The first pattern that matches gives alpha; patterns that aren't literal are skipped and reported if they stand before it.
    """
    r = F.greatest(rank, F.lit(1)).cast("double")
    alphas = F.map_entries(F.coalesce(alpha_pattern, F.create_map().cast("map<string,double>")))
    at = F.array_position(F.transform(alphas, lambda e: matches(path, e["key"])), F.lit(True)).cast("int")
    hit = F.when(at > 0, F.get(alphas, at - 1)["value"])
    before = F.when(at > 0, F.slice(alphas, 1, at)).otherwise(alphas)
    ranks = F.map_keys(F.coalesce(rank_pattern, F.create_map().cast("map<string,double>")))
    rank_at = F.array_position(F.transform(ranks, lambda k: matches(path, k)), F.lit(True)).cast("int")
    ranks_before = F.when(rank_at > 0, F.slice(ranks, 1, rank_at)).otherwise(ranks)
    unresolved = has_config & (F.exists(before, lambda e: ~is_literal(e["key"])) | F.exists(ranks_before, lambda k: ~is_literal(k)))
    alpha = F.coalesce(hit, lora_alpha.cast("double"), r)
    value = F.when(has_config, alpha / F.when(rslora, F.sqrt(r)).otherwise(r)).otherwise(F.lit(1.0))
    source = F.when(~has_config, F.lit(SCALE_SOURCES[2])).when(hit.isNotNull(), F.lit(SCALE_SOURCES[0])).when(lora_alpha.isNotNull(), F.lit(SCALE_SOURCES[1])).otherwise(F.lit(SCALE_SOURCES[2]))
    return F.struct(value.alias("scale"), r.cast("int").alias("rank"), F.when(has_config, alpha).otherwise(r).alias("alpha"), source.alias("source"), F.coalesce(unresolved, F.lit(False)).alias("unresolved"))
