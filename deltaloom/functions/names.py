"""Tensor keys: role, module path, and where in the model a module sits. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The key forms of low-rank adapters and the names of modules.
SEGMENT = "(?:[.][A-Za-z0-9_-]+)?"
KEY_FORMS = {
    "lora_A": f"^(.+)[.]lora_A{SEGMENT}[.]weight$",
    "lora_B": f"^(.+)[.]lora_B{SEGMENT}[.]weight$",
    "embedding_A": f"^(.+)[.]lora_embedding_A{SEGMENT}$",
    "embedding_B": f"^(.+)[.]lora_embedding_B{SEGMENT}$",
    "dora_magnitude": f"^(.+)[.]lora_magnitude_vector{SEGMENT}(?:[.]weight)?$",
    "trainable_tokens": f"^(.+)[.]trainable_tokens_(?:delta|original){SEGMENT}$",
}
LAYER = "(?:^|[.])(?:layers|h|blocks|layer)[.]([0-9]+)(?:[.]|$)"
BEFORE_LAYER = "^(.*?)(?:^|[.])(?:layers|h|blocks|layer)[.][0-9]+(?:[.]|$)"
EXPERT = "(?:^|[.])experts[.]([0-9]+)(?:[.]|$)"
PREFIX = "^base_model[.]model[.]"
KINDS = {
    "attention": ["q_proj", "k_proj", "v_proj", "o_proj", "qkv_proj", "query_key_value", "c_attn", "Wqkv", "out_proj", "query", "key", "value", "wq", "wk", "wv", "wo"],
    "mlp": ["gate_proj", "up_proj", "down_proj", "gate_up_proj", "fc1", "fc2", "w1", "w2", "w3", "c_fc", "c_proj", "dense_h_to_4h", "dense_4h_to_h"],
    "embedding": ["embed_tokens", "wte", "word_embeddings", "tok_embeddings"],
    "lm_head": ["lm_head", "output", "embed_out"],
    "router": ["router", "gate"],
}
FAMILY_HINTS = ["llama", "qwen", "gemma", "mistral", "mixtral", "phi", "deepseek", "falcon", "gpt-neox", "gpt2", "bloom", "olmo", "internlm", "yi", "baichuan", "chatglm", "t5"]


def _ordered(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = None
    for when, then in pairs:
        out = F.when(when, then) if out is None else out.when(when, then)
    return otherwise if out is None else out.otherwise(otherwise)


def role(key: Column) -> Column:
    return _ordered([(key.rlike(p), F.lit(r)) for r, p in KEY_FORMS.items()], F.lit("other"))


def base(key: Column) -> Column:
    """The module path that the tensor belongs to; null for role 'other'."""
    return _ordered([(key.rlike(p), F.regexp_extract(key, p, 1)) for p in KEY_FORMS.values()], F.lit(None).cast("string"))


def module_name(path: Column) -> Column:
    """The last part that isn't empty or a number; the path itself if there is none."""
    parts = F.filter(F.split(path, "[.]"), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), path)


def _number(path: Column, form: str) -> Column:
    return F.regexp_extract(path, form, 1).try_cast("int")


def layer(path: Column) -> Column:
    return _number(path, LAYER)


def expert(path: Column) -> Column:
    return _number(path, EXPERT)


def kind(path: Column) -> Column:
    name = module_name(path)
    return _ordered([(name.isin(names) & (~path.rlike(EXPERT) if k == "router" else F.lit(True)), F.lit(k)) for k, names in KINDS.items()], F.lit("other"))


def stack(path: Column) -> Column:
    """What stands before the layer, without the wrapper's prefix; empty without a layer."""
    return F.regexp_replace(F.regexp_extract(path, BEFORE_LAYER, 1), PREFIX, "")


def location(path: Column) -> Column:
    return F.struct(layer(path).alias("layer"), expert(path).alias("expert"), module_name(path).alias("module"), kind(path).alias("kind"), stack(path).alias("stack"))


def base_family(model: Column, hints: list[str] | None = None) -> Column:
    """The first hint in the name; 'unknown' without one."""
    low = F.lower(model)
    return _ordered([(F.contains(low, F.lit(h)), F.lit("mistral" if h == "mixtral" else h)) for h in hints or FAMILY_HINTS], F.lit("unknown"))


# Other adapter methods by declared type and by a part of their keys, first match wins.
METHODS = {
    "VERA": "VeRA", "IA3": "IA³", "LOHA": "LoHa", "LOKR": "LoKr", "BOFT": "BOFT", "OFT": "OFT", "HRA": "HRA", "POLY": "Poly",
    "LN_TUNING": "LayerNorm tuning", "VBLORA": "VB-LoRA", "FOURIERFT": "FourierFT", "PROMPT_TUNING": "prompt tuning",
    "PREFIX_TUNING": "prefix tuning", "P_TUNING": "P-tuning", "MULTITASK_PROMPT_TUNING": "multitask prompt tuning",
    "ADAPTION_PROMPT": "Llama-Adapter (adaption prompt)",
}
METHOD_KEYS = [
    ("vera_lambda", "VeRA"), (".vera_A", "VeRA"), (".ia3_l", "IA³"), ("hada_w1", "LoHa"), ("hada_w2", "LoHa"), ("lokr_w1", "LoKr"),
    ("lokr_w2", "LoKr"), ("boft_R", "BOFT"), ("boft_s", "BOFT"), ("oft_r", "OFT"), (".hra_u", "HRA"), ("poly_lora", "Poly"),
    ("prompt_embeddings", "prompt tuning"), ("prefix", "prefix tuning"), ("vblora_", "VB-LoRA"), ("fourierft_", "FourierFT"),
]
DECOMPOSITIONS = ["pissa", "olora", "corda", "eva"]


def normal_type(declared: Column) -> Column:
    return F.nullif(F.replace(F.upper(F.trim(declared)), F.lit("-"), F.lit("_")), F.lit(""))


def method_of_type(declared: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in METHODS.items() for x in kv)), normal_type(declared))


def method_of_keys(keys: Column) -> Column:
    """From an array of keys: the first form, in order, that any key has."""
    def any_has(infix: str) -> Column:
        return F.exists(keys, lambda k: F.contains(k, F.lit(infix)))

    return F.coalesce(*(F.when(any_has(infix), F.lit(name)) for infix, name in METHOD_KEYS))


def other_method(declared: Column, keys: Column) -> Column:
    return F.coalesce(method_of_type(declared), method_of_keys(keys))


def is_decomposition(init: Column) -> Column:
    return F.coalesce(F.lower(F.trim(init)).rlike(f"^({'|'.join(DECOMPOSITIONS)})(_|$)"), F.lit(False))
