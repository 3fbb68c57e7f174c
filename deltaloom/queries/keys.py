"""Tensor keys, headers, configurations, pairs and everything else that is parsed or joined before features."""

from pyspark.sql import functions as F

from ..functions import config, ids, names
from ..operators import inventory, profile
from ..sources import documents, listing, tensorfile
from .common import BASE_SQL, KEYED_SQL, KEYS, NAME_SQL, ROLE_SQL, Input, query, r6, table, values

KINDS_SQL = "CASE " + " ".join(f"WHEN {{0}} IN ({', '.join(repr(n) for n in ns)}) {'AND expert IS NULL' if k == 'router' else ''} THEN '{k}'" for k, ns in names.KINDS.items()) + " ELSE 'other' END"
LAYER_SQL = "try_cast(nullif(regexp_extract({0}, '(?:^|[.])(?:layers|h|blocks|layer)[.]([0-9]+)(?:[.]|$)', 1), '') AS INTEGER)"
EXPERT_SQL = "try_cast(nullif(regexp_extract({0}, '(?:^|[.])experts[.]([0-9]+)(?:[.]|$)', 1), '') AS INTEGER)"
STACK_SQL = "regexp_replace(regexp_extract({0}, '^(.*?)(?:^|[.])(?:layers|h|blocks|layer)[.][0-9]+(?:[.]|$)', 1), '^base_model[.]model[.]', '')"


@query("parse_key", f"SELECT n, key, {ROLE_SQL} AS role, {BASE_SQL} AS base FROM {KEYS.sql} k")
def parse_key(spark, d):
    return KEYS.df(spark, d).select("n", "key", names.role(F.col("key")).alias("role"), names.base(F.col("key")).alias("base"))


URLS = Input("pages", ("page_id", "replace(replace(url, '/', '.'), '-', '_') AS path"))


@query("module_name", f"SELECT page_id, {NAME_SQL.format('path')} AS module FROM {URLS.sql} u")
def module_name(spark, d):
    return URLS.df(spark, d).select("page_id", names.module_name(F.col("path")).alias("module"))


@query("locate", f"SELECT n, {LAYER_SQL.format('base')} AS layer, expert, module, {KINDS_SQL.format('module')} AS kind, {STACK_SQL.format('base')} AS stack FROM (SELECT n, base, {EXPERT_SQL.format('base')} AS expert, {NAME_SQL.format('base')} AS module FROM {KEYED_SQL} k WHERE base IS NOT NULL) t")
def locate(spark, d):
    b = KEYS.df(spark, d).select("n", names.base(F.col("key")).alias("base")).where("base IS NOT NULL")
    return b.select("n", names.location(F.col("base")).alias("l")).select("n", "l.*")


MODELS = Input("part", ("p_partkey AS n", "concat(p_name, CASE p_partkey % 9 WHEN 0 THEN ' Llama-3' WHEN 1 THEN '-QWEN' WHEN 2 THEN ' Mixtral-8x7' WHEN 3 THEN ' mistral' WHEN 4 THEN ' Gemma' WHEN 5 THEN ' gpt2 phi' WHEN 6 THEN ' falcon' ELSE '' END) AS name"))
FAMILY_SQL = "CASE " + " ".join(f"WHEN contains(lower(name), '{h}') THEN '{'mistral' if h == 'mixtral' else h}'" for h in names.FAMILY_HINTS) + " ELSE 'unknown' END"


@query("base_family", f"SELECT n, {FAMILY_SQL} AS family FROM {MODELS.sql} m")
def base_family(spark, d):
    return MODELS.df(spark, d).select("n", names.base_family(F.col("name")).alias("family"))


@query("join_profile_longest", f"SELECT n, arg_max(k, length(k)) AS family FROM (SELECT n, k FROM {MODELS.sql} m LEFT JOIN (VALUES ('llama'), ('Llama-3'), ('qwen'), ('mistral'), ('gpt2 phi'), ('phi')) v(k) ON contains(lower(name), lower(k))) t GROUP BY n")
def join_profile_longest(spark, d):
    keys = values(spark, "('llama'), ('Llama-3'), ('qwen'), ('mistral'), ('gpt2 phi'), ('phi')", "family")
    return profile.longest_contained(MODELS.df(spark, d), "name", keys, "family").select("n", "family")


@query("pattern_is_literal", "SELECT page_id, NOT regexp_matches(url, '[\\\\^$*+?{}\\[\\]()|]') AS literal FROM pages")
def pattern_is_literal(spark, d):
    return table(spark, d, "pages").select("page_id", config.is_literal(F.col("url")).alias("literal"))


SCALED = Input("part", ("p_partkey AS n", "concat('model.layers.', p_partkey % 20, CASE p_partkey % 3 WHEN 0 THEN '.self_attn.q_proj' WHEN 1 THEN '.mlp.down_proj' ELSE '.mlp.up_proj' END) AS path", "CAST(p_size AS INTEGER) AS rank", "CAST(p_partkey % 4 AS INTEGER) AS c"))


@query("resolve_scale", f"""
SELECT n, round(CASE WHEN c = 0 THEN 1 ELSE alpha / CASE WHEN c = 3 THEN sqrt(r) ELSE r END END, 6) AS scale, source, unresolved FROM (
  SELECT n, c, greatest(rank, 1)::DOUBLE AS r,
    CASE WHEN c <> 2 THEN coalesce(CASE WHEN c > 0 THEN 16 END, greatest(rank, 1))::DOUBLE WHEN path LIKE '%.q_proj' THEN 64 WHEN path LIKE '%.layers.7.mlp.down_proj' THEN 8 WHEN path LIKE '%.down_proj' THEN 32 ELSE 16 END::DOUBLE AS alpha,
    CASE WHEN c = 0 THEN 'default_alpha_equals_r' WHEN c = 2 AND (path LIKE '%.q_proj' OR path LIKE '%.down_proj') THEN 'pattern' ELSE 'config' END AS source,
    (c = 2 AND NOT (path LIKE '%.q_proj' OR path LIKE '%.layers.7.mlp.down_proj')) AS unresolved
  FROM {SCALED.sql} s) t""")
def resolve_scale(spark, d):
    patterns = F.create_map(*(F.lit(x) for x in ("q_proj", 64.0, "layers.7.mlp.down_proj", 8.0, "layers\\.[0-9]+\\.x", 1.0, "down_proj", 32.0)))
    none = F.create_map().cast("map<string,double>")
    c = F.col("c")
    s = config.scale(F.col("path"), F.col("rank"), c > 0, F.when(c > 0, F.lit(16.0)), F.when(c == 2, patterns).otherwise(none), none, c == 3)
    return SCALED.df(spark, d).select("n", s.alias("s")).select("n", r6("s.scale").alias("scale"), "s.source", "s.unresolved")


@query("join_pattern_suffix", f"SELECT n, min(o) AS first FROM (SELECT n, o FROM {SCALED.sql} s JOIN (VALUES (1, 'down_proj'), (2, 'layers.7.mlp.down_proj'), (3, 'self_attn.q_proj'), (4, 'proj')) v(o, p) ON path = p OR path LIKE '%.' || replace(p, '_', '\\_') ESCAPE '\\') t GROUP BY n")
def join_pattern_suffix(spark, d):
    """The first pattern that a path ends with: patterns ride along as one array, so paths are neither multiplied nor shuffled for them."""
    ps = F.array(*map(F.lit, ("down_proj", "layers.7.mlp.down_proj", "self_attn.q_proj", "proj")))
    at = F.array_position(F.transform(ps, lambda p: config.matches(F.col("path"), p)), F.lit(True))
    return SCALED.df(spark, d).select("n", at.cast("int").alias("first")).where("first > 0")


METHOD_SQL = "CASE " + " ".join(f"WHEN t = '{k}' THEN '{v}'" for k, v in names.METHODS.items()) + " END"
KEY_SQL = "CASE " + " ".join(f"WHEN len(list_filter(keys, lambda k: contains(k, '{i}'))) > 0 THEN '{v}'" for i, v in names.METHOD_KEYS) + " END"
TYPED = Input("part", ("p_partkey AS n", "CASE p_partkey % 8 WHEN 0 THEN ' vera' WHEN 1 THEN 'prompt-tuning' WHEN 2 THEN 'LORA' WHEN 3 THEN 'Ia3' WHEN 4 THEN '  ' ELSE NULL END AS declared", "p_name AS a", "CASE p_partkey % 5 WHEN 0 THEN 'x.hada_w2' WHEN 1 THEN 'y.oft_r' WHEN 2 THEN 'm.vera_A.z' ELSE 'm.lora_A' END AS b"))


@query("recognise_method", f"SELECT n, t AS normal_type, coalesce({METHOD_SQL}, {KEY_SQL}) AS method FROM (SELECT n, nullif(replace(upper(trim(declared)), '-', '_'), '') AS t, [a, b] AS keys FROM {TYPED.sql} t0) t1")
def recognise_method(spark, d):
    t = TYPED.df(spark, d)
    return t.select("n", names.normal_type(F.col("declared")).alias("normal_type"), names.other_method(F.col("declared"), F.array("a", "b")).alias("method"))


INITS = Input("part", ("p_partkey AS n", "CASE p_partkey % 7 WHEN 0 THEN 'PiSSA' WHEN 1 THEN 'pissa_niter_4' WHEN 2 THEN ' olora ' WHEN 3 THEN 'evaluate' WHEN 4 THEN 'gaussian' WHEN 5 THEN 'CorDA_x' ELSE NULL END AS init"))


@query("is_decomposition_init", f"SELECT n, coalesce(regexp_matches(lower(trim(init)), '^(pissa|olora|corda|eva)(_|$)'), false) AS decomposition FROM {INITS.sql} i")
def is_decomposition(spark, d):
    return INITS.df(spark, d).select("n", names.is_decomposition(F.col("init")).alias("decomposition"))


CONFIGS = Input("part", ("p_partkey AS n", """concat('{"peft_type": ', CASE WHEN p_partkey % 5 = 0 THEN '7' ELSE '"LORA"' END, ', "r": ', CASE p_partkey % 6 WHEN 0 THEN '-1' WHEN 1 THEN 'true' WHEN 2 THEN '"8"' ELSE CAST(p_size AS VARCHAR(9)) END, ', "lora_alpha": ', CASE WHEN p_partkey % 7 = 0 THEN '0' ELSE CAST(p_size * 2 AS VARCHAR(9)) END, ', "use_rslora": ', CASE WHEN p_partkey % 3 = 0 THEN 'true' ELSE 'false' END, ', "target_modules": ', CASE WHEN p_partkey % 4 = 0 THEN '"all-linear"' ELSE '["q_proj", 3, "v_proj"]' END, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE '}' END) AS text"""))


@query("parse_config", f"""
SELECT n, CASE WHEN n % 5 <> 0 THEN 'LORA' END AS peft_type, CASE WHEN n % 6 >= 3 THEN p_size END::INTEGER AS r, CASE WHEN n % 7 <> 0 THEN p_size * 2 END::DOUBLE AS lora_alpha, n % 3 = 0 AS use_rslora,
  CASE WHEN n % 4 = 0 THEN 'all-linear' ELSE 'q_proj,v_proj' END AS target_modules, ((n % 5 = 0)::INTEGER + (n % 6 < 3)::INTEGER + (n % 7 = 0)::INTEGER)::INTEGER AS n_problems
FROM (SELECT p_partkey AS n, p_size FROM part) t WHERE n % 11 <> 0""")
def parse_config(spark, d):
    c = CONFIGS.df(spark, d).select("n", config.parse(F.col("text")).alias("c")).where("c IS NOT NULL")
    return c.select("n", "c.peft_type", "c.r", "c.lora_alpha", "c.use_rslora", F.array_join("c.target_modules", ",").alias("target_modules"), F.size("c.problems").alias("n_problems"))


@query("scan_list", "SELECT path, min(ordinal) AS ordinal FROM (SELECT trim(CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE concat(' ', source, '/', doc_id % 40, '.safetensors ') END) AS path, doc_id AS ordinal FROM documents) t WHERE path <> '' GROUP BY path")
def scan_list(spark, d):
    lines = table(spark, d, "documents").select(F.expr("CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE concat(' ', source, '/', doc_id % 40, '.safetensors ') END").alias("line"), F.col("doc_id").alias("ordinal"))
    return listing.scan_list(lines)


PATHS = Input("documents", ("doc_id AS ordinal", "concat(source, '/', doc_id % 70, CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.bin' ELSE '.safetensors' END) AS path", "doc_id % 13 <> 0 AS is_file"))


@query("scan_filter_requests", f"""
SELECT 'sha256:' || sha256(path || ':r1') AS request_id, path, 'r1' AS run_id, min(ordinal) AS ordinal FROM {PATHS.sql} p WHERE is_file AND (path LIKE '%.bin' OR path LIKE '%.safetensors') GROUP BY path HAVING path NOT LIKE 'src1/%'""")
def scan_filter_requests(spark, d):
    p = PATHS.df(spark, d)
    done = p.where("path LIKE 'src1/%'").select(ids.request_id(F.col("path"), F.lit("r1")).alias("request_id")).distinct().withColumn("state", F.lit("persisted"))
    return listing.requests(p, "r1", done)


NEAR = Input("documents", ("source AS path", "concat(lang, doc_id % 50, CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.PKL' WHEN 2 THEN '.zip' WHEN 3 THEN '.json' WHEN 4 THEN '.bin' ELSE '' END) AS name"))
KIND_SQL = "CASE " + " ".join(f"WHEN lower(regexp_extract(name, '([.][^.]+)$', 1)) IN ({', '.join(map(repr, s))}) THEN '{k}'" for k, s in listing.SIBLINGS.items()) + " END"


@query("scan_siblings", f"SELECT path, name, kind FROM (SELECT DISTINCT path, name, {KIND_SQL} AS kind FROM {NEAR.sql} n) t WHERE kind IS NOT NULL")
def scan_siblings(spark, d):
    found = NEAR.df(spark, d).groupBy("path").agg(F.collect_set("name").alias("names"))
    return found.select("path", F.inline(listing.siblings(F.col("names"))))


HEADS = Input("part", ("CAST(floor(p_partkey / 50) AS BIGINT) AS file", "p_partkey AS n", "CASE p_partkey % 9 WHEN 0 THEN 'F8' WHEN 1 THEN 'BF16' ELSE 'F32' END AS dtype", "CAST(CASE p_partkey % 10 WHEN 3 THEN -1 WHEN 4 THEN 40000 ELSE p_size END AS BIGINT) AS a", "CAST(CASE p_partkey % 10 WHEN 4 THEN 40000 ELSE 8 END AS BIGINT) AS b", "CAST(p_partkey % 50 * 100 AS BIGINT) AS s", "CAST(CASE WHEN p_partkey % 8 = 5 THEN 1 ELSE 0 END AS BIGINT) AS more", "p_partkey % 23 = 0 AS broken"))
ENDS = "s + CASE dtype WHEN 'BF16' THEN 2 ELSE 4 END * a * b + more"


@query("scan_header_entries", f"""
SELECT n, CASE WHEN broken THEN 'entry is not an object' WHEN dtype = 'F8' THEN 'unsupported dtype F8' WHEN a < 0 THEN 'invalid shape' WHEN a * b > 1000000000 THEN 'tensor too large'
  WHEN e < s OR e > 6000 THEN 'offsets out of range' WHEN e - s <> a * b * CASE dtype WHEN 'BF16' THEN 2 ELSE 4 END THEN 'byte length does not match the shape' END AS problem
FROM (SELECT *, {ENDS} AS e FROM {HEADS.sql} h) t""")
def scan_header_entries(spark, d):
    raw = F.when(F.col("broken"), F.lit("[1]")).otherwise(F.to_json(F.struct("dtype", F.array("a", "b").alias("shape"), F.array(F.col("s"), F.expr(ENDS)).alias("data_offsets"))))
    e = HEADS.df(spark, d).select("n", raw.alias("raw")).select("n", "raw", F.from_json("raw", tensorfile.ENTRY).alias("e"))
    return e.select("n", tensorfile.entry_problem(F.col("raw"), F.col("e.dtype"), F.col("e.shape"), F.col("e.data_offsets"), F.lit(6000)).alias("problem"))


TILES = Input("part", ("CAST(floor(p_partkey / 20) AS BIGINT) AS path", "CAST(p_partkey % 20 * 64 + CASE WHEN p_partkey % 370 = 5 THEN 8 ELSE 0 END AS BIGINT) AS s", "CAST(p_partkey % 20 * 64 + 64 AS BIGINT) AS e"))


@query("scan_inconsistent_file", f"SELECT path, CASE WHEN max(gap) = 1 THEN 'tensors do not follow each other' ELSE 'data after the last tensor' END AS reason FROM (SELECT path, e, (s <> lag(e, 1, 0) OVER (PARTITION BY path ORDER BY s, e))::INTEGER AS gap FROM {TILES.sql} t) u GROUP BY path HAVING max(gap) = 1 OR max(e) <> 1280")
def scan_inconsistent_file(spark, d):
    t = TILES.df(spark, d).select("path", F.lit(1288).cast("long").alias("length"), F.lit(8).cast("long").alias("data_offset"), F.array("s", "e").alias("data_offsets"))
    return tensorfile.inconsistent(t)


def _tensors(spark, d):
    k = KEYS.df(spark, d)
    a = F.col("key").contains("_A")
    shape = F.when(a, F.array("r", F.lit(64).cast("long"))).when(F.col("key").contains("lora_B") | F.col("key").contains("embedding_B"), F.array(F.lit(32).cast("long"), "r")).when(F.col("odd") == 3, F.array(F.lit(5).cast("long"))).otherwise(F.array(F.lit(16).cast("long"), F.lit(4).cast("long")))
    t = k.select(F.col("file").alias("path"), "key", "dtype", shape.alias("shape"), F.array(F.lit(0).cast("long"), F.lit(1).cast("long")).alias("data_offsets"), F.lit(0).cast("long").alias("data_offset"), F.when(F.col("dtype") == "F8", F.lit("unsupported dtype F8")).alias("problem"))
    return inventory.classified(t)


BUCKET_SQL = "CASE WHEN dtype = 'F8' THEN 'bad' WHEN role IN ('lora_A', 'lora_B', 'embedding_A', 'embedding_B') THEN 'half' WHEN role = 'dora_magnitude' THEN 'dora' WHEN role = 'trainable_tokens' THEN 'token_delta' WHEN odd = 3 THEN 'bad' ELSE 'full' END"


@query("scan_inventory", f"SELECT file AS path, bucket, count(*) AS n FROM (SELECT *, {BUCKET_SQL} AS bucket FROM {KEYED_SQL} k) t GROUP BY ALL")
def scan_inventory(spark, d):
    return _tensors(spark, d).groupBy("path", "bucket").agg(F.count("*").alias("n"))


PAIR_SQL = f"""(SELECT file AS path, base, role LIKE 'embedding%' AS transposed, min(CASE WHEN role LIKE '%_A' THEN key END) AS a, min(CASE WHEN role LIKE '%_B' THEN key END) AS b,
  min(CASE WHEN role LIKE '%_A' THEN r END) AS ra, min(CASE WHEN role LIKE '%_B' THEN r END) AS rb FROM (SELECT *, {BUCKET_SQL} AS bucket FROM {KEYED_SQL} k) t WHERE bucket = 'half' GROUP BY ALL)"""
REASON_SQL = "CASE WHEN b IS NULL THEN 'lora_A without lora_B' WHEN a IS NULL THEN 'lora_B without lora_A' WHEN ra <> rb THEN 'rank of A and B differ' END"


@query("join_ab_pairs", f"SELECT path, base, transposed, a AS a_key, b AS b_key, ra::INTEGER AS rank, {REASON_SQL} AS reason FROM {PAIR_SQL} p")
def join_ab_pairs(spark, d):
    return inventory.pairs(_tensors(spark, d)).select("path", "base", "transposed", F.col("a.key").alias("a_key"), F.col("b.key").alias("b_key"), "rank", "reason")


@query("set_covers", f"SELECT path, base, count(DISTINCT side) = 2 AS covers FROM (SELECT file AS path, base, CASE WHEN role LIKE '%_A' THEN 'A' ELSE 'B' END AS side FROM (SELECT *, {BUCKET_SQL} AS bucket FROM {KEYED_SQL} k) t WHERE bucket = 'half') u GROUP BY ALL")
def set_covers(spark, d):
    halves = inventory.halves_joined(_tensors(spark, d).where("bucket = 'half'"), ["path"])
    return halves.select("path", "base", (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("covers"))


@query("sort_pairs", f"SELECT path, base, row_number() OVER (PARTITION BY path ORDER BY coalesce({LAYER_SQL.format('base')}, -1), coalesce({EXPERT_SQL.format('base')}, -1), base)::INTEGER AS place FROM {PAIR_SQL} p WHERE {REASON_SQL} IS NULL")
def sort_pairs(spark, d):
    from pyspark.sql import Window as W

    sound = inventory.pairs(_tensors(spark, d)).where("reason IS NULL")
    w = W.partitionBy("path").orderBy(F.coalesce("location.layer", F.lit(-1)), F.coalesce("location.expert", F.lit(-1)), "base")
    return sound.select("path", "base", F.row_number().over(w).alias("place"))


@query("set_not_analyzed", f"""
SELECT file AS path, key AS tensor_key, CASE WHEN dtype = 'F8' OR bucket = 'bad' THEN 'unsupported' ELSE 'unsupported' END AS category FROM (SELECT *, {BUCKET_SQL} AS bucket FROM {KEYED_SQL} k) t WHERE bucket IN ('bad', 'full')
UNION ALL SELECT path, unnest(list_filter([a, b], lambda x: x IS NOT NULL)), 'malformed' FROM {PAIR_SQL} p WHERE {REASON_SQL} IS NOT NULL""")
def set_not_analyzed(spark, d):
    t = _tensors(spark, d)
    return inventory.not_analysed(t, inventory.pairs(t)).select("path", "tensor_key", "category")


@query("full_outer_orphans", "SELECT coalesce(o_orderkey, l_orderkey) AS k, o_orderkey IS NULL AS no_a, l_orderkey IS NULL AS no_b FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) o FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 2 = 0) l ON o_orderkey = l_orderkey")
def orphans(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("base"), F.lit("A").alias("side"))
    li = table(spark, d, "lineitem").where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("base"), F.lit("B").alias("side"))
    t = o.unionByName(li).select(F.lit(0).alias("path"), "base", "side", F.lit(False).alias("embedding"), F.lit("k").alias("key"), F.lit("F32").alias("dtype"), F.array(F.lit(1)).alias("shape"), F.array(F.lit(0)).alias("data_offsets"))
    return inventory.halves_joined(t, ["path"]).select(F.col("base").alias("k"), F.col("a").isNull().alias("no_a"), F.col("b").isNull().alias("no_b"))


HEX = "'sha256:' || sha256(concat_ws(':', {0}))"


@query("stable_ids", f"SELECT doc_id, {HEX.format('source, lang')} AS request_id, {HEX.format('text, lang, source')} AS scan_id, CASE WHEN doc_id % 3 = 0 THEN concat_ws(':', source, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'HEAD' END, 'f') ELSE lang END AS logical_id FROM documents")
def stable_ids(spark, d):
    c = F.col
    logical = ids.logical_id(F.when(c("doc_id") % 3 == 0, c("source")), F.when(c("doc_id") % 2 == 0, c("lang")), F.lit("f"), c("lang"))
    return table(spark, d, "documents").select("doc_id", ids.request_id(c("source"), c("lang")).alias("request_id"), ids.scan_id(c("text"), c("lang"), c("source")).alias("scan_id"), logical.alias("logical_id"))


@query("scan_identity", "SELECT doc_id, 'sha256:' || sha256(text) AS content_hash, strlen(text)::BIGINT AS file_size_bytes FROM documents")
def scan_identity(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.hashed(F.col("text")).alias("content_hash"), F.octet_length("text").cast("long").alias("file_size_bytes"))


SAFE = Input("documents", ("doc_id", "concat(text, chr(9), 'x', chr(7), lang, chr(10), chr(8238)) AS t"))


@query("safe_text", "SELECT doc_id, replace(replace(replace(replace(concat(text, chr(9), 'x', chr(7), lang, chr(10), chr(8238)), chr(9), '\\x09'), chr(7), '\\x07'), chr(10), '\\x0a'), chr(8238), '\\u202e') AS t FROM documents")
def safe_text(spark, d):
    t = F.concat(F.col("text"), F.lit("\tx\x07"), "lang", F.lit("\n‮"))
    return table(spark, d, "documents").select("doc_id", ids.safe_text(t).alias("t"))


@query("format_codes", "SELECT page_id, left(url, 20) AS short, replace(list_reduce(list_transform(string_split(lower(replace(split_part(url, '/', 3), '.', '_')), '_'), lambda p: upper(left(p, 1)) || p[2:]), lambda a, b: a || b), ' ', '') AS camel FROM pages")
def format_codes(spark, d):
    host = F.replace(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("."), F.lit("_"))
    return table(spark, d, "pages").select("page_id", ids.shortened(F.col("url"), 20).alias("short"), ids.camel(host).alias("camel"))


CODES = Input("events", ("event_id", "CASE event_id % 7 WHEN 0 THEN 'TRUNCATED_FILE' WHEN 1 THEN 'SVD_FAILED' WHEN 2 THEN 'METADATA_DEPTH_EXCEEDED' WHEN 3 THEN 'NO_LORA_PAIRS' ELSE 'OTHER' END AS code", "CASE event_id % 3 WHEN 0 THEN 'malformed' WHEN 1 THEN 'unsupported' ELSE 'degraded' END AS category"))


@query("infer_error_severity", f"SELECT event_id, CASE WHEN code IN ('TRUNCATED_FILE', 'NO_LORA_PAIRS') THEN 'fatal' WHEN code = 'SVD_FAILED' THEN 'degraded' WHEN code = 'METADATA_DEPTH_EXCEEDED' THEN 'warning' WHEN category IN ('malformed', 'unsupported') THEN 'fatal' ELSE 'degraded' END AS severity FROM {CODES.sql} c")
def error_severity(spark, d):
    return CODES.df(spark, d).select("event_id", ids.error_severity(F.col("code"), F.col("category")).alias("severity"))


EXITS = Input("events", ("event_id", "CASE event_id % 4 WHEN 0 THEN 'failed' ELSE 'ok' END AS status", "CASE event_id % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'review' ELSE 'block' END AS action", "CASE event_id % 5 WHEN 0 THEN 'review' WHEN 1 THEN 'block' ELSE NULL END AS fail_on"))
REACHED = "coalesce(array_position(['allow', 'review', 'block'], action) >= array_position(['allow', 'review', 'block'], fail_on), false)"


@query("policy_exit_code", f"SELECT event_id, CASE WHEN status = 'failed' THEN 1 WHEN {REACHED} THEN 2 ELSE 0 END::INTEGER AS scan, CASE WHEN {REACHED} THEN 2 WHEN status = 'failed' THEN 1 ELSE 0 END::INTEGER AS batch FROM {EXITS.sql} e")
def exit_code(spark, d):
    c = F.col
    return EXITS.df(spark, d).select("event_id", ids.exit_code(c("status"), c("action"), c("fail_on")).alias("scan"), ids.exit_code(c("status"), c("action"), c("fail_on"), True).alias("batch"))


@query("scan_results_jsonl", "SELECT k, count(*) AS n FROM (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_id % 10 <> 0) t GROUP BY k")
def scan_results_jsonl(spark, d):
    """Lines of which every tenth is broken."""
    line = F.when(F.col("event_id") % 10 == 0, F.left("props", F.lit(3))).otherwise(F.col("props"))
    return documents.sound_rows(table(spark, d, "events").select(line.alias("value")), "k int").groupBy("k").agg(F.count("*").alias("n"))


@query("scan_result_doc", "SELECT event_id, CAST(event_id % 4 AS VARCHAR) || '.0' AS version FROM events WHERE event_id % 4 = 2")
def scan_result_doc(spark, d):
    version = F.concat((F.col("event_id") % 4).cast("string"), F.lit(".0"))
    docs = table(spark, d, "events").select("event_id", version.alias("version"), F.to_json(F.struct(version.alias("schema_version"))).alias("document"))
    return documents.supported(docs).select("event_id", "version")


@query("scan_latencies", "SELECT round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, count(*) AS n FROM (SELECT value AS ms FROM events WHERE event_type <> 'view') t")
def scan_latencies(spark, d):
    docs = table(spark, d, "events").where("event_type <> 'view'").select(F.to_json(F.struct(F.struct(F.col("value").alias("wall_time_ms")).alias("scan"))).alias("document"))
    return documents.latencies(docs).agg(r6(F.percentile("ms", F.lit(0.5))).alias("p50"), r6(F.percentile("ms", F.lit(0.95))).alias("p95"), F.count("*").alias("n"))


@query("scan_tensor_key_sample", f"SELECT file AS path, array_to_string(list(key ORDER BY n)[1:5], ',') AS keys FROM {KEYS.sql} k GROUP BY file")
def scan_tensor_key_sample(spark, d):
    lists = KEYS.df(spark, d).groupBy(F.col("file").alias("path")).agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("e"))
    head = F.concat(F.lit("{"), F.array_join(F.transform("e", lambda e: F.concat(F.lit('"'), e["key"], F.lit('": {}'))), ", "), F.lit("}"))
    return documents.key_sample(lists.select("path", head.alias("header")), 5).select("path", F.array_join("keys", ",").alias("keys"))
