"""How the operators are bound to tables: a query, its DuckDB SQL, and inputs that both sides derive by the same expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


@dataclass(frozen=True)
class Input:
    """Rows of a table by expressions that mean the same in both dialects."""

    source: str
    columns: tuple[str, ...]
    where: str = "true"

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(self.columns)} FROM {self.source} WHERE {self.where})"

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, self.source).where(self.where).selectExpr(*self.columns)


def values(spark: SparkSession, sql_rows: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {sql_rows} AS t({names})")


def factors(v: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of A and of B from blocks of `size` vectors, so that all are used; the last block begins early enough to be full."""
    starts = sorted({*range(0, len(v) - size + 1, size), max(len(v) - size, 0)})
    parts = [v[i : i + size] for i in starts]
    return [(p[: (len(p) + 1) // 2], p[len(p) // 2 :]) for p in parts]


#: Embeddings as factors A (4 x 8) and B (8 x 4) of small whole numbers, whose products are exact in both engines; and the 64 entries of B*A.
_W = "floor(embedding[{0}]::DOUBLE * 32)"
ENTRIES_SQL = f"(SELECT vec_id, label, i, j, list_sum(list_transform(range(0, 4), lambda k: {_W.format('33 + 4 * i + k')} * {_W.format('1 + 8 * k + j')})) AS w FROM embeddings, range(8) t(i), range(8) u(j))"
FACTORS_SQL = f"(SELECT vec_id, k, j, {_W.format('1 + 8 * k + j')} AS a, {_W.format('33 + 4 * j + k')} AS b FROM embeddings, range(4) t(k), range(8) u(j))"


def update_of(embedding) -> "lowrank.Update":
    from ..operators import lowrank

    v = np.floor(np.asarray(embedding, np.float64) * 32)
    return lowrank.Update(v[:32].reshape(4, 8), v[32:].reshape(8, 4))


def of_updates(df: DataFrame, columns: list[str], schema: str, rows) -> DataFrame:
    """rows(batch row, update of its embedding) of each row of df, as the schema has it."""

    def each(batches):
        import pandas as pd

        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            yield pd.DataFrame([r for b in batch.itertuples(index=False) for r in rows(b, update_of(b.embedding))], columns=names)

    return df.select(*columns, "embedding").mapInPandas(each, schema)


def r6(c) -> "F.Column":
    """Rounded to what both engines' sums agree on."""
    return F.round(c, 6)


# A tensor key for each part, in files of 48.
_L = "CAST(floor(p_partkey / 12) AS BIGINT) % 24"
KEYS = Input("part", (
    "CAST(floor(p_partkey / 288) AS BIGINT) AS file", "p_partkey AS n",
    f"""CASE p_partkey % 12
    WHEN 0 THEN concat('base_model.model.model.layers.', {_L}, '.self_attn.q_proj.lora_A.weight')
    WHEN 1 THEN concat('base_model.model.model.layers.', {_L}, '.self_attn.q_proj.lora_B.weight')
    WHEN 2 THEN concat('base_model.model.model.layers.', {_L}, '.mlp.down_proj.lora_A.default.weight')
    WHEN 3 THEN concat('base_model.model.model.layers.', {_L}, '.mlp.down_proj.lora_B.default.weight')
    WHEN 4 THEN concat('base_model.model.vision.blocks.', {_L}, '.fc1.lora_A.weight')
    WHEN 5 THEN concat('base_model.model.model.layers.', {_L}, '.mlp.experts.', p_partkey % 4, '.w1.lora_B.weight')
    WHEN 6 THEN concat('base_model.model.model.embed_tokens', {_L}, '.lora_embedding_A')
    WHEN 7 THEN concat('base_model.model.model.layers.', {_L}, '.self_attn.q_proj.lora_magnitude_vector.weight')
    WHEN 8 THEN concat('base_model.model.model.h.', {_L}, '.wte.trainable_tokens_delta')
    WHEN 9 THEN concat('base_model.model.lm_head', {_L}, '.weight')
    WHEN 10 THEN concat('base_model.model.model.layers.', {_L}, '.mlp.gate.lora_A.weight')
    ELSE concat('base_model.model.model.layers.', {_L}, '.mlp.gate.lora_B.weight') END AS key""",
    f"CASE WHEN {_L} = 7 THEN 'F8' WHEN p_partkey % 2 = 0 THEN 'F32' ELSE 'BF16' END AS dtype",
    f"CAST(CASE WHEN p_partkey % 12 = 1 AND {_L} = 5 THEN 4 ELSE 8 END AS BIGINT) AS r", "CAST(p_partkey % 7 AS BIGINT) AS odd",
))

# Four-layer forms of the same, in SQL for the oracle.
S = "(?:[.][A-Za-z0-9_-]+)?"
FORMS = {
    "lora_A": f"^(.+)[.]lora_A{S}[.]weight$", "lora_B": f"^(.+)[.]lora_B{S}[.]weight$", "embedding_A": f"^(.+)[.]lora_embedding_A{S}$", "embedding_B": f"^(.+)[.]lora_embedding_B{S}$",
    "dora_magnitude": f"^(.+)[.]lora_magnitude_vector{S}(?:[.]weight)?$", "trainable_tokens": f"^(.+)[.]trainable_tokens_(?:delta|original){S}$",
}
ROLE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(key, '{p}') THEN '{r}'" for r, p in FORMS.items()) + " ELSE 'other' END"
BASE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(key, '{p}') THEN regexp_extract(key, '{p}', 1)" for p in FORMS.values()) + " END"
KEYED_SQL = f"(SELECT *, {ROLE_SQL} AS role, {BASE_SQL} AS base FROM {KEYS.sql} k0)"
NAME_SQL = "coalesce(list_filter(string_split({0}, '.'), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+$'))[-1], {0})"

# A module for each embedding: its label is the family, its place among those of the label the layer.
EMBEDDED_SQL = """(SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS layer FROM embeddings)"""


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as modules: path, base, module, stack, layer, expert, kind, energy and the features that a vector has."""
    from pyspark.sql import Window as W

    from ..functions import stats
    from ..operators import compare

    e = table(spark, sf_dir, "embeddings")
    x = F.col("embedding")
    none = F.lit(None).cast("double")
    # the norms of the columns of a vector as a matrix of two rows
    folded = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.sqrt(F.get(x, i).cast("double") * F.get(x, i) + F.get(x, i + 32).cast("double") * F.get(x, i + 32)))
    own = {"log_rms": stats.log(stats.total(x, lambda v: F.abs(v))), "kurt_dw": stats.kurtosis(x), "row_hoyer": stats.hoyer(x), "row_top8": stats.top_share(x), "col_hoyer": stats.hoyer(folded)}
    # the features first, while the rows are spread; only then do a label's rows meet for their places
    wide = e.select("vec_id", "label", stats.total(x, lambda v: F.abs(v)).alias("energy"), *(own.get(f, none).alias(f) for f in stats.ALL_FEATURES))
    placed = wide.withColumn("layer", (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).cast("int"))
    out = placed.select(F.lit("all").alias("path"), F.col("vec_id").cast("string").alias("base"), F.concat(F.lit("m"), F.col("label").cast("string")).alias("module"), F.lit("").alias("stack"), "layer", F.lit(None).cast("int").alias("expert"), F.when(F.col("label") % 2 == 0, "attention").otherwise("mlp").alias("kind"), "energy", *stats.ALL_FEATURES)
    return compare.with_family(out)



_X = "list_transform(embedding, lambda v: v::DOUBLE)"
MODULES_SQL = f"""(
SELECT vec_id, 'm' || label AS family, layer, CASE WHEN label % 2 = 0 THEN 'attention' ELSE 'mlp' END AS kind, l1 AS energy, ln(l1) AS log_rms,
  (sqrt(64) - l1 / sqrt(l2)) / (sqrt(64) - 1) AS row_hoyer,
  list_sum(list_reverse_sort(list_transform(x, lambda v: v * v))[1:8]) / l2 AS row_top8,
  (list_sum(list_transform(x, lambda v: pow(v - l0 / 64, 4))) / 64) / pow(list_sum(list_transform(x, lambda v: pow(v - l0 / 64, 2))) / 64, 2) AS kurt_dw,
  (sqrt(32) - list_sum(list_transform(range(1, 33), lambda i: sqrt(x[i] * x[i] + x[i + 32] * x[i + 32]))) / sqrt(l2)) / (sqrt(32) - 1) AS col_hoyer
FROM (SELECT vec_id, label, layer, x, list_sum(x) AS l0, list_sum(list_transform(x, lambda v: abs(v))) AS l1, list_sum(list_transform(x, lambda v: v * v)) AS l2
  FROM (SELECT vec_id, label, layer, {_X} AS x FROM {EMBEDDED_SQL} e0) e1) e2)"""
LONG_SQL = f"""(SELECT vec_id, family, layer, feature, raw, CASE WHEN feature IN ('kurt_dw', 'row_top8') THEN CASE WHEN raw > 0 THEN ln(raw) END ELSE raw END AS value
FROM (UNPIVOT {MODULES_SQL} ON log_rms, kurt_dw, row_hoyer, row_top8, col_hoyer INTO NAME feature VALUE raw) u0)"""
Z_SQL = f"""
WITH p AS MATERIALIZED (SELECT * FROM {LONG_SQL} l0 QUALIFY count(*) OVER (PARTITION BY family, feature) >= 16),
slopes AS (SELECT a.family, a.feature, median((b.value - a.value) / (b.layer - a.layer)) AS slope FROM p a JOIN p b ON a.family = b.family AND a.feature = b.feature AND b.layer > a.layer GROUP BY ALL),
mids AS (SELECT family, feature, median(layer) AS mx, median(value) AS my FROM p GROUP BY ALL),
res AS (SELECT p.*, value - (my - slope * mx + slope * layer) AS residual FROM p JOIN slopes USING (family, feature) JOIN mids USING (family, feature)),
med AS (SELECT family, feature, median(residual) AS med FROM res GROUP BY ALL),
sc AS (SELECT family, feature, any_value(med) AS med, median(abs(residual - med)) AS mad, avg(abs(residual - med)) AS aad FROM res JOIN med USING (family, feature) GROUP BY ALL),
z AS (SELECT vec_id, family, layer, feature, raw, (residual - med) / CASE WHEN mad > 0 THEN 1.4826 * mad ELSE 1.2533 * aad END AS z FROM res JOIN sc USING (family, feature) WHERE mad > 0 OR aad > 0),
m AS (SELECT vec_id, family, layer, max(abs(z)) AS max_abs_z, count(*) AS n, min(z) FILTER (WHERE feature IN ('kurt_dw', 'row_top8', 'row_hoyer')) AS cz, count(*) FILTER (WHERE feature IN ('kurt_dw', 'row_top8', 'row_hoyer')) AS nc FROM z GROUP BY ALL)
"""
# Scored rows: documents with toxicity as the label.
SCORED_COLUMNS = "l.toxic AS label, d.lang AS attack, d.n_chars::DOUBLE AS score, (1 + d.n_chars % 97) / 100.0::DOUBLE AS p_value, 0.05::DOUBLE AS alpha_block, 0.1::DOUBLE AS alpha_review"
SCORED_SQL = f"(SELECT {SCORED_COLUMNS} FROM labels l JOIN documents d USING (doc_id))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    j = table(spark, sf_dir, "labels").join(d, "doc_id")
    return j.select(F.col("toxic").cast("int").alias("label"), F.col("lang").alias("attack"), F.col("n_chars").cast("double").alias("score"), ((1 + F.col("n_chars") % 97) / F.lit(100.0)).alias("p_value"), F.lit(0.05).alias("alpha_block"), F.lit(0.1).alias("alpha_review"))
