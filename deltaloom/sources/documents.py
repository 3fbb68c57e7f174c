"""Readers of stored documents: explicit schemas, unknown fields dropped, broken lines skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DUMP = "repo string, family string, base string, n_layers int, rank int, modules array<struct<m:string,l:int,e:int,k:string,f:map<string,double>>>"
SURVEY = "repo_id string, status string, action string, level string, base_family string, reason_codes array<string>, max_robust_z double, wall_time_ms long, top_findings array<string>"
METRICS = "scenario string, n long, wall_s double, per_min double, p50 double, p95 double, p99 double, error_rate double, mb_per_worker double"
MAJOR = "2."


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that fit the schema, with `ordinal`; blank and broken ones are skipped."""
    text = spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id())
    return sound_rows(text, schema)


def tolerant(text: str, schema: str) -> Column:
    """The fields of the schema: unknown ones are dropped, missing ones are null."""
    return F.from_json(text, schema)


def sound_rows(lines: DataFrame, schema: str, text: str = "value") -> DataFrame:
    """The fields of the schema and the other columns, of lines that hold an object."""
    sound = F.trim(text).startswith("{") & F.try_parse_json(text).isNotNull()
    rest = [c for c in lines.columns if c != text]
    return lines.where(sound).select(tolerant(text, schema).alias("_d"), *rest).select("_d.*", *rest)


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """One object, or a list of them."""
    return spark.read.schema(METRICS).option("multiLine", True).json(path)


def supported(documents: DataFrame, text: str = "document") -> DataFrame:
    """Documents of the major version that this reader knows."""
    return documents.where(F.get_json_object(text, "$.schema_version").startswith(MAJOR))


def eval_rows(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Manifest rows (label, attack, scan_path, ordinal) with their result documents; a row without one is an error of the manifest."""
    return manifest.join(results, manifest["scan_path"] == results["path"], "left").drop("path")


def latencies(documents: DataFrame, text: str = "document") -> DataFrame:
    return documents.select(F.get_json_object(text, "$.scan.wall_time_ms").try_cast("double").alias("ms")).where("ms IS NOT NULL")


def key_sample(headers: DataFrame, n: int) -> DataFrame:
    """path, keys: the first keys of each header; none for an unreadable file."""
    keys = F.map_keys(F.from_json("header", "map<string,string>"))
    return headers.select("path", F.coalesce(F.slice(F.filter(keys, lambda k: k != "__metadata__"), 1, n), F.array().cast("array<string>")).alias("keys"))
