"""The inventory of a file: every tensor in exactly one bucket, halves joined to pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..sources.tensorfile import MAX_RANK

BUCKETS = {"lora_A": "half", "lora_B": "half", "embedding_A": "half", "embedding_B": "half", "dora_magnitude": "dora", "trainable_tokens": "token_delta"}


def classified(tensors: DataFrame) -> DataFrame:
    """tensors (with key and problem) with role, base, side, embedding and bucket: half, dora, token_delta, full or bad."""
    role = names.role(F.col("key"))
    out = tensors.withColumn("role", role).withColumn("base", F.coalesce(names.base(F.col("key")), F.regexp_replace("key", "[.](weight|bias)$", "")))
    bucket = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in BUCKETS.items() for x in kv)), F.col("role")), F.lit("full"))
    rank = F.size("shape")
    bucket = F.when(F.col("problem").isNotNull(), "bad").when((bucket == "full") & (rank < 2), "bad").otherwise(bucket)
    problem = F.coalesce("problem", F.when((F.col("role") == "other") & (rank < 2), F.lit("not a weight matrix")))
    return out.withColumns({"bucket": bucket, "problem": problem, "side": F.when(F.col("role").endswith("_A"), "A").when(F.col("role").endswith("_B"), "B"), "embedding": F.col("role").startswith("embedding")})


def pair_problem(shape_a, shape_b):
    """Why two halves are no pair; null if they are."""
    r = F.get(shape_a, F.lit(0))
    return (
        F.when((F.size(shape_a) != 2) | (F.size(shape_b) != 2), "lora factors must be matrices")
        .when(r != F.get(shape_b, F.lit(1)), "rank of A and B differ")
        .when((r < 1) | (r > MAX_RANK), "rank out of range")
    )


def halves_joined(tensors: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each (keys, base, embedding): structs a and b of its halves (null if there is none), duplicates counted."""
    half = F.struct("key", "dtype", "shape", "data_offsets")
    side = lambda s: F.min_by(half, F.when(F.col("side") == s, F.col("key")))
    return tensors.where("side IS NOT NULL").groupBy(*keys, "base", "embedding").agg(side("A").alias("a"), side("B").alias("b"))


def pairs(tensors: DataFrame) -> DataFrame:
    """path, data_offset, base, transposed, a, b, rank, location, reason (null for a sound pair) of classified tensors."""
    joined = halves_joined(tensors.where("bucket = 'half'"), ["path", "data_offset"])
    reason = F.when(F.col("b").isNull(), "lora_A without lora_B").when(F.col("a").isNull(), "lora_B without lora_A").otherwise(pair_problem(F.col("a.shape"), F.col("b.shape")))
    return joined.select("path", "data_offset", "base", F.col("embedding").alias("transposed"), "a", "b", F.get("a.shape", F.lit(0)).cast("int").alias("rank"), names.location(F.col("base")).alias("location"), reason.alias("reason"))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of pairs by layer and expert (none first) and path."""
    return rows.orderBy("path", F.coalesce("location.layer", F.lit(-1)), F.coalesce("location.expert", F.lit(-1)), "base")


def not_analysed(tensors: DataFrame, paired: DataFrame) -> DataFrame:
    """path, tensor_key, reason, category of all tensors that no analysis reads: unsound, orphan, badly paired, or full weights."""
    bad = tensors.where("bucket = 'bad'").select("path", F.col("key").alias("tensor_key"), F.col("problem").alias("reason"), F.when(F.col("problem").startswith("unsupported") | (F.col("problem") == "not a weight matrix"), "unsupported").otherwise("malformed").alias("category"))
    broken = paired.where("reason IS NOT NULL").select("path", F.explode(F.array_compact(F.array("a.key", "b.key"))).alias("tensor_key"), "reason", F.lit("malformed").alias("category"))
    full = tensors.where("bucket = 'full'").select("path", F.col("key").alias("tensor_key"), F.lit("full weight matrix; needs the base model").alias("reason"), F.lit("unsupported").alias("category"))
    return bad.unionByName(broken).unionByName(full)
