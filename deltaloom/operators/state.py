"""Job state as an append-only table of events, a result cache, and sinks that tell equal results from conflicting ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids

# Fixed values.
TERMINAL = ["persisted", "cached_hit", "skipped_duplicate", "failed"]
MAX_RETRIES = 3
QUEUE_BATCH = 256
RETRY_MESSAGE = "retry limit exceeded"
WRITER_VERSION = "1"


def latest(events: DataFrame, key: str = "request_id", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The last event of each key: an aggregate, so a crowded key is reduced before any shuffle."""
    rest = [c for c in events.columns if c != key]
    top = F.max_by(F.struct(*rest), F.struct(*order))
    return events.groupBy(key).agg(top.alias("_l")).select(key, "_l.*").select(events.columns)


def state_counts(manifest: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return manifest.groupBy(*(keys or []), "state").agg(F.count("*").alias("n"))


def transitions(events: DataFrame, key: str = "request_id", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """before, after, n: how often a state follows another in the events of a key."""
    steps = events.withColumn("before", F.lag("state").over(W.partitionBy(key).orderBy(*order))).where("before IS NOT NULL")
    return steps.groupBy("before", F.col("state").alias("after")).agg(F.count("*").alias("n"))


def hit_counts(hits: DataFrame, key: list[str], at: str) -> DataFrame:
    """key, hits and the last hit of a cache's log: counted when asked for, so that a hit is one appended row."""
    return hits.groupBy(*key).agg(F.count("*").alias("hits"), F.max(at).alias("last"))


def resume(manifest: DataFrame) -> DataFrame:
    """Rows that aren't terminal go back to the queue with one retry more, or fail at the limit."""
    open_ = ~F.col("state").isin(TERMINAL)
    retries = F.col("retry_count") + open_.cast("int")
    over = open_ & (retries >= MAX_RETRIES)
    state = F.when(over, "failed").when(open_, "queued").otherwise(F.col("state"))
    message = F.when(over, F.lit(RETRY_MESSAGE)).otherwise(F.col("error_message"))
    return manifest.withColumns({"state": state, "error_message": message, "retry_count": retries.cast("int")})


def queue(manifest: DataFrame, run_id: Column | None = None, most: int = QUEUE_BATCH, order: tuple[str, ...] = ("adapter_path",)) -> DataFrame:
    """The next requests: a top-k of the queued ones, by path unless another order is given."""
    q = manifest.where("state = 'queued'")
    return (q if run_id is None else q.where(F.col("run_id") == run_id)).orderBy(*order).limit(most)


def expired_leases(manifest: DataFrame, now: Column) -> DataFrame:
    return manifest.where((F.col("state") == "leased") & (F.col("lease_expires_at") < now))


def upsert(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of changes replace those of the same key."""
    return table.join(changes.select(*key), key, "left_anti").unionByName(changes)


def unfinished(requests: DataFrame, manifest: DataFrame) -> DataFrame:
    return requests.join(manifest.where(F.col("state").isin(TERMINAL)).select("request_id"), "request_id", "left_anti")


def without_duplicates(requests: DataFrame, content: list[str] | None = None) -> DataFrame:
    """requests with state: of equal content in a run, one is queued and the others are skipped_duplicate. Rows of unknown content are queued."""
    content = content or ["content_hash"]
    known = F.col("content_hash").isNotNull()
    first = requests.where(known).groupBy("run_id", *content).agg(F.min("request_id").alias("_first"))
    joined = requests.join(first, ["run_id", *content], "left")
    return joined.withColumn("state", F.when(F.col("request_id") == F.coalesce("_first", "request_id"), "queued").otherwise("skipped_duplicate")).drop("_first").select(*requests.columns, "state")


CACHE_KEY = ["content_hash", "config_hash"]


def payload_hash(payload: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(payload, 256))


def intact(payload: Column, stored_hash: Column) -> Column:
    """Whether a stored payload still is what was hashed when it was stored."""
    return payload_hash(payload) == stored_hash


def cache_probe(requests: DataFrame, cache: DataFrame, now: Column, schema_version: str, writer_version: str = WRITER_VERSION) -> DataFrame:
    """requests with cached (the stored payload, or null) and miss: why there is none. Age, version and integrity are checked on reading."""
    entry = cache.select(*CACHE_KEY, "schema_version", "writer_version", "cached_at", "ttl_days", "payload", "payload_hash")
    joined = requests.join(entry, CACHE_KEY, "left")
    miss = (
        F.when(F.col("payload").isNull(), "absent")
        .when((F.col("schema_version") != schema_version) | (F.col("writer_version") != writer_version), "version")
        .when(ids.expired(F.col("cached_at"), now, F.col("ttl_days")), "expired")
        .when(~intact(F.col("payload"), F.col("payload_hash")), "tampered")
    )
    out = joined.withColumn("miss", miss).withColumn("cached", F.when(F.col("miss").isNull(), F.col("payload")))
    return out.select(*requests.columns, "cached", "miss")


def cache_rows(results: DataFrame, now: Column, schema_version: str, ttl_days: int | None = None) -> DataFrame:
    """What to store of results (content_hash, config_hash, status, payload); failed ones are not kept."""
    kept = results.where("status <> 'failed'").dropDuplicates(CACHE_KEY)
    return kept.select(*CACHE_KEY, F.lit(schema_version).alias("schema_version"), F.lit(WRITER_VERSION).alias("writer_version"), now.alias("cached_at"), F.lit(ttl_days).cast("int").alias("ttl_days"), "payload", payload_hash(F.col("payload")).alias("payload_hash"))


def cache_stats(cache: DataFrame, hits: DataFrame) -> DataFrame:
    """entries, hits: hits are counted from their log."""
    return cache.agg(F.count("*").alias("entries")).join(hits.agg(F.count("*").alias("hits")))


def stable_hash(document: Column, timing: tuple[str, ...] = ("started_at", "completed_at", "wall_time_ms")) -> Column:
    """A hash of a document (struct with scan) without its times."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(document.withField("scan", document["scan"].dropFields(*timing))), 256))


def compare_with_stored(new: DataFrame, stored: DataFrame, key: str = "scan_id", hash_col: str = "stable_hash") -> DataFrame:
    """key, outcome: new, unchanged (nothing to write) or conflict (written, and reported)."""
    old = stored.select(key, F.col(hash_col).alias("_old"))
    outcome = F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col(hash_col), "unchanged").otherwise("conflict")
    return new.join(old, key, "left").select(key, outcome.alias("outcome"))


def outcome(status: Column, cached: Column) -> Column:
    """Where a result goes: failed ones are only logged, cached ones are not stored again."""
    return F.when(status == "failed", "failed").when(cached, "cached_hit").otherwise("persisted")


def run_summary(results: DataFrame) -> DataFrame:
    """run_id, n, and how many of the last result of each scan say allow, review and block."""
    last = latest(results.select("scan_id", "run_id", "action", "completed_at"), "scan_id", ("completed_at",))
    counts = [F.count_if(F.col("action") == a).alias(a) for a in ids.ACTIONS]
    return last.groupBy("run_id").agg(F.count("*").alias("n"), *counts)
