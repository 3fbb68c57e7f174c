"""A corpus of adapters: list, leave out what is done or cached, scan the rest, store, and report. All state is in tables below one folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import state
from ..sinks import reports
from ..sources import listing, tensorfile
from . import scan as scans


class Workspace:
    """Tables below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def read(self, name: str, schema: str) -> DataFrame:
        """A table, empty before its first row; a broken one is an error."""
        files, path = self._path(name)
        if not files.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def clear(self) -> None:
        """Deletes the intermediate tables; what run() returned is one of them."""
        files, path = self._path("work")
        files.delete(path, True)

    def append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").parquet(f"{self.folder}/{name}")

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/work/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


MANIFEST = "request_id string, run_id string, adapter_path string, state string, retry_count int, content_hash string, lease_expires_at timestamp, ts timestamp, error_message string"
CACHE = "content_hash string, config_hash string, schema_version string, writer_version string, cached_at timestamp, ttl_days int, payload string, payload_hash string"


RESULTS = "scan_id string, stable_hash string, document string, stored_at timestamp, run_id string"
#: What may differ between two documents of one scan.
VOLATILE = ("started_at", "completed_at", "wall_time_ms", "run_id")


def event(requests: DataFrame, name, error=None) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    return requests.select("request_id", "run_id", F.col("path").alias("adapter_path"), (F.lit(name) if isinstance(name, str) else name).alias("state"), "retry_count", none("string").alias("content_hash"), none("timestamp").alias("lease_expires_at"), F.current_timestamp().alias("ts"), (none("string") if error is None else error).alias("error_message"))


def _requests(work: Workspace, paths: DataFrame, settings: scans.Settings, force: bool) -> DataFrame:
    """What is to do, with retry_count. Requests that an interrupted run left open are taken up again, or fail at the retry limit."""
    found = listing.resolved(paths)
    if force:
        return listing.requests(found, settings.run_id, None).withColumn("retry_count", F.lit(0))
    known = work.written(state.latest(work.read("manifest", MANIFEST)).where(F.col("run_id") == settings.run_id), "known")
    open_ = work.written(state.resume(known.where(~F.col("state").isin(state.TERMINAL))), "open")
    over = open_.where("state = 'failed'")
    work.append(over.withColumn("ts", F.current_timestamp()), "manifest")
    retries = open_.where("state = 'queued'").select("request_id", F.col("retry_count").alias("_n"))
    wanted = listing.requests(found, settings.run_id, known.unionByName(over))
    return wanted.join(retries, "request_id", "left").withColumn("retry_count", F.coalesce("_n", F.lit(0))).drop("_n")


def run(work: Workspace, paths: DataFrame, settings: scans.Settings = scans.Settings(), profiles: scans.Profiles | None = None, force: bool = False) -> DataFrame:
    """Outcomes of a batch: path, request_id, run_id, outcome, status, action, stored (new, unchanged or conflict).

    paths has (path, ordinal). Finished requests of the run are left out unless forced. Of files of equal content, configuration
    and neighbours in a run one is scanned, and the others are skipped_duplicate; what the cache holds is a cached_hit. All documents go to the
    log; the table of results takes those that are new or that differ from what it has for the scan.
    """
    wanted = work.written(_requests(work, paths, settings, force), "requests")
    work.append(event(wanted, "queued"), "manifest")
    near = listing.configs(listing.beside(wanted))
    key = F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", F.lit(f"{settings.mode};{settings.policy};{scans.ANALYZER_VERSION}"), F.coalesce("config_text", F.lit("")), F.array_join(F.transform("siblings", lambda s: s["name"]), ",")), 256))
    keyed = work.written(state.without_duplicates(wanted.join(tensorfile.identity(wanted).select("path", "content_hash"), "path").join(near.select("path", key.alias("config_hash")), "path"), state.CACHE_KEY), "keyed")
    own = keyed.where("state = 'queued'").drop("state")
    cache = work.read("cache", CACHE) if not force else work.read("cache", CACHE).limit(0)
    probed = work.written(state.cache_probe(own, state.latest(cache.withColumn("_k", F.struct(*state.CACHE_KEY)), "_k", ("cached_at",)).drop("_k"), F.current_timestamp(), scans.SCHEMA_VERSION), "probed")
    fresh = work.written(scans.scan(probed.where("cached IS NULL"), settings, profiles, work.written), "scanned")
    document = F.struct(*(c for c in reports.DOCUMENT if c in fresh.columns))
    new = fresh.select("path", "scan.scan_id", state.stable_hash(document, VOLATILE).alias("stable_hash"), F.to_json(document).alias("document"), "status", F.col("verdict.action").alias("action"))
    new = work.written(new, "new")
    hits = probed.where("cached IS NOT NULL")
    field = lambda at: F.get_json_object("cached", at)
    again = hits.select("path", field("$.scan.scan_id").alias("scan_id"), F.lit(None).cast("string").alias("stable_hash"), F.col("cached").alias("document"), field("$.status").alias("status"), field("$.verdict.action").alias("action"))
    # equal documents are not written twice
    stored = state.latest(work.read("results", RESULTS), "scan_id", ("stored_at",))
    compared = work.written(state.compare_with_stored(new.select("scan_id", "stable_hash").distinct(), stored), "compared")
    to_write = new.join(compared.where("outcome <> 'unchanged'").select("scan_id"), "scan_id", "left_semi").dropDuplicates(["scan_id"])
    reports.write_results(to_write.select("scan_id", "stable_hash", "document", F.current_timestamp().alias("stored_at"), F.lit(settings.run_id).alias("run_id")), f"{work.folder}/results")
    reports.append_log(new.unionByName(again), f"{work.folder}/log")
    rows = new.join(own.select("path", "content_hash", "config_hash"), "path").withColumn("payload", F.col("document"))
    work.append(state.cache_rows(rows.where("content_hash IS NOT NULL"), F.current_timestamp(), scans.SCHEMA_VERSION), "cache")
    names = keyed.select("path", "request_id", "run_id", "retry_count")
    none = F.lit(None).cast("string")
    done = new.join(compared.withColumnRenamed("outcome", "stored"), "scan_id", "left").select("path", state.outcome(F.col("status"), F.lit(False)).alias("outcome"), "status", "action", "stored")
    done = done.unionByName(again.select("path", state.outcome(F.col("status"), F.lit(True)).alias("outcome"), "status", "action", F.lit("unchanged").alias("stored")))
    done = done.unionByName(keyed.where("state = 'skipped_duplicate'").select("path", F.col("state").alias("outcome"), none.alias("status"), none.alias("action"), none.alias("stored")))
    out = work.written(names.join(done, "path"), "outcomes")
    work.append(event(out, F.col("outcome")), "manifest")
    return out.drop("retry_count")


def exit_code(outcomes: DataFrame, threshold: str | None) -> int:
    """2 if an action reaches the threshold, else 1 if a file failed, else 0."""
    limit = ids.ACTIONS.index(threshold) if threshold else len(ids.ACTIONS)
    row = outcomes.agg(F.max(ids.action_rank(F.col("action"))), F.bool_or(F.col("status") == "failed")).first()
    return 2 if row[0] is not None and row[0] >= limit else 1 if row[1] else 0
