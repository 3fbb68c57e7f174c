"""New adapter files and job events as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import state
from ..plans import batch
from ..plans import scan as scans

FILES = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """path, mtime, length of adapter files as they appear; their content is pruned."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.safetensors").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(folder)
    return files.select("path", F.col("modificationTime").alias("mtime"), "length")


def scan_stream(work: batch.Workspace, folder: str, checkpoint: str, settings: scans.Settings = scans.Settings()) -> StreamingQuery:
    """Every batch of new files is a run of the batch plan: what is finished or cached is left out, so a replayed batch changes nothing."""

    def one(files: DataFrame, _: int) -> None:
        batch.run(work, files.select("path", F.lit(0).cast("long").alias("ordinal")), settings)

    return new_files(work.spark, folder).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """request_id, state, ts of the last event of each request: an aggregation that a stream updates."""
    return events.withWatermark("ts", late).groupBy("request_id").agg(F.max_by("state", "ts").alias("state"), F.max("ts").alias("ts"))


def state_windows(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """start, state, n, total of events (ts, state, value) by event time; late ones are taken up to the watermark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "state").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "state", "n", "total")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end, n of runs of events without a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upserts(spark: SparkSession, events: DataFrame, folder: str, checkpoint: str, after: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Events are appended to the manifest once each; the latest state is a view of it."""

    def one(rows: DataFrame, _: int) -> None:
        known = batch.Workspace(spark, folder).read("manifest", batch.MANIFEST)
        new = rows.dropDuplicates(["request_id", "state", "ts"]).join(known, ["request_id", "state", "ts"], "left_anti")
        new.select(known.columns).write.mode("append").parquet(f"{folder}/manifest")
        if after:
            after(state.latest(batch.Workspace(spark, folder).read("manifest", batch.MANIFEST)))

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
