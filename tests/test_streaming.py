from deltaloom.plans.batch import Workspace
from deltaloom.plans.scan import Settings
from deltaloom.streaming import ingest

import adapters
from conftest import SMALL


def test_new_files_are_scanned_once(spark, tmp_path):
    adapters.make(str(tmp_path / "in" / "a"), 1, layers=2)
    work = Workspace(spark, str(tmp_path / "out"))
    for _ in range(2):
        q = ingest.scan_stream(work, str(tmp_path / "in"), str(tmp_path / "cp"), Settings(run_id="s"))
        q.awaitTermination()
    assert spark.read.json(spark.read.parquet(str(tmp_path / "out" / "results")).select("document").rdd.map(lambda r: r[0])).count() == 1


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").selectExpr("cast(ts AS timestamp) AS ts", "event_type AS state", "value")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = ingest.state_windows(stream, "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((str(r["start"]), r["state"], r["n"]) for r in df.collect())
    assert key(spark.table("w")) == key(ingest.state_windows(events, "1 hour"))
