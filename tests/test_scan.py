"""Whole scans of small adapters."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import adapters
from deltaloom.operators import rules, state
from deltaloom.plans import batch
from deltaloom.plans.scan import Settings, scan
from deltaloom.sinks import reports
from deltaloom.sources import tensorfile


def store(spark, folder):
    def written(df, name):
        path = f"{folder}/work-{name}-{len(os.listdir(folder))}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return written


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("adapters"))
    rng = np.random.default_rng(9)
    matrix = lambda *s: rng.normal(size=s).astype("f4")
    p = "base_model.model.model.layers"
    delta = matrix(20, 64)
    delta[3] *= 80
    magnitude = np.ones(64, "f4")
    magnitude[:2] += 5
    nan = matrix(8, 64)
    nan[0, 0] = np.nan
    files = {
        "clean": adapters.make(f"{root}/clean", 1),
        "payload": adapters.make(f"{root}/payload", 2, inject=("down_proj", 9)),
        "head": adapters.make(f"{root}/head", 3, extra={"base_model.model.lm_head.weight": matrix(8, 8)}),
        "orphan": adapters.make(f"{root}/orphan", 4, layers=2, extra={f"{p}.30.mlp.up_proj.lora_A.weight": matrix(8, 8), f"{p}.31.mlp.up_proj.lora_A.weight": nan, f"{p}.31.mlp.up_proj.lora_B.weight": matrix(16, 8)}),
        "dora": adapters.make(f"{root}/dora", 5, layers=2, extra={f"{p}.1.mlp.up_proj.lora_magnitude_vector.weight": magnitude, "base_model.model.model.embed_tokens.trainable_tokens_delta": delta}),
        "vera": f"{root}/vera/adapter_model.safetensors",
        "zero": adapters.make(f"{root}/zero", 6, layers=2, zero=True, config=False),
        "code": adapters.make(f"{root}/code", 7, layers=2, config={"r": 16}),
        "none": f"{root}/none.safetensors",
        "huge": f"{root}/huge.safetensors",
    }
    os.makedirs(f"{root}/vera")
    tensorfile.write(files["vera"], {"base_model.model.layers.0.q_proj.vera_lambda_b": matrix(4, 4)})
    open(f"{root}/code/modeling.py", "w").close()
    with open(files["huge"], "wb") as f:
        f.write(struct.pack("<Q", 1 << 63) + b"{}")
    paths = spark.createDataFrame([(x,) for x in files.values()], "path string")
    got = scan(paths, Settings(policy="default"), written=store(spark, root))
    found = {r["path"]: r for r in got.collect()}
    return {k: found[v] for k, v in files.items()}, got, root, files


def codes(row):
    return {r["code"] for r in row["verdict"]["reasons"]}


def found(row):
    return {f["rule_id"] for f in row["findings"]}


def test_clean(scanned):
    row = scanned[0]["clean"]
    assert (row["status"], row["verdict"]["action"], row["verdict"]["level"]) == ("ok", "allow", "LOW")
    assert row["verdict"]["confidence"]["level"] == "medium"
    c = row["coverage"]
    assert (c["n_modules"], c["n_modules_analyzed"], c["n_not_analyzed"], c["n_tensors_total"], c["n_tensors_analyzed"]) == (54, 54, 0, 108, 108)
    assert row["adapter"]["base_family"] == "llama" and row["adapter"]["rank_actual"]["distinct"] == [8]
    assert row["anomaly"]["intra"]["max_concentration_z"] < 14
    assert len(row["modules"]) == 54 and row["modules"][0]["layer"] == 0


def test_payload_is_found_where_it_is(scanned):
    row = scanned[0]["payload"]
    assert row["verdict"]["action"] == "review" and "INTRA_OUTLIER" in codes(row)
    spike = row["anomaly"]["intra"]["concentration_spikes"][0]
    assert (spike["module_type"], spike["layer"]) == ("down_proj", 9)
    assert "INTRA_CONCENTRATION_SPIKE" in found(row)


def test_structural(scanned):
    rows = scanned[0]
    assert "FULL_WEIGHT_REPLACEMENT" in codes(rows["head"]) and rows["head"]["status"] == "degraded"
    assert {"SIBLING_EXECUTABLE", "RANK_MISMATCH"} <= codes(rows["code"])
    assert rows["orphan"]["status"] == "degraded" and rows["orphan"]["coverage"]["n_not_analyzed"] == 3
    assert rows["orphan"]["coverage"]["non_finite_modules"] == ["base_model.model.model.layers.31.mlp.up_proj"]
    assert {"DORA_MAGNITUDE", "TRAINABLE_TOKEN_DELTA", "DORA_PARTIAL_ANALYSIS", "TRAINABLE_TOKENS"} <= found(rows["dora"])
    assert rows["zero"]["adapter"]["training_state"] == "init_only"


def test_failures_are_reviewed(scanned):
    rows = scanned[0]
    assert codes(rows["vera"]) == {"UNSUPPORTED_PEFT_METHOD"}
    for k in ("none", "huge", "vera"):
        assert rows[k]["status"] == "failed" and rows[k]["verdict"]["action"] == "review"
    assert rows["none"]["artifact"] is None


def test_invariants_and_reports(spark, scanned):
    got = scanned[1]
    assert rules.violations(got).count() == 0
    docs = {r[0]: json.loads(r[1]) for r in reports.as_json(got).collect()}
    assert all(d["schema_version"].startswith("2.") for d in docs.values())
    sarif = [json.loads(r["document"]) for r in reports.as_sarif(got).collect()]
    assert all(s["version"] == "2.1.0" for s in sarif) and sum(len(s["runs"][0]["results"]) for s in sarif) > 10
    texts = [r["report"] for r in reports.as_text(got).collect()]
    assert all("action" in t for t in texts)


def test_strict_policy_blocks(spark, scanned):
    paths = spark.createDataFrame([(scanned[3]["code"],)], "path string")
    row = scan(paths, Settings(policy="strict", mode="fast"), written=store(spark, scanned[2])).first()
    assert row["verdict"]["action"] == "block" and "STRICT_POLICY_STRUCTURAL" in codes(row)


def test_batch_is_cached_and_resumed(spark, scanned, tmp_path):
    files = scanned[3]
    paths = spark.createDataFrame([(files["zero"], 0), (files["huge"], 1), (files["zero"], 2)], "path string, ordinal long")
    work = batch.Workspace(spark, str(tmp_path))
    first = {r["path"]: r["outcome"] for r in batch.run(work, paths, Settings(run_id="a")).collect()}
    assert first == {files["zero"]: "persisted", files["huge"]: "failed"}
    assert batch.run(work, paths, Settings(run_id="a")).count() == 0
    again = {r["path"]: r["outcome"] for r in batch.run(work, paths, Settings(run_id="b")).collect()}
    assert again[files["zero"]] == "cached_hit"


def test_batch_sinks(spark, scanned, tmp_path):
    """Results once, conflicts reported, duplicates skipped, interrupted requests taken up or given up."""
    import shutil

    files = scanned[3]
    copies = {}
    for k, name in (("one", "clean"), ("two", "clean"), ("bad", "huge"), ("zero", "zero")):
        shutil.copytree(os.path.dirname(files[name]), tmp_path / k)
        copies[k] = str(tmp_path / k / os.path.basename(files[name]))
    paths = spark.createDataFrame([(p, i) for i, p in enumerate(copies.values())], "path string, ordinal long")
    work = batch.Workspace(spark, str(tmp_path / "out"))
    go = lambda run_id, **more: {r["path"].split("/")[-2]: r for r in batch.run(work, paths, Settings(run_id=run_id, include_modules=False), **more).collect()}
    first = go("a")
    assert sorted(r["outcome"] for r in first.values()) == ["failed", "persisted", "persisted", "skipped_duplicate"]
    assert {first[k]["outcome"] for k in ("one", "two")} == {"persisted", "skipped_duplicate"}
    assert work.read("results", batch.RESULTS).count() == 3 and spark.read.text(str(tmp_path / "out/log")).count() == 3
    old = work.written(work.read("results", batch.RESULTS).where("document LIKE '%\"failed\"%'").withColumns({"stable_hash": F.lit("other"), "stored_at": F.current_timestamp()}), "old")
    reports.write_results(old, f"{work.folder}/results")
    second = go("b")
    assert sorted(r["outcome"] for r in second.values()) == ["cached_hit", "cached_hit", "failed", "skipped_duplicate"]
    assert second["zero"]["action"] == first["zero"]["action"] and second["bad"]["stored"] == "conflict" and second["zero"]["stored"] == "unchanged"
    # cached documents are in the log in full; of stored ones only the conflicting one is stored again
    log = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out/log")).collect()]
    assert len(log) == 6 and all(d["schema_version"] for d in log)
    assert work.read("results", batch.RESULTS).count() == 3 + old.count() + 1
    # an interrupted run: one request has been tried twice before
    ids = {r["path"]: r["request_id"] for r in batch._requests(work, paths, Settings(run_id="d"), False).collect()}
    left = spark.createDataFrame([(ids[copies["one"]], copies["one"], 2), (ids[copies["zero"]], copies["zero"], 1)], "request_id string, path string, retry_count int").withColumn("run_id", F.lit("d"))
    work.append(batch.event(left, "queued"), "manifest")
    fourth = go("d")
    assert set(fourth) == {"two", "bad", "zero"}
    last = {r["adapter_path"]: r for r in state.latest(work.read("manifest", batch.MANIFEST).where("run_id = 'd'")).collect()}
    assert last[copies["one"]]["error_message"] == state.RETRY_MESSAGE and last[copies["zero"]]["retry_count"] == 2
    # a broken table is an error, not an empty one
    with open(tmp_path / "out/manifest/part-0.parquet", "w") as f:
        f.write("no table")
    with pytest.raises(Exception, match="(?i)parquet"):
        work.read("manifest", batch.MANIFEST).collect()


def test_codec_and_hostile_entries(spark, tmp_path):
    x = np.array([[1.5, -2.0], [np.inf, np.nan]], "f4")
    p = str(tmp_path / "x.safetensors")
    tensorfile.write(p, {"a": x, "b": x.astype("f2"), "c": x}, bf16=("c",))
    text, at, size = tensorfile.read_header(p)
    for k, e in json.loads(text).items():
        got = tensorfile.load(p, at, e["dtype"], e["shape"], e["data_offsets"])
        assert np.array_equal(got, x, equal_nan=True), k
    bad = {"bomb": {"dtype": "F32", "shape": [100000, 100000], "data_offsets": [0, 4]}, "u8": {"dtype": "U8", "shape": [4], "data_offsets": [0, 4]}, "short": {"dtype": "F32", "shape": [2], "data_offsets": [0, 4]}, "far": {"dtype": "F32", "shape": [1], "data_offsets": [0, 1 << 40]}, "list": [1]}
    head = json.dumps(bad).encode()
    q = str(tmp_path / "bad.safetensors")
    with open(q, "wb") as f:
        f.write(struct.pack("<Q", len(head)) + head + b"\0" * 4)
    heads = tensorfile.headers(spark.createDataFrame([(q,), (str(tmp_path),)], "path string"))
    problems = {r["key"]: r["problem"] for r in tensorfile.checked(tensorfile.entries(heads)).collect()}
    assert all(problems.values()) and len(problems) == 5
    assert heads.where("error IS NOT NULL").count() == 1


def test_files_by_uri(tmp_path, monkeypatch):
    """A path on another file system gives what the same local path gives."""
    from deltaloom.sources import files
    from pyarrow import fs

    a = tmp_path / "a.safetensors"
    tensorfile.write(str(a), {"x": np.arange(6, dtype="f4").reshape(2, 3)})
    (tmp_path / "adapter_config.json").write_text("{}")
    inside = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    by_uri = lambda p: (inside, p.removeprefix("store://")) if p.startswith("store://") else None
    monkeypatch.setattr(files, "place", by_uri)
    uri = "store://a.safetensors"
    assert tensorfile.guard(uri) is None and tensorfile.read_header(uri) == tensorfile.read_header(str(a))
    at = tensorfile.read_header(uri)[1]
    assert tensorfile.load(uri, at, "F32", [2, 3], [0, 24]).tolist() == [[0, 1, 2], [3, 4, 5]]
    assert list(files.names_beside(uri, 10)) == list(files.names_beside(str(a), 10)) == ["adapter_config.json"]
    assert files.opened(files.beside(uri, "adapter_config.json")).read() == b"{}"
    assert tensorfile.guard("store://b.safetensors").startswith("unreadable") and "regular" in tensorfile.guard("store://")
    before = files.snapshot(uri)
    a.write_bytes(a.read_bytes() + b"x")
    assert files.snapshot(uri) != before
    monkeypatch.undo()
    assert tensorfile.guard("nowhere://x.safetensors").startswith("unreadable")
