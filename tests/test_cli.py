import json

from deltaloom import cli

import adapters


def test_scan_and_batch(spark, tmp_path, capsys):
    path = adapters.make(str(tmp_path / "in" / "a"), 1, layers=2, config={"r": 4})
    assert cli.main(["scan", path, "--mode", "fast"], spark) == 0
    assert "action review" in capsys.readouterr().out
    out = str(tmp_path / "doc.json")
    assert cli.main(["scan", path, "--mode", "fast", "--format", "sarif", "--fail-on", "review", "--output", out], spark) == 2
    with open(out) as f:
        assert json.load(f)["version"] == "2.1.0"
    assert cli.main(["scan", str(tmp_path / "none.safetensors")], spark) == 1
    args = ["batch", "--input-dir", str(tmp_path / "in"), "--output-dir", str(tmp_path / "out"), "--mode", "fast", "--fail-on", "block"]
    assert cli.main(args, spark) == 0
    assert "persisted review: 1" in capsys.readouterr().out
