"""Every query named in the inventory exists."""

import os
import re

from conftest import ROOT
from deltaloom.queries import QUERIES


def test_inventory():
    with open(os.path.join(ROOT, "COVERAGE.md")) as f:
        rows = [r.split("|")[1:4] for r in f if r.startswith("| ") and not r.startswith("| Operator")]
    assert len(rows) > 100
    for operators, _, where in rows:
        named = operators if "same names" in where else where
        if "tests/" in named or named.strip() in ("none", ""):
            continue
        for name in re.findall(r"[a-z][a-z_0-9]{3,}", named.split("(")[0]):
            assert name in QUERIES or name in ("top_entry",), name
