"""Families and labels of many members: the same rows as the SQL, without all pairs or all members in one place."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaloom.functions import slopes, stats
from deltaloom.operators import compare, grouped, lowrank
from deltaloom.queries import ORACLES, QUERIES
from deltaloom.queries.common import Z_SQL
from test_queries import rows

#: All pairs of so many members, as rows, do not fit the memory of the tests' session.
MEMBERS = 12_000
FAMILY_QUERIES = ["concentration_z", "intra_summary", "join_finding_location", "max_concentration_z", "module_max_abs_z", "topk_conc_findings", "topk_contributors", "topk_outlier_findings", "family_compare", "topk_conc_spikes", "topk_depth_spikes"]


def brute(x, y):
    i, j = np.triu_indices(len(x), 1)
    i, j = i[apart := x[i] != x[j]], j[apart]
    return np.median((y[j] - y[i]) / (x[j] - x[i])) if len(i) else float("nan")


@pytest.mark.parametrize("limit", [slopes.LIMIT, 50])
@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 257])
def test_median_slope_is_that_of_all_pairs(monkeypatch, n, limit):
    monkeypatch.setattr(slopes, "LIMIT", limit)
    rng, at = np.random.default_rng(n), np.arange(n, dtype=float)
    noise = rng.normal(size=n)
    shapes = {
        "noise": (at, noise), "shuffled": (rng.permutation(at), noise), "level": (at, np.full(n, 4.2)), "line": (at, 2 * at + 1), "uneven line": (at, 0.1 * at), "stairs": (at, np.floor(at / 2)),
        "few values": (at, rng.integers(0, 3, n).astype(float)), "few places": (np.floor(at / 3), noise), "few of both": (np.floor(at / 3), rng.integers(0, 4, n) * 1000.0),
        "two places": (at % 2, noise), "far up": (at, 1e9 + noise), "falling": (at, rng.integers(0, 2, n) - at), "last bits": (at, 1000 + rng.integers(0, 3, n) * 2.0**-43),
    }
    for name, (x, y) in shapes.items():
        assert slopes.median_slope(x, y) == pytest.approx(brute(x, y), rel=0, abs=0, nan_ok=True), name


def test_few_counts_lead_to_the_median(monkeypatch):
    monkeypatch.setattr(slopes, "LIMIT", 1000)
    at, counts, below = np.arange(3000, dtype=float), [], slopes._Points.below
    monkeypatch.setattr(slopes._Points, "below", lambda self, t: counts.append(t) or below(self, t))
    noise = np.random.default_rng(8).normal(size=3000)
    assert slopes.median_slope(at, noise) == brute(at, noise)
    assert len(counts) <= 9


@pytest.mark.parametrize("of", [stats.hoyer, stats.top_share])
def test_an_array_is_computed_once(spark, of):
    assert str(of(F.col("the_array"))).count("the_array") == 1


def test_a_module_of_a_large_family_is_one_row_until_it_is_scored(spark, monkeypatch):
    monkeypatch.setattr(grouped, "ARRAY_GROUP", 20)
    rng = np.random.default_rng(9)
    values = [("p", "f", f"{i:02d}", i, None, *(None if (i + k) % 11 == 0 else float(x) for k, x in enumerate(rng.uniform(0.1, 1, len(stats.FEATURES))))) for i in range(40)]
    modules = spark.createDataFrame(values, "path string, family string, base string, layer int, expert int, " + ", ".join(f"{f} double" for f in stats.FEATURES))
    z = compare.family_z(modules)
    lines = z._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    k = next(i for i, x in enumerate(lines) if "FlatMapGroupsInArrow" in x)
    under = [x for i, x in enumerate(lines[k + 1 :], k + 1) if all(depth(y) > depth(lines[k]) for y in lines[k + 1 : i + 1])]
    assert under and not any("Generate" in x for x in under)
    got = {(r["base"], r["feature"]): (r["raw"], r["z"]) for r in z.collect()}
    monkeypatch.setattr(grouped, "ARRAY_GROUP", 100)
    want = {(r["base"], r["feature"]): (r["raw"], r["z"]) for r in compare.family_z(modules).collect()}
    assert len(want) == sum(x is not None for r in values for x in r[5:])
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-12) for k in want)


def test_of_a_large_family_a_task_holds_layers_and_values_only(spark, monkeypatch):
    monkeypatch.setattr(grouped, "ARRAY_GROUP", 20)
    rng = np.random.default_rng(10)
    lead = {"lined": lambda i: i, "one place": lambda i: 3, "unplaced": lambda i: i if i % 5 else None, None: lambda i: 2 * i}
    values = [("p", f, f"{f}{i:02d}", layer(i), None, *(None if (i + k) % 7 == 0 else 0.5 if k == 2 else float(x) for k, x in enumerate(rng.uniform(0.1, 1, len(stats.FEATURES))))) for f, layer in lead.items() for i in range(40)]
    modules = spark.createDataFrame(values, "path string, family string, base string, layer int, expert int, " + ", ".join(f"{f} double" for f in stats.FEATURES))
    z = compare.family_z(modules)
    scoring = next(x for x in z._jdf.queryExecution().optimizedPlan().toString().split("\n") if "FlatMapGroupsInArrow" in x)
    assert "layer#" in scoring and not any(c in scoring for c in ("base#", "expert#", "raw_"))
    got = {(r["base"], r["layer"], r["feature"]): (r["raw"], r["z"]) for r in z.collect()}
    monkeypatch.setattr(grouped, "ARRAY_GROUP", 100)
    want = {(r["base"], r["layer"], r["feature"]): (r["raw"], r["z"]) for r in compare.family_z(modules).collect()}
    assert len(want) > 1000 and got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-9) for k in want)


def test_lines_of_groups_of_any_size(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points = {(g, n): rng.normal(size=n) for g, n in ((1, 40), (2, 41), (None, 90), (3, 1))}
    df = spark.createDataFrame([(g, x, float(y)) for (g, _), ys in points.items() for x, y in enumerate(ys)] + [(2, None, 7.0), (2, 50, None), (2, 60, float("nan"))], "g int, x int, y double")
    few = {r["g"]: r["slope"] for r in grouped.theil_sen(df, ["g"], "x", "y").collect()}
    monkeypatch.setattr(grouped, "ARRAY_GROUP", 1)
    many = {r["g"]: r["slope"] for r in grouped.theil_sen(df, ["g"], "x", "y").collect()}
    want = {g: None if n == 1 else brute(np.arange(n, dtype=float), ys) for (g, n), ys in points.items()}
    assert few == many == want


@pytest.mark.parametrize("limit", [grouped.ARRAY_GROUP, 20])
def test_no_row_holds_a_large_family(spark, monkeypatch, limit):
    rng = np.random.default_rng(6)
    sizes = {"small": 18, "even": 41, "large": 40, "level": 30, "one place": 25, "unplaced": 33, "few": 9, None: 24}
    layer = {"one place": lambda i: 3, "unplaced": lambda i: i if i % 5 else None}
    df = spark.createDataFrame([("p", f, f"{f}{i:02d}", layer.get(f, lambda i: i)(i), i % 2 or None, 1.0 if f == "level" else float(rng.normal())) for f, n in sizes.items() for i in range(n)], "path string, family string, base string, layer int, expert int, log_rms double")
    modules = df.select("*", *(F.lit(None).cast("double").alias(f) for f in stats.FEATURES if f != "log_rms"))
    want = compare.family_z(modules).orderBy("base").collect()
    assert {r["family"] for r in want} == {f for f in sizes if f not in ("few", "level")}
    monkeypatch.setattr(grouped, "ARRAY_GROUP", limit)
    scores = compare._scores
    held = lambda *x: F.when(F.assert_true(F.size("m") <= limit, "a row holds a large family").isNull(), scores(*x))
    monkeypatch.setattr(compare, "_scores", held)
    got = compare.family_z(modules).orderBy("base").collect()
    assert [r[:-1] for r in got] == [r[:-1] for r in want]
    assert np.allclose([r["z"] for r in got], [r["z"] for r in want], rtol=1e-9, atol=1e-12)


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """A folder with one family of MEMBERS embeddings, and DuckDB with the z and m of it."""
    to = str(tmp_path_factory.mktemp("large"))
    con = duckdb.connect()
    os.mkdir(f"{to}/embeddings.parquet")
    for r in range(MEMBERS // 2000):
        con.execute(f"COPY (SELECT vec_id + {2000 * r} AS vec_id, embedding, 4 AS label FROM '/root/testdata/sf0.1/embeddings.parquet') TO '{to}/embeddings.parquet/{r}.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{to}/embeddings.parquet/*.parquet'")
    con.execute(f"CREATE TABLE z AS {Z_SQL} SELECT * FROM z")
    con.execute(f"CREATE TABLE m AS WITH {Z_SQL[Z_SQL.rindex('m AS (SELECT') :]} SELECT * FROM m")
    return to, con


@pytest.mark.parametrize("name", FAMILY_QUERIES)
def test_large_family(spark, large, name):
    to, con = large
    rest = ORACLES[name].removeprefix(Z_SQL).strip()
    want = con.execute("WITH " + rest[1:] if rest.startswith(",") else rest).fetchdf()
    assert rows(QUERIES[name](spark, to).toPandas()) == rows(want)


def test_large_label(spark, large):
    to, con = large
    assert rows(QUERIES["spectrum"](spark, to).toPandas()) == rows(con.execute(ORACLES["spectrum"]).fetchdf())


def test_gram_sums_of_many_labels(spark, monkeypatch):
    monkeypatch.setattr(lowrank, "HELD_GRAMS", 2)
    v = np.random.default_rng(3).normal(size=(40, 3)).astype(np.float32)
    df = spark.createDataFrame([(i % 5 if i % 8 else None, x.tolist()) for i, x in enumerate(v)] + [(1, None)], "label int, v array<float>").repartition(3)
    found = {r["label"]: np.reshape(r["gram"], (3, 3)) for r in lowrank.grams(df, "label", "v").collect()}
    assert sorted(found) == [0, 1, 2, 3, 4]
    for k, g in found.items():
        own = np.array([x for i, x in enumerate(v) if i % 8 and i % 5 == k], float)
        assert np.allclose(g, own.T @ own, rtol=1e-12)
