"""Queries that once used less than their whole input."""

import numpy as np
import pytest

from conftest import SMALL
from deltaloom.operators import corpus
from deltaloom.queries import QUERIES
from deltaloom.queries.common import factors, table


def test_rows_without_z_have_no_place(spark):
    rows = spark.createDataFrame([(1, None), (2, 3.0), (3, 5.0), (4, 3.0), (5, None)], "repo_id long, max_robust_z double")
    assert [r["repo_id"] for r in corpus.most_anomalous(rows, 4).collect()] == [3, 2, 4]


@pytest.mark.parametrize("n", [1, 2, 7, 15, 16, 17, 31, 32, 200])
def test_all_vectors_are_used(n):
    found = factors(np.arange(n), 16)
    assert {x for a, b in found for x in (*a, *b)} == set(range(n)) and all(len(a) == len(b) for a, b in found)


@pytest.mark.parametrize("name, size", [("module_features", 16), ("head_features", 8)])
def test_all_blocks_are_in_the_result(spark, name, size):
    n = {r["label"]: r["count"] for r in table(spark, SMALL, "embeddings").groupBy("label").count().collect()}
    got = {(r["label"], r["block"]) for r in QUERIES[name](spark, SMALL).select("label", "block").collect()}
    assert got == {(k, i) for k, c in n.items() for i in range(max(1, -(-c // size)))}
