"""Every query of the adapter analytics against its SQL on DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from conftest import SMALL
from deltaloom.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows(frame):
    def text(v):
        if pd.isna(v):
            return None
        return f"{float(v):.4f}" if isinstance(v, int | float | np.number) and not isinstance(v, bool | np.bool_) else str(v)

    return sorted((tuple(text(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = db.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
