"""Every registered query against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from quillstone.plans import oracles, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(oracles.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours, theirs = (df[sorted(df.columns)].astype(object) for df in (registry.QUERIES[name](spark, SF).toPandas(), db.sql(oracles.ORACLE_SQL[name]).df()))
    assert list(ours.columns) == list(theirs.columns)
    rows = [sorted(repr(tuple(None if pd.isna(x) else x for x in r)) for r in df.itertuples(index=False)) for df in (ours, theirs)]
    assert rows[0] == rows[1]
