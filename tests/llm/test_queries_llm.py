"""The corpus queries against their SQL in DuckDB, and those without SQL against brute force."""

import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillstone.llm import encoding, queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings benchmark labels".split()


def rows_of(df):
    return sorted(repr(tuple(None if pd.isna(x) else x for x in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), db.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows_of(ours) == rows_of(theirs)


def test_forest_recall(spark):
    found = queries.QUERIES["op5_hash_prefix_forest"](spark, SF).toPandas()
    ids, vectors = zip(*duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall(), strict=True)
    kept = [(i, np.array(v, float)) for i, v in zip(ids, vectors, strict=True) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    met = wanted = 0
    for q, x in kept:
        if q % 50 == 0:
            near = sorted((-float(x @ y) / np.sqrt((x @ x) * (y @ y)), i) for i, y in kept if i != q and len(y) == len(x))[:5]
            mine = found[found["query_id"] == q].sort_values("rank")
            exact = {i: -s for s, i in near}
            met, wanted = met + len(set(mine["vec_id"]) & set(exact)), wanted + len(near)
            assert all(abs(s - exact[v]) < 1e-6 for v, s in zip(mine["vec_id"], mine["score"], strict=True) if v in exact)
    print(f"recall {met} of {wanted}")
    assert wanted and met >= 0.9 * wanted


def test_packing_covers_every_token(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(encoding.vocabulary_path())
    packed = queries.QUERIES["op8_best_fit_packing"](spark, SF).toPandas()
    fill = {}
    for r in packed.sort_values(["sequence_id", "offset"]).itertuples():
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048
    total = {d: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()}
    assert packed.groupby("doc_id")["length"].sum().to_dict() == total


@pytest.mark.parametrize("name, column", [("op4_compression_quality", "quality"), ("op6_language_id", "lang"), ("op9_toxic_segments", "toxic")])
def test_every_document_is_scored_once(spark, name, column):
    found = queries.QUERIES[name](spark, SF).toPandas()
    docs = duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").df()
    assert sorted(found["doc_id"]) == sorted(docs["doc_id"]) and found["score"].notna().all()
    modulus, rest = (5, 0) if column == "lang" else (4, 2)
    assert all(h == (zlib.crc32(str(d).encode()) % modulus == rest) for d, h in zip(found["doc_id"], found["held_out"], strict=True))
