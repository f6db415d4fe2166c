"""Every registered query with SQL equals DuckDB's answer on the smallest tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from ruleloom import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else round(value, 6) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_queries_over_all_tokens_miss_no_cell(spark, duck):
    cells, tokens = duck.execute("SELECT count(*), count(DISTINCT t) FROM (SELECT unnest(list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'))) AS t FROM documents) WHERE t <> ''").fetchone()
    shape = catalogue.QUERIES["dataset_shape_all"](spark, SF).first()
    assert (shape["nnz_x"], shape["n_features"]) == (cells, tokens) and tokens > 60
