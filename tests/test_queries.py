"""Every generic query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from plumbline.plans import queries, rule_queries  # noqa: F401
from plumbline.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in sorted(os.listdir(FOLDER)):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 9) if isinstance(x, float) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, oracle, name):
    got = QUERIES[name](spark, FOLDER)
    want = oracle.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_no_copy_is_left_out_of_near_duplicates(spark, tmp_path):
    """Every document that equals an earlier one but for case is linked with the first of its class, short ones too."""
    text = " ".join(f"w{i}" for i in range(40))
    near, short = text.replace("w39", "x"), "Too Short"
    docs = [(1, text), (2, text.upper()), (3, near), (4, near.title()), (5, text), (5, text), (6, short), (7, short.lower()), (8, None), (9, "other"), (None, text)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["near_duplicate_docs"](spark, str(tmp_path)).select("a", "b", "similarity", "is_copy").collect()}
    assert got == {(1, 3, 97, False), (1, 2, 100, True), (1, 5, 100, True), (3, 4, 100, True), (6, 7, 100, True)}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert set(con.sql(SQL["near_duplicate_docs"]).fetchall()) == got
