"""The registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from docloom.oracle import ORACLE
from docloom.queries import QUERIES

FAST = [q for q in QUERIES if q in ORACLE]


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(norm, x))
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


def compare(got, rel):
    names = sorted(got.columns)
    assert names == sorted(c[0] for c in rel.description)
    order = [[c[0] for c in rel.description].index(n) for n in names]
    a = sorted((tuple(norm(r[n]) for n in names) for r in got.collect()), key=repr)
    b = sorted((tuple(norm(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert a == b


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, sf_dir, name):
    compare(QUERIES[name](spark, sf_dir), con.execute(ORACLE[name]))


def test_registration():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_search_results_matches_sql_where_similarities_round(spark, tmp_path):
    """Similarities of 0.5015, which is less than that in doubles, and of just under nothing, one of them by rounding alone."""
    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.1/documents.parquet' WHERE doc_id IN (180, 4934, 5340, 5461)")
    c.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    compare(QUERIES["search_results"](spark, str(tmp_path)), c.execute(ORACLE["search_results"]))
