"""Every catalogue query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from marginalia.plans import catalog, oracle

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def flat(rows):
    return sorted((tuple(round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query(spark, duck, name):
    found = catalog.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    got = flat(tuple(r[c] for c in columns) for r in found.collect())
    answer = duck.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = flat(tuple(r[names.index(c)] for c in columns) for r in answer.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(oracle.oracle_sql()) <= set(entry.queries())


def test_plans_push_filters_and_columns(spark):
    plan = catalog.bm25_filtered_lang(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,de)" in plan and "n_chars" not in plan
    plan = catalog.point_lookup(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,42)" in plan and "text" not in plan
