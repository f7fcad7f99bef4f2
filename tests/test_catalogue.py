import os

import duckdb
import pytest

from tidelog.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    if sql := catalogue.oracle_sql().get(name):
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
    else:
        assert got


def test_entry_without_the_llm_parts():
    import __spark_entry__ as e

    assert set(catalogue.queries()) <= set(e.queries())
