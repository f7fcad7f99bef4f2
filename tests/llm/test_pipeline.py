import os

import pytest

import corpus_pipeline as p
from tests.llm.common import TEXTS, awkward, near_classes
from tidelog.llm.common import documents, table
from tidelog.llm.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages_in_order_over_the_smallest_tables(spark):
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_dedup", "mixing", "packing"]
    docs, columns = documents(spark, SF), documents(spark, SF).columns
    clean = table(p.toxicity(spark, docs, SF), "t")
    assert clean.columns == columns and clean.count() > 0.75 * docs.count()
    unique = table(p.near_dedup(spark, clean, SF), "t")
    classes = near_classes([(r["doc_id"], r["text"]) for r in clean.collect()], 5, 80)
    assert unique.columns == columns
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted({least if n else d for d, n, least in classes})
    mixed = table(p.mixing(spark, unique, SF), "t")
    assert mixed.columns == columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in unique.collect()}
    assert mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
    packed = p.packing(spark, mixed, SF)
    assert packed.filter("start = 0").count() == mixed.count()
    assert p.run(spark, SF).count() == packed.count()


def test_stages_bear_awkward_rows_and_nothing(spark):
    for rows in (TEXTS, []):
        docs = awkward(spark, rows)
        for name, stage in p.STAGES[:-1]:
            docs = table(stage(spark, docs, SF), name)
            assert docs.columns == awkward(spark).columns
        assert p.packing(spark, docs, SF).count() >= docs.count()


def test_registry():
    names = sorted(queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and set(oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_agrees(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = c.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r[x] for x in columns) for r in got.collect()) == sorted(cursor.fetchall())
