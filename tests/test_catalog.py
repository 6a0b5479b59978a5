"""Every registered query of the library against its SQL twin, on the smallest tables."""

import duckdb
import pytest

from lawframe import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks items".split()
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(values, names):
    at = [names.index(n) for n in sorted(names)]
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in (r[i] for i in at)) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    made = duck.execute(ORACLES[name])
    names = [d[0] for d in made.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(got, df.columns) == rows(made.fetchall(), names)


def test_queries_do_not_depend_on_partitions(spark, sf_dir):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for name in ("V4_knn_join_per_group_topk", "S2_hierarchy_ids", "C1_chunk_300", "K1_jsonl_upsert"):
        a = rows([tuple(r) for r in QUERIES[name](spark, sf_dir).collect()], QUERIES[name](spark, sf_dir).columns)
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        b = rows([tuple(r) for r in QUERIES[name](spark, sf_dir).collect()], QUERIES[name](spark, sf_dir).columns)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert a == b
