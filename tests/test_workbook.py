"""Workbooks as a data source: types, odd characters, packing, pushed filters, commits."""

import datetime as dt
import os

import pytest

from lawframe.sources import workbook as W

SCHEMA = "id long, name string, ok boolean, x double, day date"
ROWS = [
    (1, "plain", True, 1.5, dt.date(2024, 2, 29)), (2, "<a> & \"b\" ' \n\ttail ", False, -0.1, None), (3, "", None, None, dt.date(1999, 12, 31)),
    (4, None, True, 1e300, None), (5, "a\x00b\r\x1f_x0041_ _x00e9_ 中文 😀", None, 0.1 + 0.2, None), (None, None, None, None, None), (5, "again", True, 2.0, None),
]


@pytest.fixture
def folder(spark, tmp_path):
    W.register(spark)
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.format("workbook").option("path", f"{tmp_path}/w").option("rowsPerFile", 2).mode("append").save()
    return f"{tmp_path}/w"


def key(rows):
    return sorted(map(repr, map(tuple, rows)))


def test_roundtrip(spark, folder):
    assert key(W.read_workbooks(spark, folder, SCHEMA).collect()) == key(ROWS)
    assert len(os.listdir(folder)) >= 4 and not [n for n in os.listdir(folder) if n.startswith("_")]


def test_columns_by_name_and_broken_cells(spark, folder):
    got = W.read_workbooks(spark, folder, "name int, id string, missing string").collect()
    assert key(got) == key([(None, None if r[0] is None else str(r[0]), None) for r in ROWS])
    assert W.read_workbooks(spark, folder).dtypes == [(n, "string") for n in ("id", "name", "ok", "x", "day")]
    assert key(W.read_workbooks(spark, folder, "id byte").collect()) == key([(r[0],) for r in ROWS])


def test_numbers_beyond_their_type(spark, tmp_path):
    W.register(spark)
    spark.createDataFrame([(300,), (7,)], "id long").coalesce(1).write.format("workbook").option("path", f"{tmp_path}/n").mode("append").save()
    assert key(W.read_workbooks(spark, f"{tmp_path}/n", "id byte").collect()) == key([(None,), (7,)])


def test_packing(spark, folder):
    whole = W.read_workbooks(spark, folder, SCHEMA)
    assert whole.rdd.getNumPartitions() == 1
    assert W.read_workbooks(spark, folder, SCHEMA, partitionBytes=1).rdd.getNumPartitions() == len(os.listdir(folder))


def test_pushed_filters(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = W.read_workbooks(spark, folder, SCHEMA)
        for condition, want in (
            ("id = 5 and x > 1", [r for r in ROWS if r[0] == 5 and r[3] > 1]), ("name in ('plain', '')", [r for r in ROWS if r[1] in ("plain", "")]),
            ("name is null", [r for r in ROWS if r[1] is None]), ("not ok", [r for r in ROWS if r[2] is False]), ("id is not null", [r for r in ROWS if r[0] is not None]),
        ):
            assert key(df.filter(condition).collect()) == key(want), condition
        reader = W.PushingReader(folder, df.schema, 1)
        left = list(reader.pushFilters([W.EqualTo(("id",), 5), W.EqualTo(("day",), dt.date(2024, 2, 29))]))
        assert [f.attribute for f in left] == [("day",)] and len(reader.tests) == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_overwrite_abort_and_empty(spark, folder):
    spark.createDataFrame(ROWS[:1], SCHEMA).write.format("workbook").option("path", folder).mode("overwrite").save()
    assert key(W.read_workbooks(spark, folder, SCHEMA).collect()) == key(ROWS[:1])
    before = sorted(os.listdir(folder))
    bad = spark.createDataFrame(ROWS, SCHEMA).selectExpr("if(id = 4, raise_error('no')::long, id) as id", "name")
    with pytest.raises(Exception):
        bad.repartition(2).write.format("workbook").option("path", folder).mode("append").save()
    assert [n for n in sorted(os.listdir(folder)) if not n.startswith("_")] == before
    with pytest.raises(Exception):
        spark.createDataFrame([([1],)], "a array<int>").write.format("workbook").option("path", folder).mode("append").save()
    spark.createDataFrame([], SCHEMA).write.format("workbook").option("path", folder).mode("overwrite").save()
    assert W.read_workbooks(spark, folder, SCHEMA).collect() == []


def test_shared_strings_of_other_programs(spark, tmp_path):
    from tests.test_sources import xlsx

    (tmp_path / "t.xlsx").write_bytes(xlsx())
    (tmp_path / "~t.xlsx").write_bytes(b"lock")
    assert [tuple(r) for r in W.read_workbooks(spark, str(tmp_path), "n int, name string").collect()] == [(5, "ann")]
