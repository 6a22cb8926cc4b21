import time

import pytest

from undertone.sql_surface import Surface, is_safe, render


@pytest.mark.parametrize("sql", ["select 1", "WITH a AS (select 1) select * from a;", "/* x */ select 1 -- y", "select * from t where n > 1"])
def test_accepts(sql):
    assert is_safe(sql)[0]


@pytest.mark.parametrize("sql", ["", "drop table t", "select 1; select 2", "select reflect('a','b')", "set x=1", "select * from parquet.`/etc`", "with x as (select 1) insert into t select 1", "select 'set'", "-- select\ndelete from t"])
def test_rejects(sql):
    assert not is_safe(sql)[0]


def test_queries(spark):
    s = Surface(spark, {"t": spark.createDataFrame([(1, 1.5, None), (2, 2.0, "a\nb")], "n int, x double, s string")}, {"n": "a number"})
    assert s.schema()["t"][0] == {"name": "n", "type": "int", "about": "a number"}
    r = s.query("select * from t order by n", max_rows=1)
    assert r["ok"] and r["row_count"] == 1 and r["truncated"]
    assert "2 | 2 | a b" in render(s.query("select * from t where n = 2"))
    assert not s.query("select * from missing")["ok"] and not s.query("select * from parquet.`/tmp`")["ok"]


def test_runaway_query_is_stopped(spark):
    s = Surface(spark, {"t": spark.range(1)})
    began = time.time()
    r = s.query("select sum(id % 7) from range(900000000000)", timeout_s=3)
    assert not r["ok"] and time.time() - began < 30
