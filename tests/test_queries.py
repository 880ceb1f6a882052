"""Every query runs on the smallest tables, and agrees with its SQL there."""

import os

import duckdb
import pytest

from siltstone.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in os.listdir(SF):
        c.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, duck, tmp_path, name):
    plans.QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/out")
    duck.execute(f"create or replace view b as select * from '{tmp_path}/out/*.parquet'")
    if name not in plans.SQL:
        assert duck.execute("select count(*) from b").fetchall()[0][0] > 0
        return
    duck.execute(f"create or replace table a as {plans.SQL[name]}")
    names = lambda t: sorted(r[0] for r in duck.execute(f"describe {t}").fetchall())
    assert names("a") == names("b")
    columns = ", ".join(f'"{c}"' for c in names("a"))
    for x, y in (("a", "b"), ("b", "a")):
        assert duck.execute(f"select {columns} from {x} except all select {columns} from {y}").fetchall() == []
