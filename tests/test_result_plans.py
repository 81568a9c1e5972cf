import duckdb
import pytest

from docloom.plans import result_plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(result_plans.QUERIES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(result_plans.SQL[name])
    got = result_plans.QUERIES[name](spark, SF)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
