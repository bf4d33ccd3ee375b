import glob
import os

import pytest

from veridelta.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables aren't here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    r = c.execute(SQL[name])
    cols = [d[0] for d in r.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(x[k] for k in cols) for x in df.collect()), key=repr) == sorted(r.fetchall(), key=repr)


@pytest.mark.parametrize("name, columns", [("p1_found", ["field", "ord_a", "ord_b"]), ("p2_found", ["tab", "ord", "lang"]), ("p3_found", ["ord", "line_no"]), ("p4_found", ["field", "ord_a", "ord_b"]), ("p5_found", ["ord_a", "ord_b"]), ("p6_found", ["ord", "line_no"]), ("p9_found", ["doc_id"])])
def test_columns(spark, name, columns):
    assert QUERIES[name](spark, SF).columns == columns
