"""Every core query with SQL against DuckDB on the smallest tables, and the shape of the entry."""

import datetime
import decimal
import glob
import os

import pytest

import __spark_entry__ as entry
from veridelta import catalog

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6)
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return str(x).removesuffix(" 00:00:00") if isinstance(x, (datetime.date, datetime.datetime)) else x


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    r = duck.execute(catalog.SQL[name])
    cols = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted((tuple(map(plain, x)) for x in r.fetchall()), key=repr)
    assert sorted((tuple(plain(x[c]) for c in cols) for x in df.collect()), key=repr) == want


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_or_dedup_equals_a_loop(spark):
    rows = spark.read.parquet(f"{SF}/gold.parquet").where("claim is not null").selectExpr("ord", "id", r"regexp_replace(claim, '(?U)\\s+', '') c").orderBy("ord").collect()
    ids, claims, want = set(), set(), []
    for r in rows:
        if r.id not in ids and r.c not in claims:
            ids.add(r.id)
            claims.add(r.c)
            want.append(r.ord)
    assert sorted(r.ord for r in catalog.QUERIES["or_dedup"](spark, SF).collect()) == want


@needs_data
def test_supply_components_equal_union_find(spark):
    from tests.test_operators import union_find

    edges = [(f"o{r[0]}", f"s{r[1]}") for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_suppkey").distinct().collect()]
    from collections import Counter

    want = Counter(Counter(union_find(edges).values()).values())
    assert dict(map(tuple, catalog.QUERIES["supply_components"](spark, SF).collect())) == dict(want)
