import json

from pyspark.sql import functions as F

from veridelta.sources import recorded as S


def test_hits_and_misses(spark, rows):
    req = spark.createDataFrame([("a", "x"), ("b", None), ("a", "x")], "role string, prompt string").withColumn("request", S.request_key(F.col("role"), F.col("prompt")))
    key = {r.role: r.request for r in req.collect()}
    rec = spark.createDataFrame([(key["a"], "old", 1), (key["a"], "new", 2)], "request string, response string, recorded_at int")
    assert {(r.role, r.response) for r in S.hits(req, rec).collect()} == {("a", "new"), ("b", None)}
    assert rows(S.misses(req, rec)) == [(key["b"],)]
    assert spark.range(1).select(S.request_key(F.lit("a"), F.lit(None)) == S.request_key(F.lit("a"), F.lit("null"))).first()[0] is False


def test_search_rows(spark):
    body = json.dumps({"results": [{"url": "u1", "content": "short", "raw_content": " "}, {"url": "u2", "content": None, "raw_content": None}, {"url": "u3", "content": "c", "raw_content": "long text", "published_date": "2024-01-01"}]})
    got = S.search_rows(spark.createDataFrame([("q", body), ("z", None), ("b", "{")], "k string, response string"), "k", 4).orderBy("rank").collect()
    assert [(r.rank, r.url, r.text, r.cut, r.timestamp) for r in got] == [(1, "u1", "shor", True, None), (3, "u3", "long", True, "2024-01-01")]


def test_batches(spark):
    df = spark.createDataFrame([(i, "g", f"t{i}") for i in range(5)], "ord int, g string, t string")
    got = S.batches(df, ["g"], "ord", 2, ["t"]).orderBy("batch").collect()
    assert [[x.t for x in r["items"]] for r in got] == [["t0", "t1"], ["t2", "t3"], ["t4"]]
