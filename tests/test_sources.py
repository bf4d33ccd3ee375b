import json

import pytest
from pyspark.sql import types as T

from veridelta.sources import pages, records

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])
PAGE = """<html><head><title>T</title><meta property="article:published_time" content="2024-06-16T10:00:00Z">
<script type="application/ld+json">{"@graph": [{"@type": "ClaimReview", "claimReviewed": "C &amp; D", "reviewRating": {"alternateName": "False"}, "datePublished": "2024-06-15"}]}</script>
<script type="application/ld+json">{broken</script></head><body><nav><p>Menu</p><a href="/a#x">a</a></nav><h1>Head <b>line</b></h1>
<article><p>One &lt; two.</p><p>Three<br>four</p><script>no</script></article><a href="/a">again</a><a href="b">b</a><footer><p>end</p></footer></body></html>"""


def test_extract():
    r = pages.extract(PAGE, "https://s.example/x/")
    assert r["title"] == "Head line" and r["text"] == "One < two.\nThree\nfour" and r["method"] == "html.article_container"
    assert [d["value"] for d in r["dates"]] == ["2024-06-15", "2024-06-16T10:00:00Z"] and r["bad_blocks"] == 1 and r["reviews"] == [{"claim": "C &amp; D", "rating": "False", "body": None}]
    assert r["links"] == ["https://s.example/a", "https://s.example/x/b"]


def test_extract_tries_places_in_order(spark):
    marked = '<main><p>all of it</p></main><div class="x article-body"><p>short</p></div><div id="zoom"><p>the longer text</p><aside>no</aside></div><article>much longer than the others, but unmarked</article>'
    r = pages.extract(marked, "https://s.example/")
    assert r["text"] == "the longer text" and r["method"] == "html.article_container"
    assert pages.extract("<main><p>a</p></main><main><p>bbb</p></main><p>c</p>", None)["text"] == "bbb"
    r = pages.extract("<p>a</p><div>x</div><p>b<p>c", None)
    assert r["text"].split("\n")[0] == "a" and r["method"] == "html.paragraph_fallback"
    ld = '<script type="application/ld+json">[{"@type": "Thing", "articleBody": "no", "datePublished": "2001-01-01"}, {"@type": ["https://schema.org/NewsArticle"], "articleBody": "yes", "headline": "H", "datePublished": "soon"}]</script>'
    r = pages.extract(ld + '<meta name="pubdate" content="May 4, 2011"><title>T</title><time itemprop="dateModified" datetime="2012-01-01"></time><time>2013-01-01</time><span class="pubtime">2014年1月2日</span>', None)
    assert (r["title"], r["text"], r["method"]) == ("H", "yes", "jsonld.articleBody")
    assert [(d["value"], d["method"]) for d in r["dates"]] == [("soon", "jsonld.datePublished"), ("May 4, 2011", "meta.pubdate"), ("2013-01-01", "html.time"), ("2014年1月2日", "html.publication_element")]
    df = spark.createDataFrame([(1, ld + '<meta name="pubdate" content="May 4, 2011">', "u"), (2, "", "u"), (3, None, None), (4, "<p>x</p><a href='http://[bad'>y</a>", "https://s.example")], "k int, html string, url string")
    got = {x.k: x for x in pages.extract_pages(df, "k").collect()}
    assert (got[1].published, got[1].date_method) == ("2011-05-04", "meta.pubdate") and got[2].published is None and got[3].text == "" and got[4].links == []


@pytest.mark.parametrize("html", ["", None, "<p>", "<<<>>>", "</div></div>", "<article><p>x"])
def test_broken_pages_do_not_raise(html):
    assert pages.extract(html, None)["links"] == []


def test_folder_with_sidecars(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.html").write_text(PAGE)
    (tmp_path / "a.json").write_text(json.dumps({"source": "s", "url": "https://s.example/x/"}))
    (tmp_path / "in/b.htm").write_text("<p>only</p>")
    got = pages.extract_pages(pages.read_folder(spark, str(tmp_path)), "path").collect()
    assert {r.text for r in got} == {"One < two.\nThree\nfour", "only"}
    assert pages.link_targets(pages.extract_pages(pages.read_folder(spark, str(tmp_path)), "path"), "path").count() == 2


def test_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": "a", "n": 1}\n\n{"id": "b"}\n[1]\n{oops\n')
    got = records.read_lines(spark, str(p), SCHEMA).cache()
    assert [(r.id, r.n) for r in got.where("_bad is null").collect()] == [("a", 1), ("b", None)]
    assert got.where("_bad is not null").count() == 2
    with pytest.raises(Exception):
        records.strict_lines(spark, str(p), SCHEMA).collect()
    assert records.tolerant(spark, str(tmp_path / "none*.jsonl"), SCHEMA).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], SCHEMA)
    out = str(tmp_path / "o")
    records.write_lines(df, out)
    assert records.strict_lines(spark, out, SCHEMA).count() == 2 and any('"n":null' in f.read_text() for f in (tmp_path / "o").glob("*.json"))
    with pytest.raises(Exception):
        records.write_lines(df, out)
    two = records.union_files(spark, [out, out], SCHEMA)
    assert [r.file_idx for r in two.orderBy("file_idx").collect()] == [0, 0, 1, 1]
    records.write_by(df, str(tmp_path / "by"), ["id"])
    assert spark.read.parquet(str(tmp_path / "by")).where("id = 'a'").count() == 1
    records.write_sheet(df.selectExpr("id", "array(n) as ns"), str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).columns == ["id", "ns"]
    one = records.fingerprint(spark, [str(tmp_path / "o")], {"k": 5, "api_key": "x"})
    assert one == records.fingerprint(spark, [str(tmp_path / "o")], {"k": 5, "api_key": "y"}) != records.fingerprint(spark, [str(tmp_path / "o")], {"k": 6})


def test_edge_lists(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [], "edges": [{"id": "e", "head": "a", "relation": "r", "tail": "b", "start": "2020-01-01", "end": "2020-01-01"}]}))
    assert records.edge_lists(spark, str(tmp_path / "g.json"), "typed").first().kind == "typed"


def test_path_library(spark, tmp_path):
    for h in (2, 3):
        (tmp_path / f"paths_{h}hop.json").write_text(json.dumps({"hops": h, "paths": [{"id": f"p{h}", "nodes": [{"qid": f"Q{k}", "label": "x"} for k in range(h + 1)]}]}))
    got = {r.id: (r.file, r.nodes, r.hops) for r in records.path_library(spark, str(tmp_path / "paths_*hop.json")).collect()}
    assert got == {"p2": ("paths_2hop.json", ["Q0", "Q1", "Q2"], 2), "p3": ("paths_3hop.json", ["Q0", "Q1", "Q2", "Q3"], 3)}


def test_small_files(spark, tmp_path):
    report = str(tmp_path / "r.json")
    records.write_report(spark.createDataFrame([("é", [1], None)], "name string, ns array<int>, none string"), report)
    assert json.loads((tmp_path / "r.json").read_text()) == {"name": "é", "ns": [1], "none": None} and "\n  " in (tmp_path / "r.json").read_text()
    with pytest.raises(FileExistsError):
        records.write_report(spark.createDataFrame([(1,)], "n int"), report)
    records.write_report(spark.createDataFrame([(1,)], "n int"), report, overwrite=True)
    assert json.loads((tmp_path / "r.json").read_text()) == {"n": 1}
    with pytest.raises(ValueError):
        records.write_report(spark.range(2), report, overwrite=True)
    records.write_summary(spark.createDataFrame([("é,x", None)], "a string, b int"), str(tmp_path / "s.csv"))
    assert (tmp_path / "s.csv").read_bytes().startswith(b"\xef\xbb\xbf") and (tmp_path / "s.csv").read_text("utf-8-sig").split() == ["a,b", '"é,x",']
    assert not list(tmp_path.glob("*.tmp"))
    with pytest.raises(ValueError):
        records.write_summary(spark.range(3), str(tmp_path / "t.csv"), most=2)


def test_map_links(spark):
    xml = "<urlset><url><loc> https://www.a.example/1?x=1&amp;y=2#f </loc></url><url><loc><![CDATA[https://b.example/2]]></loc></url><item><link>https://www.a.example/1?x=1&amp;y=2</link></item></urlset>"
    links = pages.map_links(spark.createDataFrame([(1, xml), (2, ""), (3, None)], "k int, x string"), "k", "x")
    assert [(r.target, r.place) for r in links.orderBy("place").collect()] == [("https://www.a.example/1?x=1&y=2", 0), ("https://b.example/2", 1)]
    own = pages.of_source(links, spark.createDataFrame([("a", "a.example")], "source string, domain string")).collect()
    assert [(r.source, r.target) for r in own] == [("a", "https://www.a.example/1?x=1&y=2")]
