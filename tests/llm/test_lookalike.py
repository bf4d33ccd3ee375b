import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veridelta.llm import lookalike as L

fold = L.transducer().fold


@pytest.mark.parametrize(
    "a, b",
    [("ＡＢ１２", "AB12"), ("été", "été"), ("a b c　d", "a b c d"), ("ze​ro﻿­", "zero"), ("ﬁn ﬂow", "fin flow"), ("рарег", "papeг"), ("Κοde", "Kode"), ("⼈⽇", "人日"), ("e​́", "é"), ("ё", "ë"), ("ĳ", "ij")],
)
def test_same_look(a, b):
    assert fold(a) == fold(b)


@pytest.mark.parametrize("a, b", [("A", "a"), ("é", "e"), ("x²", "x2"), ("a\nb", "a b"), ("a", "b"), ("œ", "oe"), ("B", "8"), ("й", "и"), ("O", "0"), ("l", "1")])
def test_other_look(a, b):
    assert fold(a) != fold(b)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_idempotent_and_one_pass(s):
    assert fold(fold(s)) == fold(s)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aбeоｅ́ﬁ​ ²Ж图", max_size=20))
def test_equals_cluster_by_cluster(s):
    """The transducer against the rules applied to the whole text at once."""
    import unicodedata

    assert fold(s) == unicodedata.normalize("NFC", L.fold_cluster(s))


def test_clusters_are_compiled():
    """Every base that looks like one with a composed form stands in the table together with the mark."""
    t = L.compile_table()
    assert t["e\u0301"] == "é" and t["е\u0301"] == "é" and t["ｅ\u0301"] == "é" and t["𝐞\u0301"] == "é" and t["о\u0308"] == "ö" and t["и\u0306"] == "й"
    assert sum(len(k) == 2 for k in t) > 5000
    assert all(L.fold_cluster(k) == v for k, v in t.items() if len(k) == 2)


def test_classes(spark):
    df = spark.createDataFrame([(1, "paper", None), (2, "рарег", "x"), (3, "рaper", "x"), (4, "paper", "ｘ"), (5, None, "")], "ord long, text string, claim string").withColumn("look", F.lit(1)).withColumn("rows", F.lit(1))
    got = {(r.field, r.ord): r for r in L.look_classes(df).collect()}
    assert len(got) == 8 and (got[("text", 1)].spellings, got[("text", 1)].rows) == (2, 3) and got[("text", 1)].look == got[("text", 3)].look != got[("text", 2)].look
    assert (got[("claim", 4)].spellings, got[("claim", 4)].rows) == (2, 3) and got[("claim", 5)].spellings == 1
    assert L.look_classes(df.limit(0)).count() == 0


def test_table_is_checked(monkeypatch):
    assert len(L.compile_table()) > 1000
    monkeypatch.setitem(L.LOOKALIKE, "щ", "Щ")
    with pytest.raises(ValueError):
        L.compile_table()


def test_pairs(spark):
    df = spark.createDataFrame([(1, "paper", None), (2, "рарег", "x"), (3, "рaper", "x"), (4, "Paper", "ｘ"), (5, None, ""), (6, "paper", "​")], "ord long, text string, claim string")
    df = df.withColumn("form", F.lit(1)).withColumn("raw", F.lit(2)).withColumn("field", F.lit(3)).withColumn("value", F.lit(4))
    assert {tuple(r) for r in L.same_looking_pairs(df).collect()} == {("text", 1, 3), ("text", 3, 6), ("claim", 2, 4), ("claim", 3, 4), ("claim", 5, 6)}
    assert L.same_looking_pairs(df.limit(0)).count() == 0


def test_canonical_column(spark):
    df = spark.createDataFrame([("ａ", 1), (None, 2)], "t string, canonical int")
    got = L.canonicalize(df, "t")
    assert got.columns == ["t", "canonical"] and [r.canonical for r in got.collect()] == ["a", None]
