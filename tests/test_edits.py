import random
import re

import pytest

from veridelta.operators import edits as E


def after(text, strategy, names=None, seed=1):
    return [text[a:b] + ">" + new for a, b, new in E.spans(text, strategy, random.Random(seed), names or {})]


@pytest.mark.parametrize("strategy, text, want", [
    ("quantifier_swap", "全部居民和少数民族，大多数人经常来", {"全部>部分", "大多数>少数", "多数>少数", "经常>偶尔"}), ("severity_swap", "严重事故造成大量损失", {"严重>轻微", "大量>少量"}), ("temporal_hedge_swap", "近日，当天", {"近日>近期", "当天>次日"}),
    ("framing_paraphrase", "网传有网民称", {"网传>有消息称", "有网民称>有网友称"}), ("synonym_swap", "发生事故导致受伤", {"发生>出现", "导致>引发", "受伤>负伤"}), ("unit_restyle", "5元和3块，3块钱，2公里", {"元>块钱", "块>元", "公里>千米"}),
    ("place_swap", "记者在海州市看到", {}), ("person_swap", "路某说", set()), ("numeric_shift", "2020年5月3日", set()),
])
def test_strategies(strategy, text, want):
    assert set(after(text, strategy)) == set(want)


def test_numbers():
    for seed in range(40):
        got = dict(x.split(">") for x in after("共有7人和85元，350名，6000次，2.5万", "numeric_shift", seed=seed))
        assert set(got) <= {"7人", "85元", "350名", "6000次", "2.5万"} and len(got) == 5
        for raw, new in got.items():
            a, b = (float(re.match(r"[\d.]+", x).group()) for x in (raw, new))
            steps = {"7人": (1, 2, 3), "85元": (1, 2, 5, 10), "350名": (10, 20, 50, 100), "6000次": (100, 200, 500, 1000), "2.5万": (0.2, 0.5)}[raw]
            assert round(abs(a - b), 6) in steps and raw[-1] == new[-1]
    assert E.shifted(1, random.Random(0)) >= 1


def test_dates():
    for seed in range(30):
        got = [x.split(">") for x in after("2020年2月29日，2021-12-31，2019年12月，2月30日，3月5日", "date_shift", seed=seed)]
        assert [a for a, _ in got] == ["2020年2月29日", "2019年12月", "2021-12-31", "2月29日", "3月5日"] and all(a != b for a, b in got)
        assert got[1][1] in ("2019年11月", "2019年1月") and re.fullmatch(r"202[12]-\d\d-\d\d", got[2][1])


def test_someone():
    got = after("张某某和李某先生", "person_swap")
    assert [x[0] for x in got] == ["张", "李"] and all(x[0] != x[-1] and x[-1] in E.SURNAMES for x in got)


def test_names_come_from_the_pool(spark):
    texts = ["南京市发生火灾", "南京市有人", "芜湖市有人", "芜湖市发生火灾", "苏州市有人", "苏州市发生", "青山大学与云海大学", "青山大学", "云海大学", None, "", "北京图书馆有3人"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, c string").withColumn("names", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    names = {r.k: r.names for r in E.drawn_names(df, "k", "c").collect()}
    assert set(names[0]) == {"南京市"} and names[0]["南京市"] in ("芜湖市", "苏州市") and all(v not in texts[k] for k, m in names.items() for v in m.values())
    got = E.chinese_edits(df, "k", "c").collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append(r)
    assert any(r.strategy == "place_swap" for r in by[0]) and any(r.edits == 2 for r in by[0]) and 9 not in by and 10 not in by
    assert all(len(v) <= 10 and len({r.variant for r in v}) == len(v) and all(r.variant != texts[k] for r in v) for k, v in by.items())
    assert sorted(map(tuple, got)) == sorted(map(tuple, E.chinese_edits(df.repartition(3), "k", "c").collect()))
    assert E.chinese_edits(df.limit(0), "k", "c").count() == 0
