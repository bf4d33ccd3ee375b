import pytest
from pyspark.sql import functions as F

from veridelta.operators import articles as A


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_quotes(spark):
    text = "近日网传：“老磨坊本周将被拆除改建”，又有人说“老磨坊本周”不。主题是“共同守护我们的老磨坊吧”。视频称『灯塔昨夜倒塌多人受伤』。发帖「短的」。消息称“老磨坊本周将被拆除改建并出售给外地公司”。帖文“面包师要求延长夜间工作”"
    got = one(spark, text, A.quotes)
    assert got == ["老磨坊本周将被拆除改建并出售给外地公司", "面包师要求延长夜间工作", "灯塔昨夜倒塌多人受伤"]
    assert one(spark, "", A.quotes) == [] and one(spark, None, A.quotes) is None


def test_correction(spark):
    text = "网传“灯塔昨夜倒塌”。经核查，灯塔昨夜并未倒塌，照片拍摄于多年以前。港务局已作说明。请广大网民不信谣。再见。\n谣言：另一条"
    assert one(spark, text, lambda c: A.correction(c, F.lit("灯塔昨夜倒塌"))) == "经核查，灯塔昨夜并未倒塌，照片拍摄于多年以前。港务局已作说明。"
    assert one(spark, "网传“甲”。短。", lambda c: A.correction(c, F.lit("甲"))) is None and one(spark, "x", lambda c: A.correction(c, F.lit("甲"))) is None


@pytest.mark.parametrize("text, want", [("正文（来源：港务局）。", ("正文", "港务局")), ("（来源：甲）后面还有", ("（来源：甲）后面还有", None)), ("一（来源：甲）二(来源: 乙 )", ("一（来源：甲）二", "乙")), ("正文（来源：）", ("正文", None)), (None, (None, None))])
def test_attribution(spark, text, want):
    assert tuple(one(spark, text, A.attribution)) == want


def test_mining(spark):
    fix = "经核查该说法不实，灯塔完好，照片拍摄于多年以前的另一座港口，特此澄清。"
    rows = [(1, "谣言：“灯塔昨夜倒塌”？", f"网传“灯塔昨夜倒塌多人受伤”。{fix}（来源：港务局）"), (2, "标题", " "), (3, "标题", "今天天气很好"), (4, "栏目｜灯塔昨夜真的倒塌了吗？", "不实。"), (5, "标题", "该消息不实。"), (6, None, None)]
    got = {}
    for r in A.mined_claims(spark.createDataFrame(rows, "ord int, title string, text string")).collect():
        got.setdefault(r.ord, []).append(r)
    assert [(r.claim, r.scope, r.confidence) for r in got[1]] == [("灯塔昨夜倒塌", "correction_after_quote", "high"), ("灯塔昨夜倒塌多人受伤", "correction_after_quote", "high")]
    assert got[1][1].evidence == fix and got[1][1].source == "港务局"
    assert [got[k][0].reason for k in (2, 3, 5, 6)] == ["no_text", "no_refutation_cue", "no_claim_pattern", "no_text"]
    assert got[4][0].claim == "灯塔昨夜真的倒塌了吗？" and got[4][0].method == "title_question" and got[4][0].reason is None


@pytest.mark.parametrize("p, want", [("谣言：灯塔倒塌", ("谣言", "灯塔倒塌")), ("辟 谣 网传不实", ("辟谣", "网传不实")), ("误区一：不吃", ("误区", "不吃")), ("误区 12 不吃", ("误区", "不吃")), ("警方提示：小心", ("警方提示", "小心")), ("谣言止于智者", None), ("热点 | 新闻", ("热点", "新闻")), (None, None)])
def test_heading(spark, p, want):
    got = one(spark, p, A.heading)
    assert (got and tuple(got)) == want


def test_items_and_claims(spark):
    ps = ["导语", "谣言：灯塔倒塌", "真相：灯塔完好", "照片是旧的。（来源：港务局）", "误区一：不吃早饭", "其实要吃。", "谣言：没有下文", "编辑：某人"]
    df = spark.createDataFrame([(ps,), (["只有正文", "两段"],), ([],)], "p array<string>").withColumn("i", A.items(F.col("p"))).select("i", A.item_claims(F.col("i")).alias("c"), A.sections(F.col("i")).alias("s")).collect()
    assert [x.label for x in df[0].i] == ["谣言", "真相", "误区", "谣言", "编辑"] and [x.label for x in df[0].s] == ["谣言", "真相", "误区", "谣言"]
    a, b, c = df[0].c
    assert (a.claim, a.correction, a.evidence, a.source, a.evidence_from) == ("灯塔倒塌", "灯塔完好", "灯塔完好\n照片是旧的。", "港务局", "following_correction")
    assert (b.claim, b.correction, b.evidence, b.evidence_from) == ("不吃早饭", None, "其实要吃。", "same_item_body") and c.evidence is None and c.evidence_from is None
    assert [(x.label, x.body) for x in df[1].i] == [("正文", ["只有正文", "两段"])] and df[1].c == [] and df[2].i == []
