"""Chinese fact-check articles: quoted rumours with what corrects them, and labelled items paired into claims. Everything is a column expression over one article's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.functions.text import clean_title, let, strip

# Words right before a quotation that make it a rumour, words that refute, sentences that are no evidence, and headings that end a correction.
CUES = (
    "称", "声称", "发布", "流传", "传言", "网传", "写道", "显示", "提到", "表示", "配文", "发帖", "帖文", "消息", "援引", "爆料", "反映", "说", "询问", "疑问", "关于", "出现", "传出", "曝出", "曝", "涉及", "题为", "名为", "消息称",
)
REFUTING = ("辟谣", "不实", "谣言", "虚假", "假的", "误读", "不属实", "纯属虚构", "澄清", "求证", "真相", "误区", "捏造", "不准确", "并无", "未发生", "系伪")
BOILERPLATE = ("不信谣", "不传谣", "提醒广大", "请广大", "共同维护", "清朗网络", "擦亮双眼")
ENDING_HEADS = ("谣言", "真相", "事实", "详情", "科普", "提示", "通报", "热点", "关注", "误区", "警惕", "重要", "案例", "监制", "统筹", "来源", "文字", "设计", "执行", "编辑", "责任编辑", "策划", "审核")
# Labels that head an item, in the order in which they are tried; those in NUMBERED may carry a number.
LABELS = (
    "警方提示", "责任编辑", "举报电话", "举报网址", "举报客户端", "谣言", "辟谣", "真相", "误区", "详情", "科普", "事实", "提示", "通报", "热点", "关注", "警惕", "重要", "自行办理", "案例", "监制", "统筹", "来源", "文字", "设计", "执行",
    "编辑", "策划", "审核",
)
NUMBERED = ("误区", "案例")
CLAIM_LABELS, CORRECTION_LABELS = ("谣言", "辟谣", "误区"), ("真相", "详情", "事实", "科普")
META_LABELS = ("监制", "统筹", "来源", "文字", "设计", "执行", "编辑", "责任编辑", "策划", "审核")
#: Characters before a quotation that are looked at, least length of one, most quotations of a text, least length of a correction.
REACH, LEAST, MOST, LEAST_CORRECTION, SURE = 18, 8, 3, 20, 30

_QUOTE = "[“『「]([^”』」]{6,400})[”』」]"
_CUE = "(?:" + "|".join(CUES) + r")\s*[:：，,]?\s*$"
_MINED = "struct<claim:string,evidence:string,source:string,scope:string,method:string,confidence:string>"


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return F.regexp_like(text, F.lit("|".join(words)))


def quotes(text: Column) -> Column:
    """The longest quotations with a cue right before them, at most MOST, none a part of another; the longest first, equal ones by place."""
    pattern = "([^“『「”』」]{0,%d})%s" % (REACH, _QUOTE)
    found = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    all_ = F.zip_with(found(1), found(2), lambda b, q: F.struct(b.alias("b"), strip(q).alias("q")))
    hits = F.transform(F.filter(all_, lambda x: (F.length(x["q"]) >= LEAST) & x["b"].rlike(_CUE)), lambda x: x["q"])

    def best(qs: Column) -> Column:
        outer = F.filter(qs, lambda q: ~F.exists(qs, lambda o: (o != q) & F.contains(o, q)))
        placed = F.array_sort(F.transform(outer, lambda q, i: F.struct((-F.length(q)).alias("n"), i.alias("i"), q.alias("q"))))
        return F.transform(F.slice(placed, 1, MOST), lambda x: x["q"])

    return let(hits, best)


def correction(text: Column, quote: Column) -> Column:
    """What follows the sentence of a quotation, up to the next heading and without closing admonitions; null if it is short."""
    at = F.instr(text, quote)
    tail = F.substr(text, at + F.length(quote))
    after = F.when(tail.rlike("[。！？!?]"), F.regexp_replace(tail, "(?s)^.*?[。！？!?]", "")).otherwise(tail)
    body = F.split(after, r"(?:^|\n)\s*(?:" + "|".join(ENDING_HEADS) + ")[：:]", 2)[0]
    body = F.regexp_replace(strip(body), "^[。；;，, ]+", "")
    kept = F.aggregate(
        F.filter(F.split(body, "(?<=[。！？!?])"), lambda s: strip(s) != ""), F.struct(F.lit(False).alias("done"), F.lit("").alias("out")),
        lambda a, s: F.when(a["done"] | (any_of(s, BOILERPLATE) & (a["out"] != "")), F.struct(F.lit(True).alias("done"), a["out"].alias("out"))).otherwise(F.struct(F.lit(False).alias("done"), F.concat(a["out"], strip(s)).alias("out"))),
    )["out"]
    return F.when((at > 0) & (F.length(body) >= LEAST_CORRECTION), F.nullif(kept, F.lit("")))


def attribution(text: Column) -> Column:
    """Struct of text and source, where the text closes with one in brackets: （来源：X）."""
    pattern = r"(?s)^(.*)[（(]\s*来源\s*[:：]\s*([^）)]*?)\s*[）)][。 \t\r\n]*$"
    hit = text.rlike(pattern)
    return F.struct(F.when(hit, strip(F.regexp_extract(text, pattern, 1))).otherwise(text).alias("text"), F.when(hit, F.nullif(strip(F.regexp_extract(text, pattern, 2)), F.lit(""))).alias("source"))


def mine(title: Column, text: Column) -> Column:
    """Struct of claims and reason. Claims: the quotation of the title, then those of the text, each with what corrects it, else the whole text; without any, a title that is a question.
    reason: no_text, no_refutation_cue or no_claim_pattern where there are none."""
    body, head = strip(text), F.coalesce(title, F.lit(""))
    first = strip(F.regexp_extract(head, _QUOTE, 1))
    own = quotes(body)
    all_ = let(own, lambda qs: F.when((first != "") & ~F.array_contains(qs, first), F.concat(F.array(first), qs)).otherwise(qs))

    def claim(q: Column) -> Column:
        def with_evidence(c: Column) -> Column:
            a = attribution(F.coalesce(c, body))
            sure = (F.length(a["text"]) >= SURE) & any_of(a["text"], REFUTING)
            return F.struct(q.alias("claim"), a["text"].alias("evidence"), a["source"].alias("source"), F.when(c.isNull(), "full_text").otherwise("correction_after_quote").alias("scope"), F.lit("quoted_rumor").alias("method"), F.when(sure, "high").otherwise("low").alias("confidence")).cast(_MINED)

        return let(correction(body, q), with_evidence)

    question, whole = clean_title(head), attribution(body)
    asked = F.struct(question.alias("claim"), whole["text"].alias("evidence"), whole["source"].alias("source"), F.lit("full_text").alias("scope"), F.lit("title_question").alias("method"), F.lit("high").alias("confidence")).cast(_MINED)
    none = F.array().cast(f"array<{_MINED}>")
    by_title = F.when(question.rlike("[？?]$") & F.length(question).between(8, 90), F.array(asked)).otherwise(none)
    refutes = any_of(F.concat(head, F.lit(" "), body), REFUTING)
    claims = F.when(refutes, let(F.transform(all_, claim), lambda cs: F.when(F.size(cs) > 0, cs).otherwise(by_title))).otherwise(none)
    blank = F.coalesce(body == "", F.lit(True))
    return F.struct(F.when(blank, none).otherwise(claims).alias("claims"), F.when(blank, "no_text").when(~refutes, "no_refutation_cue").when(F.size(claims) == 0, "no_claim_pattern").alias("reason"))


def mined_claims(articles: DataFrame, key: str = "ord", title: str = "title", text: str = "text") -> DataFrame:
    """(key, place, claim, evidence, source, scope, method, confidence) of every mined claim, and a row with the reason for each article without one."""
    m = articles.select(key, mine(F.col(title), F.col(text)).alias("m"))
    return m.select(key, "m.reason", F.posexplode_outer("m.claims").alias("place", "c")).select(key, "place", "c.*", "reason")


def heading(paragraph: Column) -> Column:
    """Struct of label and rest where a paragraph opens an item: one of LABELS, also in spaced letters or with a number, and then white space or a colon; else null."""
    spaced = [r"\s*".join(x) + (r"(?:\s*(?:[一二三四五六七八九十]|\d+))?" if x in NUMBERED else "") for x in LABELS]
    pattern = "(?s)^(" + "|".join(spaced) + r")([\s：:]+)(.*)$"
    raw = F.regexp_replace(F.regexp_extract(paragraph, pattern, 1), r"\s+", "")
    label = F.regexp_replace(raw, "^(" + "|".join(NUMBERED) + r")[一二三四五六七八九十\d]+$", "$1")
    rest = strip(F.regexp_replace(F.regexp_extract(paragraph, pattern, 3), r"^[|｜·、—\-\s]+", ""))
    return F.when(paragraph.rlike(pattern), F.struct(label.alias("label"), rest.alias("rest")))


_ITEM = "struct<label:string,heading:string,body:array<string>>"


def items(paragraphs: Column) -> Column:
    """Items of an article from its paragraphs: a heading opens one, other paragraphs are the body of the last. Paragraphs before the first heading are dropped; an article without a
    heading is one item of the label 正文."""
    none = F.array().cast(f"array<{_ITEM}>")

    def step(acc: Column, p: Column) -> Column:
        def with_heading(h: Column) -> Column:
            new = F.struct(h["label"].alias("label"), h["rest"].alias("heading"), F.array().cast("array<string>").alias("body")).cast(_ITEM)
            last = F.element_at(acc, -1)
            longer = F.struct(last["label"].alias("label"), last["heading"].alias("heading"), F.array_append(last["body"], p).alias("body")).cast(_ITEM)
            return F.when(h.isNotNull(), F.array_append(acc, new)).when(F.size(acc) > 0, F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), longer)).otherwise(acc)

        return let(heading(p), with_heading)

    plain = F.array(F.struct(F.lit("正文").alias("label"), F.lit("").alias("heading"), paragraphs.alias("body")).cast(_ITEM))
    return let(F.aggregate(paragraphs, none, step), lambda got: F.when((F.size(got) == 0) & (F.size(paragraphs) > 0), plain).otherwise(got))


def item_claims(found: Column) -> Column:
    """Claims of items: each rumour item with a heading, corrected by the item after it if that is a correction, else by its own body."""
    pick = F.filter(F.transform(found, lambda x, i: F.struct(x.alias("x"), F.get(found, i + 1).alias("next"))), lambda p: p["x"]["label"].isin(*CLAIM_LABELS) & (p["x"]["heading"] != ""))

    def claim(p: Column) -> Column:
        x, n = p["x"], p["next"]
        fixed = F.coalesce(n["label"].isin(*CORRECTION_LABELS), F.lit(False))
        told = F.when(fixed, strip(F.array_join(F.concat(F.array(n["heading"]), n["body"]), "\n"))).when(F.size(x["body"]) > 0, strip(F.array_join(x["body"], "\n")))
        a = attribution(F.nullif(told, F.lit("")))
        return F.struct(
            x["label"].alias("label"), x["heading"].alias("claim"), F.when(fixed, n["heading"]).alias("correction"), F.when(fixed, n["label"]).alias("correction_label"), a["text"].alias("evidence"), a["source"].alias("source"),
            F.when(fixed, "following_correction").when(F.size(x["body"]) > 0, "same_item_body").alias("evidence_from"),
        )

    return F.transform(pick, claim)


def sections(found: Column) -> Column:
    """Items that say who made the article left out."""
    return F.filter(found, lambda x: ~x["label"].isin(*META_LABELS))
