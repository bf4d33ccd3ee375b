"""Steps between the stages of a dataset: listings, name pools, label maps, repairs, date upgrades from recorded answers, expansion of answers, and the adapter to gold records.

Every step is a DataFrame transform with its faults as data: rows that can't go on come back with the reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.functions import dates as D
from veridelta.functions import text as X

# How Chinese places and organisations end, and what a place can't end with, begin with or hold.
PLACE_ENDS = ("省", "市", "县", "区", "州", "盟", "旗")
ORG_ENDS = ("公司", "集团", "大学", "学院", "医院", "学校", "银行", "协会", "研究院", "研究所", "机场", "车站", "铁路局", "法院", "检察院", "工作室", "俱乐部", "基金会", "事务中心")
NO_PLACE_END = (
    "地区", "小区", "小镇", "城镇", "乡村", "农村", "新村", "景区", "园区", "城区", "郊区", "市区", "灾区", "山区", "辖区", "库区", "牧区", "矿区", "校区", "街区", "社区", "县区", "村镇", "九区", "某区", "各区",
    "上市", "都市", "城市", "集市", "夜市", "超市", "股市", "楼市", "车市", "菜市", "早市", "全市", "全省", "降价", "涨价",
)
NO_PLACE_HEAD = ("该", "某", "这", "那", "多", "全", "各", "部", "一", "些", "两", "几")
NO_PLACE_PART = ("部分", "一些", "某些", "广大", "各地", "全国", "多家", "多个", "少数", "首个", "市场", "上市", "都市", "超市", "股市", "楼市", "集市", "车市", "夜市", "菜市", "早市", "节约", "节省", "省份")
NO_PLACE_CHARS = "着待援救可以节能会要把被让给了的是在有定格"
PROVINCES = (
    "河北省", "山西省", "辽宁省", "吉林省", "黑龙江省", "江苏省", "浙江省", "安徽省", "福建省", "江西省", "山东省", "河南省", "湖北省", "湖南省", "广东省", "海南省", "四川省", "贵州省", "云南省", "陕西省", "甘肃省", "青海省", "台湾省",
)
PLACE = "[\\x{4e00}-\\x{9fa5}]{2,8}(?:" + "|".join(PLACE_ENDS) + ")"
ORG = "[\\x{4e00}-\\x{9fa5}]{2,10}(?:" + "|".join(ORG_ENDS) + ")"


def place_ok(name: Column) -> Column:
    """A name that the pattern of places found is one: three to nine characters, a province only if it exists, none of the endings, heads and parts of common words."""
    ends = lambda xs: F.regexp_like(name, F.lit("(?:" + "|".join(xs) + ")$"))
    common = ends(NO_PLACE_END) | F.regexp_like(name, F.lit("^[" + "".join(NO_PLACE_HEAD) + "]")) | F.regexp_like(name, F.lit("|".join(NO_PLACE_PART))) | F.regexp_like(name, F.lit("[" + NO_PLACE_CHARS + "]"))
    return F.length(name).between(3, 9) & F.when(name.endswith("省"), name.isin(*PROVINCES)).otherwise(~common)


def org_ok(name: Column) -> Column:
    return F.length(name).between(3, 12)


def swap_pools(claims: DataFrame, claim: str = "claim") -> DataFrame:
    """(kind, suffix, names): names of places by their last character and of organisations by their last three that two or more mentions hold, in pools of two or more."""
    each = []
    for kind, pattern, ok, size in (("place", PLACE, place_ok, 1), ("organisation", ORG, org_ok, 3)):
        found = claims.select(F.explode(F.regexp_extract_all(claim, F.lit(pattern), F.lit(0))).alias("name")).where(ok(F.col("name")))
        each.append(found.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(F.lit(kind).alias("kind"), F.expr(f"right(name, {size})").alias("suffix"), "name"))
    return each[0].unionByName(each[1]).groupBy("kind", "suffix").agg(F.array_sort(F.collect_list("name")).alias("names")).where(F.size("names") >= 2)


def evidence_rank(text: Column) -> Column:
    """The finest date that a text holds: 3 a day, 2 a month, 1 a year, 0 none."""
    m, gap, lo, hi = D.MONTHS, r"[\s\p{Z}]+", r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"  # letters and digits of all scripts make words
    day = rf"(?i){lo}(?:{m}){gap}\d{{1,2}},?{gap}\d{{4}}{hi}|{lo}\d{{1,2}}{gap}(?:{m}){gap}\d{{4}}{hi}|{lo}\d{{4}}-\d{{2}}-\d{{2}}{hi}"
    return F.when(text.rlike(day), 3).when(text.rlike(rf"(?i){lo}(?:{m}){gap}\d{{4}}{hi}"), 2).when(text.rlike(rf"{lo}(?:1[89]\d{{2}}|20\d{{2}}){hi}"), 1).otherwise(0)


def upgradable(facts: DataFrame, text: Column, precision: str) -> DataFrame:
    """The facts whose text may hold a finer date than theirs."""
    return facts.where(evidence_rank(text) > D.precision_rank(F.col(precision)))


def upgrade_dates(facts: DataFrame, answers: DataFrame, key: str, text: Column, date: str = "date", precision: str = "precision") -> DataFrame:
    """``facts`` with date and precision replaced by the answer (key, new_date, new_precision, quote) where this is finer, a partial date, and its quote a piece of the fact's text;
    ``upgraded`` says where. One answer for a fact; of several the least by (new_date, quote)."""
    one = answers.groupBy(key).agg(F.min(F.struct("new_date", "new_precision", "quote")).alias("_a"))
    a = F.col("_a")
    ok = a["new_date"].rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$") & (D.precision_rank(a["new_precision"]) > D.precision_rank(F.col(precision))) & (F.trim(a["quote"]) != "") & F.contains(text, F.trim(a["quote"]))
    out = facts.join(one, key, "left").withColumn("upgraded", F.coalesce(ok, F.lit(False)))
    return out.withColumn(date, F.when(F.col("upgraded"), a["new_date"]).otherwise(F.col(date))).withColumn(precision, F.when(F.col("upgraded"), a["new_precision"]).otherwise(F.col(precision))).drop("_a")


def recorded_dates(triples: DataFrame, statements: DataFrame, properties: DataFrame, release: str = "P577") -> DataFrame:
    """``triples`` (key, head, relation, tail, date, precision) with a finer date from recorded statements (entity, property, tail, date; partial ISO dates): of a property that holds once
    (``properties``: relation, property, once) the head's least date; of another the one dated statement that names the tail, if there is exactly one; else the least date of the tail's
    ``release`` property. Columns date, precision and origin (once, statement, release, null)."""
    dated = statements.where(D.precision(F.col("date")).isNotNull())
    least = dated.groupBy("entity", "property").agg(F.min("date").alias("d"))
    t = triples.join(properties, "relation", "left")
    once = t.where("once").select("key", F.col("head").alias("entity"), "property").join(least, ["entity", "property"]).groupBy("key").agg(F.min("d").alias("_once"))
    named = t.where("not once").select("key", F.col("head").alias("entity"), "property", "tail").join(dated, ["entity", "property", "tail"]).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("_statement")).where("n = 1").drop("n")
    told = triples.select("key", F.col("tail").alias("entity")).join(least.where(F.col("property") == release), "entity").groupBy("key").agg(F.min("d").alias("_release"))
    j = triples.join(once, "key", "left").join(named, "key", "left").join(told, "key", "left")
    new = F.coalesce("_once", "_statement", "_release")
    finer = D.precision_rank(D.precision(new)) > D.precision_rank(F.col("precision"))
    origin = F.when(F.col("_once").isNotNull(), "once").when(F.col("_statement").isNotNull(), "statement").otherwise("release")
    better = lambda a, b: F.when(F.coalesce(finer, F.lit(False)), a).otherwise(b)
    return j.select(*(c for c in triples.columns if c not in ("date", "precision")), better(new, F.col("date")).alias("date"), better(D.precision(new), F.col("precision")).alias("precision"), F.when(F.coalesce(finer, F.lit(False)), origin).alias("origin"))


def checked_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join by ``key``; rows of ``left`` without a partner are an error that names some of them."""
    lost = [r[0] for r in left.join(right.select(key).distinct(), key, "left_anti").select(key).orderBy(key).limit(10).collect()]
    if lost:
        raise ValueError(f"no partner for {key}: {', '.join(map(str, lost))}")
    return left.join(right, key)


def label_ids(parts: Sequence[DataFrame]) -> DataFrame:
    """(label, id) from tables (label, id, ord): the first table that has a label wins, in it the least ord."""
    all_ = parts[0].select("label", "id", F.lit(0).alias("prio"), "ord")
    for i, p in enumerate(parts[1:], 1):
        all_ = all_.unionByName(p.select("label", "id", F.lit(i).alias("prio"), "ord"))
    return all_.where("label is not null").groupBy("label").agg(F.min_by("id", F.struct("prio", "ord")).alias("id"))


def resolved(edges: DataFrame, ids: DataFrame, side: str = "tail") -> DataFrame:
    """``edges`` with <side>_id, null for a label that no table has."""
    return edges.join(ids.select(F.col("label").alias(side), F.col("id").alias(f"{side}_id")), side, "left")


def new_labels(found: DataFrame, known: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels of ``found`` that ``known`` doesn't hold, whatever their case and outer space."""
    norm = lambda df: df.select(F.lower(X.strip(F.col(label))).alias("_n"))
    own = found.where(F.col(label).isNotNull()).groupBy(F.lower(X.strip(F.col(label))).alias("_n")).agg(F.min(label).alias(label))
    return own.where("_n <> ''").join(norm(known).distinct(), "_n", "left_anti").select(label)


def repaired(source: DataFrame, existing: DataFrame, key: str, text: str, clean: Column) -> DataFrame:
    """``source`` with its text taken from ``existing`` where that is clean (a condition on ``text``): column status 'kept', or 'redo' where nothing clean is there."""
    have = existing.where(F.coalesce(clean, F.lit(False))).groupBy(key).agg(F.min(text).alias("_have"))
    out = source.join(have, key, "left")
    return out.withColumn("status", F.when(F.col("_have").isNotNull(), "kept").otherwise("redo")).withColumn(text, F.coalesce("_have", text)).drop("_have")


def listing_rows(rows: DataFrame, url: str, title: str, published: str, hosts: Column) -> DataFrame:
    """Rows of a listing that can be fetched: with a day of this century at the start of ``published`` and a URL of one of ``hosts`` (an array); others come with ``skipped``."""
    day = F.substring(published, 1, 10)
    ok = (F.trim(F.coalesce(url, F.lit(""))) != "") & day.rlike(r"^20\d{2}-\d{2}-\d{2}$") & F.array_contains(hosts, X.url_host(F.col(url)))
    return rows.withColumn("skipped", ~F.coalesce(ok, F.lit(False))).withColumn("day", day).withColumn(title, X.strip(F.regexp_replace(title, "<[^>]+>", "")))


def merge_listings(rows: DataFrame, url: str, column: str, order: str) -> DataFrame:
    """One row a URL: all of the first listing's row, and ``columns``, the listings that hold it in order."""
    rest = [c for c in rows.columns if c not in (url, order)]
    got = rows.groupBy(url).agg(F.min(order).alias(order), F.min_by(F.struct(*rest), order).alias("_r"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("c")))).alias("_c"))
    return got.select(url, order, "_r.*", F.transform("_c", lambda x: x["c"]).alias("columns"))


def expand_answers(parents: DataFrame, answers: DataFrame, key: str = "id", claim: str = "claim", most: int = 2) -> DataFrame:
    """Claims from recorded answers (key, response JSON: perturbations [{claim, edit}], truth {statement, basis}): of the first ``most`` perturbations those that are valid and differ, labelled
    false, and the true statement if it is valid, labelled true. Columns id, parent, place, claim, label, edit, method; what isn't valid comes with a ``problem`` instead."""
    kind = "perturbations array<struct<claim:string,edit:string>>, truth struct<statement:string,basis:string>"
    j = parents.select(F.col(key).alias("parent"), F.col(claim).alias("_own")).join(answers.select(F.col(key).alias("parent"), F.from_json("response", kind).alias("r")), "parent")
    edits = F.transform(F.slice(F.coalesce("r.perturbations", F.array().cast("array<struct<claim:string,edit:string>>")), 1, most), lambda p, i: F.struct(i.alias("place"), X.strip(p["claim"]).alias("claim"), F.lit(False).alias("label"), p["edit"].alias("edit"), F.lit("perturbation").alias("method"), F.lit(6).alias("least")))
    truth = F.struct(F.lit(most).alias("place"), X.strip(F.col("r.truth.statement")).alias("claim"), F.lit(True).alias("label"), F.col("r.truth.basis").alias("edit"), F.lit("true_statement").alias("method"), F.lit(8).alias("least"))
    each = j.select("parent", "_own", F.explode(F.concat(edits, F.array(truth))).alias("x")).select("parent", "_own", "x.*")
    valid = X.valid_claim(F.col("claim"), F.col("_own"), 6, 90) & (F.length("claim") >= F.col("least"))
    # among the few of one parent the same words count once
    first = each.where(valid & ~F.col("label")).groupBy("parent", X.squeeze(F.col("claim")).alias("_k")).agg(F.min("place").alias("_p"))
    out = each.withColumn("_k", X.squeeze(F.col("claim"))).join(first, ["parent", "_k"], "left")
    again = ~F.col("label") & (F.col("_p") < F.col("place"))
    problem = F.when(~F.coalesce(valid, F.lit(False)), F.when(F.col("label"), "invalid_statement").otherwise("invalid_perturbation")).when(F.coalesce(again, F.lit(False)), "repeated")
    new_id = F.concat(F.lit("llm_"), F.substring(F.sha2(F.concat_ws(":", "parent", "claim"), 256), 1, 20))
    return out.select(F.when(problem.isNull(), new_id).alias("id"), "parent", "place", "claim", "label", "edit", "method", problem.alias("problem"))


def retag(rows: DataFrame, **tags: object) -> DataFrame:
    """``rows`` with constant columns."""
    return rows.withColumns({k: F.lit(v) for k, v in tags.items()})


def _bounds(date: Column) -> Column:
    return F.struct(D.first_day(date).alias("start"), D.last_day(date).alias("end"))


def adapt_gold(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Gold records from claims (ord, id, claim, label, hop_count, time_window <start, end>, path_nodes, evidence_chain [<relation, date, fact_id, fact>], evidence, date) and facts (id, fact, url,
    date): id, claim, label, hop_count, time_window, reasoning_graph, evidence, reference_date, and ``failure``, the first of: bad_or_duplicate_id, empty_claim, no_window, no_graph, bad_window,
    window_reversed, hops_differ. Windows and edges widen partial dates to their bounds. Evidence holds each fact of the chain once, in order, from the fact table where it is known; a record
    without a fact gets its own evidence text as <id>-ev0."""
    turn = claims.where(~F.coalesce(X.strip(F.col("id")) == "", F.lit(True))).groupBy(F.col("id").alias("_id")).agg(F.min("ord").alias("_first"))
    base = claims.join(turn, F.col("id") == F.col("_id"), "left")
    ids = claims.select("ord", F.posexplode("evidence_chain").alias("pos", "e")).where(F.coalesce(F.col("e.fact_id"), F.lit("")) != "").groupBy("ord", F.col("e.fact_id").alias("fact_id")).agg(F.min("pos").alias("pos"), F.min_by("e", "pos").alias("e"))
    known = facts.select(F.col("id").alias("fact_id"), F.col("fact").alias("_fact"), F.col("url").alias("_url"), F.col("date").alias("_date"))
    text = F.when(F.coalesce("_fact", F.lit("")) != "", F.col("_fact")).otherwise(F.coalesce("e.fact", F.lit("")))
    item = F.struct(F.col("fact_id").alias("id"), F.col("_url").alias("url"), text.alias("text"), F.coalesce("_date", "e.date").alias("timestamp"))
    held = ids.join(known, "fact_id", "left").groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("v")))).alias("_ev"))
    own = F.array(F.struct(F.concat("id", F.lit("-ev0")).alias("id"), F.lit(None).cast("string").alias("url"), F.coalesce("evidence", F.lit("")).alias("text"), F.lit(None).cast("string").alias("timestamp")))
    w = F.col("time_window")
    nodes = F.transform("path_nodes", lambda x, i: F.struct(F.concat(F.lit("n"), i).alias("id"), x.alias("label"), F.lit("entity").alias("type")))
    edges = F.transform("evidence_chain", lambda e, i: F.struct(F.concat(F.lit("e"), i).alias("id"), F.concat(F.lit("n"), i).alias("head"), F.concat(F.lit("n"), i + 1).alias("tail"), e["relation"].alias("relation"), _bounds(e["date"])["start"].alias("start"), _bounds(e["date"])["end"].alias("end")))
    start, end = D.first_day(w["start"]), D.last_day(w["end"])
    none = lambda c: F.coalesce(c == "", F.lit(True))
    failure = (
        F.when(F.col("_first").isNull() | (F.col("_first") < F.col("ord")), "bad_or_duplicate_id").when(none(X.strip(F.col("claim"))), "empty_claim").when(none(w["start"]) | none(w["end"]), "no_window")
        .when((F.coalesce(F.size("path_nodes"), F.lit(0)) < 1) | (F.coalesce(F.size("evidence_chain"), F.lit(0)) < 1), "no_graph").when(start.isNull() | end.isNull(), "bad_window").when(start > end, "window_reversed")
        .when(F.size("path_nodes") != F.size("evidence_chain") + 1, "hops_differ")
    )
    ref = F.when(F.length("date") == 10, F.col("date"))
    return base.join(held, "ord", "left").select(
        "ord", "id", X.strip(F.col("claim")).alias("claim"), "label", "hop_count", F.struct(start.alias("start"), end.alias("end")).alias("time_window"), F.struct(nodes.alias("nodes"), edges.alias("edges")).alias("reasoning_graph"),
        F.coalesce(F.transform("_ev", lambda x: x["v"]), own).alias("evidence"), ref.alias("reference_date"), failure.alias("failure"),
    )


def months_back(today: Column, n: int) -> Column:
    """The last ``n`` whole months before a day, the latest first, as yyyy-MM."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.date_format(F.add_months(F.trunc(today, "month"), -i), "yyyy-MM"))


def month_seeds(spark, sources: DataFrame, start: str, end: str) -> DataFrame:
    """(turn, source, url) of sources (source, home, monthly): a monthly archive gives a URL for each month from the last to the first, another its home page; sources take turns."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    months = F.when(first <= last, F.reverse(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")))).otherwise(F.array().cast("array<date>"))
    urls = F.when(F.col("monthly"), F.transform(months, lambda m: F.concat("home", F.date_format(m, "yyyy/MM"), F.lit("/")))).otherwise(F.array("home"))
    return sources.select("source", F.posexplode(urls).alias("turn", "url")).select("turn", "source", "url")
