"""Span edits of Chinese claims by eleven strategies: what a claim says is changed at places that the strategy finds, or said in other words.

Places and organisations are swapped for names of the same suffix that other claims hold (``adapt.swap_pools``). A claim draws its names from the numbered pool by a hash, so a
pool may have any number of names and no claim is given all of them. All other strategies need the claim alone; they find match offsets, so they are Python, run once a claim."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from datetime import date, timedelta
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from veridelta.operators.adapt import ORG_ENDS, PLACE_ENDS, org_ok, place_ok, swap_pools
from veridelta.operators.claims import edit, plans
from veridelta.operators.paths import draw

# The strategies in their order, the words that each exchanges, and the steps by which numbers and days move.
STRATEGIES = (
    "numeric_shift", "place_swap", "date_shift", "quantifier_swap", "org_swap", "severity_swap", "temporal_hedge_swap", "framing_paraphrase", "person_swap", "synonym_swap", "unit_restyle",
)
QUANTIFIERS = (
    ("全部", "部分"), ("所有", "个别"), ("大多数", "少数"), ("大部分", "小部分"), ("多数", "少数"), ("经常", "偶尔"), ("总是", "偶尔"), ("从来", "偶尔"), ("完全", "基本"), ("彻底", "部分"), ("永远", "暂时"),
)
#: Words that are no quantity before these.
QUANTIFIER_GUARDS = {"少数": ("民族", "名族"), "多数": ("民族",)}
SEVERITIES = (("严重", "轻微"), ("大量", "少量"), ("重大", "一般"), ("急剧", "缓慢"), ("持续", "短暂"), ("巨大", "微小"), ("紧急", "常规"), ("猛增", "略涨"), ("骤降", "微降"), ("成群", "零星"))
HEDGES = (("近日", "近期"), ("日前", "本周"), ("近期", "日前"), ("目前", "如今"), ("当天", "次日"), ("昨日", "前日"), ("今天", "昨天"), ("最近", "日前"))
FRAMINGS = (("网传", "有消息称"), ("有网民称", "有网友称"), ("网友称", "有网民称"), ("据传", "网传"))
SYNONYMS = (
    ("发生", "出现"), ("死亡", "身亡"), ("受伤", "负伤"), ("疑似", "疑为"), ("声称", "宣称"), ("系谣言", "是谣言"), ("不实", "虚假"), ("辟谣", "澄清"), ("导致", "引发"), ("查处", "处置"), ("流传", "传播"), ("涉及", "牵涉"),
)
UNITS = ((r"(?<=\d)元", "块钱"), (r"(?<=\d)块(?!钱)", "元"), ("公里", "千米"), ("千米", "公里"), ("公斤", "千克"), ("千克", "公斤"), ("平方米", "平米"), ("平米", "平方米"))
#: Surnames that may stand before 某; a longer list is a parameter.
SURNAMES = "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦许何吕张孔曹严华金魏陶姜"
NUMBER_UNITS = ("万", "亿", "千", "百", "人", "岁", "元", "块", "个", "名", "次", "天", "周", "斤", "公斤", "米", "公里", "%", "％")
NUMBER_STEPS = ((10, (1, 2, 3)), (100, (1, 2, 5, 10)), (1000, (10, 20, 50, 100)), (None, (100, 200, 500, 1000)))
DECIMAL_STEPS = (-0.5, -0.2, 0.2, 0.5)
DAY_STEPS = (-30, -15, -7, -3, -1, 1, 3, 7, 15, 30)
#: Share of numbers that grow; draws by which a claim looks for a name that it doesn't hold.
GROWS, DRAWS = 0.6, 6

_NUMBER = re.compile(r"(?<![\d.])(\d{1,6}(?:\.\d+)?)(" + "|".join(NUMBER_UNITS) + ")?")
_FULL, _ISO, _DAY = re.compile(r"(20\d{2})\s*年\s*(\d{1,2})\s*月(?:\s*(\d{1,2})\s*[日号])?"), re.compile(r"20\d{2}-\d{2}-\d{2}"), re.compile(r"(\d{1,2})\s*月\s*(\d{1,2})\s*[日号]")
_SOMEONE = re.compile("([一-龥])某(?:某|先生|女士)?")
_PLACE, _ORG = re.compile("[一-龥]{2,8}(?:" + "|".join(PLACE_ENDS) + ")"), re.compile("[一-龥]{2,10}(?:" + "|".join(ORG_ENDS) + ")")

Span = tuple[int, int, str]


def shifted(value: int, rng: random.Random) -> int:
    """A number moved by a step of its size, never below one."""
    steps = next(s for below, s in NUMBER_STEPS if below is None or value < below)
    return max(1, value + rng.choice(steps) * (1 if rng.random() < GROWS else -1))


def _numbers(text: str, rng: random.Random) -> Iterator[Span]:
    for m in _NUMBER.finditer(text):
        raw, unit = m.group(1), m.group(2) or ""
        if text[m.end() : m.end() + 1] in ("月", "日", "年", "号"):
            continue
        new = f"{round(max(0.1, float(raw) + rng.choice(DECIMAL_STEPS)), 1):g}" if "." in raw else str(shifted(int(raw), rng))
        if new != raw:
            yield m.start(), m.end(), new + unit


def _moved(original: str, make, rng: random.Random) -> str | None:
    """The first of the steps, in random order, that gives another date."""
    for step in rng.sample(DAY_STEPS, len(DAY_STEPS)):
        try:
            new = make(step)
        except (ValueError, OverflowError):
            continue
        if new and new != original:
            return new
    return None


def _dates(text: str, rng: random.Random) -> Iterator[Span]:
    def full(m: re.Match):
        y, mo, d = m.groups()

        def make(step: int) -> str:
            if d is None:
                return f"{y}年{(int(mo) - 1 + (1 if step > 0 else -1)) % 12 + 1}月"
            at = date(int(y), int(mo), int(d)) + timedelta(days=step)
            return f"{at.year}年{at.month}月{at.day}日"

        return make

    iso = lambda m: lambda step: (date.fromisoformat(m.group()) + timedelta(days=step)).isoformat()

    def day(m: re.Match):
        def make(step: int) -> str:
            at = date(2024, int(m.group(1)), int(m.group(2))) + timedelta(days=step)  # a leap year, so that every day exists
            return f"{at.month}月{at.day}日"

        return make

    for pattern, how in ((_FULL, full), (_ISO, iso), (_DAY, day)):
        for m in pattern.finditer(text):
            new = _moved(m.group(), how(m), rng)
            if new:
                yield m.start(), m.end(), new


def _pairs(text: str, pairs: tuple[tuple[str, str], ...], guards: dict[str, tuple[str, ...]] | None = None) -> Iterator[Span]:
    for word, new in pairs:
        for m in re.finditer(re.escape(word), text):
            if not text.startswith((guards or {}).get(word, ()), m.end()):
                yield m.start(), m.end(), new


def spans(text: str, strategy: str, rng: random.Random, names: dict[str, str], surnames: str = SURNAMES) -> list[Span]:
    """(start, end, replacement) of every place of the text that the strategy edits. ``names``: name -> the name drawn for it."""
    if strategy == "numeric_shift":
        return list(_numbers(text, rng))
    if strategy == "date_shift":
        return list(_dates(text, rng))
    if strategy in ("place_swap", "org_swap"):
        found = (_PLACE if strategy == "place_swap" else _ORG).finditer(text)
        return [(m.start(), m.end(), names[m.group()]) for m in found if m.group() in names]
    if strategy == "person_swap":
        return [(m.start(), m.start() + 1, rng.choice(surnames.replace(m.group(1), ""))) for m in _SOMEONE.finditer(text) if m.group(1) in surnames]
    if strategy == "unit_restyle":
        return [(m.start(), m.end(), new) for pattern, new in UNITS for m in re.finditer(pattern, text)]
    table = {"quantifier_swap": QUANTIFIERS, "severity_swap": SEVERITIES, "temporal_hedge_swap": HEDGES, "framing_paraphrase": FRAMINGS, "synonym_swap": SYNONYMS}[strategy]
    return list(_pairs(text, table, QUANTIFIER_GUARDS if strategy == "quantifier_swap" else None))


@udtf(returnType="strategy string, variant string, edits int")
class ChineseEdits:
    """Variants of a claim: all single edits in the order of the strategies, then ordered pairs and triples of strategies, up to ``most``; seeded by key."""

    def eval(self, key: str, text: str, names: dict, seed: int, most: int, surnames: str):
        if text is None:
            return
        found = {s: spans(text, s, random.Random(f"{seed}:{s}:{key}"), dict(names or {}), surnames) for s in STRATEGIES}
        seen = {text}
        made = ((name, edit(text, chosen), len(chosen)) for name, chosen in plans(found))
        yield from islice((x for x in made if x[1] not in seen and not seen.add(x[1])), most)


def drawn_names(claims: DataFrame, key: str, text: str, seed: int = 42) -> DataFrame:
    """(key, names MAP): for the places and organisations of a claim that another claim holds too, a name of the same suffix that the claim doesn't hold. A name is numbered in its pool
    and looked up by a hash, DRAWS times at most."""
    pools = swap_pools(claims, text).select("kind", "suffix", F.size("names").alias("n"), F.posexplode("names").alias("no", "name"))
    found = None
    for kind, pattern, ok in (("place", _PLACE.pattern, place_ok), ("organisation", _ORG.pattern, org_ok)):
        got = claims.select(key, F.col(text).alias("_text"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("name")).where(ok(F.col("name"))).withColumn("kind", F.lit(kind))
        found = got if found is None else found.unionByName(got)
    own = found.join(pools.select("kind", "name", "suffix", "n"), ["kind", "name"]).withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
    own = own.withColumn("no", F.pmod(draw(seed, F.col(key), F.col("name"), F.col("try")), "n").cast("int"))
    other = pools.select("kind", "suffix", "no", F.col("name").alias("other"))
    hit = own.join(other, ["kind", "suffix", "no"]).where((F.col("other") != F.col("name")) & ~F.contains("_text", F.col("other")))
    one = hit.groupBy(key, "name").agg(F.min_by("other", "try").alias("other"))
    return one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "other"))).alias("names"))


def chinese_edits(claims: DataFrame, key: str, text: str, seed: int = 42, most: int = 10, surnames: str = SURNAMES) -> DataFrame:
    """(key, strategy, variant, edits): up to ``most`` edited variants of each claim. ``key`` is unique; ``surnames`` has two or more."""
    base = claims.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("_c")).join(drawn_names(claims, key, text, seed), key, "left")
    base = base.withColumn("_k", F.col(key).cast("string")).withColumn("_n", F.coalesce("names", F.expr("cast(map() as map<string,string>)")))
    out = base.lateralJoin(ChineseEdits(F.col("_k").outer(), F.col("_c").outer(), F.col("_n").outer(), F.lit(seed), F.lit(most), F.lit(surnames)))
    return out.select(key, "strategy", "variant", "edits")
