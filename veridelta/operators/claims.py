"""Mining and rewriting claims: quotes with cues, corrections, relations by rule, entity mentions, span edits, expansion."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from itertools import islice, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from veridelta.functions import text as X
from veridelta.functions.dates import text_date
from veridelta.functions.text import SPACE, let, squeeze

#: Words before a quotation that say it is a rumour, looked for in so many characters before it.
CUES, CUE_REACH, QUOTE_LEAST, QUOTES_KEPT = r"(?i)claim|rumou?r|post|said|alleg|网传|传言|称|声称|谣言", 18, 8, 3
#: Cues that an article refutes something.
REFUTES = r"(?i)\b(?:false|fake|debunk|mislead|no evidence|not true)|谣言|不实|虚假|辟谣|误导"


def quote_candidates(text: Column) -> Column:
    """The longest quotations behind a cue, none inside another: an array, the longest first."""
    pattern = r"(?s)([^“”\"]{0,%d})[“\"]([^“”\"]{%d,})[”\"]" % (CUE_REACH, QUOTE_LEAST)
    before, inside = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    hits = F.transform(F.filter(F.arrays_zip(before.alias("b"), inside.alias("q")), lambda x: x["b"].rlike(CUES)), lambda x: x["q"])

    def longest(qs: Column) -> Column:
        outer = F.filter(F.array_distinct(qs), lambda q: ~F.exists(qs, lambda o: (F.length(o) > F.length(q)) & F.contains(o, q)))
        ranked = F.array_sort(F.transform(outer, lambda q: F.struct((-F.length(q)).alias("n"), q.alias("q"))))
        return F.transform(F.slice(ranked, 1, QUOTES_KEPT), lambda x: x["q"])

    return let(hits, longest)


def correction_after(text: Column, quote: Column, least: int = 20) -> Column:
    """What follows the sentence of the quotation, up to the next blank line; null when shorter than ``least``."""
    at = F.instr(text, quote)
    rest = F.substring(text, at + F.length(quote), F.length(text))
    after = F.regexp_extract(rest, r"(?s)^.*?(?:[.!?][”\"']?\s+|[。！？]|\n)(.*?)(?:\n\s*\n|$)", 1)
    clean = F.trim(F.regexp_replace(after, r"(?U)\s+", " "))
    return F.when((at > 0) & (F.length(clean) >= least), clean)


def mining_reason(title: Column, text: Column) -> Column:
    """Why an article isn't mined: no_text, no_refutation, no_quote; null when it is."""
    both = F.concat_ws(" ", title, text)
    return F.when(text.isNull() | (F.trim(text) == ""), "no_text").when(~both.rlike(REFUTES), "no_refutation").when(F.size(quote_candidates(text)) == 0, "no_quote")


_DAY = r"(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2},? \d{4}"
_NAME = r"([A-Z][A-Za-z'’\-\. ]{2,55}?)(?=[,;()]|\s+(?:and|but|or|who|which|where|when|in|on|at|from|by|for|with|as|of|to)\s|[.!?]|$)"
# Phrases that state a relation, what its object is, in the order in which they are tried. The object is the last group.
RELATION_RULES = (
    ("born_on", "date", rf"\bborn on ({_DAY})"),
    ("born_year", "value", r"\bborn in (\d{4})"),
    ("died_on", "date", rf"\bdied on ({_DAY})"),
    ("died_year", "value", r"\bdied in (\d{4})"),
    ("is_a", "value", r"\b(?:is|was) an? ([a-z][a-z \-]{2,50}?)(?:[.,;]| who| and )"),
    ("founded", "entity", r"\b(?:founded|co-founded|established|created) (?:the )?" + _NAME),
    ("member_of", "entity", r"\b(?:member of|joined|belonged to) (?:the )?" + _NAME),
    ("married_to", "entity", r"\bmarried " + _NAME),
    ("child_of", "entity", r"\b(?:son|daughter) of " + _NAME),
    ("parent_of", "entity", r"\b(?:father|mother) of " + _NAME),
    ("sibling_of", "entity", r"\b(?:brother|sister) of " + _NAME),
    ("acted_in", "entity", r"\b(?:played|portrayed|starred as) ([^.,;()]{2,50}?) in " + _NAME),
    ("directed", "entity", r"\bdirected (?:the )?" + _NAME),
    ("wrote", "entity", r"\b(?:wrote|authored) (?:the )?" + _NAME),
    ("released", "entity", r"\breleased (?:the )?" + _NAME),
    ("won", "entity", r"\bwon (?:the )?" + _NAME),
    ("nominated_for", "entity", r"\bnominated for (?:the )?" + _NAME),
    ("leader_of", "entity", r"\b(?:CEO|chairman|chairwoman|president|leader|head|director) of (?:the )?" + _NAME),
    ("worked_for", "entity", r"\b(?:worked for|employed by|worked at) " + _NAME),
    ("educated_at", "entity", r"\bgraduated from " + _NAME),
    ("located_in", "entity", r"\b(?:is |was |are |were )?(?:located|based|headquartered) in " + _NAME),
    ("occurred_in", "entity", r"\b(?:took place|occurred) in " + _NAME),
    ("served_as", "value", r"\bserved as (?:the )?([a-z][^.,;]{3,60}?)(?:[.,;]| and | from |$)"),
)
RELATION = "struct<relation:string,object:string,kind:string,role:string>"


def relation(sentence: Column, rules: tuple[tuple[str, str, str], ...] = RELATION_RULES, least: int = 3) -> Column:
    """Struct of relation, object, its kind (date, value or entity) and a role, by the first rule whose object is long enough; null for none."""
    out = F.lit(None).cast(RELATION)
    for name, kind, pattern in reversed(rules):
        groups = re.compile(pattern).groups
        got = F.trim(F.replace(F.regexp_extract(sentence, pattern, groups), F.lit('"'), F.lit("")))
        role = F.trim(F.regexp_extract(sentence, pattern, 1)) if groups > 1 else F.lit(None).cast("string")
        out = F.when(F.length(got) >= least, F.struct(F.lit(name).alias("relation"), got.alias("object"), F.lit(kind).alias("kind"), role.alias("role")).cast(RELATION)).otherwise(out)
    return out


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[a-z)»”\"][.!?])\s+|(?<=\d{3}[.!?])\s+|(?<=[。！？])|\n+"), lambda x: F.trim(x) != "")


def _name_tokens(text: Column) -> Column:
    """Words, numbers and what hyphens and apostrophes join; each Han character is one, as nothing parts Han words."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\p{IsHan}|[\w'’\-&&[^\p{IsHan}]]+"), F.lit(0))


def mentions(texts: DataFrame, names: DataFrame, key: str, text: str, small: int = 100_000) -> DataFrame:
    """(key, name, start, tokens): names that stand in the texts as token runs, longest first from the left, none over another.
    ``names``: name. The texts are scanned once for all names: a run is joined only where a name begins with its first token, at
    the lengths of such names. The dictionary is broadcast when counted small."""
    d = names.select("name").distinct().withColumn("_n", _name_tokens(F.col("name"))).where("size(_n) > 0")
    d = d.select("name", F.array_join("_n", " ").alias("_run"), F.col("_n")[0].alias("_t"), F.size("_n").alias("tokens"))
    count, most = d.agg(F.count(F.lit(1)), F.coalesce(F.max("tokens"), F.lit(1))).first()
    near = F.broadcast if count <= small else lambda x: x
    words = texts.select(key, _name_tokens(F.col(text)).alias("_ts"))
    runs = words.select(key, F.posexplode("_ts").alias("start", "_t"), "_ts").withColumn("_ts", F.slice("_ts", F.col("start") + 1, most))
    begins = d.groupBy("_t").agg(F.collect_set("tokens").alias("_lengths"))
    grams = runs.join(near(begins), "_t").select(key, "start", "_ts", F.explode("_lengths").alias("tokens")).where("tokens <= size(_ts)")
    grams = grams.select(key, "start", "tokens", F.array_join(F.slice("_ts", F.lit(1), F.col("tokens")), " ").alias("_run"))
    hit = grams.join(near(d.select("name", "_run")), "_run")
    ordered = F.array_sort(F.collect_list(F.struct("start", (-F.col("tokens")).alias("neg"), "name")))
    state = "struct<last:int,out:array<struct<start:int,tokens:int,name:string>>>"
    walk = F.aggregate(
        "_o", F.struct(F.lit(-1).alias("last"), F.array().cast("array<struct<start:int,tokens:int,name:string>>").alias("out")).cast(state),
        lambda a, x: F.when(x["start"] <= a["last"], a).otherwise(F.struct((x["start"] - x["neg"] - 1).alias("last"), F.array_append(a["out"], F.struct(x["start"].alias("start"), (-x["neg"]).alias("tokens"), x["name"].alias("name"))).alias("out")).cast(state)),
    )
    return hit.groupBy(key).agg(ordered.alias("_o")).select(key, F.explode(walk["out"]).alias("m")).select(key, "m.name", "m.start", "m.tokens")


# Single words that name nothing by themselves, and labels that aren't names.
STOP_SINGLE = (
    "from", "this", "that", "when", "while", "after", "before", "during", "there", "here", "these", "those", "their", "they", "what", "which", "where", "indian", "american", "chinese", "english", "french", "german", "russian",
    "japanese", "korean", "italian", "spanish", "mexican", "canadian", "australian", "european", "african", "asian", "national", "international", "college", "university", "city", "state", "world", "life", "war", "man", "woman",
    "king", "queen", "love", "home", "work", "game", "film", "music", "art", "history", "time", "people", "party", "company", "general", "black", "white", "great", "little", "young", "long", "short", "high", "low", "first",
    "united", "states", "county", "island", "river", "mountain", "house",
)
NO_NAMES = ("list", "main page")
#: Fewest letters of a name, and of one of a single word.
NAME_LEAST, SINGLE_LEAST = 4, 6


def distinctive_names(entities: DataFrame, key: str = "id", label: str = "label", title: str | None = None, views: str | None = None) -> DataFrame:
    """(name, id, ambiguous): what entities are looked for by. Label and title count without a closing parenthetical; a name needs four letters, a single word six and to be no common
    one. Of several entities of a name the one of most views stands for it (then of least id), and ``ambiguous`` says so."""
    names = F.array_distinct(F.array_compact(F.array(*(X.strip(F.regexp_replace(c, r"\s*\([^)]*\)\s*$", "")) for c in (label, title) if c))))
    seen = F.col(views) if views else F.lit(0)
    each = entities.select(F.col(key).alias("id"), F.coalesce(seen, F.lit(0)).alias("views"), F.explode(names).alias("n")).withColumn("name", F.regexp_replace("n", SPACE, " "))
    single = ~F.contains("name", F.lit(" "))
    good = (F.length("name") >= NAME_LEAST) & ~F.lower("name").isin(*NO_NAMES) & (~single | ((F.length("name") >= SINGLE_LEAST) & ~F.lower("name").isin(*STOP_SINGLE)))
    return each.where(good).groupBy("name").agg(F.min_by("id", F.struct((-F.col("views")).alias("v"), "id")).alias("id"), (F.count_distinct("id") > 1).alias("ambiguous"))


def relation_edges(facts: DataFrame, names: DataFrame, key: str = "id", head: str = "head", text: str = "text", date: str = "date", precision: str = "precision") -> DataFrame:
    """(key, head, relation, tail, tail_label, tail_type, date, precision, role, ambiguous) of the facts that state a relation. An object that is an entity is looked for among ``names``
    (name, id, ambiguous; see ``distinctive_names``): the first longest name in it; what isn't found keeps its words. Dates of birth and death are those that are told, others the fact's."""
    r = facts.select(key, F.col(head).alias("head"), F.col(date).alias("_date"), F.col(precision).alias("_precision"), relation(F.col(text)).alias("r")).where("r is not null")
    flat = r.select(key, "head", "_date", "_precision", "r.*")
    found = mentions(flat.where("kind = 'entity'").select(key, "object"), names.select("name"), key, "object")
    first = found.groupBy(key).agg(F.min_by("name", "start").alias("name")).join(names.select("name", F.col("id").alias("tail"), "ambiguous"), "name").select(key, "name", "tail", "ambiguous")
    j = flat.join(first, key, "left")
    told, year = F.col("kind") == "date", F.col("relation").isin("born_year", "died_year")
    at = F.when(told, text_date(F.col("object"), F.col("_date"))).when(year, F.col("object")).otherwise(F.col("_date"))
    how = F.when(told, F.when(F.length(at) == 10, "day").otherwise("year")).when(year, "year").otherwise(F.col("_precision"))
    kind = F.when(F.col("tail").isNotNull(), "entity").when(F.col("kind") == "value", "value").otherwise("other")
    return j.select(key, "head", "relation", "tail", F.coalesce("name", "object").alias("tail_label"), kind.alias("tail_type"), at.alias("date"), how.alias("precision"), "role", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


# Span edits: each strategy finds places in a text and says what to put there. Choices come from a generator seeded by key and
# strategy, so a claim's variants don't depend on what else is in the table.
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth")
_PAIRS = {
    "order": (("before", "after"), ("earlier", "later"), ("以前", "以后"), ("之前", "之后")),
    "degree": (("more", "less"), ("most", "least"), ("at least", "at most"), ("all", "some"), ("所有", "部分"), ("不到", "超过")),
    "direction": (("north", "south"), ("east", "west"), ("upper", "lower"), ("Upper", "Lower"), ("上", "下")),
    "polarity": (("always", "never"), ("supported", "opposed"), ("confirmed", "denied"), ("accepted", "rejected"), ("支持", "反对"), ("确认", "否认")),
}
_NUMBER = re.compile(r"(?<![\d,.-])\d{1,3}(?:,\d{3})+(?![\d,-])|(?<![\d,.-])\d{1,6}(?![\d,年月日-])")
_YEAR = re.compile(r"(?<!\d)(?:19|20)\d{2}(?=-\d{2}-\d{2}|年|(?!\d))")
_MONTH_NO = re.compile(r"(?<=\d{4}-)\d{2}(?=-\d{2})|(?<=\d年)\d{1,2}(?=月)")
_DAY_NO = re.compile(r"(?<=\d{4}-\d{2}-)\d{2}(?!\d)|(?<=月)\d{1,2}(?=日)")
_NAME = re.compile(r"\b(?:[A-Z][\w'’-]+ )+[A-Z][\w'’-]+\b")
_IS = re.compile(r"\b(?:is|was|were|are|has|had|can|will)\b(?! not)")
STRATEGIES = ("number", "year", "month", "day", "ordinal", "name", "negation", *_PAIRS)


def _table(pairs: tuple[tuple[str, str], ...]) -> tuple[re.Pattern, dict[str, str]]:
    swap = {x: y for a, b in pairs for x, y in ((a, b), (b, a))}
    word = lambda w: rf"\b{w}\b" if w.isascii() else w
    return re.compile("|".join(word(w) for w in sorted(swap, key=len, reverse=True))), swap


_SWAPS = {k: _table(v) for k, v in _PAIRS.items()}


def _other(value: int, low: int, high: int, rng: random.Random) -> int:
    return rng.choice([v for v in range(low, high + 1) if v != value])


def spans(text: str, strategy: str, rng: random.Random, pool: list[str]) -> list[tuple[int, int, str]]:
    """(start, end, replacement) of every place the strategy can edit. A day is moved within 1..28, so the date stays a date."""
    put = lambda m, new: (m.start(), m.end(), new)
    if strategy == "number":
        out = []
        for m in _NUMBER.finditer(text):
            v = int(m.group().replace(",", ""))
            v += (1 if v < 10 else 5 if v < 100 else 25 if v < 1000 else v // 10) * rng.choice((1, 2, 3))
            out.append(put(m, f"{v:,}" if "," in m.group() else str(v)))
        return out
    if strategy == "year":
        return [put(m, str(int(m.group()) + rng.choice((-3, -2, -1, 1, 2)))) for m in _YEAR.finditer(text)]
    if strategy in ("month", "day"):
        numbers = _MONTH_NO if strategy == "month" else _DAY_NO
        out = [put(m, str(_other(int(m.group()), 1, 12 if strategy == "month" else 28, rng)).zfill(len(m.group()))) for m in numbers.finditer(text)]
        if strategy == "month":
            out += [put(m, rng.choice([x for x in _MONTHS if x != m.group()])) for m in re.finditer(r"\b(?:" + "|".join(_MONTHS) + r")\b(?= \d|,? \d{4})", text)]
        return out
    if strategy == "ordinal":
        return [put(m, rng.choice([x for x in _ORDINALS if x != m.group()])) for m in re.finditer(r"\b(?:" + "|".join(_ORDINALS) + r")\b", text)]
    if strategy == "name":
        return [put(m, rng.choice(other)) for m in _NAME.finditer(text) if (other := [p for p in pool if p != m.group()])]
    if strategy == "negation":
        return [(m.start(), m.end(), f"{m.group()} not") for m in _IS.finditer(text)]
    pattern, swap = _SWAPS[strategy]
    return [put(m, swap[m.group()]) for m in pattern.finditer(text)]


def edit(text: str, chosen: list[tuple[int, int, str]]) -> str:
    """The text with the spans replaced, from the back, so that places stay right."""
    for a, b, new in sorted(chosen, reverse=True):
        text = text[:a] + new + text[b:]
    return text


def _apart(choices: list[list[tuple[int, int, str]]], chosen: tuple[tuple[int, int, str], ...] = ()) -> tuple[tuple[int, int, str], ...] | None:
    """The first pick of a place from each list, none over another; null for none."""
    if not choices:
        return chosen
    free = (x for x in choices[0] if all(x[1] <= y[0] or y[1] <= x[0] for y in chosen))
    return next((got for x in free if (got := _apart(choices[1:], (*chosen, x)))), None)


def plans(found: dict[str, list[tuple[int, int, str]]]) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """(strategies, edits): all single edits, then one of each ordered pair and each ordered triple of strategies whose places
    are apart; the first strategy takes its foremost place that fits, the others their last."""
    for s, spots in found.items():
        for x in spots:
            yield s, [x]
    some = [s for s in found if found[s]]
    for k in (2, 3):
        for combo in permutations(some, k):
            got = _apart([found[combo[0]], *(found[s][::-1] for s in combo[1:])])
            if got:
                yield "+".join(combo), list(got)


@udtf(returnType="strategy string, variant string, edits int")
class SpanEdits:
    """The plans of a claim that give new texts, up to ``most``; seeded by key."""

    def eval(self, key: str, text: str, pool: list[str], seed: int, most: int):
        if text is None:
            return
        seen = {text}
        found = {}
        for s in STRATEGIES:
            found[s] = spans(text, s, random.Random(f"{seed}:{s}:{key}"), list(pool or []))
        made = ((name, edit(text, chosen), len(chosen)) for name, chosen in plans(found))
        yield from islice((x for x in made if x[1] not in seen and not seen.add(x[1])), most)


def span_edits(claims: DataFrame, key: str, text: str, pool: Column | None = None, seed: int = 42, most: int = 10) -> DataFrame:
    """(key, strategy, variant, edits): up to ``most`` perturbed variants of each claim."""
    base = claims.select(F.col(key), F.col(key).cast("string").alias("_k"), F.col(text).alias("_c"), (pool if pool is not None else F.array().cast("array<string>")).alias("_p"))
    out = base.lateralJoin(SpanEdits(F.col("_k").outer(), F.col("_c").outer(), F.col("_p").outer(), F.lit(seed), F.lit(most)))
    return out.select(key, "strategy", "variant", "edits")


def expand_paths(paths: DataFrame, key: str, positives: str, negatives: str) -> DataFrame:
    """(key, claim, label): the positive and negative texts of each path, one a row, blank ones and copies out."""
    side = lambda c, label: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(x.alias("claim"), F.lit(label).alias("label")))
    rows = paths.select(key, F.explode(F.array_distinct(F.concat(side(F.col(positives), True), side(F.col(negatives), False)))).alias("x"))
    return rows.select(key, "x.claim", "x.label").where(squeeze(F.col("claim")) != "")


def apply_responses(rows: DataFrame, responses: DataFrame, key: list[str], order: str, field: str) -> DataFrame:
    """``rows`` with ``field`` taken from the last response of the same key, where there is one that isn't blank."""
    last = responses.groupBy(*key).agg(F.max_by(field, order).alias("_new"))
    out = rows.join(last, key, "left")
    return out.withColumn(field, F.when(F.trim(F.coalesce("_new", F.lit(""))) != "", F.col("_new")).otherwise(F.col(field))).drop("_new")
