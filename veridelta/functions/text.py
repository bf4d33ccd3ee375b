"""Column functions over text and URLs. All are built-in expressions and null-safe: null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
HAN = r"[一-鿿㐀-䶿]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_lines(c: Column) -> Column:
    """Lines with single spaces, without the empty ones."""
    lines = F.transform(F.split(c, r"\R"), lambda x: strip(F.regexp_replace(x, SPACE, " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def squeeze(c: Column) -> Column:
    """Without white space: the key by which claims are compared."""
    return F.regexp_replace(c, SPACE, "")


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def url_reason(url: Column) -> Column:
    """Why a URL can't be used, null if it can: blank, space, scheme, host, credentials; checked in this order."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(rest, "^.*@", ""), r":[0-9]*$", "")
    return (
        F.when(url.isNull() | (strip(url) == ""), "blank")
        .when(url.rlike(r"(?U)\s"), "space")
        .when(~F.lower(url).rlike("^https?://"), "scheme")
        .when(host == "", "host")
        .when(F.instr(rest, "@") > 0, "credentials")
    )


def scoring_url(url: Column) -> Column:
    """The form in which URLs are equal: scheme and host in small letters, no default port, no fragment, '/' for no path."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/?#]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    path = F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(url_reason(url).isNull(), F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), query))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/?#:]*)", 1))


# What verdict words mean.
VERDICTS = {
    "true": "true", "correct": "true", "real": "true", "mostly true": "true", "真实": "true", "真": "true", "属实": "true",
    "false": "false", "fake": "false", "incorrect": "false", "mostly false": "false", "谣言": "false", "假": "false", "不实": "false", "虚假": "false",
    "mixed": "mixed", "mixture": "mixed", "misleading": "mixed", "partly true": "mixed", "部分属实": "mixed", "误导": "mixed",
}
# Labels of either truth value, written as text.
TRUE_LABELS = ("true", "supported", "supports", "real", "真实", "真", "支持")
FALSE_LABELS = ("false", "refuted", "refutes", "fake", "虚假", "假", "反驳")
#: Most characters of a banner before a title.
BANNER = 24


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The table's value for ``c``, null for none."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)


def verdict(c: Column, table: dict[str, str] = VERDICTS) -> Column:
    """'true', 'false', 'mixed' or null."""
    return lookup(F.regexp_replace(F.lower(strip(c)), r"(?U)[\s_-]+", " "), table)


def binary_label(c: Column) -> Column:
    """A label written as text: true, false, or null for anything else (an error to the caller)."""
    low = strip(F.lower(c))
    return F.when(low.isin(*TRUE_LABELS), True).when(low.isin(*FALSE_LABELS), False)


def strip_tags(c: Column) -> Column:
    """Without tags, with the five named entities and numeric ones of ASCII resolved."""
    out = F.regexp_replace(c, "<[^>]*>", "")
    for name, ch in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("#39", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(ch))
    return out


def trailing_source(c: Column) -> Column:
    """Struct of body and attribution, where the text closes with one in brackets: '... (source: X)' or '（来源：X）'."""
    pattern = r"(?s)^(.*?)\s*[(（](?:source|sources|来源|据)\s*[:：]\s*([^()（）]+)[)）]\s*$"
    hit = c.rlike(pattern)
    return F.struct(F.when(hit, F.regexp_extract(c, pattern, 1)).otherwise(c).alias("body"), F.when(hit, F.regexp_extract(c, pattern, 2)).alias("attribution"))


def clean_title(c: Column, most: int = BANNER) -> Column:
    """Without a banner of at most ``most`` characters before the first full-width bar or, where there is none, the first plain bar."""
    t = strip(c)
    bar = F.when(F.instr(t, "｜") > 0, F.instr(t, "｜")).otherwise(F.instr(t, "|"))
    return F.when((bar > 0) & (bar - 1 <= most), strip(F.substr(t, bar + 1))).otherwise(t)


def wikitext(c: Column, depth: int = 8) -> Column:
    """Plain text of wiki markup: comments, references, nested templates and tables out; links by their label."""
    out = F.regexp_replace(c, r"(?s)<!--.*?-->|<ref[^>/]*/>|<ref[^>]*>.*?</ref>", "")
    for _ in range(depth):
        out = F.regexp_replace(out, r"\{\{[^{}]*\}\}", "")
    out = F.regexp_replace(out, r"(?s)\{\|.*?\|\}", "")
    out = F.regexp_replace(out, r"\[\[(?:File|Image|Category|文件|分类):[^\]]*\]\]", "")
    out = F.regexp_replace(out, r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", "$1")
    out = F.regexp_replace(out, r"\[https?://\S+\s+([^\]]*)\]", "$1")
    out = F.regexp_replace(out, r"'{2,}", "")
    out = F.regexp_replace(out, r"(?m)^=+\s*(.*?)\s*=+\s*$", "$1")
    return clean_lines(F.regexp_replace(out, "<[^>]+>", ""))


def name_variants(c: Column) -> Column:
    """The name, and without a closing parenthetical; distinct, in this order."""
    bare = strip(F.regexp_replace(c, r"\s*[(（][^()（）]*[)）]\s*$", ""))
    return F.array_distinct(F.filter(F.array(strip(c), bare), lambda x: x != ""))


def unresolved(c: Column, ids: Column) -> Column:
    """A placeholder is left: braces, a tag, TODO or TBD, or a literal query id as a word."""
    return c.rlike(r"[{}]|<[A-Za-z_]+>|(?i)\b(?:TODO|TBD)\b") | F.exists(ids, lambda i: F.array_contains(F.split(c, "[^A-Za-z0-9_]+"), i))


def digits_preserved(before: Column, after: Column) -> Column:
    """Every run of digits of ``before`` stands in ``after``."""
    return F.forall(F.regexp_extract_all(before, F.lit("[0-9]+"), F.lit(0)), lambda d: F.contains(after, d))


def han_ratio(c: Column) -> Column:
    return F.regexp_count(c, F.lit(HAN)) / F.greatest(F.length(c), F.lit(1))


def valid_claim(c: Column, parent: Column, least: int = 6, most: int = 90) -> Column:
    """Long enough, not too long, another than its parent, without left-over markup."""
    return F.coalesce(F.length(c).between(least, most) & (squeeze(c) != squeeze(parent)) & ~c.rlike(r"[{}<>]|\.\.\.|……|\bN/A\b"), F.lit(False))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, also where lambdas read it again and again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def capital_ngrams(c: Column, most: int = 5) -> Column:
    """Runs of one to ``most`` neighbouring capitalised words, as spaced strings, from each start."""
    # a word that isn't capitalised becomes null; a run from a start ends before the first null
    words = F.transform(F.regexp_extract_all(c, F.lit(r"(?U)[\w'’-]+"), F.lit(0)), lambda w: F.when(w.rlike(r"(?U)^\p{Lu}"), w))

    def runs(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda i: F.get(w, i - 1).isNotNull())
        grams = F.transform(starts, lambda i: F.filter(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.slice(w, i, n)), lambda g: F.forall(g, lambda x: x.isNotNull())))
        return F.array_distinct(F.transform(F.flatten(grams), lambda g: F.array_join(g, " ")))

    return let(words, runs)


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements in order."""
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def chain(edges: Column, bar: str = " | ") -> Column:
    """Facts of a path in one line: head relation tail (start..end)."""
    one = lambda e: F.concat_ws(" ", e["head"], e["relation"], e["tail"], F.concat(F.lit("("), e["start"], F.lit(".."), e["end"], F.lit(")")))
    return F.array_join(F.transform(edges, one), bar)


def stable_id(prefix: str, *parts: Column, compact: bool = False) -> Column:
    """prefix + the first 20 hex digits of SHA-256: of a JSON array of the parts, with or without a space after commas, as text."""
    if compact:
        body = F.to_json(F.array(*parts))
    else:
        quoted = [F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("null")) for p in parts]
        body = F.concat(F.lit("["), F.concat_ws(", ", *quoted), F.lit("]"))
    return F.concat(F.lit(prefix), F.substring(F.sha2(body, 256), 1, 20))


def best_label(labels: Column, languages: tuple[str, ...] = ("en", "zh")) -> Column:
    """The first label that isn't blank, by language: from a map of language to label."""
    return F.coalesce(*(F.nullif(F.try_element_at(labels, F.lit(x)), F.lit("")) for x in languages))


def first_category(ids: Column, categories: dict[str, tuple[str, ...]]) -> Column:
    """The first category one of whose ids is among ``ids``; null for none."""
    return F.coalesce(*(F.when(F.arrays_overlap(ids, F.array(*map(F.lit, wanted))), F.lit(name)) for name, wanted in categories.items()))


def is_leaf_category(title: Column) -> Column:
    """A category of things in or of a place, and no container of categories by something."""
    return ~F.contains(title, F.lit(" by ")) & (F.contains(title, F.lit(" in ")) | F.contains(title, F.lit(" of ")))


def url_class(url: Column, source: Column, articles: dict[str, str], discovery: dict[str, str]) -> Column:
    """'article', 'discovery' or null for a URL of a source: by the source's pattern over the path. Site maps and feeds are for discovery whatever the source."""
    path = F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    low = F.lower(path)
    by = lambda table, p: F.coalesce(F.regexp_like(p, lookup(source, table)), F.lit(False))
    feed = F.contains(low, F.lit("sitemap")) | low.endswith(".xml") | F.contains(low, F.lit("feed"))
    return F.when(url.isNull(), None).when(feed, "discovery").when(by(articles, path), "article").when(by(discovery, low), "discovery")
