"""Column functions over dates, partial dates and closed intervals. Dates kept as text are compared as text on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridelta.functions.text import strip

DAY, MONTH, YEAR = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "^[0-9]{4}-[0-9]{2}$", "^[0-9]{4}$"


def iso_day(c: Column) -> Column:
    """A strict ISO day as a date, else null."""
    return F.when(c.rlike(DAY), F.try_to_date(c, "yyyy-MM-dd"))


def publication_date(c: Column) -> Column:
    """The day of a publication date as sites write it: ISO or Chinese at the start, RFC 2822, or with an English month name."""
    s = strip(c)
    lead = r"^([0-9]{4})[-/.年]\s*([0-9]{1,2})[-/.月]\s*([0-9]{1,2})"
    part = lambda i: F.regexp_extract(s, lead, i)
    first = F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd")
    mail = F.regexp_extract(s, r"^(?:[A-Za-z]{3},\s*)?([0-9]{1,2} [A-Za-z]{3} [0-9]{4})\b", 1)
    rest = F.coalesce(F.try_to_date(F.nullif(mail, F.lit("")), "d MMM yyyy"), F.try_to_date(s, "MMMM d, yyyy"), F.try_to_date(s, "MMM d, yyyy"), F.when(s.rlike("^[0-9]{8}$"), F.try_to_date(s, "yyyyMMdd")))
    return F.when(s.rlike(lead), first).otherwise(rest)


def precision(c: Column) -> Column:
    """'day', 'month', 'year' of a partial ISO date that exists, else null."""
    return F.when(c.rlike(DAY) & iso_day(c).isNotNull(), "day").when(c.rlike(MONTH) & F.try_to_date(F.concat(c, F.lit("-01")), "yyyy-MM-dd").isNotNull(), "month").when(c.rlike(YEAR), "year")


def first_day(c: Column) -> Column:
    p = precision(c)
    return F.when(p == "day", iso_day(c)).when(p == "month", F.try_to_date(F.concat(c, F.lit("-01")), "yyyy-MM-dd")).when(p == "year", F.try_to_date(F.concat(c, F.lit("-01-01")), "yyyy-MM-dd"))


def last_day(c: Column) -> Column:
    p = precision(c)
    return F.when(p == "day", iso_day(c)).when(p == "month", F.last_day(F.try_to_date(F.concat(c, F.lit("-01")), "yyyy-MM-dd"))).when(p == "year", F.try_to_date(F.concat(c, F.lit("-12-31")), "yyyy-MM-dd"))


def time_node(c: Column) -> Column:
    """Struct of start, end and precision of a partial date; null for none."""
    return F.when(precision(c).isNotNull(), F.struct(first_day(c).alias("start"), last_day(c).alias("end"), precision(c).alias("precision")))


def precision_rank(p: Column) -> Column:
    return F.when(p == "day", 3).when(p == "month", 2).when(p == "year", 1).otherwise(0)


def finer(old: Column, new: Column) -> Column:
    """The new partial date where it is strictly finer than the old one, else the old."""
    return F.when(precision_rank(precision(new)) > precision_rank(precision(old)), new).otherwise(old)


def half_open(start: Column, end: Column) -> Column:
    """Ordinals [start, end + 1) of a closed interval of days."""
    return F.struct(F.unix_date(start).alias("lo"), (F.unix_date(end) + 1).alias("hi"))


def source_day(c: Column) -> Column:
    """The calendar day of an ISO day or of a timestamp with an offset, in its own offset; null if there is no offset or the
    offset doesn't exist."""
    stamp = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]+)?)?(Z|[+-]([01][0-9]|2[0-3]):?[0-5][0-9])$"
    return F.when(c.rlike(DAY) | c.rlike(stamp), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))


def provider_day(c: Column) -> Column:
    """The calendar day of a time as search providers write it: an ISO day, an ISO time with an offset, or a mail date ('Tue, 15 Jun 2024 23:30:00 -0500'), each in its own offset. A time
    without an offset, or a date that doesn't exist, is null."""
    mail = r"^(?:[A-Za-z]{3},\s*)?([0-9]{1,2} [A-Za-z]{3} [0-9]{4}) [0-9]{2}:[0-9]{2}(?::[0-9]{2})? (?:[+-][0-9]{4}|GMT|UTC|UT|Z)$"
    return F.coalesce(source_day(c), F.try_to_date(F.nullif(F.regexp_extract(strip(c), mail, 1), F.lit("")), "d MMM yyyy"))


def month_number(c: Column) -> Column:
    """Months since year 0 of a partial date of a month or more."""
    y, m = F.regexp_extract(c, "^([0-9]{4})-([0-9]{2})", 1), F.regexp_extract(c, "^([0-9]{4})-([0-9]{2})", 2)
    return F.when((y != "") & m.between("01", "12"), F.try_to_number(y, F.lit("9999")).cast("int") * 12 + F.try_to_number(m, F.lit("99")).cast("int"))


def month_gap(a: Column, b: Column) -> Column:
    return F.abs(month_number(a) - month_number(b))


def month_window(dates: Column) -> Column:
    """Struct of the least and largest month of partial dates, as text: a year stands for all its months, others are left out."""
    good = F.filter(dates, lambda d: d.rlike("^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$"))
    lo = F.array_min(F.transform(good, lambda d: F.when(F.length(d) == 4, F.concat(d, F.lit("-01"))).otherwise(F.substring(d, 1, 7))))
    hi = F.array_max(F.transform(good, lambda d: F.when(F.length(d) == 4, F.concat(d, F.lit("-12"))).otherwise(F.substring(d, 1, 7))))
    return F.struct(lo.alias("start"), hi.alias("end"))


#: English month names, as one alternation.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


# Explicit dates in Chinese text, in the order in which they are looked for.
_GAP = r"[\s\p{Z}]*"
CHINESE_DATE = rf"20[0-9]{{2}}{_GAP}年{_GAP}[0-9]{{1,2}}{_GAP}月(?:{_GAP}[0-9]{{1,2}}{_GAP}[日号])?"
ISO_DATE = "20[0-9]{2}-[0-9]{2}-[0-9]{2}"
MONTH_DAY = rf"[0-9]{{1,2}}{_GAP}月{_GAP}[0-9]{{1,2}}{_GAP}[日号]"


def date_mentions(c: Column) -> Column:
    """Explicit dates, each spelling once: Chinese days and months, then ISO days, then days without a year; each kind is looked for in what the kinds before it left over. Structs of raw, iso
    (null for months, days without a year and days that don't exist) and precision (day, month, month_day). ISO days that don't exist are left out."""
    of = lambda x, i: F.regexp_extract(x, rf"(20[0-9]{{2}}){_GAP}年{_GAP}([0-9]{{1,2}}){_GAP}月(?:{_GAP}([0-9]{{1,2}}))?", i)
    kind = "struct<raw:string,iso:string,precision:string>"
    none = F.lit(None).cast("string")

    def chinese(x: Column) -> Column:
        day = F.try_to_date(F.concat_ws("-", of(x, 1), F.lpad(of(x, 2), 2, "0"), F.lpad(of(x, 3), 2, "0")), "yyyy-MM-dd")
        full = of(x, 3) != ""
        return F.struct(x.alias("raw"), F.when(full, day.cast("string")).alias("iso"), F.when(full, "day").otherwise("month").alias("precision")).cast(kind)

    all_ = lambda text, p: F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    left = F.regexp_replace(c, CHINESE_DATE, " ")
    rest = F.regexp_replace(left, ISO_DATE, " ")
    a = F.transform(all_(c, CHINESE_DATE), chinese)
    b = F.transform(F.filter(all_(left, ISO_DATE), lambda x: iso_day(x).isNotNull()), lambda x: F.struct(x.alias("raw"), x.alias("iso"), F.lit("day").alias("precision")).cast(kind))
    m = F.transform(all_(rest, MONTH_DAY), lambda x: F.struct(x.alias("raw"), none.alias("iso"), F.lit("month_day").alias("precision")).cast(kind))
    return F.concat(a, b, m)


def grounded(day: Column, text: Column) -> Column:
    """The day stands in the text: as ISO, with an English month name in either order, or in Chinese."""
    y, m, d = F.year(day).cast("string"), F.month(day).cast("string"), F.day(day).cast("string")
    name = F.date_format(day, "MMMM")
    word = F.concat(F.lit("(?:"), name, F.lit("|"), F.substring(name, 1, 3), F.lit("\\.?)"))
    nth = F.concat(d, F.lit("(?:st|nd|rd|th)?"))
    pattern = F.concat_ws(
        "|",
        F.concat(F.lit("(?<![0-9])"), F.date_format(day, "yyyy-MM-dd"), F.lit("(?![0-9])")),
        F.concat(word, F.lit(" "), nth, F.lit(",? "), y), F.concat(F.lit("(?<![0-9])"), nth, F.lit(" "), word, F.lit(",? "), y),
        F.concat(y, F.lit("年0?"), m, F.lit("月0?"), d, F.lit("日")),
    )
    return F.regexp_like(text, pattern)


def grounded_as(day: Column, precision: Column, text: Column) -> Column:
    """A day stands in the text at its precision: the year as a number of its own; the month in ISO form, with its English name or in Chinese; the day in the same forms. English
    names may be cut to three letters (September to four), with a dot. Numbers alone such as 03/04/24 never count."""
    y, m, d = F.year(day).cast("string"), F.month(day).cast("string"), F.day(day).cast("string")
    name = F.date_format(day, "MMMM")
    short = F.when(F.month(day) == 9, "Sept?\\.?").otherwise(F.concat(F.substring(name, 1, 3), F.lit("\\.?")))
    word = F.concat(F.lit("(?:"), name, F.lit("|"), short, F.lit(")"))
    gap, nth, alone = F.lit("[\\s\\p{Z}]+"), F.concat(F.lit("0?"), d, F.lit("(?:st|nd|rd|th)?")), lambda c: F.concat(F.lit("(?:^|[^0-9])"), c, F.lit("(?:[^0-9]|$)"))
    edge, some = F.lit("\\b"), F.lit("[\\s\\p{Z}]*0?")
    year = alone(y)
    month = F.concat_ws("|", alone(F.date_format(day, "yyyy-MM")), F.concat(edge, word, gap, y, edge), F.concat(y, F.lit("年"), some, m, F.lit("月")))
    full = F.concat_ws("|", alone(F.date_format(day, "yyyy-MM-dd")), F.concat(edge, word, gap, nth, F.lit(",?"), gap, y, edge), F.concat(edge, nth, gap, word, F.lit(",?"), gap, y, edge), F.concat(y, F.lit("年"), some, m, F.lit("月"), some, d, F.lit("[日号]")))
    return F.regexp_like(text, F.concat(F.lit("(?i)"), F.when(precision == "year", year).when(precision == "month", month).when(precision == "day", full)))


# Numbers written as words.
NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


def relative_grounded(day: Column, anchor: Column, offset: Column, anchor_quote: Column, quote: Column) -> Column:
    """The day is ``offset`` days from an anchor that stands in its own quote, and the quote says so: 'two days after', '2天后'."""
    n = F.abs(offset)
    word = F.get(F.array(*map(F.lit, NUMBERS)), n)
    number = F.when(n < len(NUMBERS), F.concat(F.lit("(?:"), n.cast("string"), F.lit("|"), word, F.lit(")"))).otherwise(n.cast("string"))
    after = offset >= 0
    said = F.concat(F.lit("(?i)\\b"), number, F.lit("\\s+days?\\s+"), F.when(after, "(?:after|later|following)").otherwise("(?:before|earlier|prior)"), F.lit("\\b"))
    chinese = F.concat(n.cast("string"), F.when(after, "天(?:后|之后)").otherwise("天(?:前|之前)"))
    return (day == F.date_add(anchor, offset.cast("int"))) & grounded_as(anchor, F.lit("day"), anchor_quote) & (F.regexp_like(quote, said) | F.regexp_like(quote, chinese))


def wikidata_time(value: Column, grain: Column) -> Column:
    """The partial ISO date of a '+2020-05-00T00:00:00Z' value at precision 9 (year), 10 (month) or 11 (day), never finer than
    what is not zero."""
    part = lambda i: F.regexp_extract(value, r"^\+?([0-9]{4})-([0-9]{2})-([0-9]{2})", i)
    y, m, d = part(1), part(2), part(3)
    return (
        F.when(y == "", None)
        .when((grain >= 11) & (m != "00") & (d != "00"), F.concat_ws("-", y, m, d))
        .when((grain >= 10) & (m != "00"), F.concat_ws("-", y, m))
        .otherwise(y)
    )


def statement_date(qualifiers: Column, main: Column) -> Column:
    """The date of a statement: of its start (P580), else its end (P582), else its own value. ``qualifiers``: MAP<property, ARRAY<STRUCT<time, grain>>>; ``main``: STRUCT<time, grain>. The first
    usable value of a property counts."""
    usable = lambda xs: F.get(F.array_compact(F.transform(xs, lambda x: wikidata_time(x["time"], x["grain"]))), 0)
    of = lambda p: usable(F.coalesce(F.try_element_at(qualifiers, F.lit(p)), F.array().cast("array<struct<time:string,grain:int>>")))
    return F.coalesce(of("P580"), of("P582"), wikidata_time(main["time"], main["grain"]))


def text_date(c: Column, fallback: Column) -> Column:
    """The first day with an English month name in either order, else the first year, else the fallback."""
    a, b = rf"({MONTHS}) ([0-9]{{1,2}}), ([0-9]{{4}})", rf"([0-9]{{1,2}}) ({MONTHS}) ([0-9]{{4}})"
    us = F.try_to_date(F.concat_ws(" ", F.regexp_extract(c, a, 2), F.regexp_extract(c, a, 1), F.regexp_extract(c, a, 3)), "d MMMM yyyy")
    uk = F.try_to_date(F.nullif(F.regexp_extract(c, b, 0), F.lit("")), "d MMMM yyyy")
    year = F.nullif(F.regexp_extract(c, r"\b((?:1[5-9]|20)[0-9]{2})\b", 1), F.lit(""))
    return F.coalesce(us.cast("string"), uk.cast("string"), year, fallback)
