"""Problem 4: one form for text that looks the same.

A transducer is compiled once from rules over the Unicode database (widths, spaces, joined letters, letters of another font, numerals made of letters) plus
one list of look-alike letters of other blocks. Its input alphabet is grapheme clusters (a base and its combining marks): single code points, and every base that
looks like one with a composed form together with the mark. It matches the longest run of clusters that change, rewrites the run in one pass and leaves every other
character alone. ``compile_table`` checks the mapping for conflicts. Only clusters of several marks are put together when they are met.

Defined results: null stays null, the empty text stays empty, unknown characters pass through; the fold is idempotent.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridelta.session import cut

# Letters of other blocks drawn like a Latin letter, or like one another, by block.
LOOKALIKE = {
    # Cyrillic small
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ԍ": "ɢ",
    # Cyrillic capital
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Һ": "H", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I", "Ԍ": "G",
    # Greek
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "ϱ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "κ": "к", "τ": "т", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "յ": "j", "Օ": "O", "Ս": "U", "Տ": "S",
    # Coptic
    "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "Ⲍ": "Z",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Small capitals
    "ᴄ": "c", "ᴏ": "o", "ꜱ": "s", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ʙ": "в", "ʜ": "н", "ᴋ": "к", "ᴍ": "м", "ᴛ": "т", "ᴦ": "г", "ᴨ": "п",
    # Latin extensions without a decomposition
    "ı": "i", "ɑ": "a", "ɡ": "g", "ʋ": "u", "ɩ": "i", "ĸ": "к", "ƅ": "ь",
    # Hyphens drawn like the ASCII hyphen
    "‐": "-", "‑": "-", "−": "-",
}

#: Characters without a glyph, as ranges.
INVISIBLE = ((0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE01EF))
#: Code points the rules are run over: the planes that hold letters.
LAST = 0x323AF


def _hidden(o: int) -> bool:
    return any(a <= o <= b for a, b in INVISIBLE)


def _decomposed(ch: str) -> str:
    """The characters that ``ch`` is drawn as, by the rules on widths, fonts, spaces, joined letters, numerals and radicals; else itself."""
    if ud.category(ch) == "Zs":
        return " "
    tag, _, rest = ud.decomposition(ch).partition(" ")
    if not tag.startswith("<"):
        return ch
    to = "".join(chr(int(x, 16)) for x in rest.split())
    if tag in ("<wide>", "<narrow>", "<font>"):
        return to
    if tag == "<compat>":
        if 0x2E80 <= ord(ch) <= 0x2FDF:
            return to
        if ud.category(ch)[0] == "L" and len(to) > 1 and all(ud.category(x)[0] == "L" for x in to):
            return to
        if ud.category(ch) == "Nl" and all(x.isascii() and x.isalpha() for x in to):  # numerals written with letters
            return to
    return ch


def fold_cluster(cluster: str) -> str:
    """The form of one grapheme cluster, by the rules; the compiled table holds its results."""
    out = []
    for ch in ud.normalize("NFD", cluster):
        for x in ud.normalize("NFD", _decomposed(ch)):
            if not _hidden(ord(x)):
                out.append(LOOKALIKE.get(x, x))
    return ud.normalize("NFC", "".join(out))


def compile_table() -> dict[str, str]:
    """Clusters that change -> their form: single code points, and pairs of a base and a mark. Raises ValueError on a conflict: a form that changes
    again, an ASCII source, or two cases of one letter that would become equal."""
    table, composed = {}, {}
    for o in range(0x80, LAST + 1):
        if 0x3400 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7A3 or 0xD800 <= o <= 0xF8FF or 0x20000 <= o <= 0x2F7FF:
            continue
        ch = chr(o)
        parts = ud.decomposition(ch).split()
        if len(parts) == 2 and not parts[0].startswith("<") and ud.combining(chr(int(parts[1], 16))):
            base, mark = (chr(int(x, 16)) for x in parts)
            composed[LOOKALIKE.get(base, base) + mark] = mark
        to = "" if _hidden(o) else fold_cluster(ch)
        if to != ch:
            table[ch] = to
    for ch, to in table.items():
        if to and fold_cluster(to) != to:
            raise ValueError(f"{ch!r} -> {to!r} isn't a final form")
        up = ch.upper()
        if len(up) == 1 and up != ch and len(to) == 1 and to.isalpha() and table.get(up, up) == to:
            raise ValueError(f"{ch!r} and {up!r} both become {to!r}")
    if any(ord(ch) < 0x80 for ch in table):
        raise ValueError("an ASCII character would change")
    looks: dict[str, list[str]] = {}
    for ch, to in table.items():
        if len(to) == 1:
            looks.setdefault(to, []).append(ch)
    for pair, mark in composed.items():
        to = fold_cluster(pair)
        if fold_cluster(to) != to:
            raise ValueError(f"{pair!r} -> {to!r} isn't a final form")
        table.update({base + mark: to for base in (pair[:-1], *looks.get(pair[:-1], ())) if base + mark != to})
    return table


class _Runs(dict):
    """Run of clusters -> its form, filled on first sight and bounded."""

    limit = 200_000

    def __init__(self, table: dict[str, str], cluster: re.Pattern):
        super().__init__()
        self.table, self.cluster = table, cluster

    def __missing__(self, run: str) -> str:
        if len(self) > self.limit:
            self.clear()
        table = self.table
        out = ud.normalize("NFC", "".join(table[c] if c in table else fold_cluster(c) for c in self.cluster.findall(run)))
        self[run] = out
        return out


class Transducer:
    """``fold(text)``: the one form of ``text``."""

    def __init__(self) -> None:
        self.table = compile_table()
        marks = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x300, 0x36F), (0x483, 0x487), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20F0), (0x3099, 0x309A), (0xFE20, 0xFE2F)))
        special = "".join(re.escape(f) if f == t else f"{re.escape(f)}-{re.escape(t)}" for f, t in self._ranges(c for c in self.table if len(c) == 1 and not re.match(f"[{marks}]", c)))
        self.cluster = re.compile(f"(?s)[{marks}]*[^{marks}][{marks}]*|[{marks}]+")
        self.runs = re.compile(f"(?s)(?:[{special}][{marks}]*|[^{marks}][{marks}]+)+")
        self.known = _Runs(self.table, re.compile(f"(?s)[^{marks}][{marks}]*|[{marks}]+"))

    @staticmethod
    def _ranges(chars: Iterable[str]) -> Iterator[tuple[str, str]]:
        first = last = None
        for o in sorted(map(ord, chars)):
            if last is not None and o == last + 1:
                last = o
                continue
            if first is not None:
                yield chr(first), chr(last)
            first = last = o
        if first is not None:
            yield chr(first), chr(last)

    def fold(self, text: str) -> str:
        if text.isascii():
            return text
        known = self.known
        out = self.runs.sub(lambda m: known[m.group()], text)
        return out if ud.is_normalized("NFC", out) else ud.normalize("NFC", out)  # a mark may have stood behind an invisible character


_transducer: Transducer | None = None


def transducer() -> Transducer:
    """One per Python worker."""
    global _transducer
    if _transducer is None:
        _transducer = Transducer()
    return _transducer


def canonicalize(df: DataFrame, column: str, to: str = "canonical") -> DataFrame:
    """Append ``to``: the one form of ``column``. Any other columns pass through; an existing ``to`` is replaced."""
    schema = T.StructType([f for f in df.schema.fields if f.name != to] + [T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = transducer().fold
        for b in batches:
            got = pa.array([None if v is None else fold(v) for v in b.column(column).to_pylist()], pa.string())
            keep = [n for n in b.schema.names if n != to]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [got], names=[*keep, to])

    return df.mapInArrow(run, schema)


def long_fields(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(field, key, value) with one row for each non-null value of ``fields``."""
    return df.select(F.col(key).alias("ord"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x")).select("x.field", "ord", "x.value").where("value is not null")


def _digests(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(field, ord, form, raw): two 128-bit digests a value, of its form and of itself, in the shared folder, so that texts are folded once."""
    schema = "field string, ord long, form binary, raw binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        fold, digest = transducer().fold, xxhash.xxh3_128_digest
        for b in batches:
            values = b.column("value").to_pylist()
            raw = [digest(v.encode("utf-8", "surrogatepass")) for v in values]
            form = [r if v.isascii() else digest(fold(v).encode("utf-8", "surrogatepass")) for v, r in zip(values, raw, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("field"), b.column("ord"), pa.array(form, pa.binary()), pa.array(raw, pa.binary())], names=["field", "ord", "form", "raw"])

    return cut(long_fields(df, key, fields).mapInArrow(run, schema))


def look_classes(df: DataFrame, key: str = "ord", fields: tuple[str, ...] = ("text", "claim")) -> DataFrame:
    """(field, ord, look, spellings, rows): one row a value. Values of one ``look`` look the same; spellings counts its different strings, rows its values. The
    form for large collections: as long as the values, however large a class is."""
    rows = _digests(df, key, fields)
    of = rows.groupBy("field", "form", "raw").agg(F.count(F.lit(1)).alias("n")).groupBy("field", "form").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("rows"))
    return rows.drop("raw").join(of, ["field", "form"]).select("field", "ord", F.lower(F.hex("form")).alias("look"), "spellings", "rows")


def same_looking_pairs(df: DataFrame, key: str = "ord", fields: tuple[str, ...] = ("text", "claim")) -> DataFrame:
    """(field, ord_a, ord_b), ord_a < ord_b: values of one field that look the same and aren't equal as strings.

    Classes with one spelling are dropped before the pairs are joined; the pairs themselves are the result, however large a class is. ``look_classes`` tells the
    same without pairs."""
    rows = _digests(df, key, fields)
    mixed = rows.groupBy("field", "form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("field", "form")
    kept = rows.join(mixed, ["field", "form"], "left_semi")
    a, b = kept.alias("a"), kept.alias("b")
    on = (F.col("a.field") == F.col("b.field")) & (F.col("a.form") == F.col("b.form")) & (F.col("a.ord") < F.col("b.ord")) & (F.col("a.raw") != F.col("b.raw"))
    return a.join(b, on).select(F.col("a.field").alias("field"), F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b"))
