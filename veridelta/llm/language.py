"""Problem 2: the language of documents and of their segments.

Per language an interpolated Kneser-Ney model over the characters of words (order ORDER, words padded at both ends) is
fitted on labelled one-language samples. All models lie in one sorted hash array per order with a row of values for the
languages, so a word is scored for all languages by one binary search per order and position. Words are scored once a
worker and remembered.

A value is cut into segments (lines, sentences, parts around a slash); bracketed and quoted passages are left out. A segment
gets the language of the lowest length-normalised cross-entropy. It is rejected when it is too short for a sentence, when
its cross-entropy is above the calibrated limit of that language, or when the runner-up is too near. Confidence is the
posterior of the language for the segment, tempered by the power that makes it truest on held-out pieces of one to eight words; ``Models.error``
is what is left of its calibration error there.

Defined results: null and empty texts have no segment and no language; texts of which no segment is accepted have none
either; ties go to the first language in sorted order.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.llm.lookalike import _hidden
from veridelta.llm.tokens import is_han, one_case

ORDER, DISCOUNT = 5, 0.75
#: Most labelled rows that the models are fitted on, for each language, those with the least hash; most languages.
FIT_ROWS, MOST_LANGUAGES = 2_000, 64
#: Fewest words (Han characters count one each) and letters of a segment that is a sentence, nats between best and second.
MIN_WORDS, MIN_LETTERS, MIN_HAN, MIN_NATS = 4, 16, 7, 6.0
#: Most nats that one word may speak against a language: a word of the samples, and any other, a name perhaps.
WORD_NATS, OTHER_NATS = 5.0, 1.6
#: A segment is foreign to a language above this many times the largest cross-entropy of the held-out samples.
SLACK = 1.6
#: Words of the pieces that the temper is fitted on, and the powers that are tried.
PIECES, TEMPERS = (1, 2, 3, 5, 8), tuple(round(0.02 * 1.25**k, 4) for k in range(24))

#: Names of the languages by which labels call them: ISO 639-1, 639-2 and 639-3 codes and English names.
NAMES = {
    "en": ("en", "eng", "english"), "zh": ("zh", "zho", "chi", "cmn", "chinese", "mandarin"), "es": ("es", "spa", "spanish", "castilian"), "fr": ("fr", "fra", "fre", "french"),
    "de": ("de", "deu", "ger", "german"), "pt": ("pt", "por", "portuguese"), "ru": ("ru", "rus", "russian"),
}
NO_LABEL = ("", "und", "unknown", "n/a")

_QUOTED = re.compile(r"\([^()\n]*\)|（[^（）\n]*）|\[[^\[\]\n]*\]|【[^【】\n]*】|«[^«»\n]*»|„[^„“”\n]*[“”]|“[^“”\n]*”|「[^「」\n]*」|『[^『』\n]*』|《[^《》\n]*》")
_ENDS = re.compile(r"(?<=[^\d\s][.!?])\s+|(?<=\d\d\d[.!?])\s+|(?<=-\d\d[.!?])\s+|(?<=[。！？；])|\s/\s|[\n\r  ]+")


class _Letters(dict):
    """Code point -> lower-case folded letters with their accents; a Han character stands as a word of its own."""

    def __missing__(self, o: int) -> str:
        ch = chr(o)
        if ch == "\n":
            to = ch
        elif _hidden(o) or ud.combining(ch):
            to = ""
        elif is_han(ch):
            to = f" {ch} "
        else:
            low = one_case(ch)
            to = "".join(x if x.isalpha() and not ud.combining(x) else " " for x in low) or " "
            if len(to) == 1 and is_han(to):
                to = f" {to} "
        self[o] = to
        return to


LETTERS = _Letters()


def segments(text: str) -> list[str]:
    """The segments of ``text``, as spaced lower-case words."""
    t = _ENDS.sub("\n", _QUOTED.sub("*", text))
    return t.translate(LETTERS).split("\n")


def raw_segments(text: str) -> list[str]:
    """The segments as they stand in ``text``, in step with ``segments``."""
    return _ENDS.sub("\n", _QUOTED.sub("*", text)).split("\n")


def _codes(word: str) -> np.ndarray:
    return np.frombuffer(f"\x02{word}\x03".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


_MULT = np.uint64(0x9E3779B97F4A7C15)


def _grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the gram of each length 1..order that ends at each character, 0 where it would begin before the word; word
    of each character)."""
    codes = [_codes(w) for w in words]
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(codes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((order, len(flat)), np.uint64)
    h = np.zeros(len(flat), np.uint64)
    power = np.ones(1, np.uint64)
    for n in range(order):
        part = np.zeros(len(flat), np.uint64)
        part[n:] = flat[: len(flat) - n] if n else flat
        h = h + (part + np.uint64(0x1234567)) * power
        power = power * _MULT
        g = h ^ (h >> np.uint64(29))
        g = g * np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
        out[n] = np.where(at >= n, g | np.uint64(1), np.uint64(0))
    return out, of


def _whole(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


@dataclass
class Models:
    """Per order: sorted gram hashes, and rows over the languages of the discounted share of the gram and of the weight that
    the gram, as a context, gives to the shorter order. floor: the probability of an unseen character."""

    langs: list[str]
    keys: list[np.ndarray]
    share: list[np.ndarray]
    back: list[np.ndarray]
    floor: float
    limit: np.ndarray
    vocabulary: np.ndarray
    temper: float = 1.0
    error: float = 0.0

    def costs(self, words: list[str]) -> np.ndarray:
        """(words, languages): nats of each word, end mark included."""
        grams, of = _grams(words, len(self.keys))
        n, L = grams.shape[1], len(self.langs)
        at, known = [], []
        for k, key in enumerate(self.keys):
            i = np.searchsorted(key, grams[k])
            i[i == len(key)] = 0
            at.append(i)
            known.append((key[i] == grams[k]) & (grams[k] != 0))
        p = np.full((n, L), self.floor, np.float32)
        p = np.where(known[0][:, None], self.share[0][at[0]] + self.floor, p)
        for k in range(1, len(self.keys)):
            ctx_known = np.r_[False, known[k - 1][:-1]] & (grams[k] != 0)
            rows = np.flatnonzero(ctx_known)
            ctx = at[k - 1][rows - 1]
            got = np.where(known[k][rows, None], self.share[k][at[k][rows]], np.float32(0))
            p[rows] = got + self.back[k - 1][ctx] * p[rows]
        cost = -np.log(p)
        cost[grams[1] == 0] = 0  # the start mark itself
        starts = np.r_[0, np.flatnonzero(np.diff(of)) + 1] if n else np.zeros(0, np.int64)
        cost = np.add.reduceat(cost, starts, axis=0) if n else np.zeros((0, L), np.float32)
        seen = np.isin(_whole(words), self.vocabulary)
        return np.minimum(cost, cost.min(axis=1, keepdims=True) + np.where(seen, WORD_NATS, OTHER_NATS)[:, None].astype(np.float32))


def _fit_one(words: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per order: gram hashes, discounted shares, weights of the grams as contexts."""
    grams, _ = _grams(words, ORDER)
    prev = np.zeros_like(grams)
    prev[1:, 1:] = grams[:-1, :-1]  # the context of an order-(k+1) gram
    out, weights = [], []
    for k in range(ORDER):
        use = np.flatnonzero(grams[k])
        if k == ORDER - 1:
            g, first, n = np.unique(grams[k][use], return_index=True, return_counts=True)
            first = use[first]
        else:  # continuation counts: kinds of longer grams that end in this one; grams at a word's start keep their counts
            up = np.flatnonzero(grams[k + 1])
            _, i = np.unique(grams[k + 1][up], return_index=True)
            start = use[grams[k + 1][use] == 0]
            where = np.r_[up[i], start]
            g, j, n = np.unique(grams[k][where], return_index=True, return_counts=True)
            first = where[j]
        ctx = prev[k][first] if k else np.zeros(len(g), np.uint64)
        c, inv = np.unique(ctx, return_inverse=True)
        total = np.bincount(inv, n)
        kinds = np.bincount(inv)
        out.append((g, (np.maximum(n - DISCOUNT, 0) / total[inv]).astype(np.float32)))
        weights.append((c, (DISCOUNT * kinds / total).astype(np.float32)))
    full = []
    for k in range(ORDER):
        g, share = out[k]
        back = np.ones(len(g), np.float32)
        if k + 1 < ORDER and len(weights[k + 1][0]):
            c, w = weights[k + 1]
            i = np.searchsorted(c, g)
            i[i == len(c)] = 0
            back = np.where(c[i] == g, w[i], np.float32(1)).astype(np.float32)
        full.append((g, share, back))
    return full


def _stripped(w: str) -> str:
    return "".join(x for x in ud.normalize("NFD", w) if not ud.combining(x))


def _join(fits: dict[str, list], words: list[str]) -> Models:
    langs = sorted(fits)
    keys, share, back = [], [], []
    for k in range(ORDER):
        all_ = np.unique(np.concatenate([fits[x][k][0] for x in langs]))
        s, b = np.zeros((len(all_), len(langs)), np.float32), np.ones((len(all_), len(langs)), np.float32)
        for j, x in enumerate(langs):
            g, sh, ba = fits[x][k]
            i = np.searchsorted(all_, g)
            s[i, j], b[i, j] = sh, ba
        keys.append(all_)
        share.append(s)
        back.append(b)
    return Models(langs, keys, share, back, 1e-5, np.full(len(langs), np.inf, np.float32), np.unique(_whole(words)))


def _fit_all(words: dict[str, list[str]]) -> Models:
    """A word counts as one of the samples' own from its second sight in a language; names come once."""
    own = [w for ws in words.values() for w, n in Counter(ws).items() if n > 1]
    return _join({x: _fit_one(ws) for x, ws in words.items()}, own)


def fit(samples: list[tuple[str, str]]) -> Models:
    """Models from (language, text). A fifth of the samples is held out to calibrate the limits and the temper, then all are used. Each word
    also enters without its accents, since texts lose them."""
    by: dict[str, list[str]] = {}
    for lang, text in sorted(x for x in samples if x[0] and x[1]):
        by.setdefault(lang, []).append(text)

    def words(texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            for s in segments(t):
                for w in s.split():
                    out.append(w)
                    if not w.isascii() and _stripped(w) != w:
                        out.append(_stripped(w))
        return out

    part = _fit_all({x: words([t for i, t in enumerate(ts) if i % 5]) for x, ts in by.items()})
    limit = np.zeros(len(part.langs), np.float32)
    for j, x in enumerate(part.langs):
        own = Scorer(part).score([t for i, t in enumerate(by[x]) if i % 5 == 0])
        good = own["words"] >= MIN_WORDS
        limit[j] = SLACK * (own["ce"][good, j].max() if good.any() else np.inf)
    out = _fit_all({x: words(ts) for x, ts in by.items()})
    out.limit = limit
    out.temper, out.error = calibrate(part, [(j, t) for j, x in enumerate(part.langs) for i, t in enumerate(by[x]) if i % 5 == 0])
    return out


def calibrate(m: Models, held: list[tuple[int, str]]) -> tuple[float, float]:
    """(temper, error) from held-out (language, text): the power of the likelihoods that makes the posterior truest on short pieces, where
    mistakes happen, and the mean gap between confidence and accuracy over tenths of confidence that remains."""
    pieces = [(j, " ".join(w[a : a + n])) for j, t in held for s in segments(t) for w in [s.split()] for n in PIECES for a in range(0, len(w) - n + 1, n)]
    if not pieces or len(m.langs) < 2:
        return 1.0, 0.0
    s = Scorer(m).score([t for _, t in pieces])
    true = np.array([j for j, _ in pieces])[s["of"]]
    nats = (s["ce"] - s["ce"].min(axis=1, keepdims=True)) * (s["letters"] + s["words"])[:, None]
    rows = np.arange(len(true))

    def posterior(temper: float) -> np.ndarray:
        e = np.exp(-np.minimum(temper * nats, 60))
        return e / e.sum(axis=1, keepdims=True)

    temper = min(TEMPERS, key=lambda t: float(-np.log(posterior(t)[rows, true]).mean()))
    p = posterior(temper)
    conf, right = p.max(axis=1), p.argmax(axis=1) == true
    bins = np.minimum((conf * 10).astype(int), 9)
    gaps = [abs(conf[bins == k].mean() - right[bins == k].mean()) * (bins == k).mean() for k in range(10) if (bins == k).any()]
    return temper, float(sum(gaps))


class Scorer:
    """Scores texts; remembers the words it has met."""

    MOST = 400_000

    def __init__(self, models: Models):
        self.m = models
        self.ids: dict[str, int] = {}
        self.cost = np.zeros((0, len(models.langs)), np.float32)
        self.size = np.zeros(0, np.int32)
        self.han = np.zeros(0, bool)

    def _learn(self, flat: list[str]) -> None:
        if len(self.ids) > self.MOST:
            self.__init__(self.m)
        ids = self.ids
        new = list(dict.fromkeys(w for w in flat if w not in ids))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.cost = np.concatenate([self.cost, self.m.costs(part)])
            self.size = np.concatenate([self.size, np.fromiter(map(len, part), np.int32, len(part))])
            self.han = np.concatenate([self.han, np.fromiter((len(w) == 1 and is_han(w) for w in part), bool, len(part))])
            for w in part:
                ids[w] = len(ids)

    def score(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Per segment: the text it is of, its number there, words, letters, Han characters, cross-entropy by language."""
        flat: list[str] = []
        sizes, of, no = [], [], []
        for k, t in enumerate(texts):
            for n, s in enumerate(segments(t)):
                w = s.split()
                if w:
                    flat += w
                    sizes.append(len(w))
                    of.append(k)
                    no.append(n)
        self._learn(flat)
        idx = np.fromiter(map(self.ids.__getitem__, flat), np.int64, len(flat))
        sizes = np.array(sizes, np.int64)
        starts = np.cumsum(sizes) - sizes
        red = lambda x: np.add.reduceat(x, starts, axis=0) if len(starts) else x[:0]
        letters, han = red(self.size[idx]), red(self.han[idx].astype(np.int32))
        ce = red(self.cost[idx]) / np.maximum(letters + sizes, 1)[:, None]
        return {"of": np.array(of, np.int64), "no": np.array(no, np.int64), "words": sizes, "letters": letters, "han": han, "ce": ce}

    def label(self, texts: list[str]) -> dict[str, np.ndarray]:
        """``score`` with lang (index, -1: rejected) and confidence."""
        s = self.score(texts)
        ce = s["ce"]
        if not len(ce):
            return s | {"lang": np.zeros(0, np.int64), "confidence": np.zeros(0)}
        best = ce.argmin(axis=1)
        rows = np.arange(len(ce))
        least = ce[rows, best]
        length = s["letters"] + s["words"]
        nats = (ce - least[:, None]) * length[:, None]
        second = np.partition(nats, 1, axis=1)[:, 1]
        whole = ((s["words"] >= MIN_WORDS) & (s["letters"] >= MIN_LETTERS) & (s["han"] * 2 < s["letters"])) | ((s["han"] >= MIN_HAN) & (s["han"] * 2 >= s["letters"]))
        ok = whole & (second >= MIN_NATS) & (least <= self.m.limit[best])
        conf = 1 / np.exp(-np.minimum(self.m.temper * nats, 60)).sum(axis=1)
        return s | {"lang": np.where(ok, best, -1), "confidence": conf}


def models_from(samples: DataFrame, lang: str = "lang", text: str = "text") -> Models:
    """Fit on at most FIT_ROWS labelled rows of each language, those with the least hash of their text."""
    known = samples.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"))
    if known.select("l").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"at most {MOST_LANGUAGES} languages")
    turn = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("t"), "t"))
    rows = known.withColumn("turn", turn).where(F.col("turn") <= FIT_ROWS).select("l", "t").collect()
    return fit([(r[0], r[1]) for r in rows])


def languages(values: DataFrame, models: Models, key: list[str], text: str) -> DataFrame:
    """``key`` columns and langs ARRAY<STRUCT<lang, confidence>>: the languages of each value with the highest confidence of
    their segments. Values without an accepted segment come with an empty array."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.select(*key).schema.fields) + ", langs array<struct<lang: string, confidence: double>>"
    names = models.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                got = scorer.label([t or "" for t in part.column(text).to_pylist()])
                best = np.zeros((part.num_rows, len(names)))
                ok = got["lang"] >= 0
                np.maximum.at(best, (got["of"][ok], got["lang"][ok]), got["confidence"][ok])
                langs = [[{"lang": names[j], "confidence": float(r[j])} for j in np.flatnonzero(r)] for r in best]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in key), pa.array(langs, pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64())])))], names=[*key, "langs"])

    return values.select(*key, text).mapInArrow(run, schema)


def _with_key(values: DataFrame, key: list[str], more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.select(*key).schema.fields) + ", " + more


def document_languages(values: DataFrame, models: Models, key: list[str], text: str) -> DataFrame:
    """``key`` columns, lang, confidence, share: a row for each language of each value; confidence is the mean of its accepted segments', by letters, and share
    its part of the accepted letters. A value without an accepted segment, null among them, has one row with nulls."""
    names = models.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                got = scorer.label([t or "" for t in part.column(text).to_pylist()])
                ok = got["lang"] >= 0
                letters, sure = np.zeros((part.num_rows, len(names))), np.zeros((part.num_rows, len(names)))
                at = (got["of"][ok], got["lang"][ok])
                np.add.at(letters, at, got["letters"][ok])
                np.add.at(sure, at, got["letters"][ok] * got["confidence"][ok])
                row, lang = np.nonzero(letters)
                none = np.setdiff1d(np.arange(part.num_rows), row)
                lone = [None] * len(none)
                conf, share = sure[row, lang] / letters[row, lang], letters[row, lang] / letters[row].sum(axis=1)
                take = pa.array(np.r_[row, none])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(take) for k in key), pa.array([*(names[j] for j in lang), *lone], pa.string()), pa.array([*conf.tolist(), *lone], pa.float64()), pa.array([*share.tolist(), *lone], pa.float64())], names=[*key, "lang", "confidence", "share"]
                )

    return values.select(*key, text).mapInArrow(run, _with_key(values, key, "lang string, confidence double, share double"))


def segment_languages(values: DataFrame, models: Models, key: list[str], text: str) -> DataFrame:
    """``key`` columns, seg_no, segment, lang, confidence: every segment with a word; a null lang is a rejected one."""
    names = models.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                texts = [t or "" for t in part.column(text).to_pylist()]
                got = scorer.label(texts)
                raw = [raw_segments(t) for t in texts]
                at = pa.array(got["of"])
                seg = [raw[i][n].strip() for i, n in zip(got["of"], got["no"], strict=True)]
                lang = [names[j] if j >= 0 else None for j in got["lang"]]
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in key), pa.array(got["no"] + 1, pa.int32()), pa.array(seg, pa.string()), pa.array(lang, pa.string()), pa.array(got["confidence"], pa.float64())], names=[*key, "seg_no", "segment", "lang", "confidence"])

    return values.select(*key, text).mapInArrow(run, _with_key(values, key, "seg_no int, segment string, lang string, confidence double"))


def label_language(label: Column) -> Column:
    """The seven-language code that a label names; null if it is missing; 'other' for any other name."""
    low = F.lower(F.trim(F.regexp_replace(label, r"(?U)^\s+|\s+$", "")))
    head = F.regexp_extract(low, r"^([^-_]*)", 1)
    out = F.when(low.isNull() | low.isin(*NO_LABEL), F.lit(None))
    for code, names in NAMES.items():
        out = out.when(head.isin(*names), F.lit(code))
    return out.otherwise(F.lit("other"))


def label_cases(values: DataFrame, models: Models, key: list[str], text: str, label: str) -> DataFrame:
    """``key`` columns, lang, confidence: a row for each language of each value whose label is missing, names a language that
    the value isn't in, or whose value holds several."""
    kept = values.where(F.col(text).isNotNull()).select(*key, text, label_language(F.col(label)).alias("_label"))
    langs = languages(kept, models, [*key, "_label"], text)
    case = F.col("_label").isNull() | (F.size("langs") > 1) | ~F.exists("langs", lambda x: x["lang"] == F.col("_label"))
    return langs.where(case).select(*key, F.explode("langs").alias("x")).select(*key, "x.lang", "x.confidence")
