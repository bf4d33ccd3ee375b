"""Problem 9: repetition inside a document.

``repeated`` is the share of the letters that lie in passages of ten or more words (twenty or more characters in Chinese
text) that occurred earlier, without regard to case, spacing, punctuation and digits.

Which documents are worth that measure is decided by a learned list on cheaper statistics, none of which holds the answer: letters in short
runs of words that stood before (three and five words), in whole lines that stood before, the share of different words, and how far a
compressor packs the text. A decision list is learned on a bounded sample with exact labels: sequential covering grows a conjunction of
thresholds on two thirds of the sample, prunes it on the rest, takes the rows it covers away and goes on. The list becomes an
ordered CASE expression; ``repetitive`` measures only the documents that it flags. Thresholds lie next to the nearest row of the other class,
so that the list errs towards finding.

A list learned on a sample can't know of what the sample doesn't hold, be it all repetition where this is rare. So its last rule is a
bound that needs no sample: letters in repeated passages of ten words lie in repeated runs of five too, so no document with a share of SHARE
has fewer of these. What the rules before it don't take and the bound leaves is measured as well, and nothing is lost.

Defined results: null and empty texts and texts without letters have share 0 and are never flagged; texts shorter than a
passage have share 0; very long texts are measured whole; repeated rows are measured alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.llm.tokens import is_han

WORDS, HAN_CHARS, SHARE = 10, 20, 0.4
#: About so many labelled rows the decision list is learned on: those with the least hash, all where there are fewer.
FIT_ROWS = 4000
STATISTICS = ("short", "phrases", "lines", "distinct", "packed")
#: Characters of a batch's texts that are measured at once.
BLOCK_CHARS = 2_000_000


class _Letters(dict):
    """Code point -> its small letter; a Han character as a word of its own; a space for the rest."""

    def __missing__(self, o: int) -> str:
        ch = chr(o)
        to = f" {ch} " if is_han(ch) else "".join(x if x.isalpha() or 0x300 <= ord(x) <= 0x36F else " " for x in ch.lower())
        if ch == "\n":
            to = " \n "
        self[o] = to
        return to


_LETTERS = _Letters()


class _Ids(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        out = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        self[w] = out
        return out


class _Han(dict):
    """Word -> whether it is a Han character, bounded."""

    def __missing__(self, w: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        out = self[w] = len(w) == 1 and is_han(w)
        return out


_ids, _han = _Ids(), _Han()


def tokens(text: str) -> list[str]:
    return text.translate(_LETTERS).split()


def _covered(ids: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Which tokens lie in a window of ``width`` tokens that stood earlier in the same document."""
    n = len(ids) - width + 1
    hit = np.zeros(len(ids) + 1, np.int64)
    if n <= 0:
        return hit[:-1].astype(bool)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n]
    inside = doc[:n] == doc[width - 1 :]
    at = np.flatnonzero(inside)
    key = (h[at] ^ (h[at] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + doc[at].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    if not len(at):
        return hit[:-1].astype(bool)
    order = np.argsort(key)
    one = key[order]
    again = np.ones(len(at), bool)
    again[np.minimum.reduceat(order, np.flatnonzero(np.r_[True, one[1:] != one[:-1]]))] = False  # the first of each is none
    start = at[again]
    np.add.at(hit, start, 1)
    np.add.at(hit, start + width, -1)
    return np.cumsum(hit)[:-1] > 0


class _Block:
    """The words of some texts in a row."""

    def __init__(self, texts: list[str]):
        flat: list[str] = []
        sizes, line_of, line_doc = [], [], []
        for k, t in enumerate(texts):
            before = len(flat)
            for line in t.translate(_LETTERS).split("\n") if t else ():
                w = line.split()
                if w:
                    flat += w
                    line_of.append(len(w))
                    line_doc.append(k)
            sizes.append(len(flat) - before)
        self.texts, self.n, self.sizes = texts, len(texts), np.array(sizes, np.int64)
        self.line_of, self.line_doc = np.array(line_of, np.int64), np.array(line_doc, np.uint64)
        self.ids = np.fromiter(map(_ids.__getitem__, flat), np.uint64, len(flat))
        self.letters = np.fromiter(map(len, flat), np.int64, len(flat))
        self.doc = np.repeat(np.arange(self.n), sizes)
        self.total = np.bincount(self.doc, self.letters, self.n)
        han = np.fromiter(map(_han.__getitem__, flat), bool, len(flat))
        self.chinese = np.bincount(self.doc, han, self.n) * 2 > self.total

    def share(self, mask: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, self.letters * mask, self.n) / np.maximum(self.total, 1)

    def again(self, words: int, han: int) -> np.ndarray:
        """The share of letters in runs of so many words (Han characters) that stood earlier."""
        covered = np.zeros(len(self.ids), bool)
        for is_zh in (False, True):
            own = np.flatnonzero(self.chinese[self.doc] == is_zh)
            if len(own):
                covered[own] = _covered(self.ids[own], self.doc[own], han if is_zh else words)
        return self.share(covered)

    def lines(self) -> np.ndarray:
        """The share of letters in whole lines that stood earlier."""
        if not len(self.ids):
            return np.zeros(self.n)
        starts = np.cumsum(self.line_of) - self.line_of
        pos = np.arange(len(self.ids)) - np.repeat(starts, self.line_of)
        mixed = (self.ids + pos.astype(np.uint64) * np.uint64(0x94D049BB133111EB)) * np.uint64(0x9E3779B97F4A7C15)
        lk = np.stack([self.line_doc, np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), starts)], axis=1)
        order = np.lexsort((np.arange(len(lk)), lk[:, 1], lk[:, 0]))
        again = np.zeros(len(lk), bool)
        again[order[1:]] = (lk[order[1:]] == lk[order[:-1]]).all(axis=1)
        return self.share(np.repeat(again, self.line_of))

    def distinct(self) -> np.ndarray:
        """Different words against all; 1 where there is none."""
        order = np.lexsort((self.ids, self.doc))
        i, d = self.ids[order], self.doc[order]
        new = np.r_[True, (i[1:] != i[:-1]) | (d[1:] != d[:-1])] if len(i) else np.zeros(0, bool)
        return np.where(self.sizes > 0, np.bincount(d, new, self.n) / np.maximum(self.sizes, 1), 1.0)

    def packed(self) -> np.ndarray:
        """Compressed bytes against all; 1 for an empty text."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in self.texts]
        return np.array([min(1.0, len(zlib.compress(r, 1)) / len(r)) if r else 1.0 for r in raw])

    def statistics(self) -> np.ndarray:
        return np.stack([self.again(3, 6), self.again(WORDS // 2, HAN_CHARS // 2), self.lines(), self.distinct(), self.packed()], axis=1)


def _blocks(texts: list[str | None]) -> Iterator[_Block]:
    """``texts`` in blocks of bounded size."""
    own, size = [], 0
    for t in texts:
        own.append(t or "")
        size += len(own[-1])
        if size >= BLOCK_CHARS:
            yield _Block(own)
            own, size = [], 0
    if own:
        yield _Block(own)


def measure(texts: list[str | None]) -> np.ndarray:
    """(texts, STATISTICS)."""
    parts = [b.statistics() for b in _blocks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


def shares(texts: list[str | None]) -> np.ndarray:
    """The share of repeated text of each."""
    parts = [b.again(WORDS, HAN_CHARS) for b in _blocks(texts)]
    return np.concatenate(parts) if parts else np.zeros(0)


def exact_share(text: str | None) -> float:
    """Brute force over lists of words: the labels and the tests."""
    t = tokens((text or "").replace("\n", " "))
    total = sum(map(len, t))
    width = HAN_CHARS if sum(len(w) == 1 and is_han(w) for w in t) * 2 > total else WORDS
    seen, hit = set(), [False] * len(t)
    for i in range(len(t) - width + 1):
        w = tuple(t[i : i + width])
        if w in seen:
            hit[i : i + width] = [True] * width
        seen.add(w)
    return sum(len(w) for w, h in zip(t, hit, strict=True) if h) / total if total else 0.0


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text", repeated: bool = False, with_text: bool = False) -> DataFrame:
    """(key, STATISTICS...) of every row; also the share ``repeated`` and the text, if asked for."""
    names = [*STATISTICS, *(["repeated"] if repeated else [])]
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names) + (", _text string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text).to_pylist()
            got = measure(texts)
            cols = [pa.array(got[:, j]) for j in range(got.shape[1])]
            if repeated:
                cols.append(pa.array(shares(texts)))
            more = [b.column(text)] if with_text else []
            yield pa.RecordBatch.from_arrays([b.column(key), *cols, *more], names=[key, *names, *(["_text"] if with_text else [])])

    return df.select(key, text).mapInArrow(run, schema)


Rule = list[tuple[int, str, float]]


#: The bound that needs no sample: it takes what the learned rules leave.
BOUND: Rule = [(STATISTICS.index("phrases"), ">=", SHARE)]


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for j, op, v in rule:
        ok &= x[:, j] >= v if op == ">=" else x[:, j] <= v
    return ok


def _best_condition(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[int, str, float] | None]:
    """The threshold with the largest information gain of FOIL; it lies just beyond the nearest row of the other class."""
    p0, n0 = y.sum(), (~y).sum()
    best, got = 0.0, None
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, pos = x[order, j], y[order]
        for op in (">=", "<="):
            s, q = (v[::-1], pos[::-1]) if op == ">=" else (v, pos)
            p, n = np.cumsum(q), np.cumsum(~q)
            last = np.r_[s[1:] != s[:-1], True]
            gain = np.where(last & (p > 0), p * (np.log2(np.maximum(p, 1) / (p + n)) - np.log2(p0 / (p0 + n0))), -1)
            i = int(gain.argmax())
            if gain[i] > best + 1e-9:
                nearest = s[i + 1] if i + 1 < len(s) else s[i]
                best, got = float(gain[i]), (j, op, float(nearest + (s[i] - nearest) * 0.02))
    return best, got


def learn(x: np.ndarray, y: np.ndarray, least: int = 3, rules: int = 12) -> list[Rule]:
    """Ordered rules for the class ``y``; rows that no rule covers aren't of it."""
    y = y.astype(bool)
    part = np.arange(len(y)) % 3 == 0
    left = np.ones(len(y), bool)
    out: list[Rule] = []
    while (y & left).sum() >= least and len(out) < rules:
        grow, prune = left & ~part, left & part
        rule: Rule = []
        rows = np.flatnonzero(grow)
        while len(rows) and not y[rows].all() and len(rule) < 4:
            gain, cond = _best_condition(x[rows], y[rows])
            if cond is None:
                break
            rule.append(cond)
            rows = rows[_holds([cond], x[rows])]
        if not rule:
            break
        worth = lambda r: (lambda h: (y[h].sum() - (~y[h]).sum()) / max(1, len(h)))(np.flatnonzero(prune & _holds(r, x)))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = left & _holds(rule, x)
        if not hit.any() or (y & hit).sum() <= (~y & hit).sum():
            break
        out.append(rule)
        left &= ~hit
    return out


def sample(df: DataFrame, key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """(STATISTICS, label) of about ``rows`` rows, those with the least hash of the key; only these figures reach the driver."""
    n = df.count()
    part = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(2**31)) < int(2**31 * min(1.0, rows / max(1, n)))
    some = df.where(part & F.col(text).isNotNull()).select(key, text)
    got = np.array([tuple(r)[1:] for r in statistics(some, key, text, repeated=True).orderBy(key).collect()], float).reshape(-1, len(STATISTICS) + 1)
    return got[:, :-1], got[:, -1] >= SHARE


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> list[Rule]:
    """The rules learned on ``sample``, and the bound."""
    x, y = sample(df, key, text, rows)
    return [*(learn(x, y) if len(x) else []), BOUND]


def expression(rules: list[Rule]) -> Column:
    """The ordered list as one CASE expression: the number of the first rule that holds, 0 for none."""
    out = F
    for i, rule in enumerate(rules):
        cond = F.lit(True)
        for j, op, v in rule:
            c = F.col(STATISTICS[j])
            cond = cond & (c >= v if op == ">=" else c <= v)
        out = out.when(cond, F.lit(i + 1))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def classify(df: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """(key, STATISTICS..., repeated, rule): every row; rule is that of the list that flags it, 0 for none."""
    rules = fit(df, key, text) if rules is None else rules
    return statistics(df, key, text, repeated=True).withColumn("rule", expression(rules))


def repetitive(df: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None, share: float = SHARE) -> DataFrame:
    """(key, rule, repeated) of the rows that the list flags and whose share, measured for them alone, is ``share`` or more."""
    rules = fit(df, key, text) if rules is None else rules
    flagged = statistics(df, key, text, with_text=True).select(key, expression(rules).alias("rule"), "_text").where("rule > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = shares(b.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("rule"), pa.array(got)], names=[key, "rule", "repeated"]).filter(pa.array(got >= share))

    return flagged.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, rule int, repeated double")
