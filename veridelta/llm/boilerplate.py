"""Problem 3: page furniture beside the main content.

A recurrent block labeller reads the leaf blocks (non-blank lines) of a whole page. A block's input is the mean of its word
vectors (found by hash in a sorted array; a word outside it takes the vector of the bucket that its hash falls in) and a tag-path vector. The tables hold extracted
text, not markup, so the path is that which extraction leaves to see: the extraction method, the kind of list mark, separators,
closing punctuation, length, blank lines around, place in the page. A bidirectional LSTM in numpy carries context over the
page, and a logistic unit labels each block with what stands before and after it.

The model is fitted by ``boilerplate_train`` and kept beside this module. Pages of a batch are sorted by length and run
together, so a step is one small matrix product for thousands of pages.

Defined results: null and empty texts have no block; a blank line is never labelled; null metadata is a method of its own;
texts of any length are read whole; repeated rows get the same labels.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridelta.llm.language import LETTERS

MODEL = os.path.join(os.path.dirname(__file__), "boilerplate_model.npz")
METHODS = ("jsonld.articleBody", "html.article_container", "html.paragraph_fallback")
MARKS = ("-", "•", "›", "*", "·", "–", "»")
SEPARATORS = "|·>/\t｜›"
CLOSERS = ".。!?！？…\"”»"
#: Words in a batch that is run together.
BLOCK_LINES = 60_000
WIDTH = 33
#: Vectors of the words that the model's table doesn't hold.
BUCKETS = 512
_DIGIT = re.compile(r"\d")


def path_vector(line: str, method: int, before: bool, after: bool, place: int, total: int) -> list[float]:
    """The tag-path vector of a block, WIDTH numbers."""
    s = line.strip()
    v = [0.0] * WIDTH
    v[method] = 1.0  # 0..3
    head = s[0]
    if head in MARKS:
        v[4 + MARKS.index(head) % 3] = 1.0
    elif head.isdigit():
        k = 1
        while k < len(s) and s[k].isdigit():
            k += 1
        v[7 if s[k : k + 1] in (")", ".", "、") else 8] = 1.0
    elif head in "©®":
        v[9] = 1.0
    elif head in "\"“„«":
        v[10] = 1.0
    else:
        v[11] = 1.0
    tail = s[-1]
    v[12] = float(tail in CLOSERS)
    v[13] = float(tail == ")")
    v[14] = float(tail.isdigit())
    n = len(s)
    for k, most in enumerate((8, 20, 40, 60, 80, 120)):
        if n <= most:
            v[15 + k] = 1.0
            break
    else:
        v[21] = 1.0
    seps = sum(map(s.count, SEPARATORS))
    v[22] = min(seps, 6) / 3
    v[23] = float("  " in s or "\t" in s)
    v[24] = float(_DIGIT.search(s) is not None)
    v[25], v[26] = float(before), float(after)
    v[27] = float(place == 0)
    v[28] = float(place == total - 1)
    v[29] = 1 / (1 + place)
    v[30] = 1 / (total - place)
    v[31] = place / total
    v[32] = min(total, 60) / 30
    return v


@dataclass
class Model:
    """Sorted word hashes and their vectors (the last BUCKETS are those of other words), and the two LSTMs' weights."""

    hashes: np.ndarray
    words: np.ndarray
    w: tuple[np.ndarray, np.ndarray]  # (inputs + hidden + 1, 4 hidden) forwards and backwards; gates: in, forget, out, new
    out: np.ndarray  # (2 hidden + 1)

    @property
    def hidden(self) -> int:
        return self.w[0].shape[1] // 4

    @staticmethod
    @lru_cache(4)
    def load(path: str = MODEL) -> Model:
        with np.load(path) as z:
            return Model(z["hashes"], z["words"].astype(np.float32), (z["w0"].astype(np.float32), z["w1"].astype(np.float32)), z["out"].astype(np.float32))

    def save(self, path: str = MODEL) -> None:
        np.savez_compressed(path, hashes=self.hashes, words=self.words.astype(np.float16), w0=self.w[0].astype(np.float32), w1=self.w[1].astype(np.float32), out=self.out.astype(np.float32))


class _Places(dict):
    """Word -> row of its vector."""

    def __init__(self, hashes: np.ndarray):
        super().__init__()
        self.hashes = hashes

    def __missing__(self, w: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = np.uint64(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")))
        i = int(np.searchsorted(self.hashes, h))
        self[w] = i = i if i < len(self.hashes) and self.hashes[i] == h else len(self.hashes) + int(h) % BUCKETS
        return i


@dataclass
class Pages:
    """Blocks of pages in a row: page, line number, path vectors, and the words' rows with their starts."""

    page: np.ndarray
    line: np.ndarray
    path: np.ndarray
    words: np.ndarray
    sizes: np.ndarray


def read_pages(texts: list[str | None], methods: list[str | None], places: _Places) -> Pages:
    page, number, path, flat, sizes = [], [], [], [], []
    for i, (t, m) in enumerate(zip(texts, methods, strict=True)):
        if not t:
            continue
        kind = METHODS.index(m) if m in METHODS else 3
        lines = t.split("\n")
        plain = t.translate(LETTERS).split("\n")
        own = [k for k, x in enumerate(lines) if x and not x.isspace()]
        for n, k in enumerate(own):
            page.append(i)
            number.append(k + 1)
            path.append(path_vector(lines[k], kind, k > 0 and not lines[k - 1].strip(), k + 1 < len(lines) and not lines[k + 1].strip(), n, len(own)))
            w = plain[k].split()
            flat += w
            sizes.append(len(w))
    rows = np.fromiter(map(places.__getitem__, flat), np.int64, len(flat))
    return Pages(np.array(page, np.int64), np.array(number, np.int64), np.array(path, np.float32).reshape(-1, WIDTH), rows, np.array(sizes, np.int64))


def inputs(p: Pages, words: np.ndarray) -> np.ndarray:
    """(blocks, inputs): mean word vector and path vector."""
    mean = np.zeros((len(p.sizes), words.shape[1]), np.float32)
    some = np.flatnonzero(p.sizes)
    if len(some):
        starts = (np.cumsum(p.sizes) - p.sizes)[some]
        mean[some] = np.add.reduceat(words[p.words], starts, axis=0) / p.sizes[some, None]
    return np.concatenate([mean, p.path], axis=1)


def padded(p: Pages) -> tuple[np.ndarray, np.ndarray]:
    """(steps, pages) block at each step or -1, for pages from the longest; the lengths."""
    pages, counts = np.unique(p.page, return_counts=True)
    starts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    steps = np.arange(counts.max() if len(counts) else 0)[:, None]
    at = np.where(steps < counts[order], starts[order] + steps, -1)
    return at, counts[order]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def run_lstm(x: np.ndarray, at: np.ndarray, counts: np.ndarray, w: np.ndarray, back: bool) -> np.ndarray:
    """Hidden states of the blocks ``x`` in page order ``at``, forwards or backwards."""
    n, hidden = x.shape[0], w.shape[1] // 4
    own = x @ w[: x.shape[1]] + w[-1]
    rec = w[x.shape[1] : -1]
    out = np.zeros((n, hidden), np.float32)
    h, c = np.zeros((at.shape[1], hidden), np.float32), np.zeros((at.shape[1], hidden), np.float32)
    for s in range(len(at)):
        if back:
            live = int(np.searchsorted(-counts, -s, "left"))  # pages longer than s
            row = at[counts[:live] - 1 - s, np.arange(live)]
        else:
            live = int(np.searchsorted(-counts, -s, "left"))
            row = at[s, :live]
        g = own[row] + h[:live] @ rec
        i, f, o = _sigmoid(g[:, :hidden]), _sigmoid(g[:, hidden : 2 * hidden]), _sigmoid(g[:, 2 * hidden : 3 * hidden])
        c[:live] = f * c[:live] + i * np.tanh(g[:, 3 * hidden :])
        h[:live] = o * np.tanh(c[:live])
        out[row] = h[:live]
    return out


def furniture(p: Pages, m: Model) -> np.ndarray:
    """Probability of each block that it is no part of the article."""
    if not len(p.page):
        return np.zeros(0, np.float32)
    x = inputs(p, m.words)
    at, counts = padded(p)
    both = [run_lstm(x, at, counts, m.w[k], bool(k)) for k in (0, 1)]
    return _sigmoid(np.concatenate(both, axis=1) @ m.out[:-1] + m.out[-1])


def label_pages(texts: list[str | None], methods: list[str | None], m: Model, places: _Places) -> Iterator[tuple[int, Pages, np.ndarray]]:
    """(first page, blocks, probabilities) in groups of bounded size."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += t.count("\n") + 1 if t else 0
        if size >= BLOCK_LINES or k == len(texts) - 1:
            p = read_pages(texts[lo : k + 1], methods[lo : k + 1], places)
            yield lo, p, furniture(p, m)
            lo, size = k + 1, 0


def _method(df: DataFrame, metadata: str | None) -> DataFrame:
    return df.withColumn("_method", F.col(f"{metadata}.extraction_method") if metadata else F.lit(None).cast("string"))


def furniture_lines(df: DataFrame, key: str = "ord", text: str = "text", metadata: str | None = "metadata", model: Model | None = None) -> DataFrame:
    """(key, line_no, probability): every non-blank line labelled as page furniture."""
    m = Model.load() if model is None else model
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(m.hashes)
        for b in batches:
            for lo, p, prob in label_pages(b.column(text).to_pylist(), b.column("_method").to_pylist(), m, places):
                hit = np.flatnonzero(prob >= 0.5)
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(p.page[hit] + lo)), pa.array(p.line[hit].astype(np.int32)), pa.array(prob[hit].astype(np.float64))], names=[key, "line_no", "probability"])

    return _method(df, metadata).select(key, text, "_method").mapInArrow(run, f"`{key}` {kind}, line_no int, probability double")


def main_content(df: DataFrame, key: str = "ord", text: str = "text", metadata: str | None = "metadata", model: Model | None = None) -> DataFrame:
    """(key, content): the lines of the article, in order, one a line; null for null texts."""
    m = Model.load() if model is None else model
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(m.hashes)
        for b in batches:
            texts = b.column(text).to_pylist()
            out: list[list[str] | None] = [None if t is None else [] for t in texts]
            for lo, p, prob in label_pages(texts, b.column("_method").to_pylist(), m, places):
                last, lines = -1, []
                for i in np.flatnonzero(prob < 0.5):
                    page = int(p.page[i]) + lo
                    if page != last:
                        last, lines = page, texts[page].split("\n")
                    out[page].append(lines[p.line[i] - 1])
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([None if o is None else "\n".join(o) for o in out], pa.string())], names=[key, "content"])

    return _method(df, metadata).select(key, text, "_method").mapInArrow(run, f"`{key}` {kind}, content string")
