"""Fits the block labeller: python -m veridelta.llm.boilerplate_train PAGES.parquet [OUT.npz]

The pages carry no labels, and no list of phrases makes them: at most FIT_PAGES of them are annotated by what recurs over pages, once numbers, list marks and
the site's name are taken out of a line. An article's own subheads and list items recur as well; two facts tell furniture from them. It stands outside the
article, before its first or after its last sentence that occurs on no other page, in EDGE or more of its places; an article's own lines hardly ever do.
And it is the more frequent the coarser the extraction was (METHODS, from the page's structured data to all its paragraphs), by DEVIATIONS or more, while an
article's own lines are as frequent under all. A recurring line that is mostly followed by single lines without closing punctuation heads other stories, which go on as long
as such lines follow. A line of several parts is furniture if half of them are parts that stand outside articles.

The annotator looks at the whole sample, which a page at hand can't offer; the recurrent model learns to tell the same from one page.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

import numpy as np

from veridelta.llm.boilerplate import BUCKETS, METHODS, WIDTH, Model, Pages, _Places, _sigmoid, furniture, padded, read_pages
from veridelta.llm.language import LETTERS

FIT_PAGES = 20_000
DIM, HIDDEN = 20, 24
#: One page in so many isn't fitted on.
HELD = 10

#: A line recurs from so many pages; a headline is no story of its own from so many.
RECURS, HEADLINE = 3, 6
EDGE, DEVIATIONS = 0.2, 3.0
#: Characters of a sentence that is the article's.
SENTENCE = 15
CLOSED = ".。!?！？"

_LINK = re.compile(r"^(?:[-•›»*–·]\s+|\d+[).、]\s*)?")
_PARTS = re.compile(r"[·|>/\t｜›]|\s{2,}")


def skeleton(line: str, site: str) -> str:
    s = re.sub(r"\s+", " ", _LINK.sub("", line.strip()))
    if site:
        s = re.sub(re.escape(site), "{site}", s, flags=re.I)
    return re.sub(r"\d[\d,.]*", "#", s)


class Recurrence:
    """What recurs over pages of (source, text, extraction method), and where."""

    def __init__(self, pages: list[tuple[str, str, str | None]]):
        once = {(source, text.strip().split("\n")[-1], max(text.split("\n"), key=len)): (source, text, method) for source, text, method in reversed(pages)}  # a page crawled again counts once
        self.on, self.coarse, self.known, self.outside, self.inside = Counter(), Counter(), Counter(), Counter(), Counter()
        self.followed, self.headed, self.part_outside, self.part_inside = Counter(), Counter(), Counter(), Counter()
        prepared = []
        for source, text, method in once.values():
            own = [x.strip() for x in text.split("\n") if x.strip()]
            keys = [skeleton(x, site_name(source)) for x in own]
            prepared.append((source, own, keys))
            for k in set(keys):
                self.on[k] += 1
                if method in METHODS:
                    self.known[k] += 1
                    self.coarse[k] += METHODS.index(method)
        grades = np.array([METHODS.index(m) for _, _, m in once.values() if m in METHODS] or [0])
        self.mean, self.deviation = float(grades.mean()), float(grades.std())
        for source, own, keys in prepared:
            lone = [i for i, (x, k) in enumerate(zip(own, keys, strict=True)) if x[-1] in CLOSED and len(x) >= SENTENCE and self.pages(k) < RECURS]
            lo, hi = (lone[0], lone[-1]) if lone else (len(own), -1)
            for i, (x, k) in enumerate(zip(own, keys, strict=True)):
                out = not lo <= i <= hi
                if lone:
                    (self.outside if out else self.inside)[k] += 1
                if i + 1 < len(own):
                    self.followed[k] += 1
                    self.headed[k] += own[i + 1][-1] not in CLOSED and self.pages(keys[i + 1]) < RECURS
                for p in parts(x, source):
                    (self.part_outside if out else self.part_inside)[p] += 1

    def pages(self, k: str) -> int:
        return self.on[k]

    def is_furniture(self, k: str) -> bool:
        if self.pages(k) < RECURS:
            return False
        apart = self.outside[k] >= EDGE * max(1, self.outside[k] + self.inside[k])
        n = self.known[k]
        return apart or (n > 0 and self.coarse[k] - self.mean * n > DEVIATIONS * self.deviation * n**0.5)

    def heads_stories(self, k: str) -> bool:
        return self.headed[k] * 2 >= max(1, self.followed[k])

    def is_menu(self, ps: list[str]) -> bool:
        return len(ps) > 1 and sum(self.part_outside[p] + self.part_inside[p] >= RECURS and self.part_outside[p] >= EDGE * (self.part_outside[p] + self.part_inside[p]) for p in ps) * 2 >= len(ps)


def site_name(source: str | None) -> str:
    return (source or "").replace("_", " ").title()


def parts(line: str, source: str | None) -> list[str]:
    """The parts of a line that separators cut, none for an uncut one."""
    got = [p for p in (skeleton(x, site_name(source)) for x in _PARTS.split(line.strip())) if p]
    return got if len(got) > 1 else []


def annotate(pages: list[tuple[str, str, str | None]]) -> list[dict[int, bool]]:
    """Of (source, text, extraction method): line number -> is furniture."""
    seen = Recurrence(pages)
    out = []
    for source, text, _ in pages:
        labels: dict[int, bool] = {}
        stories = False
        for no, raw in enumerate(text.split("\n"), 1):
            s = raw.strip()
            if not s:
                continue
            k, closed = skeleton(s, site_name(source)), s[-1] in CLOSED
            if seen.is_furniture(k):
                labels[no], stories = True, not closed and seen.heads_stories(k)
            elif seen.is_menu(parts(s, source)):
                labels[no], stories = True, False
            elif stories and not closed and seen.pages(k) < HEADLINE:
                labels[no] = True
            else:
                labels[no] = stories = False
        out.append(labels)
    return out


def _adam(params: list[np.ndarray], grads: list[np.ndarray], state: dict, rate: float) -> None:
    state["t"] = state.get("t", 0) + 1
    for k, (p, g) in enumerate(zip(params, grads, strict=True)):
        m, v = state.setdefault(k, (np.zeros_like(p), np.zeros_like(p)))
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        p -= rate * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(v / (1 - 0.999 ** state["t"])) + 1e-8)


def _forward(x: np.ndarray, at: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, list]:
    """Padded LSTM with what its gradient needs; ``at`` in the order of reading."""
    d, hidden = x.shape[1], w.shape[1] // 4
    h = c = np.zeros((at.shape[1], hidden), np.float32)
    out, keep = np.zeros((len(x), hidden), np.float32), []
    for row in at:
        on = (row >= 0).astype(np.float32)[:, None]
        xs = x[np.maximum(row, 0)] * on
        g = xs @ w[:d] + h @ w[d:-1] + w[-1]
        i, f, o, n = _sigmoid(g[:, :hidden]), _sigmoid(g[:, hidden : 2 * hidden]), _sigmoid(g[:, 2 * hidden : 3 * hidden]), np.tanh(g[:, 3 * hidden :])
        c1 = (f * c + i * n) * on + c * (1 - on)
        t = np.tanh(c1)
        h1 = o * t * on + h * (1 - on)
        keep.append((row, on, xs, h, c, i, f, o, n, t))
        h, c = h1, c1
        live = row >= 0
        out[row[live]] = h[live]
    return out, keep


def _backward(dout: np.ndarray, keep: list, w: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    hidden = w.shape[1] // 4
    dw, dx = np.zeros_like(w), np.zeros((len(dout), d), np.float32)
    dh = dc = np.zeros((len(keep[0][0]), hidden), np.float32)
    for row, on, xs, h, c, i, f, o, n, t in reversed(keep):
        dh = dh + dout[np.maximum(row, 0)] * on
        do = dh * t * o * (1 - o) * on
        dcc = (dc + dh * o * (1 - t * t)) * on
        dg = np.concatenate([dcc * n * i * (1 - i), dcc * c * f * (1 - f), do, dcc * i * (1 - n * n)], axis=1)
        dw[:d] += xs.T @ dg
        dw[d:-1] += h.T @ dg
        dw[-1] += dg.sum(0)
        live = row >= 0
        dx[row[live]] += (dg @ w[:d].T)[live]
        dh = dg @ w[d:-1].T + dh * (1 - on)
        dc = dcc * f + dc * (1 - on)
    return dw, dx


def _sub(p: Pages, which: np.ndarray) -> tuple[Pages, np.ndarray]:
    """The blocks of the pages ``which`` and their places in ``p``."""
    rows = np.flatnonzero(np.isin(p.page, which))
    ends = np.cumsum(p.sizes)
    words = np.concatenate([p.words[ends[r] - p.sizes[r] : ends[r]] for r in rows]) if len(rows) else p.words[:0]
    return Pages(p.page[rows], p.line[rows], p.path[rows], words, p.sizes[rows]), rows


def fit(texts: list[str], methods: list[str | None], labels: list[dict[int, bool]], epochs: int = 24, seed: int = 7, batch: int = 96, rate: float = 4e-3) -> Model:
    """Labels are by line number. Words of four pages or more get a vector, others that of their bucket; now and then a word is taken for one of the others."""
    import xxhash

    rng = np.random.default_rng(seed)
    df: Counter[str] = Counter()
    for t in texts:
        df.update(set(t.translate(LETTERS).split()))
    own = sorted(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w, n in df.items() if n >= 4)
    hashes = np.array(own, np.uint64)
    p = read_pages(texts, methods, _Places(hashes))
    y = np.array([labels[a][int(b)] for a, b in zip(p.page, p.line, strict=True)], np.float32)
    d = DIM + WIDTH
    vec = (rng.normal(size=(len(hashes) + BUCKETS, DIM)) * 0.3).astype(np.float32)
    w = [(rng.normal(size=(d + HIDDEN + 1, 4 * HIDDEN)) / np.sqrt(d + HIDDEN)).astype(np.float32) for _ in (0, 1)]
    for x in w:
        x[-1, HIDDEN : 2 * HIDDEN] = 1
    out = (rng.normal(size=2 * HIDDEN + 1) * 0.1).astype(np.float32)
    params, state = [vec, *w, out], {}
    bucket = np.r_[len(hashes) + (hashes % np.uint64(BUCKETS)).astype(np.int64), len(hashes) + np.arange(BUCKETS)]
    pages = np.unique(p.page)
    for epoch in range(epochs):
        loss = 0.0
        order = rng.permutation(pages)
        order = order[np.argsort(rng.integers(0, 4, len(order)), kind="stable")]
        for lo in range(0, len(order), batch):
            q, rows = _sub(p, order[lo : lo + batch])
            q.words = np.where(rng.random(len(q.words)) < 0.1, bucket[q.words], q.words)
            starts = np.cumsum(q.sizes) - q.sizes
            some = np.flatnonzero(q.sizes)
            mean = np.zeros((len(rows), DIM), np.float32)
            if len(some):
                mean[some] = np.add.reduceat(vec[q.words], starts[some], axis=0) / q.sizes[some, None]
            x = np.concatenate([mean, q.path], axis=1)
            at, counts = padded(q)
            rev = np.full_like(at, -1)
            for k, n in enumerate(counts):
                rev[:n, k] = at[:n, k][::-1]
            a, keep_a = _forward(x, at, w[0])
            b, keep_b = _forward(x, rev, w[1])
            both = np.concatenate([a, b], axis=1)
            prob = _sigmoid(both @ out[:-1] + out[-1])
            err = (prob - y[rows]).astype(np.float32) / len(rows)
            loss -= float(np.mean(np.log(np.where(y[rows] > 0, prob, 1 - prob) + 1e-9)))
            g_out = np.concatenate([both.T @ err, [err.sum()]]).astype(np.float32)
            d_both = err[:, None] * out[None, :-1]
            dw0, dx0 = _backward(d_both[:, :HIDDEN], keep_a, w[0], d)
            dw1, dx1 = _backward(d_both[:, HIDDEN:], keep_b, w[1], d)
            dmean = (dx0 + dx1)[:, :DIM] / np.maximum(q.sizes, 1)[:, None]
            dvec = np.zeros_like(vec)
            np.add.at(dvec, q.words, np.repeat(dmean, q.sizes, axis=0))
            _adam(params, [dvec, dw0, dw1, g_out], state, rate * (1 - 0.9 * epoch / epochs))
        print(f"epoch {epoch + 1}: loss {loss / max(1, -(-len(order) // batch)):.5f}", flush=True)
    return Model(hashes, vec, (w[0], w[1]), out)


def evaluate(m: Model, texts: list[str], methods: list[str | None], labels: list[dict[int, bool]]) -> tuple[float, float, int]:
    """Precision and recall of furniture, and the blocks that differ."""
    p = read_pages(texts, methods, _Places(m.hashes))
    got = furniture(p, m) >= 0.5
    y = np.array([labels[a][int(b)] for a, b in zip(p.page, p.line, strict=True)])
    return float((got & y).sum() / max(1, got.sum())), float((got & y).sum() / max(1, y.sum())), int((got != y).sum())


def read_rows(path: str) -> list[dict]:
    """Pages with a text, at most FIT_PAGES: those with the least hash of their key."""
    import pyarrow.dataset as ds
    import xxhash

    rows = ds.dataset(path).to_table(columns=["ord", "source", "text", "metadata"]).to_pylist()
    return sorted((r for r in rows if r["text"]), key=lambda r: xxhash.xxh3_64_intdigest(str(r["ord"])))[:FIT_PAGES]


def main(path: str, to: str | None = None) -> None:
    rows = read_rows(path)
    texts, methods = [r["text"] for r in rows], [(r["metadata"] or {}).get("extraction_method") for r in rows]
    labels = annotate([(r["source"], r["text"], m) for r, m in zip(rows, methods, strict=True)])
    held = [k for k in range(len(rows)) if k % HELD == 0]
    used = [k for k in range(len(rows)) if k % HELD]
    pick = lambda ks: ([texts[k] for k in ks], [methods[k] for k in ks], [labels[k] for k in ks])
    m = fit(*pick(used))
    print("held out: precision %.5f, recall %.5f, %d blocks differ" % evaluate(m, *pick(held)))
    m.save(*([to] if to else []))


if __name__ == "__main__":
    main(*sys.argv[1:])
