"""Problem 5: evaluation records that also stand in training data.

Claims are normalised; a claim's words are those of near-same comparison (neighbouring Han characters count as pairs). The
passages that find a record are the shortest ones there are, of one word (two Han characters): of its n words put in order of
their counts over all claims, the first n - ceil(NEAR n) + 1. A text of similarity NEAR or more holds one of them, and holds it among its
own first words, whatever the order of the words is. So no pair is lost, and common words are hardly ever asked for.

Aho-Corasick automata over shards of the passages scan the training texts. A text is sent only to the shards that its own first
words fall in, and only for words that some record asks for, so the traffic is in proportion to the texts and doesn't grow with the number of shards. Shards are cells of a grid:
one whose passages or texts are many is split on both sides by its own counts, and a cell streams its texts past the automaton. Pairs whose
sizes and word sketches rule out enough common words are dropped, which loses none; the others are verified on all their words. Of those, an
automaton over the record's longer passages (WINDOW words, HAN_WINDOW characters) scans the text, and the matched intervals are merged into
the share of the record that is covered.

The order of words needs no exact counts: words that make up less than 1 / COMMON of all are tied, and go by their spelling. At most COMMON words
have a larger share, so the list that is sent to the tasks is bounded whatever the table's size. Equal claims are one class from the start;
pairs of rows come back by joins.

Defined results: null claims and claims without a word match nothing by claim; null ids match nothing by id; a null split is
not train; an empty table gives no pair; repeated rows each give their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.llm.tokens import is_han, plain
from veridelta.session import cut

WINDOW, HAN_WINDOW = 3, 5
NEAR = 0.7
#: Words of a larger share than one in COMMON are told apart by their counts.
COMMON = 100_000
#: A claim's words as bits of so many longs: a bit that only one of two claims has is a word that the other lacks.
SKETCH = ("s0", "s1", "s2", "s3")
#: Passages of an automaton and training texts of a cell.
SHARD_PASSAGES, BLOCK_TEXTS = 32_768, 65_536
#: Pairs that a task checks at once.
PAIRS = 1_000_000


def units(text: str) -> list[str]:
    """Normalised words; each Han character is one."""
    p = plain(text)
    if p.isascii():
        return p.split()
    return "".join(f" {c} " if is_han(c) else c for c in p).split()


def _bag(norm: str) -> set[str]:
    """The words of near-same comparison from a normalised claim: of neighbouring Han characters, their pairs."""
    if norm.isascii():
        return set(norm.split(" ")) - {""}
    out, run = set(), []
    for w in [*norm.split(" "), ""]:
        if len(w) == 1 and is_han(w):
            run.append(w)
            continue
        if run:
            out.update(map("".join, zip(run, run[1:], strict=False))) if len(run) > 1 else out.add(run[0])
            run = []
        if w:
            out.add(w)
    return out


class _Bits(dict):
    """Word -> its bit of a sketch, bounded."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        out = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % (64 * len(SKETCH))
        return out


_bits = _Bits()


def _passage(word: str) -> str:
    """A word as it stands in a normalised claim."""
    return f" {word[0]} {word[1]} " if len(word) == 2 and is_han(word[0]) and is_han(word[1]) else f" {word} "


def prefix(size: int, near: float) -> int:
    """How many of a claim's ``size`` words must be looked for: of as many common words as ``near`` takes, one is among them."""
    return size - int(np.ceil(near * size - 1e-9)) + 1


def _members(df: DataFrame, key: str, claim: str, split: str, train: str) -> DataFrame:
    """(ord, train, c1, c2, norm, bag) of each claim with a word."""
    rows = df.where(F.col(claim).isNotNull()).select(F.col(key).alias("ord"), F.coalesce(F.col(split) == train, F.lit(False)).alias("train"), F.col(claim).alias("claim"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            norm = [" ".join(units(v)) for v in b.column("claim").to_pylist()]
            c = np.frombuffer(b"".join(xxhash.xxh3_128_digest(n.encode("utf-8", "surrogatepass")) for n in norm), np.int64).reshape(-1, 2)
            bags = pa.array([list(_bag(n)) for n in norm], pa.list_(pa.string()))
            out = pa.RecordBatch.from_arrays([b.column("ord"), b.column("train"), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(norm, pa.string()), bags], names=["ord", "train", "c1", "c2", "norm", "bag"])
            yield out.filter(pa.array([bool(n) for n in norm], pa.bool_()))

    return rows.mapInArrow(run, "ord long, train boolean, c1 long, c2 long, norm string, bag array<string>")


def common_words(members: DataFrame, share: int = COMMON) -> dict[str, int]:
    """Word -> count of the words that are more than one in ``share`` of all: at most ``share`` of them."""
    n = members.select(F.explode("bag").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    total = members.agg(F.sum(F.size("bag"))).first()[0] or 0
    return {r.w: r.n for r in n.where(F.col("n") * share > total).collect()}


def _classes(members: DataFrame, common: dict[str, int], near: float) -> DataFrame:
    """(c1, c2, held, text, norm, words, size, SKETCH...): every different claim, whether it stands in an evaluation split and in train, and
    the words it is looked for by."""
    once = members.groupBy("c1", "c2").agg(F.bool_or(~F.col("train")).alias("held"), F.bool_or("train").alias("text"), F.first("norm").alias("norm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [_bag(n) for n in b.column("norm").to_pylist()]
            words = [sorted(x, key=lambda w: (common.get(w, 0), w))[: prefix(len(x), near)] for x in bags]
            bits = np.zeros((len(bags), 64 * len(SKETCH)), np.uint8)
            for i, bag in enumerate(bags):
                bits[i, [_bits[w] for w in bag]] = 1
            sketch = np.packbits(bits, axis=1).view(np.int64)
            own = [b.column(n) for n in ("c1", "c2", "held", "text", "norm")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(words, pa.list_(pa.string())), pa.array(map(len, bags), pa.int32()), *(pa.array(sketch[:, k]) for k in range(len(SKETCH)))], names=["c1", "c2", "held", "text", "norm", "words", "size", *SKETCH])

    return once.mapInArrow(run, "c1 long, c2 long, held boolean, text boolean, norm string, words array<string>, size int, " + ", ".join(f"{x} long" for x in SKETCH))


def _cells(classes: DataFrame, shard_passages: int, block_texts: int) -> DataFrame:
    """(cell, side, c1, c2, size, SKETCH..., words, norm): side 0 is a passage of a record (``words`` holds it alone), side 1 a training text
    with those of the words it may be found by that fall in the shard. Passages and texts of a shard meet in one cell, or once in a grid of cells."""
    shards = max(1, -(-(classes.where("held").agg(F.sum(F.size("words"))).first()[0] or 0) // shard_passages))
    of = lambda w: F.pmod(F.xxhash64(w), F.lit(shards))
    same = ["c1", "c2", "size", *SKETCH]
    asked = classes.where("held").select(*same, F.explode("words").alias("w")).select(*same, F.array("w").alias("words"), of("w").alias("shard"))
    some = classes.where("text").select("c1", "c2", F.explode("words").alias("w")).join(asked.select(F.col("words")[0].alias("w")).distinct(), "w", "left_semi")
    found = some.groupBy("c1", "c2").agg(F.collect_set("w").alias("found"))
    texts = classes.where("text").select(*same, "norm").join(found, ["c1", "c2"]).withColumnRenamed("found", "words")
    sent = texts.select(*same, "words", "norm", F.explode(F.array_distinct(F.transform("words", of))).alias("shard")).withColumn("words", F.filter("words", lambda w: of(w) == F.col("shard")))
    grid = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / shard_passages).alias("rows")).join(sent.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block_texts).alias("cols")), "shard")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    a = asked.join(grid, "shard").withColumn("i", F.pmod(F.xxhash64("c1", "words"), "rows").cast("int")).withColumn("j", all_of("cols"))
    b = sent.join(grid, "shard").withColumn("j", F.pmod(F.xxhash64("c1"), "cols").cast("int")).withColumn("i", all_of("rows"))
    cell = F.struct("shard", "i", "j").alias("cell")
    return a.select(cell, F.lit(0).alias("side"), *same, "words", F.lit(None).cast("string").alias("norm")).unionByName(b.select(cell, F.lit(1).alias("side"), *same, "words", "norm"))


class _Cell:
    """The passages of one cell and the automaton over them."""

    def __init__(self) -> None:
        self.parts: list[pa.RecordBatch] = []
        self.machine = None

    def build(self) -> None:
        import ahocorasick

        t = pa.Table.from_batches(self.parts)
        self.key = np.stack([t.column(n).to_numpy() for n in ("c1", "c2")], axis=1)
        self.size = t.column("size").to_numpy().astype(np.int64)
        self.sketch = np.stack([t.column(n).to_numpy() for n in SKETCH], axis=1).view(np.uint64)
        holders: dict[str, list[int]] = {}
        for i, w in enumerate(t.column("words").combine_chunks().flatten().to_pylist()):
            holders.setdefault(w, []).append(i)
        self.of = {w: np.array(v, np.int64) for w, v in holders.items()}
        self.machine = ahocorasick.Automaton()
        for w in holders:
            self.machine.add_word(_passage(w), w)
        self.machine.make_automaton()

    def pairs(self, texts: pa.RecordBatch, near: float) -> Iterator[pa.RecordBatch]:
        size, sketch = texts.column("size").to_numpy().astype(np.int64), np.stack([texts.column(n).to_numpy() for n in SKETCH], axis=1).view(np.uint64)
        row: list[int] = []
        hit: list[np.ndarray] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            t, e = np.repeat(np.array(row, np.int64), list(map(len, hit))), np.concatenate(hit) if hit else np.zeros(0, np.int64)
            for lo in range(0, len(t), PAIRS):
                a, b = e[lo : lo + PAIRS], t[lo : lo + PAIRS]
                x, y = self.sketch[a], sketch[b]
                common = np.minimum(self.size[a] - np.bitwise_count(x & ~y).sum(axis=1), size[b] - np.bitwise_count(y & ~x).sum(axis=1))
                ok = common >= (self.size[a] + size[b] - common) * (near - 1e-9)
                if ok.any():
                    got = np.unique(np.stack([a[ok], b[ok]], axis=1), axis=0)
                    cols = [self.key[got[:, 0], 0], self.key[got[:, 0], 1]]
                    at = pa.array(got[:, 1])
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), texts.column("c1").take(at), texts.column("c2").take(at)], names=["e1", "e2", "t1", "t2"])

        for i, (norm, words) in enumerate(zip(texts.column("norm").to_pylist(), texts.column("words").to_pylist(), strict=True)):
            own = set(words)
            for w in {w for _, w in self.machine.iter(f" {norm} ")} & own:
                row.append(i)
                hit.append(self.of[w])
                n += len(hit[-1])
            if n >= PAIRS:
                yield from flush()
                row, hit, n = [], [], 0
        yield from flush()


def _scan(cells: DataFrame, near: float) -> DataFrame:
    """(e1, e2, t1, t2): pairs of classes that share a passage and that sizes and sketches leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, _Cell()
        for b in batches:
            at = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (*(b.column("cell").field(n) for n in ("shard", "i", "j")), b.column("side"))], axis=1)
            edges = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(at)], strict=True):
                if hi == lo:
                    continue
                if tuple(at[lo, :3]) != now:
                    now, cell = tuple(at[lo, :3]), _Cell()
                part = b.slice(lo, hi - lo)
                if at[lo, 3] == 0:
                    cell.parts.append(part)
                elif cell.parts:
                    if cell.machine is None:
                        cell.build()
                    yield from cell.pairs(part, near)

    return cells.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(run, "e1 long, e2 long, t1 long, t2 long")


def covered_classes(df: DataFrame, key: str = "ord", claim: str = "claim", split: str = "split", train: str = "train", near: float = NEAR, shard_passages: int = SHARD_PASSAGES, block_texts: int = BLOCK_TEXTS) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: ord, train, c1, c2 of each claim with a word. links: e1, e2, t1, t2, coverage, similarity of the verified pairs
    of classes."""
    members = cut(_members(df, key, claim, split, train))
    classes = cut(_classes(members, common_words(members), near))
    pairs = _scan(_cells(classes, shard_passages, block_texts), near).distinct()
    side = lambda of, a, b, n: classes.where(of).select(F.col("c1").alias(a), F.col("c2").alias(b), F.col("norm").alias(n))
    both = pairs.join(side("text", "t1", "t2", "nt"), ["t1", "t2"]).join(side("held", "e1", "e2", "ne"), ["e1", "e2"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sim, covered = [], []
            for x, y in zip(b.column("ne").to_pylist(), b.column("nt").to_pylist(), strict=True):
                p, q = _bag(x), _bag(y)
                sim.append(len(p & q) / len(p | q))
                covered.append(coverage(x, y) if sim[-1] >= near else 0.0)
            out = pa.RecordBatch.from_arrays([*(b.column(n) for n in ("e1", "e2", "t1", "t2")), pa.array(covered, pa.float64()), pa.array(sim, pa.float64())], names=["e1", "e2", "t1", "t2", "coverage", "similarity"])
            yield out.filter(pa.array([s >= near for s in sim], pa.bool_()))

    return members.select("ord", "train", "c1", "c2"), both.mapInArrow(verify, "e1 long, e2 long, t1 long, t2 long, coverage double, similarity double")


@lru_cache(256)
def _passages(norm: str):
    """The automaton over a record's passages, each with the places where it stands, the width of one and the record's words."""
    import ahocorasick

    u = norm.split(" ")
    w = min(HAN_WINDOW if sum(len(x) == 1 and is_han(x) for x in u) * 2 > len(u) else WINDOW, len(u))
    places: dict[str, list[int]] = {}
    for j in range(len(u) - w + 1):
        places.setdefault(" ".join(u[j : j + w]), []).append(j)
    machine = ahocorasick.Automaton()
    for p, at in places.items():
        machine.add_word(f" {p} ", at)
    machine.make_automaton()
    return machine, w, len(u)


def coverage(norm: str, text: str) -> float:
    """The share of a record's words that lie in passages of it that stand in the text: the matched intervals, merged."""
    machine, w, n = _passages(norm)
    end = covered = 0
    for j in sorted({j for _, at in machine.iter(f" {text} ") for j in at}):
        covered += j + w - max(j, end)
        end = j + w
    return covered / n


def overlaps(df: DataFrame, key: str = "ord", record_id: str = "id", claim: str = "claim", split: str = "split", train: str = "train", **sizes: int) -> DataFrame:
    """(eval_ord, train_ord, same_id, coverage, similarity): every pair of an evaluation and a training row with equal id or
    near-same claim; coverage and similarity are null for pairs by id only."""
    members, links = covered_classes(df, key, claim, split, train, **sizes)
    side = lambda of, a, b, to: members.where(of).select(F.col("c1").alias(a), F.col("c2").alias(b), F.col("ord").alias(to))
    by_claim = links.join(side(~F.col("train"), "e1", "e2", "eval_ord"), ["e1", "e2"]).join(side(F.col("train"), "t1", "t2", "train_ord"), ["t1", "t2"])
    ids = _ids(df, key, record_id, split, train)
    by_id = ids.where(~F.col("t")).select("i", F.col("o").alias("eval_ord")).join(ids.where("t").select("i", F.col("o").alias("train_ord")), "i")
    none = F.lit(None).cast("double")
    all_ = by_claim.select("eval_ord", "train_ord", F.lit(False).alias("same_id"), "coverage", "similarity").unionByName(by_id.select("eval_ord", "train_ord", F.lit(True).alias("same_id"), none.alias("coverage"), none.alias("similarity")))
    return all_.groupBy("eval_ord", "train_ord").agg(F.max("same_id").alias("same_id"), F.max("coverage").alias("coverage"), F.max("similarity").alias("similarity"))


def _ids(df: DataFrame, key: str, record_id: str, split: str, train: str) -> DataFrame:
    return df.where(F.col(record_id).isNotNull()).select(F.col(key).alias("o"), F.col(record_id).alias("i"), F.coalesce(F.col(split) == train, F.lit(False)).alias("t"))


def record_overlaps(df: DataFrame, key: str = "ord", record_id: str = "id", claim: str = "claim", split: str = "split", train: str = "train", **sizes: int) -> DataFrame:
    """(ord, by_id, by_claim, both, pairs, coverage): of every evaluation row the number of training rows with its id, with a near-same claim and with
    both, and the largest coverage of its claim. Rows of a class are counted, not paired."""
    members, links = covered_classes(df, key, claim, split, train, **sizes)
    links = cut(links.select("e1", "e2", "t1", "t2", "coverage"))
    one = F.count(F.lit(1))
    texts = members.where("train").groupBy(F.col("c1").alias("t1"), F.col("c2").alias("t2")).agg(one.alias("n"))
    near = links.join(texts, ["t1", "t2"]).groupBy("e1", "e2").agg(F.sum("n").alias("by_claim"), F.max("coverage").alias("coverage"))
    ids = _ids(df, key, record_id, split, train)
    same = ids.where("t").groupBy("i").agg(one.alias("by_id"))
    of_row = members.join(ids.select(F.col("o").alias("ord"), "i"), "ord")
    held = of_row.where(~F.col("train")).select(F.col("c1").alias("e1"), F.col("c2").alias("e2"), "i").distinct()
    train_ids = of_row.where("train").groupBy(F.col("c1").alias("t1"), F.col("c2").alias("t2"), "i").agg(one.alias("n"))
    twice = held.join(links, ["e1", "e2"]).join(train_ids, ["t1", "t2", "i"]).groupBy("e1", "e2", "i").agg(F.sum("n").alias("both"))
    rows = df.where(~F.coalesce(F.col(split) == train, F.lit(False))).select(F.col(key).alias("ord"), F.col(record_id).alias("i"))
    rows = rows.join(members.where(~F.col("train")).select("ord", F.col("c1").alias("e1"), F.col("c2").alias("e2")), "ord", "left")
    out = rows.join(same, "i", "left").join(near, ["e1", "e2"], "left").join(twice, ["e1", "e2", "i"], "left").fillna(0, ["by_id", "by_claim", "both"])
    return out.select("ord", "by_id", "by_claim", "both", (F.col("by_id") + F.col("by_claim") - F.col("both")).alias("pairs"), "coverage")


def report(df: DataFrame, key: str = "ord", split: str = "split", source: str = "source", **columns: str) -> DataFrame:
    """(split, source, pairs, records, by_id, by_claim): overlaps with train of each evaluation split and source."""
    got = record_overlaps(df, key, split=split, **columns).where("pairs > 0")
    of = df.select(F.col(key).alias("ord"), F.col(split).alias("split"), F.col(source).alias("source"))
    return got.join(of, "ord").groupBy("split", "source").agg(F.sum("pairs").alias("pairs"), F.count(F.lit(1)).alias("records"), F.sum("by_id").alias("by_id"), F.sum("by_claim").alias("by_claim"))
