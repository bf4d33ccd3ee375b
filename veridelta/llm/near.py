"""Problem 1: near-duplicate values by meet-in-the-middle ball hashing.

A value's fingerprint is a row of one-bit minhashes: two values of Jaccard similarity J differ in a bit with probability
(1 - J) / 2. The row is read as several tables of ``bits`` bits. In each table a fingerprint emits all variants within
half the radius (itself and its one-bit neighbours); fingerprints within the radius of two bits share a variant. Variants
are shuffled by their leading bits (a fingerprint is sent once to each shard that any of its variants falls in), collide
inside the shard, are deduplicated by a rule that keeps one meeting place a pair, and are verified by exact Jaccard over
all words.

Tables and the bound on whole fingerprints are planned so that of the pairs at the limit itself no more than MISSED get lost, at any number of
values; of nearer pairs far fewer are.

Copies (equal word sets) are one class from the start: a class emits once, and its members come back by a join. A pair is
never dropped: no cap on a variant's or a class's size exists. A shard that many different values of one template fall in is cut into
blocks, each two of which meet in a task of their own, and a task hands its pairs on as it finds them.

``near_groups`` is the form for large collections: one row a value with its class, group and number of links. ``near_pairs`` gives
every pair of rows, which is as much as a group's rows squared.

Defined results: null never matches; values without a word (empty, punctuation only) match when they look the same;
repeated rows are members of one class; an empty table gives no pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridelta.llm.lookalike import long_fields, transducer
from veridelta.llm.tokens import word_hashes
from veridelta.session import cut, small

#: Two values are near-same from this share of common distinct words.
NEAR = 0.7
#: Shares of the pairs of a similarity that the tables may miss.
MISSED = {0.7: 0.02, 0.8: 1e-3}
#: Standard deviations by which the whole fingerprints of a pair may differ more than those at the limit do on average.
DEVIATIONS = 3.0
#: Fingerprints that one shard of a table should hold, and from how many on it is cut into blocks of how many.
SHARD_ROWS, HOT_ROWS, BLOCK_ROWS = 150_000, 225_000, 100_000
#: Pairs that a task hands on at once.
BATCH_PAIRS = 100_000


@dataclass(frozen=True)
class Plan:
    """bits of a table, tables, leading bits that name a shard, 64-bit words of a fingerprint."""

    bits: int
    tables: int
    shard_bits: int

    @property
    def per_word(self) -> int:
        return 64 // self.bits

    @property
    def n_words(self) -> int:
        return -(-self.tables // self.per_word)


def _missed(bits: int, similarity: float) -> float:
    """The share of the pairs of a similarity that differ in more than two of ``bits`` bits."""
    p = (1 - similarity) / 2
    return 1 - sum(math.comb(bits, d) * p**d * (1 - p) ** (bits - d) for d in range(3))


def plan(values: int) -> Plan:
    """Longer fingerprints for more values, so that chance collisions stay in proportion to the values, and as many tables
    as it takes to miss no more than MISSED."""
    bits = min(60, max(20, math.ceil(math.log2(max(2, values))) + 4))
    tables = max(1, *(math.ceil(math.log(share) / math.log(_missed(bits, at))) for at, share in MISSED.items()))
    shard_bits = 0
    while shard_bits < bits - 6 and values * (shard_bits + 1) / 2**shard_bits > SHARD_ROWS:
        shard_bits += 1
    return Plan(bits, tables, shard_bits)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_260_101)
    return rng.integers(1, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def fingerprints(hashes: list[np.ndarray], p: Plan) -> np.ndarray:
    """From arrays of 32-bit word hashes: (values, n_words) uint64; table t is the t % per_word-th group of bits of word t // per_word."""
    n = p.bits * p.tables
    a, b = _coefficients(n)
    out = np.zeros((len(hashes), p.n_words), np.uint64)
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    full = np.flatnonzero(sizes)
    place = np.empty(n, np.int64)
    shift = np.empty(n, np.uint64)
    for t in range(p.tables):
        place[t * p.bits : (t + 1) * p.bits] = t // p.per_word
        shift[t * p.bits : (t + 1) * p.bits] = (t % p.per_word) * p.bits + np.arange(p.bits)
    i = 0
    while i < len(full):
        k, rows = i, 0
        while k < len(full) and (k == i or rows + sizes[full[k]] <= 4096):
            rows += sizes[full[k]]
            k += 1
        own = full[i:k]
        h = np.concatenate([hashes[j] for j in own])
        least = np.minimum.reduceat(h[:, None] * a + b, np.r_[0, np.cumsum(sizes[own])[:-1]], axis=0)
        least ^= least >> np.uint32(15)
        least *= np.uint32(0x2C1B3C6D)
        bit = (least >> np.uint32(31)).astype(np.uint64) << shift
        for w in range(p.n_words):
            out[own, w] = np.bitwise_or.reduce(bit[:, place == w], axis=1)
        i = k
    return out


def _members(values: DataFrame) -> DataFrame:
    """(field, ord, c1, c2, words): the class of each value (128 bits of its word set) and its words, by 32 bits of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        fold = transducer().fold
        for b in batches:
            keys, packed = [], []
            for v in b.column("value").to_pylist():
                h = word_hashes(v)
                keys.append(xxhash.xxh3_128_digest(h.tobytes() if len(h) else b"raw:" + fold(v).encode("utf-8", "surrogatepass")))
                packed.append((h >> np.uint64(32)).astype(np.uint32).tobytes())
            c = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("field"), b.column("ord"), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(packed, pa.binary())], names=["field", "ord", "c1", "c2", "words"])

    return values.mapInArrow(run, "field int, ord long, c1 long, c2 long, words binary")


def _prints(classes: DataFrame, p: Plan) -> DataFrame:
    """(field, c1, c2, f0, f1, ...): each class's fingerprint."""
    names = [f"f{w}" for w in range(p.n_words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints([np.frombuffer(w, np.uint32) for w in b.column("words").to_pylist()], p)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("field", "c1", "c2")), *(pa.array(fp[:, w].view(np.int64)) for w in range(p.n_words))], names=["field", "c1", "c2", *names])

    return classes.mapInArrow(run, "field int, c1 long, c2 long, " + ", ".join(f"{n} long" for n in names))


def _emit(prints: DataFrame, p: Plan, hot_rows: int, block_rows: int) -> DataFrame:
    """(g, i, j, blk, c1, c2, f0, f1, ...): each fingerprint, once for each table and shard it has a variant in. g is the shard's number, which holds
    the field, the table and the leading bits. A shard of more than ``hot_rows`` is cut into blocks: a fingerprint of block blk goes to every
    cell (i, j) of two blocks that blk is one of."""
    mask, rest = (1 << p.bits) - 1, p.bits - p.shard_bits
    word = "array(" + ", ".join(f"f{w}" for w in range(p.n_words)) + ")"
    own = f"shiftrightunsigned(element_at({word}, cast(t div {p.per_word} as int) + 1), cast(t % {p.per_word} * {p.bits} as int)) & {mask}L"
    home = f"cast(field as bigint) * {p.tables} + t << {p.shard_bits}"
    all_g = f"flatten(transform(sequence(0, {p.tables - 1}), t -> transform(sequence(-1, {p.shard_bits - 1}), k -> ({home}) + (shiftrightunsigned({own}, {rest}) ^ if(k < 0, 0L, shiftleft(1L, k))))))"
    sent = prints.withColumn("g", F.explode(F.expr(all_g))).drop("field")
    hot = sent.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("g", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    got = sent.join(small(cut(hot)), "g", "left").withColumn("blk", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("c1", "c2"), "blocks").cast("int")))
    got = got.withColumn("x", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    return got.select("g", F.least("blk", "x").alias("i"), F.greatest("blk", "x").alias("j"), "blk", "c1", "c2", *(f"f{w}" for w in range(p.n_words)))


def collisions(fp: np.ndarray, tab: int, shard: int, p: Plan, far: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one shard's fingerprints that are within two bits in table ``tab``, in no table before it, and within
    ``far`` bits over all tables; each pair once over all shards, at its one meeting place."""
    mask = np.uint64((1 << p.bits) - 1)

    def of(t: int, x: np.ndarray) -> np.ndarray:
        return (x[:, t // p.per_word] >> np.uint64((t % p.per_word) * p.bits)) & mask

    own = of(tab, fp)
    keys, who = [], []
    for flip in (0, *(1 << k for k in range(p.bits))):
        key = own ^ np.uint64(flip)
        here = np.flatnonzero((key >> np.uint64(p.bits - p.shard_bits)).astype(np.int64) == shard) if p.shard_bits else np.arange(len(key))
        keys.append(key[here])
        who.append(here)
    key, idx = np.concatenate(keys), np.concatenate(who)
    order = np.lexsort((idx, key))
    key, idx = key[order], idx[order]
    one = np.uint64(1)
    step, at = 1, np.arange(max(0, len(key) - 1))
    while True:
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            return
        i, j, v = idx[at], idx[at + step], key[at]
        a, b = own[i], own[j]
        x = a ^ b
        n = np.bitwise_count(x)
        bit = x & (~x + one)
        meet = np.where(n == 0, a, np.where(n == 1, np.minimum(a, b), np.minimum(a ^ bit, b ^ bit)))
        ok = (n <= 2) & (meet == v)
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1) <= far
        i, j = i[ok], j[ok]
        for t in range(tab):
            ok = np.bitwise_count(of(t, fp[i]) ^ of(t, fp[j])) > 2
            i, j = i[ok], j[ok]
        if len(i):
            yield i, j
        step += 1


def furthest(n: int, near: float) -> int:
    """Bits of ``n`` that the fingerprints of a pair at similarity ``near`` may differ in."""
    chance = (1 - near) / 2
    return math.ceil(n * chance + DEVIATIONS * math.sqrt(n * chance * (1 - chance)))


def _candidates(classes: DataFrame, p: Plan, near: float, hot_rows: int, block_rows: int) -> DataFrame:
    """(field, a1, a2, b1, b2): classes that collide and whose whole fingerprints are as near as similarity ``near`` makes them."""
    far = furthest(p.bits * p.tables, near)
    names = ["field", "a1", "a2", "b1", "b2"]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, i, j = (k.as_py() for k in key)
        t = pa.Table.from_batches(batches)
        fp = np.stack([t.column(f"f{w}").to_numpy().view(np.uint64) for w in range(p.n_words)], axis=1)
        c1, c2, blk = (t.column(n).to_numpy() for n in ("c1", "c2", "blk"))
        field, tab, shard = (g >> p.shard_bits) // p.tables, (g >> p.shard_bits) % p.tables, g & ((1 << p.shard_bits) - 1)
        parts, n = [], 0
        for a, b in collisions(fp, tab, shard, p, far):
            if i != j:  # pairs inside a block meet in the block's own cell
                cross = blk[a] != blk[b]
                a, b = a[cross], b[cross]
            parts.append((a, b))
            n += len(a)
            if n >= BATCH_PAIRS:
                yield _pairs(field, c1, c2, parts, names)
                parts, n = [], 0
        yield _pairs(field, c1, c2, parts, names)

    return _emit(cut(_prints(classes, p)), p, hot_rows, block_rows).groupBy("g", "i", "j").applyInArrow(run, "field int, a1 long, a2 long, b1 long, b2 long")


def _pairs(field: int, c1: np.ndarray, c2: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], names: list[str]) -> pa.RecordBatch:
    a, b = (np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), field, np.int32)), *map(pa.array, (c1[a], c2[a], c1[b], c2[b]))], names=names)


def near_classes(df: DataFrame, key: str = "ord", fields: tuple[str, ...] = ("text", "claim"), near: float = NEAR, hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(members, links). field is the place in ``fields``. members: field, ord, c1, c2 with one row a non-null value. links: field, a1, a2, b1, b2 with one row
    for each pair of different classes whose similarity is ``near`` or more."""
    place = F.create_map(*(F.lit(x) for k, f in enumerate(fields) for x in (f, k)))
    members = cut(_members(long_fields(df, key, fields).withColumn("field", place[F.col("field")])))
    classes = members.groupBy("field", "c1", "c2").agg(F.first("words").alias("words"))
    p = plan(members.count())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for k, (x, y) in enumerate(zip(b.column("wa").to_pylist(), b.column("wb").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(x, y))
                ok[k] = both >= near * (len(x) + len(y) - both) and both > 0
            yield b.select(["field", "a1", "a2", "b1", "b2"]).filter(pa.array(ok))

    side = lambda s: classes.select("field", F.col("c1").alias(f"{s}1"), F.col("c2").alias(f"{s}2"), F.col("words").alias(f"w{s}"))
    pairs = _candidates(classes.where("length(words) > 0"), p, near, hot_rows, block_rows)
    links = pairs.join(side("a"), ["field", "a1", "a2"]).join(side("b"), ["field", "b1", "b2"]).mapInArrow(verify, "field int, a1 long, a2 long, b1 long, b2 long")
    return members.drop("words"), links


def near_pairs(df: DataFrame, key: str = "ord", fields: tuple[str, ...] = ("text", "claim"), near: float = NEAR) -> DataFrame:
    """(field, ord_a, ord_b), ord_a < ord_b: every pair of rows near-same or equal in a field, copies included."""
    members, links = near_classes(df, key, fields, near)
    side = lambda s: members.select("field", F.col("c1").alias(f"{s}1"), F.col("c2").alias(f"{s}2"), F.col("ord").alias(f"o{s}"))
    same = side("a").join(side("b").withColumnsRenamed({"b1": "a1", "b2": "a2"}), ["field", "a1", "a2"]).where("oa < ob")
    other = links.join(side("a"), ["field", "a1", "a2"]).join(side("b"), ["field", "b1", "b2"])
    return same.select("field", "oa", "ob").unionByName(other.select("field", "oa", "ob")).select(F.element_at(F.array(*map(F.lit, fields)), F.col("field") + 1).alias("field"), F.least("oa", "ob").alias("ord_a"), F.greatest("oa", "ob").alias("ord_b"))


def near_groups(df: DataFrame, key: str = "ord", fields: tuple[str, ...] = ("text", "claim"), near: float = NEAR) -> DataFrame:
    """(field, ord, class, grp, links): one row a value. class names equal word sets, grp the least class of those connected by
    links, links counts the classes that the value's class is linked to. Only linked classes go through the components."""
    from veridelta.operators.graph import components

    members, found = near_classes(df, key, fields, near)
    name = lambda a, b: F.concat_ws(":", "field", F.hex(a), F.hex(b))
    links = cut(found.select(name("a1", "a2").alias("src"), name("b1", "b2").alias("dst")))
    n = links.select(F.explode(F.array("src", "dst")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    group = components(links).withColumnsRenamed({"node": "class", "component": "grp"})
    out = members.select("field", "ord", name("c1", "c2").alias("class")).join(n.join(group, "class"), "class", "left")
    of = F.element_at(F.array(*map(F.lit, fields)), F.col("field") + 1)
    return out.select(of.alias("field"), "ord", "class", F.coalesce("grp", "class").alias("grp"), F.coalesce("links", F.lit(0)).alias("links"))
