"""Problem 7: filling containers of fixed capacity.

Bounded-space online packing: each partition keeps at most OPEN windows of a capacity. An item goes to the open window that
it leaves the least space in; when it fits in none and all windows are taken, the fullest is emitted. The windows left open at
the end of the partitions are items of a second round: groups of GROUP partitions merge them, largest first, best-fit. Such a
merge leaves at most one window of a group half empty, so unused space doesn't grow with the number of partitions. Texts are
measured once for all capacities, and no task holds more than OPEN x GROUP windows.

An item larger than the capacity, and no other, is split: into full windows of its own and a rest.

Defined results: null texts aren't packed; texts without a token go into a window at no cost; ties go to the window opened
first; repeated rows are items of their own; an empty table gives no window; capacities below 1 are refused.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridelta.llm.sizes import count_tokens
from veridelta.session import cut

OPEN, GROUP = 128, 32
#: Most capacities of one call; the table of capacities is read to the driver.
CAPACITIES = 64


class Packer:
    """Windows of one capacity in one partition."""

    def __init__(self, capacity: int, open_windows: int = OPEN):
        self.capacity, self.open = capacity, open_windows
        self.space: list[tuple[int, int]] = []  # (space left, window), sorted
        self.opened = 0

    def place(self, size: int) -> int:
        """The window that an item of ``size`` <= capacity goes to."""
        i = bisect_left(self.space, (size, -1))
        if i < len(self.space):
            left, w = self.space.pop(i)
        else:
            if len(self.space) >= self.open:
                self.space.pop(0)  # the fullest is emitted
            w, left = self.own(), self.capacity
        if left > size or size == 0:
            insort(self.space, (left - size, w))
        return w

    def own(self) -> int:
        """A window that nothing else goes to."""
        self.opened += 1
        return self.opened - 1


def merge_windows(used: list[int], capacity: int) -> list[int]:
    """Best-fit decreasing over the whole windows ``used``: the new window of each."""
    space: list[tuple[int, int]] = []
    out = [0] * len(used)
    n = 0
    for k in sorted(range(len(used)), key=lambda k: (-used[k], k)):
        i = bisect_left(space, (used[k], -1))
        if i < len(space):
            left, w = space.pop(i)
        else:
            left, w, n = capacity, n, n + 1
        insort(space, (left - used[k], w))
        out[k] = w
    return out


def pack(df: DataFrame, capacities: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(pack_id, window, key, piece, start, tokens): where each piece of each text went. ``capacities``: pack_id, capacity_tokens.
    A piece is the tokens start .. start + tokens - 1 of its text; whole texts are one piece."""
    caps = [(r[0], int(r[1])) for r in capacities.select("pack_id", "capacity_tokens").orderBy("pack_id").limit(CAPACITIES + 1).collect()]
    if len(caps) > CAPACITIES or any(c < 1 for _, c in caps):
        raise ValueError(f"at most {CAPACITIES} capacities, each 1 or more")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packers = [Packer(c) for _, c in caps]

        def batch(pid: list[int], win: list[int], ids: pa.Array | None, piece: list[int], start: list[int], tokens: list[int]) -> pa.RecordBatch:
            n = len(pid)
            cols = [pa.array([caps[k][0] for k in pid], pa.string()), pa.array([part] * n, pa.int32()), pa.array([(part << 32) + w for w in win], pa.int64()), ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(tokens, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["pack_id", "part", "window", key, "piece", "start", "tokens"])

        kind_arrow = None
        for b in batches:
            kind_arrow = b.schema.field(key).type
            sizes = count_tokens(b.column(text).to_pylist(), vocabulary)
            pid, win, row, piece, start, tokens = [], [], [], [], [], []
            for i, size in enumerate(sizes):
                for k, p in enumerate(packers):
                    c, at, n = p.capacity, 0, 0
                    while size - at > c:
                        w = p.own()
                        for col, v in ((pid, k), (win, w), (row, i), (piece, n), (start, at), (tokens, c)):
                            col.append(v)
                        at, n = at + c, n + 1
                    rest = size - at
                    for col, v in ((pid, k), (win, p.place(rest)), (row, i), (piece, n), (start, at), (tokens, rest)):
                        col.append(v)
            yield batch(pid, win, b.column(key).take(pa.array(row, pa.int64())), piece, start, tokens)
        if kind_arrow is not None:  # the windows left open, as rows without a piece
            pid = [k for k, p in enumerate(packers) for _ in p.space]
            yield batch(pid, [w for p in packers for _, w in p.space], pa.nulls(len(pid), kind_arrow), [-1] * len(pid), [0] * len(pid), [p.capacity - left for p in packers for left, _ in p.space])

    schema = f"pack_id string, part int, window long, `{key}` {kind}, piece int, start long, tokens long"
    placed = cut(df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, schema))
    capacity = dict(caps)

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("window")
        name, group = t.column("pack_id")[0].as_py(), t.column("grp")[0].as_py()
        new = merge_windows(t.column("tokens").to_pylist(), capacity[name])
        to = [-1 - ((group << 32) + w) for w in new]  # below 0: merged windows
        return pa.table([t.column("pack_id"), t.column("window"), pa.array(to, pa.int64())], names=["pack_id", "window", "merged"])

    left = placed.where("piece < 0").select("pack_id", "window", "tokens", F.floor(F.col("part") / GROUP).alias("grp"))
    to = left.groupBy("pack_id", "grp").applyInArrow(merge, "pack_id string, window long, merged long")
    return placed.where("piece >= 0").join(to, ["pack_id", "window"], "left").select("pack_id", F.coalesce("merged", "window").alias("window"), key, "piece", "start", "tokens")


def report(packs: DataFrame, capacities: DataFrame) -> DataFrame:
    """(pack_id, capacity_tokens, windows, tokens, unused_share, least_windows): least_windows is no packing's fewer."""
    n = packs.groupBy("pack_id").agg(F.count_distinct("window").alias("windows"), F.sum("tokens").alias("tokens"))
    room = F.col("windows") * F.col("capacity_tokens")
    return n.join(F.broadcast(capacities.select("pack_id", "capacity_tokens")), "pack_id").select(
        "pack_id", "capacity_tokens", "windows", "tokens", (1 - F.col("tokens") / room).alias("unused_share"), F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_windows")
    )


def invariants(packs: DataFrame, capacities: DataFrame, key: str = "doc_id") -> DataFrame:
    """(pack_id, documents, wrong_documents, over_capacity) of every capacity; the last two are 0 where the packing is right. A document is wrong if its pieces don't
    follow one another without a gap, or if it is split though it fits."""
    own = capacities.select("pack_id", "capacity_tokens")
    one = packs.groupBy("pack_id", key).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.max(F.col("start") + F.col("tokens")).alias("end"), F.max("piece").alias("last"), F.count_distinct("start").alias("starts"))
    wrong = (F.col("t") != F.col("end")) | (F.col("n") != F.col("last") + 1) | (F.col("starts") != F.col("n")) | ((F.col("n") > 1) & (F.col("t") <= F.col("capacity_tokens")))
    docs = one.join(F.broadcast(own), "pack_id").groupBy("pack_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(wrong).alias("wrong_documents"))
    full = packs.groupBy("pack_id", "window").agg(F.sum("tokens").alias("t")).join(F.broadcast(own), "pack_id").where("t > capacity_tokens").groupBy("pack_id").agg(F.count(F.lit(1)).alias("over_capacity"))
    return own.select("pack_id").join(docs, "pack_id", "left").join(full, "pack_id", "left").fillna(0)
