"""Problem 6: lines repeated across one source's documents.

First pass: a heavy-hitter summary of line hashes for each source (the counters of Misra and Gries), built inside each
partition, whose rows are sorted by source so that one source's counters are held at a time, and merged in rounds of FAN summaries, so that no task gets
more than the counters of so many, however many partitions there are. Second pass:
the lines a summary can't rule out are counted exactly, by their text. Last pass: the confirmed lines, a set of a few per
source, are taken out of each text.

A source whose summary's error reaches the threshold (rows of very many lines) is counted exactly instead, line by line.

Defined results: a null text has no lines but is a row of its source; rows with a null source form one source; a line of
only digits and white space is blank and never counted; a row counts a line once; an empty table gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.session import cut, small

#: A line is repeated from this many rows and this share of its source's rows.
MIN_ROWS, MIN_SHARE = 5, 0.15
#: Counters of a summary; its error is at most lines / (COUNTERS + 1).
COUNTERS = 1024
#: Summaries of a source that one task merges.
FAN = 64
NO_SOURCE = "\x00none"


def normal(line: Column) -> Column:
    """A line without case, white space and digits."""
    return F.lower(F.regexp_replace(line, r"(?U)[\s\p{Nd}]+", ""))


def reduce_counters(h: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Counters summed by hash and cut to ``k`` by subtracting the (k + 1)-th largest count; that count is the error added."""
    u, inv = np.unique(h, return_inverse=True)
    n = np.bincount(inv, weights=n, minlength=len(u)).astype(np.int64) if len(u) else np.zeros(0, np.int64)
    if len(u) <= k:
        return u, n, 0
    off = int(np.partition(n, len(n) - k - 1)[len(n) - k - 1])
    keep = n > off
    return u[keep], n[keep] - off, off


def _rows(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("ord"), F.coalesce(source, F.lit(NO_SOURCE)).alias("src"), F.split(text, "\n").alias("lines"))


def summaries(df: DataFrame, key: str = "ord", source: str = "source", text: str = "text", counters: int = COUNTERS, fan: int = FAN) -> DataFrame:
    """(src, h, n, err, rows): the merged counters of each source; rows and err are the source's, repeated on each row. The
    row with a null h is there for sources without a line."""
    hashed = _rows(df, key, source, text).select("src", F.array_distinct(F.transform(F.filter(F.transform("lines", normal), lambda x: x != ""), lambda x: F.xxhash64(x))).alias("hs"))
    schema = "src string, part int, h long, n long, err long, rows long"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name, state = None, None
        for b in batches:
            hs = b.column("hs")
            sizes = np.nan_to_num(hs.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            flat, ends = hs.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            src = b.column("src").dictionary_encode()
            codes, names = src.indices.to_numpy(), src.dictionary.to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1), len(codes)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if state is None or names[codes[lo]] != name:
                    if state is not None:
                        yield _batch(name, part, *state)
                    name, state = names[codes[lo]], (np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0)
                new = flat[ends[lo] - sizes[lo] : ends[hi - 1]].astype(np.int64)
                h, n, off = reduce_counters(np.r_[state[0], new], np.r_[state[1], np.ones(len(new), np.int64)], counters)
                state = (h, n, state[2] + off, state[3] + hi - lo)
        if state is not None:
            yield _batch(name, part, *state)

    def _batch(name: str, part: int, h: np.ndarray, n: np.ndarray, err: int, rows: int) -> pa.RecordBatch:
        m = len(h) + 1
        return pa.RecordBatch.from_arrays([pa.array([name] * m), pa.array(np.full(m, part, np.int32)), pa.array([*h.tolist(), None], pa.int64()), pa.array([*n.tolist(), 0], pa.int64()), pa.array([0] * (m - 1) + [err], pa.int64()), pa.array([0] * (m - 1) + [rows], pa.int64())], names=["src", "part", "h", "n", "err", "rows"])

    def merge(t: pa.Table) -> pa.Table:
        own = t.filter(t.column("h").is_valid())
        h, n, off = reduce_counters(own.column("h").to_numpy(), own.column("n").to_numpy(), counters)
        err, rows = (int(np.sum(t.column(c).to_numpy())) for c in ("err", "rows"))
        return pa.Table.from_batches([_batch(t.column("src")[0].as_py(), t.column("part")[0].as_py(), h, n, err + off, rows)])

    own = hashed.sortWithinPartitions("src")
    parts = own.rdd.getNumPartitions()
    out = own.mapInArrow(first, schema)
    while True:
        parts = -(-parts // fan)
        out = out.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("src", "part").applyInArrow(merge, schema)
        if parts <= 1:
            return cut(out.select("src", "h", "n", "err", "rows"))


def repeated_lines(df: DataFrame, key: str = "ord", source: str = "source", text: str = "text", min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE, counters: int = COUNTERS) -> DataFrame:
    """(src, line, n, rows): the normal form of each repeated line with its exact count of rows and the source's."""
    s = summaries(df, key, source, text, counters)
    of = s.groupBy("src").agg(F.sum("rows").alias("rows"), F.sum("err").alias("err")).withColumn("least", F.greatest(F.lit(float(min_rows)), F.lit(min_share) * F.col("rows")))
    cand = s.where("h is not null").select("src", "h", "n").join(of, "src").where("err < least and n + err >= least").select("src", "h")
    unsure = of.where("err >= least").select("src")
    lines = _rows(df, key, source, text).select("src", F.explode(F.array_distinct(F.filter(F.transform("lines", normal), lambda x: x != ""))).alias("line"))
    few = lines.withColumn("h", F.xxhash64("line")).join(small(cand), ["src", "h"], "left_semi").select("src", "line")
    if unsure.limit(1).count():
        few = few.unionByName(lines.join(small(unsure), "src", "left_semi"))
    n = few.groupBy("src", "line").agg(F.count(F.lit(1)).alias("n"))
    return cut(n.join(small(of.select("src", "rows", "least")), "src").where("n >= least").select("src", "line", "n", "rows"))


def _free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` hasn't."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _with_sets(df: DataFrame, repeated: DataFrame, source: str, to: str) -> DataFrame:
    """``df`` with the array ``to`` of its source's repeated lines, null where there are none."""
    src = _free(df, "_src")
    sets = repeated.groupBy(F.col("src").alias(src)).agg(F.collect_set("line").alias(to))
    return df.join(small(sets), F.coalesce(df[source], F.lit(NO_SOURCE)) == F.col(src), "left").drop(src)


def found_lines(df: DataFrame, key: str = "ord", source: str = "source", text: str = "text", **options) -> DataFrame:
    """(ord, line_no) of each repeated line of each row."""
    rep = repeated_lines(df, key, source, text, **options)
    rows = _with_sets(df.select(F.col(key).alias("ord"), F.col(source).alias("source"), F.split(text, "\n").alias("lines")), rep, "source", "_set").where("_set is not null")
    hit = F.filter(F.transform("lines", lambda x, i: F.when(F.array_contains("_set", normal(x)), (i + 1).cast("int"))), lambda x: x.isNotNull())
    return rows.select("ord", F.explode(hit).alias("line_no"))


def remove_lines(df: DataFrame, key: str = "ord", source: str = "source", text: str = "text", **options) -> DataFrame:
    """``df`` with the repeated lines taken out of ``text``; other columns, of any names, are kept. Blank lines stay."""
    rep = repeated_lines(df, key, source, text, **options)
    own = _free(df, "_set")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(own, normal(x))), "\n")
    clean = _with_sets(df, rep, source, own)
    return clean.withColumn(text, F.when(F.col(own).isNull() | F.col(text).isNull(), F.col(text)).otherwise(left)).drop(own)
