"""Pairs of rows that share a key, told in tasks by blocks of bounded size, and the letters of their names."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procuris.sources.shared import saved

#: Rows of a key that a block holds of either side, pairs that a task holds at once, and pairs and rows of a task, about.
BLOCK, AT_ONCE, PAIRS, ROWS = 2048, 1 << 18, 1 << 23, 200_000

#: Letters of pairs, times the width of their band, that are compared at once.
CELLS = 1 << 22


def met(left: DataFrame, right: DataFrame, tell: Callable, schema: str) -> DataFrame:
    """What `tell` makes of all pairs of rows that share `key`, a long; some rows of other keys may meet too.

    A key's rows are dealt into blocks on both sides, and a pair of blocks is one task's work, so that a key that most rows
    share is many tasks' work. tell(left rows, right rows) returns a function of the places of pairs on both sides, which
    is called with some pairs at a time, the left places rising, and returns rows of the schema.
    """
    spark, (left, right) = left.sparkSession, (saved(df) for df in (left, right))
    sizes = left.groupBy("key").agg(F.count("*").alias("_a")).join(right.groupBy("key").agg(F.count("*").alias("_b")).hint("merge"), "key")
    sizes = saved(sizes.withColumns({"_i": F.ceil(F.col("_a") / BLOCK), "_j": F.ceil(F.col("_b") / BLOCK)}))
    pairs, rows = sizes.agg(F.sum(F.col("_a").cast("double") * F.col("_b")), F.sum(F.col("_a") * F.col("_j") + F.col("_b") * F.col("_i"))).first()
    n = int(max(4 * spark.sparkContext.defaultParallelism, (pairs or 0) // PAIRS, (rows or 0) // ROWS))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        out = df.join(sizes.select("key", "_i", "_j").hint("merge"), "key").withColumn(own, F.pmod(F.xxhash64(*df.columns), F.col(own)))
        out = out.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).withColumn("_block", F.xxhash64("key", "_i", "_j"))
        return out.withColumn("_task", F.pmod("_block", F.lit(n))).drop("key", "_i", "_j").repartition(n, "_task")

    def each(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame()
        a, b = a.sort_values("_block", ignore_index=True), b.sort_values("_block", ignore_index=True)
        first, last = (np.searchsorted(b["_block"].to_numpy(), a["_block"].to_numpy(), side) for side in ("left", "right"))
        upto, told, out, at = np.cumsum(last - first), tell(a, b), [], 0
        while at < len(a):
            done = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, done + AT_ONCE, "right")))
            many = (last - first)[at:end]
            i = np.repeat(np.arange(at, end), many)
            j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + first[i]
            if len(i):
                out.append(told(i, j))
            at = end
        return pd.concat(out) if out else pd.DataFrame()

    return dealt(left, "_i", "_j").groupBy("_task").cogroup(dealt(right, "_j", "_i").groupBy("_task")).applyInPandas(each, schema)


class Letters:
    """The letters of names, in a row, with each name's number of them and for each of 32 classes of letters how many it has there, four at most, as bits."""

    def __init__(self, names: pd.Series):
        self.place, own = pd.factorize(names)  # a name that many rows hold is looked at once
        self.size = np.fromiter(map(len, own), np.int64, len(own))
        self.flat = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.begin = np.cumsum(self.size) - self.size
        counts = np.bincount(np.repeat(np.arange(len(own)), self.size) * 32 + self.flat % 32, minlength=32 * len(own)).reshape(-1, 2, 16)
        self.bits = np.bitwise_or.reduce(((np.uint64(1) << np.minimum(counts, 4).astype(np.uint64)) - np.uint64(1)) << (4 * np.arange(16, dtype=np.uint64)), axis=2)

    def at(self, rows: np.ndarray, width: int, pad: int) -> np.ndarray:
        """A column of letters for each of the names, with pads behind them."""
        out = np.full((width, len(rows)), pad, np.uint32)
        begin, size = self.begin[rows], self.size[rows]
        least = min(width, int(size.min()))
        for k in range(min(width, int(size.max()))):
            if k < least:
                out[k] = self.flat[begin + k]
            else:
                has = size > k
                out[k, has] = self.flat[begin[has] + k]
        return out


def lacking(x: Letters, y: Letters, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Edits that names i of x and j of y are apart at least: one adds one letter at most and takes one, so counts tell."""
    less = more = 0
    for k in (0, 1):
        a, b = x.bits[i, k], y.bits[j, k]
        less, more = less + np.bitwise_count(a & ~b), more + np.bitwise_count(b & ~a)
    return np.maximum(less, more).astype(np.int64)


def edits(x: Letters, y: Letters, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Edit distances of names i of x and j of y, in code points; where it is above `most`, some number above it."""
    out, order, at = np.asarray(most, np.int64) + 1, np.lexsort((most, x.size[i])), 0
    while at < len(order):
        # as many pairs as fit at the width of the first, and no pair of more than twice the letters or band
        first = order[at]
        near = order[at:at + max(1, CELLS // ((int(x.size[i[first]]) + 1) * (2 * int(max(most[first], 0)) + 1)))]
        wide = (x.size[i[near]] > 2 * x.size[i[first]] + 8) | (most[near] > 2 * most[first] + 8)
        near = near[:max(1, int(wide.argmax()) if wide.any() else len(near))]
        out[near] = np.minimum(out[near], _banded(x, y, i[near], j[near], int(max(most[near].max(), 0))))
        at += len(near)
    return out


def _banded(x: Letters, y: Letters, i: np.ndarray, j: np.ndarray, t: int) -> np.ndarray:
    """Edit distances up to t, or some number above: rows of the usual table, of which cells within t of the diagonal are filled, for all pairs at once."""
    m, n = x.size[i], y.size[j]
    high = int(m.max())
    far, kind = t + high + 1, np.uint8 if 2 * (t + high) < 250 else np.uint32  # a cell grows by one a row at most
    a, b = x.at(i, high, 1 << 30), np.vstack([np.full((t, len(j)), 1 << 31, np.uint32), y.at(j, high + t + 1, 1 << 31)])  # row r of b is letter r - t
    out = np.where((m == 0) & (n <= t), n, far)
    cells = np.repeat(np.where(np.arange(-t, t + 1) < 0, far, np.arange(-t, t + 1)).astype(kind)[:, None], len(i), 1)
    for r in range(1, high + 1):
        now = cells + (b[r - 1:r + 2 * t] != a[r - 1])
        now[:-1] = np.minimum(now[:-1], cells[1:] + 1)
        if r <= t:
            now[:t - r] = far
            now[t - r] = r
        for d in range(1, 2 * t + 1):
            np.minimum(now[d], now[d - 1] + 1, out=now[d])
        cells = now.astype(kind, copy=False)
        ends = np.flatnonzero((m == r) & (np.abs(n - r) <= t))
        out[ends] = cells[n[ends] - r + t, ends]
    return out
