"""Embedding near-duplicates by an epsilon grid order join (operator 6)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procuris.llm.common import components, local_components, runs, saved, table

#: Vectors of a sequence interval that is sent to tasks, at most and at least; how many such there should be before they
#: grow; intervals that form one of the next level; vectors of an interval inside a task.
BLOCK, LEAST_BLOCK, BLOCKS, FAN, INNER = 16384, 1024, 12, 16, 256
#: Leading principal dimensions that bound distances; the first GRID of them order the grid.
DIMS, GRID = 16, 6
#: Vectors (a sample by hash of the id) that set the principal dimensions; they change the speed, not the result.
SAMPLE = 8192


def usable(vector: Column) -> Column:
    """True for a vector that is not null, not empty, not all zero and has finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def principal(vectors: DataFrame, sample: int) -> np.ndarray | None:
    """Orthonormal leading directions of the unit vectors, from a bounded sample; of the commonest length only."""
    cut = vectors.select(F.xxhash64("rep").alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if cut is None:
        return None
    rows = [r[0] for r in vectors.filter(F.xxhash64("rep") <= cut).select("v").collect()]
    sizes = [len(r) for r in rows]
    wide = max(set(sizes), key=lambda n: (sizes.count(n), n))
    x = np.array([r for r in rows if len(r) == wide])
    x /= np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) * np.abs(x).max(1, keepdims=True)
    return np.linalg.eigh(x.T @ x - len(x) * np.outer(x.mean(0), x.mean(0)))[1][:, ::-1][:, :DIMS]


def ordered(vectors: DataFrame, basis: np.ndarray, epsilon: float, size: int) -> DataFrame:
    """vectors (rep, weight, v) in epsilon grid order, with y (leading coordinates), at (rises with the order) and block (its sequence interval of `size`)."""
    dims = basis.shape[0]

    def project(batches):
        for batch in batches:
            y, cell = [], []
            for v in batch.column("v"):
                x = v.values.to_numpy()
                x = x / np.abs(x).max()
                x = x / np.linalg.norm(x)
                own = x @ basis if len(x) == dims else np.full(basis.shape[1], 8.0 + len(x))  # other lengths lie apart
                y.append(own)
                cell.append(np.floor(own[:GRID] / epsilon).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y, pa.list_(pa.float64())), pa.array(cell, pa.list_(pa.int32()))], names=["rep", "weight", "v", "y", "cell"])

    placed = vectors.mapInArrow(project, "rep long, weight long, v array<double>, y array<double>, cell array<int>")
    placed = saved(placed.orderBy("cell", "rep").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row for each partition that was sorted
    base = F.sum(F.ceil(F.col("n") / size)).over(Window.orderBy("part")) - F.ceil(F.col("n") / size)
    parts = parts.select("part", base.cast("long").alias("base"))
    block = F.col("base") + F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / size)
    return placed.withColumn("part", part).join(F.broadcast(parts), "part").select("rep", "weight", "v", "y", "at", block.cast("long").alias("block"))


def far(low_a: str, high_a: str, low_b: str, high_b: str) -> Column:
    """Squared distance between two boxes."""
    gap = F.zip_with(F.zip_with(low_a, high_b, lambda a, b: a - b), F.zip_with(low_b, high_a, lambda a, b: a - b), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)


def interval_pairs(rows: DataFrame, k: int, epsilon: float) -> DataFrame:
    """(one, two), one <= two: blocks whose boxes in the leading dimensions are within epsilon.

    From the top, a pair of intervals that may hold near vectors is parted into pairs of their FAN parts, and all
    others are left; each level is a join by interval number.
    """
    edges = [F.min(F.col("y")[i]) for i in range(k)], [F.max(F.col("y")[i]) for i in range(k)]
    boxes = saved(rows.groupBy("block").agg(F.array(*edges[0]).alias("low"), F.array(*edges[1]).alias("high")))
    last = boxes.agg(F.max("block")).first()[0]
    levels = max(1, math.ceil(math.log(last + 1, FAN) - 1e-9)) if last else 1
    pairs = rows.sparkSession.createDataFrame([(0, 0)], "one long, two long")
    for level in range(levels - 1, -1, -1):
        own = boxes.groupBy(F.floor(F.col("block") / FAN**level).alias("n")).agg(
            F.array(*(F.min(F.col("low")[i]) for i in range(k))).alias("low"), F.array(*(F.max(F.col("high")[i]) for i in range(k))).alias("high"))
        parts = F.sequence(F.lit(0), F.lit(FAN - 1))
        pairs = pairs.select((F.col("one") * FAN).alias("one"), (F.col("two") * FAN).alias("two")).withColumn("a", F.explode(parts)).withColumn("b", F.explode(parts))
        pairs = pairs.select((F.col("one") + F.col("a")).alias("one"), (F.col("two") + F.col("b")).alias("two")).filter("one <= two")
        left = own.select(F.col("n").alias("one"), F.col("low").alias("la"), F.col("high").alias("ha"))
        right = own.select(F.col("n").alias("two"), F.col("low").alias("lb"), F.col("high").alias("hb"))
        pairs = pairs.join(left, "one").join(right, "two").filter(far("la", "ha", "lb", "hb") <= epsilon * epsilon).select("one", "two")
        if level and level % 2 == 0:
            pairs = saved(pairs)
    return saved(pairs.join(boxes.select(F.col("block").alias("one"), F.col("low").alias("la"), F.col("high").alias("ha")), "one").join(
        boxes.select(F.col("block").alias("two"), F.col("low").alias("lb"), F.col("high").alias("hb")), "two"))


def cosine_links(vectors: DataFrame, least: float) -> DataFrame:
    """(rep, links, root): for each linked vector of vectors (rep, weight, v; distinct v) the weight linked to it in a
    pair of blocks, and the smallest rep it reaches there. Rows of one rep are to be summed and joined up."""
    epsilon = math.sqrt(2 - 2 * least) + 1e-9
    basis = principal(vectors, SAMPLE)
    if basis is None:
        return vectors.sparkSession.createDataFrame([], "rep long, links long, root long")
    k = basis.shape[1]
    size = min(BLOCK, max(LEAST_BLOCK, -(-vectors.count() // BLOCKS)))  # a vector meets so few blocks that copies stay few
    rows = saved(ordered(vectors, basis, epsilon, size))
    pairs = interval_pairs(rows, k, epsilon)
    both = pairs.select("one", "two", F.explode(F.array(
        F.struct(F.col("one").alias("block"), F.lit(0).alias("side"), F.col("lb").alias("low"), F.col("hb").alias("high")),
        F.struct(F.col("two").alias("block"), F.lit(1).alias("side"), F.col("la").alias("low"), F.col("ha").alias("high")))).alias("x"))
    both = both.select("one", "two", "x.*").filter("one <> two or side = 0")
    # of a block only vectors near the other block's box are sent
    sent = rows.join(both, "block").filter(far("y", "y", "low", "high") <= epsilon * epsilon)
    dealt = sent.select("one", "two", "side", "at", "rep", "weight", "v").repartition("one", "two").sortWithinPartitions("one", "two", "side", "at")

    def compare(batches):
        for part in runs(batches, ["one", "two"]):
            one, two, side = (part[c].to_numpy() for c in ("one", "two", "side"))
            begin = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
            for a, b in zip(begin, np.append(begin[1:], len(one))):
                out = near_in_group(part.slice(a, b - a), side[a:b], one[a] == two[a], least, basis)
                if out is not None:
                    yield out

    return dealt.mapInArrow(compare, "rep long, links long, root long")


def near_in_group(group: pa.Table, side: np.ndarray, same: bool, least: float, basis: np.ndarray) -> pa.RecordBatch | None:
    """Links of a pair of blocks, whose rows stand in grid order. Intervals of INNER rows whose boxes lie too far apart are skipped."""
    rep, weight = group["rep"].to_numpy(), group["weight"].to_numpy()
    v = group["v"].combine_chunks()
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
    size = np.diff(v.offsets.to_numpy())
    degree, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
    for width in np.unique(size):
        at = np.flatnonzero(size == width)
        x = v.take(pa.array(at)).flatten().to_numpy().reshape(-1, width)
        x = x / np.abs(x).max(1, keepdims=True)
        norm = np.sqrt((x * x).sum(1))
        left = np.flatnonzero(side[at] == 0)
        right = left if same else np.flatnonzero(side[at] == 1)
        if not len(left) or not len(right):
            continue
        y = x @ basis / norm[:, None] if width == len(basis) else np.zeros((len(x), 1))
        cuts = np.arange(0, len(right), INNER)
        low, high = np.minimum.reduceat(y[right], cuts), np.maximum.reduceat(y[right], cuts)
        for start in range(0, len(left), INNER):
            rows = left[start:start + INNER]
            gap = np.maximum(np.maximum(low - y[rows].max(0), y[rows].min(0) - high), 0)
            near = np.flatnonzero((gap * gap).sum(1) <= 2 - 2 * least + 1e-9)
            # a few intervals at a time; inside one block each pair is met once
            for some in (near[n:n + 16] for n in range(0, len(near), 16)):
                if same:
                    some = some[some >= start // INNER]
                    if not len(some):
                        continue
                others = np.concatenate([right[c:c + INNER] for c in cuts[some]])
                hit = (x[rows] @ x[others].T) / (norm[rows][:, None] * norm[others][None]) >= least
                if same:
                    hit &= rows[:, None] < others[None]
                i, j = np.nonzero(hit)
                if not len(i):
                    continue
                i, j = at[rows[i]], at[others[j]]
                np.add.at(degree, i, weight[j])
                np.add.at(degree, j, weight[i])
                root = local_components(len(rep), np.append(i, root), np.append(j, np.arange(len(rep))))
    linked = np.flatnonzero(degree)
    if not len(linked):
        return None
    low = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(low, root, rep)
    return pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(degree[linked]), pa.array(low[root[linked]])], names=["rep", "links", "root"])


def near_duplicates(rows: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row: links are pairs of cosine >= least, in double precision.

    Rows of equal vectors are compared once and count each. Null vectors, zero ones and those with a null or
    non-finite component link with nothing; vectors of different lengths never link. Rows without an id link and count
    like others and are never kept; where no row of a component has an id, component_id is null. Rows of one id have a row each. An empty table gives no rows.
    """
    plain = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = plain.filter(usable(F.col("v")))
    groups = saved(good.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("weight")).withColumn("rep", F.monotonically_increasing_id()))
    found = saved(cosine_links(groups.select("rep", "weight", "v"), least))
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    state = groups.join(degree, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    state = state.select("least", F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("root", "rep").alias("r"))
    state = state.join(state.groupBy("r").agg(F.min("least").alias("c")), "r")
    out = good.join(state, F.col("v") == F.col("_v")).select("id", "n", "c")
    alone = plain.filter(~usable(F.col("v"))).select("id", F.lit(0).alias("n"), F.col("id").alias("c"))  # no join: they may be many
    out, component = out.union(alone), F.col("c")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def op6(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
