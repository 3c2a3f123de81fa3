"""Hard negatives of anchor vectors, by bounds from summaries of vector segments (operator 12)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procuris.llm.common import runs, saved, table

#: Components become whole numbers of one SCALE-th.
SCALE = 256
#: Segments of a vector whose mean and deviation are stored; bounds are taken over so many at each level.
SEGMENTS, LEVELS = 16, (1, 4, 16)
#: Rows of a block at least and at most, how many blocks there should be before they grow, and anchors of a block at most.
LEAST_ROWS, MOST_ROWS, BLOCKS, MOST_ANCHORS = 1024, 16384, 24, 16384
#: Anchors and rows of a tile; the share of live pairs below which they are scored one by one.
TILE_ANCHORS, TILE_ROWS, SPARSE = 256, 4096, 0.05
#: Squared length from which a hundredfold score outgrows a long.
LONGEST = 2.0**56
NONE = np.iinfo(np.int64).min
SIDE = "no long, id long, label long, v array<long>, mean array<double>, dev array<double>"


def cuts(width: int, segments: int) -> np.ndarray:
    """Where each of at most `segments` segments of a vector begins."""
    segments = max(1, min(segments, width))
    return np.arange(segments) * width // segments


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each segment of each row."""
    width = x.shape[1]
    if not width:
        return np.zeros((len(x), 1)), np.zeros((len(x), 1))
    first = cuts(width, SEGMENTS)
    size = np.diff(first, append=width)
    mean = np.add.reduceat(x, first, axis=1) / size
    rest = x - np.repeat(mean, size, axis=1)
    return mean, np.sqrt(np.add.reduceat(rest * rest, first, axis=1) / size)


def prepared(rows: DataFrame, label: Column, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """Rows that take part, saved: no (names the row), id, label, v (floor of scale * component), mean and dev of its segments."""
    plain = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    plain = plain.filter(F.col("label").isNotNull() & F.col("x").isNotNull()).withColumn("no", F.monotonically_increasing_id())

    def each(batches):
        for batch in batches:
            x = batch.column("x")
            offsets = x.offsets.to_numpy().astype(np.int64)
            flat = x.values.to_numpy(zero_copy_only=False).astype(np.float64)[offsets[0]:offsets[-1]]
            offsets -= offsets[0]
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(scale * flat)
                odd = np.append(0, np.cumsum(~np.isfinite(whole)))
            width, fine = np.diff(offsets), odd[offsets[1:]] == odd[offsets[:-1]]
            for w in np.unique(width[fine]):
                at = np.flatnonzero(fine & (width == w))
                v = whole[offsets[at][:, None] + np.arange(w)]
                with np.errstate(over="ignore"):
                    short = (v * v).sum(1) < LONGEST
                at, v = at[short], v[short]
                mean, dev = summaries(v)
                picked = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([
                    *(picked.column(c) for c in ("no", "id", "label")), pa.array(list(v.astype(np.int64)), pa.list_(pa.int64())),
                    pa.array(list(mean), pa.list_(pa.float64())), pa.array(list(dev), pa.list_(pa.float64()))], names=["no", "id", "label", "v", "mean", "dev"])

    return saved(plain.select("no", "id", "label", "x").mapInArrow(each, SIDE))


class Side:
    """Rows of one width as arrays: v, and for each level the segments' means and deviations, weighted by their lengths' roots."""

    def __init__(self, part: pa.Table, at: np.ndarray, width: int):
        part = part.take(pa.array(at))
        self.no, self.label = part["no"].to_numpy(), part["label"].to_numpy()
        self.v = wide(part["v"], np.int64, width)
        self.norm = np.sqrt((self.v.astype(np.float64) ** 2).sum(1))
        mean, dev = (wide(part[c], np.float64, max(1, min(SEGMENTS, width))) for c in ("mean", "dev"))
        first = cuts(width, SEGMENTS) if width else np.zeros(1, int)
        size = np.diff(first, append=max(1, width)).astype(float)
        self.levels = []
        for n in sorted({min(n, len(first)) for n in LEVELS}):  # a coarse segment is made of whole fine ones
            lead = np.arange(n) * len(first) // n
            total = np.add.reduceat(size, lead)
            m = np.add.reduceat(mean * size, lead, axis=1) / total
            off = mean - np.repeat(m, np.diff(lead, append=len(first)), axis=1)
            d = np.add.reduceat((dev * dev + off * off) * size, lead, axis=1)
            self.levels.append((m * np.sqrt(total), np.sqrt(d)))

    def __len__(self):
        return len(self.no)


def wide(column: pa.ChunkedArray, kind, width: int) -> np.ndarray:
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(kind, copy=False).reshape(len(column), width)


def tile(a: Side, b: Side, alive: np.ndarray, rows: slice, columns: slice, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Scores of anchors a[rows] with b[columns] where alive and maybe within [least, most] of the anchor; NONE elsewhere.

    The score lies at the sum over segments of (product of means) +- (product of deviations). Each level has finer
    segments and drops the pairs, and with them rows and columns, that its bounds place outside; what is left is scored.
    """
    out = np.full(alive.shape, NONE, np.int64)
    norm_a, norm_b = a.norm[rows], b.norm[columns]
    for (mean_a, dev_a), (mean_b, dev_b) in zip(a.levels, b.levels):
        i, j = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(i):
            return out
        middle = mean_a[rows][i] @ mean_b[columns][j].T
        reach = dev_a[rows][i] @ dev_b[columns][j].T + (1e-9 * norm_a[i][:, None] * norm_b[j][None] + 0.5)
        near = alive[np.ix_(i, j)] & (middle + reach >= least[i][:, None]) & (middle - reach <= most[i][:, None])
        alive = np.zeros_like(alive)
        alive[np.ix_(i, j)] = near
    i, j = np.nonzero(alive)
    if not len(i):
        return out
    kind = np.float64 if norm_a.max() * norm_b.max() < 2.0**53 else np.int64  # doubles are exact so far
    va, vb = a.v[rows].astype(kind), b.v[columns].astype(kind)
    if len(i) < SPARSE * alive.size:
        for p in range(0, len(i), 1 << 16):
            some = slice(p, p + (1 << 16))
            out[i[some], j[some]] = (va[i[some]] * vb[j[some]]).sum(1)
    else:
        r, c = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        exact = (va[r] @ vb[c].T).astype(np.int64)
        out[np.ix_(r, c)] = np.where(alive[np.ix_(r, c)], exact, NONE)
    return out


def first_k(scores: np.ndarray, k: int) -> np.ndarray:
    """Flags the k largest scores of each row that are not NONE, and ties of the last of them."""
    if scores.shape[1] > k:
        last = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        return (scores >= last[:, None]) & (scores != NONE)
    return scores != NONE


def best(a: Side, b: Side, meet, low: np.ndarray, high: np.ndarray, k: int):
    """(anchor, row): for each window of an anchor the k best rows of b inside it; b stands in order of ties.

    low, high: anchors x windows. meet(rows, columns) flags pairs that may meet. A row in several windows comes once.
    """
    found_a, found_b, found_s = [], [], []
    for start in range(0, len(a), TILE_ANCHORS):
        rows = slice(start, start + TILE_ANCHORS)
        n, windows = low[rows].shape
        held = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64))] * windows
        floor = low[rows].copy()
        for begin in range(0, len(b), TILE_ROWS):
            columns = slice(begin, begin + TILE_ROWS)
            scores = tile(a, b, meet(rows, columns), rows, columns, floor.min(1), high[rows].max(1))
            if (scores == NONE).all():
                continue
            for w in range(windows):
                own = np.where((scores >= floor[:, w, None]) & (scores <= high[rows][:, w, None]), scores, NONE)
                i, j = np.nonzero(first_k(own, k))
                ha, hb, hs = (np.concatenate(x) for x in zip(held[w], (i, j + begin, own[i, j])))
                order = np.lexsort((hb, -hs, ha))
                ha, hb, hs = ha[order], hb[order], hs[order]
                first = np.searchsorted(ha, np.arange(n))
                rank = np.arange(len(ha)) - first[ha]
                keep = rank < k
                last = rank == k - 1
                floor[ha[last], w] = np.maximum(floor[ha[last], w], hs[last])
                held[w] = ha[keep], hb[keep], hs[keep]
        i, j, s = (np.concatenate(x) for x in zip(*held))
        pair, at = np.unique(i * len(b) + j, return_index=True)
        found_a.append(i[at] + start)
        found_b.append(j[at])
        found_s.append(s[at])
    if not found_a:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b), np.concatenate(found_s)


def searched(sent: DataFrame, keys: list[str], k: int, same_label: bool) -> DataFrame:
    """(anchor, other, other_id, score) from rows dealt by keys, side 0 the searched rows and side 1 anchors with their windows (low, high)."""
    dealt = sent.repartition(*keys).sortWithinPartitions(*keys, "side", F.col("id").asc_nulls_last())

    def each(batches):
        for part in runs(batches, keys):
            new = np.zeros(part.num_rows - 1, bool)
            for x in (part[c].to_numpy() for c in keys):
                new |= x[1:] != x[:-1]
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), part.num_rows]
            for begin, end in zip(edges[:-1], edges[1:]):
                group = part.slice(begin, end - begin)
                side = group["side"].to_numpy()
                width = np.diff(group["v"].combine_chunks().offsets.to_numpy())
                for w in np.unique(width[side == 1]):
                    rows, asking = np.flatnonzero((side == 0) & (width == w)), np.flatnonzero((side == 1) & (width == w))
                    if not len(rows):
                        continue
                    a, b = Side(group, asking, w), Side(group, rows, w)
                    windows = group.take(pa.array(asking))
                    number = len(windows["low"][0])
                    low, high = (wide(windows[c], np.int64, number) for c in ("low", "high"))

                    def meet(r, c, a=a, b=b):
                        if same_label:
                            return a.no[r][:, None] != b.no[c][None]
                        return a.label[r][:, None] != b.label[c][None]

                    i, j, s = best(a, b, meet, low, high, k)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(a.no[i]), pa.array(b.no[j]), group["id"].take(pa.array(rows[j])).combine_chunks(), pa.array(s)], names=["anchor", "other", "other_id", "score"])

    return dealt.select(*dict.fromkeys([*keys, "side", "no", "id", "label", "v", "mean", "dev", "low", "high"])).mapInArrow(each, "anchor long, other long, other_id long, score long")


def blocks(name: str, number: Column) -> Column:
    """The row's own block of `number`, by its row number."""
    return F.pmod(F.xxhash64("no", F.lit(name)), number).cast("int")


def positives(rows: DataFrame, anchors: DataFrame, size: int, k: int) -> DataFrame:
    """(anchor, place, positive_id, positive_score): each anchor's k best other rows of its label. A label's rows and anchors are dealt into blocks."""
    number = rows.groupBy("label").agg(F.ceil(F.count("*") / size).cast("int").alias("nb"))
    number = anchors.groupBy("label").agg(F.ceil(F.count("*") / MOST_ANCHORS).cast("int").alias("na")).join(number, "label")
    window = F.array(F.lit(NONE + 1))
    given = rows.join(number, "label").withColumns({"b": blocks("row", F.col("nb")), "a": F.explode(F.sequence(F.lit(0), F.col("na") - 1)), "side": F.lit(0), "low": F.lit(None).cast("array<long>"), "high": F.lit(None).cast("array<long>")})
    asking = anchors.join(number, "label").withColumns({"a": blocks("anchor", F.col("na")), "b": F.explode(F.sequence(F.lit(0), F.col("nb") - 1)), "side": F.lit(1), "low": window, "high": F.array(F.lit(2**62))})
    found = searched(given.unionByName(asking), ["label", "a", "b"], k, True)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.col("other_id").asc_nulls_last(), "other")
    best_k = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return saved(best_k.select("anchor", "place", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))


def hard_negatives(rows: DataFrame, anchor: Column, label: Column | None = None, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
                   id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that `anchor` flags (a
    condition on id) and each of its n_positives best other rows of the same label, the n_negatives best rows of
    another label whose score is from `low` to `high` hundredths of the positive's.

    A score is the inner product of floor(256 * component); ties go by the smaller id, null ids last. Rows with a null
    label, a null vector, a null or non-finite component take no part, nor do those of a squared length of 2^56 or more,
    whose scores outgrow a long; vectors meet those of their own length. A null id is never an anchor. Repeated rows are rows of their
    own: each is another row to the next, and repeated anchors give their results each. An empty table gives no rows.
    Columns other than the three are not read. All rows are compared exactly, anchors by blocks with rows by blocks.
    """
    base = prepared(rows, F.col(label_col) if label is None else label, id_col, vector_col)
    anchors = base.filter(anchor)
    size = min(MOST_ROWS, max(LEAST_ROWS, -(-base.count() // BLOCKS)))
    found = positives(base, anchors, size, n_positives)

    windows = found.groupBy("anchor").agg(F.collect_list("positive_score").alias("scores"))
    filled = F.concat("scores", F.array_repeat(F.element_at("scores", 1), n_positives - F.size("scores")))  # all anchors have as many windows
    # whole numbers: the floor of x / 100 is (x - pmod(x, 100)) / 100
    edges = {"low": F.transform(filled, lambda s: F.call_function("div", low * s + F.pmod(-low * s, F.lit(100)), F.lit(100))),
             "high": F.transform(filled, lambda s: F.call_function("div", high * s - F.pmod(high * s, F.lit(100)), F.lit(100)))}
    asking = anchors.join(windows, anchors["no"] == windows["anchor"]).withColumns(edges)
    n_rows, n_anchors = max(1, -(-base.count() // size)), max(1, -(-anchors.count() // MOST_ANCHORS))
    whole = F.sequence(F.lit(0), F.lit(n_rows - 1)), F.sequence(F.lit(0), F.lit(n_anchors - 1))
    names = ["no", "id", "label", "v", "mean", "dev", "a", "b", "side", "low", "high"]
    given = base.withColumns({"b": blocks("row", F.lit(n_rows)), "a": F.explode(whole[1]), "side": F.lit(0), "low": F.lit(None).cast("array<long>"), "high": F.lit(None).cast("array<long>")})
    asking = asking.withColumns({"a": blocks("anchor", F.lit(n_anchors)), "b": F.explode(whole[0]), "side": F.lit(1)})
    near = searched(given.select(names).union(asking.select(names)), ["a", "b"], n_negatives, False)

    near = near.select("anchor", "other", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    both = found.join(near, "anchor").filter((low * F.col("positive_score") <= 100 * F.col("negative_score")) & (100 * F.col("negative_score") <= high * F.col("positive_score")))
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last(), "other")
    both = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives)
    names = anchors.select(F.col("no").alias("anchor"), F.col("id").alias("anchor_id"))
    return both.join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12(spark, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, moved)


OP12_SQL = """
with e as (select row_number() over () as no, vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
         where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     s as (select a.no as anchor, a.id as anchor_id, b.no, b.id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
         from e a join e b on a.no <> b.no and len(a.v) = len(b.v) where a.id % 100 = 0),
     p as (select anchor, anchor_id, no, id as positive_id, score as positive_score from s where same
         qualify row_number() over (partition by anchor order by score desc, id) <= 5),
     n as (select p.anchor_id, p.positive_id, s.id as negative_id, p.positive_score, s.score as negative_score,
         row_number() over (partition by p.anchor, p.no order by s.score desc, s.id)::integer as rank
         from p join s on p.anchor = s.anchor where not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
