"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 5)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from procuris.llm.common import crc32_of_id, free, saved, slices, table, words

BITS = 20
#: At most about so many labelled rows (a sample by hash of the id) fit the weights.
SAMPLE = 12000
#: Features of fewer labelled rows than this are left out of the fit. This and L1 hold for SAMPLE rows and shrink with
#: the fourth root of their number.
LEAST_ROWS = 5
EPOCHS, ALPHA, BETA, L1, L2 = 3, 1.0, 1.0, 8.0, 1.0
THRESHOLD = 0.3
EDGE = ".,;:!?\"'()[]{}<>*#$%&-_/\\|~`^+=@"


@dataclass
class Weights:
    """The sparse model: feature indexes, their weights and the bias. No labelled row: empty, and bias None."""

    index: np.ndarray
    value: np.ndarray
    bias: float | None


def features(index: np.ndarray, offsets: np.ndarray, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every 1-gram, 2-gram and 2-gram that skips one or two words; repeats stay."""
    digest = xxhash.xxh64_intdigest
    base = np.fromiter((digest((w.strip(EDGE) or w).encode("utf-8", "surrogatepass")) for w in vocabulary),
                       np.uint64, len(vocabulary))
    word = base[index] if len(index) else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    rows, cells = [text], [word]
    for kind, gap in enumerate((1, 2, 3)):
        same = text[:-gap] == text[gap:]
        rows.append(text[:-gap][same])
        cells.append((word[:-gap] * np.uint64(0x9E3779B97F4A7C15) + word[gap:] + np.uint64(kind + 1))[same])
    mixed = np.concatenate(cells) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.concatenate(rows), (mixed >> np.uint64(64 - BITS)).astype(np.int32)


def fit_rows(rows: list[tuple[np.ndarray, int]]) -> Weights:
    """FTRL-proximal (McMahan et al. 2013): per-coordinate rates, L1 leaves most weights at exactly zero."""
    if not rows:
        return Weights(np.zeros(0, np.int32), np.zeros(0), None)
    seen = np.zeros(1 << BITS, np.int32)
    for at, _ in rows:
        seen[at] += 1
    scale = min(1.0, len(rows) / SAMPLE) ** 0.25
    rows, l1 = [(at[seen[at] >= LEAST_ROWS * scale], label) for at, label in rows], L1 * scale
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, label in rows:
            w = weight(z[at], n[at])
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - label
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
    w = weight(z, n)
    at = np.flatnonzero(w)
    return Weights(at.astype(np.int32), w[at], float(-bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", order_col: str = "doc_id",
        sample: int = SAMPLE) -> Weights:
    """Weights learned from labelled rows, of which about `sample` at most are used, chosen by a hash of order_col, then of the text.

    Rows without a label are left out; a null text is an empty one. The fit is one task over the bounded sample, in
    the order of the hash, so that reruns agree; what comes back are the nonzero weights only.
    """
    labelled = labelled.filter(F.col(label_col).isNotNull()).withColumns({"_h": F.xxhash64(F.col(order_col)), "_t": F.xxhash64(F.col(text_col))})
    cut = labelled.select("_h", "_t").orderBy("_h", "_t").limit(sample).agg(F.max(F.struct("_h", "_t"))).first()[0]
    if cut is None:
        return fit_rows([])

    def extract(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                row, cell = features(*words(part.column(text_col)))
                both = np.unique(row.astype(np.int64) << BITS | cell)
                row, cell = both >> BITS, (both & ((1 << BITS) - 1)).astype(np.int32)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("_h"), part.column("_y"), pa.ListArray.from_arrays(ends, cell)], names=["_h", "_y", "at"])

    def train(batches):
        rows = []
        for batch in batches:
            rows += [(at.values.to_numpy(), y) for at, y in zip(batch.column("at"), batch.column("_y").to_pylist())]
        got = fit_rows(rows)
        yield pa.RecordBatch.from_arrays([pa.array([got.bias], pa.float64()), pa.array([got.index.tolist()], pa.list_(pa.int32())), pa.array([got.value.tolist()], pa.list_(pa.float64()))], names=["bias", "at", "value"])

    within = (F.col("_h") < cut["_h"]) | ((F.col("_h") == cut["_h"]) & (F.col("_t") <= cut["_t"]))
    chosen = labelled.filter(within).select("_h", "_t", F.col(label_col).cast("int").alias("_y"), text_col)
    chosen = chosen.dropDuplicates(["_h", "_t", "_y"]).drop("_t")  # a row that is repeated without end is learned once
    rows = chosen.mapInArrow(extract, "_h long, _y int, at array<int>")
    one = rows.repartition(1).sortWithinPartitions("_h", "_y", F.xxhash64("at"))
    got = one.mapInArrow(train, "bias double, at array<int>, value array<double>").first()
    return Weights(np.array(got["at"], np.int32), np.array(got["value"]), got["bias"])


def score(docs: DataFrame, model: Weights, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with a column out_col (0 to 1): the chance of the label. Empty and null texts get the bias alone; if
    nothing was learned every score is 0. A column of docs named out_col is replaced; others stay as they are."""
    base = docs.drop(out_col)
    names = base.columns
    shared = base.sparkSession.sparkContext.broadcast((model.index, model.value, model.bias))

    def each(batches):
        at, value, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[at] = value
        live = np.zeros(1 << BITS, bool)
        live[at] = True
        for batch in batches:
            for part in slices(batch, text_col):
                if bias is None:
                    got = np.zeros(part.num_rows)
                else:
                    row, cell = features(*words(part.column(text_col)))
                    hit = live[cell]
                    both = np.unique(row[hit].astype(np.int64) << BITS | cell[hit])
                    sums = np.bincount(both >> BITS, dense[both & ((1 << BITS) - 1)], part.num_rows)
                    got = 1 / (1 + np.exp(-np.clip(sums + bias, -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got)], names=[*names, out_col])

    return base.mapInArrow(each, StructType([*base.schema.fields, StructField(out_col, DoubleType())]))


def labelled_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of rows whose crc32(doc_id) mod 4 is not 2; several labels of one id count as their largest.

    Ids are chosen before texts are read: about `sample` by a hash, so few that they go to every task. fit bounds the
    rows of an id that has very many.
    """
    truth = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    truth = truth.filter(F.pmod(crc32_of_id(), F.lit(4)) != 2)
    known = docs.select("doc_id").join(truth, "doc_id").withColumn("_h", F.xxhash64("doc_id"))
    cut = known.select("_h").orderBy("_h").limit(sample).agg(F.max("_h")).first()[0]
    chosen = saved(known.filter(F.col("_h") <= F.lit(cut)).select("doc_id", "toxic").distinct())
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold; columns as they were."""
    (name,) = free(docs, "toxicity")
    scored = score(docs, fit(labelled_rows(docs, labels)), out_col=name)
    return scored.filter(F.col(name) < threshold).select(*docs.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(labelled_rows(docs, labels))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", (F.pmod(crc32_of_id(), F.lit(4)) == 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
