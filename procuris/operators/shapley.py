"""Shapley values of fitted forests from their node tables."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procuris.sources.shared import at_exit, shared_dir

#: Features of a path up to which the values of all its patterns are worked out once; longer paths take the patterns that rows have.
TABLED = 8

#: Cells of rows alike to all paths whose values a task keeps, about.
KEPT = 100_000


@dataclass
class Leaf:
    """A path to a leaf: its distinct features, the interval (low, high] that each has to be in, the share of the training
    rows that the path's splits on it let through, and what the leaf says of each class."""

    features: list[int]
    low: list[float]
    high: list[float]
    share: list[float]
    value: np.ndarray

    def patterns(self, x: np.ndarray) -> np.ndarray:
        """For each row which of the path's features are inside, as bits. A missing value is in no (.., high], as in the forest."""
        out = np.zeros(len(x), np.int64)
        for n, (f, low, high) in enumerate(zip(self.features, self.low, self.high)):
            inside = np.ones(len(x), bool) if high == math.inf else x[:, f] <= high
            if low > -math.inf:
                inside &= ~(x[:, f] <= low)
            out |= inside.astype(np.int64) << n
        return out

    def contributions(self, patterns: np.ndarray) -> np.ndarray:
        """Patterns x features: each feature's Shapley value of reaching this leaf.

        A set of known features is worth the product of their insides and of the others' shares. Sets of one size are
        summed by a polynomial whose coefficients are built up a feature at a time, so that the work grows with the
        cube of the path's features and not with the number of their sets.
        """
        d = len(self.features)
        inside = (patterns[:, None] >> np.arange(d) & 1).astype(float)
        weight = [math.factorial(m) * math.factorial(d - 1 - m) / math.factorial(d) for m in range(d)]
        out = np.empty((len(patterns), d))
        for i in range(d):
            sums = np.zeros((len(patterns), d))
            sums[:, 0] = 1
            for n, j in enumerate(j for j in range(d) if j != i):
                known = sums[:, :n + 1] * inside[:, j, None]
                sums[:, :n + 1] *= self.share[j]
                sums[:, 1:n + 2] += known
            out[:, i] = (inside[:, i] - self.share[i]) * (sums @ weight)
        return out


def node_rows(model: Model, spark) -> list:
    """Nodes of a fitted forest or boosted trees, as the model is saved: a few thousand rows, whatever it was fitted to."""
    path = f"{shared_dir(spark)}/procuris/model-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    at_exit(spark, path)
    return spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()


def leaves(model: Model, spark) -> list[Leaf]:
    """All paths of a random forest (chances of the classes) or of boosted or regression trees (one number)."""
    weights, classes = list(model.treeWeights), getattr(model, "numClasses", None)
    chances = "RandomForestClassification" in type(model).__name__
    scale = 1 / sum(weights) if "RandomForest" in type(model).__name__ else 1.0
    trees: dict[int, dict] = {}
    for r in node_rows(model, spark):
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    out = []
    for tree, nodes in trees.items():
        def cover(n, nodes=nodes):
            stats = nodes[n]["impurityStats"]
            return sum(stats) if chances else stats[0]

        stack = [(0, {})]
        while stack:
            n, path = stack.pop()
            node = nodes[n]
            if node["leftChild"] < 0:
                stats = np.array(node["impurityStats"]) if chances else None
                value = stats[:classes] / max(stats.sum(), 1e-300) if chances else np.array([node["prediction"]])
                fs = sorted(path)
                out.append(Leaf(fs, [path[f][0] for f in fs], [path[f][1] for f in fs], [path[f][2] for f in fs], value * weights[tree] * scale))
                continue
            split = node["split"]
            if split["numCategories"] != -1:
                raise ValueError("splits by categories are not explained; index them as numbers")
            f, cut, whole = split["featureIndex"], split["leftCategoriesOrThreshold"][0], cover(n)
            for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
                low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
                share *= cover(child) / whole if whole else 0.5
                stack.append((child, path | {f: (low, min(high, cut), share) if left else (max(low, cut), high, share)}))
    return out


def all_cuts(paths: list[Leaf], features: int) -> list[np.ndarray]:
    """The cuts of each feature on any path, in order."""
    found: list[set] = [set() for _ in range(features)]
    for p in paths:
        for f, low, high in zip(p.features, p.low, p.high):
            found[f] |= {cut for cut in (low, high) if math.isfinite(cut)}
    return [np.array(sorted(cuts), float) for cuts in found]


def cells(cuts: list[np.ndarray], x: np.ndarray) -> np.ndarray | None:
    """A number for each row: rows of one number lie between the same cuts, and so fare alike. None where there are too many cells to number."""
    if math.prod(len(c) + 1 for c in cuts) >= 1 << 62:
        return None
    code = np.zeros(len(x), np.int64)
    for f, own in enumerate(cuts):
        code = code * (len(own) + 1) + np.searchsorted(own, x[:, f])  # up to a cut is under it; what is missing is above all
    return code


def forest_shapley(model: Model, rows: DataFrame, features: list[str], key: str = "vendor_id", of: int | None = None) -> DataFrame:
    """(key, class_index, expected, prediction, contributions): path-dependent tree Shapley values (Lundberg et al. 2020) of every row.

    contributions has one number for each of features, which with expected (the forest's mean over its training rows)
    add up to prediction: the chance of the class `of`, or of the row's likeliest class, of a random forest; the margin
    of boosted trees; the value of a regression. The paths go to every task; their number hangs on the model alone. Missing
    figures count as missing, which the forest sends right. Other columns are not read. Rows between the same cuts have the
    same values, which a task works out once and keeps for some KEPT cells.
    """
    spark = rows.sparkSession
    paths = leaves(model, spark)
    shared = spark.sparkContext.broadcast(paths)
    kind = f"{key} {rows.schema[key].dataType.simpleString()}, class_index int, expected double, prediction double, contributions array<double>"

    def each(batches):
        paths = shared.value
        cuts = all_cuts(paths, len(features))
        expected = sum(p.value * math.prod(p.share) for p in paths)
        tables = [p.contributions(np.arange(1 << len(p.features))) if len(p.features) <= TABLED else None for p in paths]

        def told(x: np.ndarray) -> np.ndarray:
            """Rows of class, prediction and contributions."""
            met = [p.patterns(x) for p in paths]
            chance = np.zeros((len(x), len(expected)))
            for p, own in zip(paths, met):
                chance[own == (1 << len(p.features)) - 1] += p.value
            index = np.full(len(x), of) if of is not None else chance.argmax(1)
            out = np.zeros((len(x), len(features)))
            for p, own, ready in zip(paths, met, tables):
                if not p.features:
                    continue
                if ready is None:
                    distinct, own = np.unique(own, return_inverse=True)
                    ready = p.contributions(distinct)
                out[:, p.features] += ready[own] * p.value[index][:, None]
            return np.column_stack([index, chance[np.arange(len(x)), index], out])

        known, values = np.zeros(0, np.int64), np.zeros((0, 2 + len(features)))
        for pdf in batches:
            x = pdf[features].to_numpy(float)
            code = cells(cuts, x)
            if code is None:
                found = told(x)
            else:
                code, first, own = np.unique(code, return_index=True, return_inverse=True)
                fresh = ~np.isin(code, known, assume_unique=True)
                if fresh.any():
                    if len(known) > KEPT:
                        known, values, fresh = known[:0], values[:0], np.ones(len(code), bool)
                    more = np.concatenate([known, code[fresh]])
                    order = np.argsort(more)
                    known, values = more[order], np.concatenate([values, told(x[first[fresh]])])[order]
                found = values[np.searchsorted(known, code)][own]
            index = found[:, 0].astype(np.int32)
            yield pd.DataFrame({key: pdf[key], "class_index": index, "expected": expected[index], "prediction": found[:, 1], "contributions": list(found[:, 2:])})

    return rows.select(key, *(F.col(f).cast("double") for f in features)).mapInPandas(each, kind)


def contributions_long(explained: DataFrame, features: list[str], key: str = "vendor_id") -> DataFrame:
    """(key, feature, contribution, driver) of explained rows, ranked by size as in explain.additive_drivers, without a shuffle."""
    named = F.transform(F.col("contributions"), lambda c, i: F.struct((-F.abs(c)).alias("size"), F.element_at(F.array(*map(F.lit, features)), i + 1).alias("feature"), c.alias("contribution")))
    ranked = explained.select(key, F.posexplode(F.array_sort(named)).alias("at", "x"))
    return ranked.select(key, F.col("x.feature").alias("feature"), F.col("x.contribution").alias("contribution"), (F.col("at") + 1).alias("driver"))
