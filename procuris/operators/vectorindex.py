"""An inverted file of k-means cells for vector search (T6, M25), with texts and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procuris.functions.columns import dot
from procuris.operators.relational import top_n
from procuris.sources.shared import saved

#: Vectors, by a hash of the id, that the cells are fitted to at most; cells at most; vectors of a block of a cell.
SAMPLE, MOST_CELLS, BLOCK = 20_000, 1024, 20_000


@dataclass
class Index:
    """cells: the centres, a row each; rows: saved (cell, part, vec_id, v) of all vectors, v of length one; parts: blocks by cell."""

    cells: np.ndarray
    rows: DataFrame
    parts: dict[int, int]


def unit(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(key, v): vectors divided by their length; null, zero and non-finite ones go."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key), v.alias("v")).filter(F.col("v").isNotNull() & fine)
    length = F.sqrt(dot("v", "v"))
    return rows.withColumn("n", length).filter("n > 0").select(key, F.transform("v", lambda x: x / F.col("n")).alias("v"))


def build(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", sample: int = SAMPLE, cells: int | None = None, seed: int = 7) -> Index:
    """An index of all vectors. Cells, of the commonest width, are about the square root of the number of vectors, at most MOST_CELLS,
    and fitted to a sample that a hash of the id chooses; every vector is then put into the cell of the nearest centre.
    A cell of more than BLOCK vectors has several blocks, so none grows with the table. Vectors of other widths lie in a cell
    of their own, -1, which every query goes through."""
    rows = saved(unit(vectors, key, column))
    n = rows.count()
    if not n:
        return Index(np.zeros((0, 0)), rows.select(F.lit(0).alias("cell"), F.lit(0).alias("part"), key, "v").limit(0), {})
    k = max(1, min(MOST_CELLS, cells or int(n**0.5)))
    wide = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()["w"]
    chosen = rows.filter(F.size("v") == wide).withColumn("h", F.xxhash64(key)).orderBy("h").limit(sample).select(array_to_vector("v").alias("features")).persist()  # every round reads it
    centres = np.array(KMeans(k=k, seed=seed, maxIter=20).fit(chosen).clusterCenters())
    chosen.unpersist()
    centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    kind = rows.schema[key].dataType.simpleString()

    def place(batches):
        for pdf in batches:
            cell, fit = np.full(len(pdf), -1, np.int32), (pdf["v"].map(len) == wide).to_numpy(bool)
            if fit.any():
                cell[fit] = (np.stack(pdf["v"].to_numpy()[fit]) @ shared.value.T).argmax(1)
            yield pdf.assign(cell=cell)[["cell", key, "v"]]

    placed = saved(rows.mapInPandas(place, f"cell int, {key} {kind}, v array<double>"), rows)
    parts = {r["cell"]: -(-r["count"] // BLOCK) for r in placed.groupBy("cell").count().collect()}  # a row a cell
    number = F.create_map(*(F.lit(x) for pair in parts.items() for x in pair))
    dealt = placed.withColumn("part", F.pmod(F.xxhash64(key), F.element_at(number, F.col("cell"))).cast("int"))
    return Index(centres, saved(dealt.select("cell", "part", key, "v").repartition("cell", "part").sortWithinPartitions("cell", "part"), placed), parts)


def search(index: Index, queries: DataFrame, k: int, probes: int, key: str = "vec_id") -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest of the vectors in the `probes` cells nearest to each query (query_id, q), by cosine; ties by id.

    With as many probes as cells the result is the exact one. A query meets vectors of its own width; null and zero queries
    find nothing.
    """
    spark = queries.sparkSession
    asked = unit(queries, "query_id", "q")
    kind = {c: df.schema[c].dataType.simpleString() for df, c in ((asked, "query_id"), (index.rows, key))}
    shared = spark.sparkContext.broadcast((index.cells, index.parts))

    def probe(batches):
        cells, parts = shared.value
        for pdf in batches:
            for query, v in pdf[["query_id", "v"]].itertuples(index=False):
                near = np.argsort(-(cells @ v), kind="stable")[:probes].tolist() if len(v) == cells.shape[1] else []
                at = [(c, p) for c in [*near, -1] for p in range(parts.get(c, 0))]
                if at:
                    yield pd.DataFrame({"query_id": query, "v": [v] * len(at), "cell": np.array([c for c, _ in at], np.int32), "part": np.array([p for _, p in at], np.int32)})

    sent = asked.mapInPandas(probe, f"query_id {kind['query_id']}, v array<double>, cell int, part int")

    def best(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], key: [], "similarity": []})
        out, size, wide = [], x["v"].map(len), q["v"].map(len)
        for w in set(size) & set(wide):
            some, ask = x[size == w], q[wide == w]
            found = np.round(np.stack(ask["v"].to_numpy()) @ np.stack(some["v"].to_numpy()).T, 6)
            ids = some[key].to_numpy()
            for query, row in zip(ask["query_id"], found):
                at = np.lexsort((ids, -row))[:k]
                out.append(pd.DataFrame({"query_id": query, key: ids[at], "similarity": row[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], key: [], "similarity": []})

    near = index.rows.groupBy("cell", "part").cogroup(sent.groupBy("cell", "part")).applyInPandas(best, f"query_id {kind['query_id']}, {key} {kind[key]}, similarity double")
    return top_n(near, ["query_id"], [F.desc("similarity"), F.asc(key)], k, rank="rank").select("query_id", key, "similarity", "rank")


def with_texts(found: DataFrame, texts: DataFrame, key: str = "vec_id") -> DataFrame:
    """What was found with the text and metadata of its row (texts has unique keys); what has none keeps nulls."""
    return found.join(texts, key, "left")


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """(queries, wanted, recall): the share of the exact result's rows that were found."""
    hit = exact.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return hit.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("wanted"), (F.count("hit") / F.count("*")).alias("recall"))
