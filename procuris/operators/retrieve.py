"""Vector retrieval and context packing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procuris.functions.columns import shown_money
from procuris.operators.relational import top_n
from procuris.sources.shared import saved


#: Vectors and queries of one block; queries of it whose similarities a task holds at once.
VECTORS, QUERIES, AT_ONCE = 20_000, 1000, 32


def top_k(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest of vectors (vec_id, v) to each query (query_id, q), by cosine.

    Vectors and queries are dealt into blocks of bounded size; every pair of blocks is one task's work, of which only
    the k best of each query leave it, and these compete once more. Ties by id; null vectors and those of no length
    are near nothing.
    """
    rows = (vectors if where is None else vectors.filter(where)).select("vec_id", F.col("v").cast("array<double>").alias("v")).filter("v IS NOT NULL")
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).filter("q IS NOT NULL")
    parts, blocks = (max(1, -(-df.count() // most)) for df, most in ((rows, VECTORS), (asked, QUERIES)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def best(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        size, wide = v["v"].map(len), q["q"].map(len)
        for n in set(size) & set(wide):
            some, ask = v[size == n], q[wide == n]
            x, y = np.stack(some["v"].to_numpy()), np.stack(ask["q"].to_numpy())
            ids, names = some["vec_id"].to_numpy(), ask["query_id"].to_numpy()
            length = np.linalg.norm(x, axis=1)
            for begin in range(0, len(y), AT_ONCE):
                part = y[begin:begin + AT_ONCE]
                with np.errstate(divide="ignore", invalid="ignore"):
                    found = np.round((part @ x.T) / np.linalg.norm(part, axis=1)[:, None] / length, 6)
                for query, row in zip(names[begin:begin + AT_ONCE], found):
                    at = np.flatnonzero(~np.isnan(row))
                    at = at[np.lexsort((ids[at], -row[at]))][:k]
                    out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at], "similarity": row[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []})

    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((rows, "vec_id"), (asked, "query_id"))}
    near = rows.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInPandas(best, f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, similarity double")
    return top_n(near, ["query_id"], [F.desc("similarity"), F.asc("vec_id")], k, rank="rank").select("query_id", "vec_id", "similarity", "rank")


def vendor_text(rows: DataFrame) -> DataFrame:
    """(vendor_id, text): a vendor's facts as a sentence; what is not known is left out."""
    text = F.concat_ws(" ", F.concat(F.col("supplier_name"), F.lit(" of "), F.col("country"), F.lit(".")), F.concat(F.lit("Industry: "), F.col("industry_category"), F.lit(".")),
                       F.when(F.col("total_spend").isNotNull(), F.concat(F.lit("Spend: "), shown_money("total_spend"), F.lit("."))))
    return rows.select("vendor_id", text.alias("text"))


def embed(texts: DataFrame, size: int = 256) -> DataFrame:
    """(id, v): hashed TF-IDF vectors of texts, of length one. Another encoder may take its place by mapInPandas."""
    stages = [RegexTokenizer(inputCol="text", outputCol="_w", pattern=r"\W+"), HashingTF(inputCol="_w", outputCol="_t", numFeatures=size), IDF(inputCol="_t", outputCol="_i"), Normalizer(inputCol="_i", outputCol="_v")]
    from pyspark.ml.functions import vector_to_array

    return Pipeline(stages=stages).fit(texts).transform(texts).select("id", vector_to_array("_v").alias("v"))


def pack_context(ranked: DataFrame, budget: int) -> DataFrame:
    """Of each query's ranked texts (query_id, rank, text) those before the first that takes a quarter of a token a sign over the budget.

    Running sums are of lengths alone; the texts join the chosen ones afterwards.
    """
    sizes = ranked.select("query_id", "rank", F.length("text").alias("_n"))
    cost = F.sum(F.col("_n") * 0.25).over(Window.partitionBy("query_id").orderBy("rank"))
    kept = sizes.withColumn("cost", cost).filter(F.col("cost") <= budget).select(F.col("query_id").alias("_query"), F.col("rank").alias("_rank"), "cost")
    return ranked.join(kept, F.col("query_id").eqNullSafe(F.col("_query")) & (F.col("rank") == F.col("_rank"))).drop("_query", "_rank")


def pack_in_order(texts: DataFrame, budget: int, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """M26 for long lists: of each query's texts (query, key, text) in the order of key those before the first that goes over the budget, with cost.

    Keys are unique in a query. Only keys and lengths are ordered: they are parted into ranges by sampled splitters, so
    that a query of very many texts has several; ranges that begin beyond the budget go, the others are summed inside.
    The texts of what is left join last.
    """
    sizes = texts.select(F.col(query).alias("q"), F.col(key).alias("k"), (F.length("text") * 0.25).alias("n"))
    dealt = saved(sizes.repartitionByRange("q", "k").sortWithinPartitions("q", "k").withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)))
    sums = dealt.groupBy("q", "part").agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("own"))
    sums = sums.withColumn("base", F.sum("own").over(Window.partitionBy("q").orderBy("part")) - F.col("own")).filter(F.col("base") <= budget)
    met = dealt.join(sums.select(F.col("q").alias("sq"), F.col("part").alias("sp"), "base"), F.col("q").eqNullSafe(F.col("sq")) & (F.col("part") == F.col("sp")))
    cost = F.col("base") + F.sum("n").over(Window.partitionBy("q", "part").orderBy("k"))
    kept = met.withColumn("cost", cost).filter(F.col("cost") <= budget).select("q", "k", "cost")
    return texts.join(kept, F.col(query).eqNullSafe(F.col("q")) & (F.col(key) == F.col("k"))).drop("q", "k")
