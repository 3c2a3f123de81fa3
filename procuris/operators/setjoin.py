"""Joins of names by the words they share, without all pairs of a common word."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procuris.functions.columns import tokens
from procuris.operators import blocks

EDGE = 1e-9


def ordered_words(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables of names (id, norm) with w, the distinct words of norm, the rarest of both tables first, and n, their number."""
    sides = [df.select(F.lit(s).alias("side"), "id", "norm").distinct() for s, df in enumerate((left, right))]
    each = sides[0].union(sides[1]).withColumn("word", F.explode(tokens("norm")))
    common = each.groupBy("word").agg(F.count("*").alias("many"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("many", "word"))), lambda x: x["word"])
    sets = each.join(common, "word").groupBy("side", "id", "norm").agg(words.alias("w")).withColumn("n", F.size("w"))
    return tuple(sets.filter(F.col("side") == s).drop("side") for s in (0, 1))


def prefix(sets: DataFrame, side: str, upto: Column) -> DataFrame:
    """A row (word, at) for each of the first `upto` words of a set, with its names' columns marked by side."""
    rows = sets.withColumn("upto", F.least(F.col("n"), F.greatest(upto.cast("int"), F.lit(0))))
    rows = rows.select(F.col("id").alias(f"{side}_id"), F.col("norm").alias(f"{side}_norm"), F.col("n").alias(f"{side}_n"), F.posexplode(F.slice("w", 1, F.col("upto"))).alias(f"{side}_at", "word"))
    return rows


def set_pairs(left: DataFrame, right: DataFrame, least: float, contained: float, once: bool = True, tell: Callable | None = None) -> DataFrame:
    """(left_id, left_norm, right_id, right_norm), each once unless `once` is false: all pairs of word sets that have a Jaccard similarity of at least
    `least`, or of which one holds the other and has at least `contained` of its size; and some more, to be scored.

    Words have one order, rarest first. Two sets of similarity t share a word within their first n - ceil(t n) + 1, and a
    set that another holds has its rarest word early there, so common words, which come last, are joined on by names
    only that have little else (Chaudhuri et al. 2006, Bayardo et al. 2007). Sizes and the places of the shared word bound what
    pairs can still reach, which drops most before they are told apart. Names without a word meet nothing; null names too.

    tell (see blocks.met) gets the pairs in blocks, with no bounds applied, and the rows are those that it returns.
    """
    left, right = ordered_words(left, right)
    names = ["left_id", "left_norm", "right_id", "right_norm"]
    ln, rn = F.col("left_n"), F.col("right_n")

    def enough(n: Column, share: float) -> Column:
        return F.ceil(n * F.lit(max(share, 0.0)) - EDGE)

    a, b = (prefix(df, s, F.col("n") - enough(F.col("n"), least) + 1) for df, s in ((left, "left"), (right, "right")))
    holding = [[prefix(x, s, F.lit(1)), prefix(y, t, F.col("n") - enough(F.col("n"), contained) + 1)] for x, y, s, t in ((left, right, "left", "right"), (right, left, "right", "left"))]
    if tell is not None:
        keyed = [[df.select(f"{s}_id", f"{s}_norm", F.xxhash64(F.lit(kind), "word").alias("key")) for kind, df in enumerate(dfs)]
                 for s, dfs in (("left", (a, holding[0][0], holding[1][1])), ("right", (b, holding[0][1], holding[1][0])))]
        kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((a, "left_id"), (a, "left_norm"), (b, "right_id"), (b, "right_norm")))
        return blocks.met(*(reduce(DataFrame.union, dfs) for dfs in keyed), tell, kinds)
    reach = 1 + F.least(ln - F.col("left_at"), rn - F.col("right_at")) - 1  # this word and those behind it
    alike = a.join(b, "word").filter((ln >= rn * F.lit(least) - EDGE) & (rn >= ln * F.lit(least) - EDGE) & (reach >= (ln + rn) * F.lit(max(least, 0.0) / (1 + max(least, 0.0))) - EDGE))
    held = []
    for (one, two), s, t in zip(holding, ("left", "right"), ("right", "left")):
        sn, tn = F.col(f"{s}_n"), F.col(f"{t}_n")
        held.append(one.join(two, "word").filter((sn <= tn) & (sn >= tn * F.lit(contained) - EDGE) & (sn <= tn - F.col(f"{t}_at"))))
    met = alike.select(names).union(held[0].select(names)).union(held[1].select(names))
    return met.distinct() if once else met
