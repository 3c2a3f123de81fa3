"""Matching and merging of vendor names."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procuris.functions.columns import edit_ratio, normal_name, token_score
from procuris.operators.blocks import Letters, edits, lacking, met
from procuris.operators.relational import top_n
from procuris.operators.setjoin import set_pairs
from procuris.sources.shared import saved


def score(a: str | Column, b: str | Column) -> Column:
    """0.6 of the words' score and 0.4 of the edit ratio, two places; equal names have 100."""
    return F.round(F.when(F.col(a) == F.col(b), 100.0).otherwise(0.6 * token_score(a, b) + 0.4 * edit_ratio(a, b)), 2)


#: More than the rounding of scores can move one against another.
CLOSE = 0.011


def best_of(threshold: float) -> Callable:
    """For set_pairs: of each left name's pairs in a block those of the best score, and of nearly that, of equal scores that of the least right id.

    A pair's words and counts of letters bound its score. Edits are counted of each name's most promising pair first,
    and then of those pairs alone whose bound is not below what that one, or an earlier one, scores.
    """

    def tell(a: pd.DataFrame, b: pd.DataFrame) -> Callable:
        one, two, known = Letters(a["left_norm"]), Letters(b["right_norm"]), {}
        words = []
        for names, pad in ((a["left_norm"], -1), (b["right_norm"], -2)):
            sets = [[known.setdefault(w, len(known)) for w in dict.fromkeys(x.split(" ")) if w] for x in names.unique()]
            table = np.full((len(sets), max(map(len, sets))), pad)
            for row, own in zip(table, sets):
                row[:len(own)] = own
            words.append((table, np.fromiter(map(len, sets), np.int64, len(sets))))
        (x, nx), (y, ny) = words
        bar = np.full(len(one.size), threshold - CLOSE)

        def least(i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
            p, q = one.place[i], two.place[j]
            both = sum((x[p, c] == y[q, d] for c in range(x.shape[1]) for d in range(y.shape[1])), np.zeros(len(p), np.int64))
            held = np.where((both == nx[p]) | (both == ny[q]), 0.2, 0.0)
            base = 0.6 * np.minimum(100.0, (both / (nx[p] + ny[q] - both) + held) * 100)
            longest = np.maximum(one.size[p], two.size[q])
            bound = base + 0.4 * (1 - lacking(one, two, p, q) / longest) * 100
            some = np.flatnonzero(bound >= bar[p])
            firsts = some[np.lexsort((-bound[some], p[some]))]
            firsts = firsts[np.diff(p[firsts], prepend=-1) != 0]
            scores = np.full(len(p), -1.0)
            for pick in (firsts, None):
                pick = some[(bound[some] >= bar[p[some]]) & (scores[some] < 0)] if pick is None else pick
                most = np.floor((base[pick] + 40 - bar[p[pick]]) / 40 * longest[pick] + 1e-9).astype(np.int64)
                far = edits(one, two, p[pick], q[pick], np.minimum(most, longest[pick]))
                scores[pick] = np.where(far <= most, base[pick] + 0.4 * (1 - far / longest[pick]) * 100, 0.0)
                np.maximum.at(bar, p[pick], scores[pick] - CLOSE)
            kept = some[scores[some] >= bar[p[some]]]
            out = pd.DataFrame({"left_id": a["left_id"].to_numpy()[i[kept]], "left_norm": a["left_norm"].to_numpy()[i[kept]], "right_id": b["right_id"].to_numpy()[j[kept]], "right_norm": b["right_norm"].to_numpy()[j[kept]], "score": scores[kept]})
            return out.sort_values("right_id").drop_duplicates(["left_norm", "score"]).drop(columns="score")

        return least

    return tell


def fuzzy_match(left: DataFrame, right: DataFrame, threshold: float = 60.0) -> DataFrame:
    """For each left name the best right name of at least the threshold; (left_id, right_id, score, confidence). Ties to the least id.

    A name without a common word scores 40 at most, so the threshold has to be above. From it follow the shares of words
    that two names need to have in common, or one to hold of the other, and with these they are joined (setjoin.set_pairs).
    Names of one normal form meet once.
    """
    if threshold <= 40:
        raise ValueError("names without a common word can score 40: ask for more")
    left, right = (df.withColumn("norm", normal_name("name")) for df in (left, right))
    share = (threshold - 0.005 - 40) / 60  # scores are rounded to two places
    forms = [df.groupBy("norm").agg(F.min("id").alias("id")) for df in (left, right)]
    # the best of a form are kept where pairs are made, so pairs are not shuffled
    rows = set_pairs(*forms, share, share - 0.2, tell=best_of(threshold)).withColumn("score", score("left_norm", "right_norm")).filter(F.col("score") >= threshold)
    top = rows.groupBy("left_norm").agg(F.max_by(F.struct("score", "right_id"), F.struct("score", (-F.col("right_id")).alias("_i"))).alias("top"))
    best = top_n(left.join(top, F.col("norm") == F.col("left_norm")).select(F.col("id").alias("left_id"), "top.*"), ["left_id"], [F.desc("score"), F.asc("right_id")], 1)
    return best.select("left_id", "right_id", "score", F.when(F.col("score") >= 100, "Exact").when(F.col("score") >= 85, "High").when(F.col("score") >= 70, "Medium").otherwise("Low").alias("confidence"))


def unmatched(left: DataFrame, matches: DataFrame) -> DataFrame:
    """U4: left names without a match."""
    return left.join(matches.select(F.col("left_id").alias("id")), "id", "left_anti")


def match_summary(left: DataFrame, right: DataFrame, matches: DataFrame) -> DataFrame:
    """How many of both lists met, and the left list's coverage in percent."""
    n = left.agg(F.count("*").alias("left_names")).crossJoin(right.agg(F.count("*").alias("right_names"))).crossJoin(matches.agg(F.count("*").alias("matched"), F.countDistinct("right_id").alias("right_matched")))
    return n.withColumn("coverage_pct", F.round(F.col("matched") / F.col("left_names") * 100, 4))


def sequence_ratio(a: str, b: str) -> Column:
    """The sequence matcher's ratio, on candidates only, in batches."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y)])

    return ratio(F.col(a), F.col(b))


def edit_slack(least: float) -> float:
    """The share of the longer name's letters that may differ at an edit ratio of at least `least`, which is rounded to two places."""
    return (100 - least + 0.005) / 100


def segment_keys(norm: str, least: float, probe: bool) -> Column:
    """Keys of a name, of which two names of an edit ratio of at least `least` share one if one probes and the other is indexed.

    Let the shorter have n letters. Then at most t = n (100 - least) / least edits lie between them, so one of its t + 1
    segments stands in the longer name (pigeonhole). Moved by m places, it leaves at least |m| edits before it and |d - m|
    behind it, d being the difference of lengths, so m lies between -(t - d) / 2 and (t + d) / 2. An index key is a segment with its
    number and n; probe keys are the same substrings of the longer name for every n that it may meet.
    """
    c, slack = F.col(norm), edit_slack(least)
    whole = F.length(c)

    def edits(n: Column) -> Column:
        return F.floor(n * slack / (1 - slack) + 1e-9).cast("int")

    def keys(n: Column, moves: Column) -> Column:
        parts = edits(n) + 1

        def of(i: Column) -> Column:
            begin, end = F.floor(n * i / parts).cast("int"), F.floor(n * (i + 1) / parts).cast("int")
            return F.transform(moves, lambda m: F.when((begin + m >= 0) & (end + m <= whole), F.xxhash64(n, i, c.substr(begin + m + 1, end - begin))))

        return F.flatten(F.transform(F.sequence(F.lit(0), parts - 1), of))

    if not probe:
        return F.array_distinct(keys(whole, F.array(F.lit(0))))

    def moves(n: Column) -> Column:
        t, d = edits(n), whole - n
        return F.when(t >= d, F.sequence(-F.floor((t - d) / 2).cast("int"), F.floor((t + d) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))

    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(whole * (1 - slack) - 1e-9)).cast("int"), whole)
    return F.array_compact(F.array_distinct(F.flatten(F.transform(lengths, lambda n: keys(n, moves(n))))))


def segment_join(index: DataFrame, probe: DataFrame, least: float) -> DataFrame:
    """(x, y, similarity), some more than once: names (x, xn) and (y, yn) with an edit ratio of at least `least` that share a segment key.

    Keys are many times the names, so neither side may be sent whole to every task. Pairs are told where they meet, by
    their counts of letters and then by their edits, and only those that are near enough go on.
    """
    slack, kinds = edit_slack(least), {c: df.schema[c].dataType.simpleString() for df, c in ((index, "x"), (probe, "y"))}

    def tell(a: pd.DataFrame, b: pd.DataFrame):
        one, two, x, y = Letters(a["xn"]), Letters(b["yn"]), a["x"].to_numpy(), b["y"].to_numpy()

        def near(i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
            p, q = one.place[i], two.place[j]
            most = np.floor(two.size[q] * slack + 1e-9).astype(np.int64)  # the probing name is the longer one
            some = np.flatnonzero(lacking(one, two, p, q) <= most)
            apart = edits(one, two, p[some], q[some], most[some])
            fine = apart <= most[some]
            some = some[fine]
            return pd.DataFrame({"x": x[i[some]], "y": y[j[some]], "edits": apart[fine], "longest": np.maximum(one.size[p[some]], two.size[q[some]])}).drop_duplicates()

        return near

    cores = index.sparkSession.sparkContext.defaultParallelism  # few names are read by one task, which would make all keys
    index = index.repartition(cores).select("x", "xn", F.explode(segment_keys("xn", least, False)).alias("key"))
    probe = probe.repartition(cores).select("y", "yn", F.explode(segment_keys("yn", least, True)).alias("key"))
    found = met(index, probe, tell, f"x {kinds['x']}, y {kinds['y']}, edits long, longest long")
    return found.select("x", "y", F.round((1 - F.col("edits") / F.col("longest")) * 100, 2).alias("similarity")).filter(F.col("similarity") >= least)


def duplicate_pairs(names: DataFrame, least: float = 85.0) -> DataFrame:
    """(a, b, similarity), a < b: names (id, name) whose normal names have an edit ratio of at least `least`.

    Names of one normal form meet once, in their least id, which the others pair with; pairs of forms come from a join
    of segment keys, which misses none. Empty names pair with nothing.
    """
    rows = names.withColumn("norm", normal_name("name")).filter("norm <> ''")
    forms = saved(rows.groupBy("norm").agg(F.min("id").alias("id")))
    same = rows.join(forms.withColumnRenamed("id", "_first"), "norm").filter("id <> _first").select(F.col("_first").alias("a"), F.col("id").alias("b"), F.lit(100.0).alias("similarity"))
    like = segment_join(forms.select(F.col("id").alias("x"), F.col("norm").alias("xn")), forms.select(F.col("id").alias("y"), F.col("norm").alias("yn")), least)
    pairs = like.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity").distinct()
    return pairs.union(same)


def near_names(left: DataFrame, right: DataFrame, least: float = 85.0) -> DataFrame:
    """(left_id, right_id, similarity): names (id, name) of two tables with an edit ratio of at least `least`, case aside, by segment keys.

    Names that are equal but for case meet by a join of their own. Null and empty names meet nothing; repeated rows count
    once, and names that many ids share are compared once.
    """
    rows = [df.select(F.col("id").alias(f"{s}_id"), F.lower("name").alias(f"{s}_norm")).filter(F.col(f"{s}_norm") != "").distinct() for s, df in (("left", left), ("right", right))]
    forms = [saved(r.select(F.col(f"{s}_norm").alias("norm")).distinct()) for s, r in (("left", rows[0]), ("right", rows[1]))]
    one, two = (forms[i].select(F.col("norm").alias(n), F.col("norm").alias(f"{n}n")) for i, n in ((0, "x"), (1, "y")))
    like = segment_join(one, two, least).select(F.col("x").alias("left_norm"), F.col("y").alias("right_norm"), "similarity")
    one, two = (forms[i].select(F.col("norm").alias(n), F.col("norm").alias(f"{n}n")) for i, n in ((1, "x"), (0, "y")))
    like = like.union(segment_join(one, two, least).select(F.col("y").alias("left_norm"), F.col("x").alias("right_norm"), "similarity")).distinct()
    return rows[0].join(like, "left_norm").join(rows[1], "right_norm").select("left_id", "right_id", "similarity")


def groups(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, master): the least id that pairs connect an id with.

    Large and small stars in turn (Kiveris et al. 2014), so that rounds grow with the logarithm of a chain's length;
    each round is saved.
    """
    now, before = saved(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        now = saved(small.select("x.u", "x.v").filter("u <> v").distinct(), now)
    return ids.select("id").join(now.withColumnsRenamed({"u": "id", "v": "_m"}), "id", "left").select("id", F.coalesce("_m", "id").alias("master"))


def merged(vendors: DataFrame, masters: DataFrame) -> DataFrame:
    """C14: one row for each master: variants and mean figures."""
    rows = vendors.join(masters, vendors["vendor_id"] == masters["id"])
    return rows.groupBy("master").agg(F.count("*").alias("variant_count"), F.min_by("supplier_name", "vendor_id").alias("master_name"), F.round(F.avg("balance"), 4).alias("mean_balance"))
