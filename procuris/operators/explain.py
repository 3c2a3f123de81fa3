"""Attribution of scores."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procuris.operators.relational import with_totals
from procuris.sources.shared import discard, saved


def additive_drivers(rows: DataFrame, weights: dict[str, float], key: str = "vendor_id") -> DataFrame:
    """(key, feature, contribution, driver) of a weighted sum: weight times distance from the mean, ranked by size.

    For an additive score these are its exact Shapley values.
    """
    mean = {c: F.sum(F.col(c).cast("decimal(28,12)")).cast("double") / F.count("*") for c in weights}
    rows = with_totals(rows.select(key, *weights), **{f"_{c}": m for c, m in mean.items()})
    rows = rows.select(key, *(F.round(w * (F.col(c) - F.col(f"_{c}")), 6).alias(c) for c, w in weights.items()))
    long = rows.unpivot(key, list(weights), "feature", "contribution")
    return long.withColumn("driver", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs("contribution")), F.asc("feature"))))


def driver_rows(drivers: DataFrame, key: str = "vendor_id", n: int = 3) -> DataFrame:
    """One row a vendor: its first n drivers, its first mitigator (a negative contribution) and a sentence."""
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("driver", "feature", "contribution"))), 1, n), lambda x: x["feature"])
    mitigator = F.min_by(F.when(F.col("contribution") < 0, F.col("feature")), F.when(F.col("contribution") < 0, F.col("driver")))
    out = drivers.groupBy(key).agg(top.alias("drivers"), mitigator.alias("mitigator"))
    return out.withColumn("narrative", F.concat(F.lit("Risk is driven by "), F.array_join("drivers", ", "), F.coalesce(F.concat(F.lit("; eased by "), F.col("mitigator")), F.lit(""))))


def tiled_importance(rows: DataFrame, importance: DataFrame, key: str = "vendor_id") -> DataFrame:
    """(key, feature, contribution): every row gets the same importances, as shares of the largest; for models that explain no single row.

    importance (feature, importance) has a row for each feature and goes to every task.
    """
    clean = F.coalesce(F.nanvl("importance", F.lit(0.0)), F.lit(0.0))
    top = with_totals(importance.select("feature", clean.alias("_i")), _top=F.max("_i"))
    share = top.select("feature", F.when(F.col("_top") > 0, F.col("_i") / F.col("_top")).otherwise(0.0).alias("contribution"))
    return rows.select(key).crossJoin(F.broadcast(share))


#: Rows of one block, among which a column's values are dealt anew.
DEALT = 20_000


def blocks(rows: DataFrame, key: str) -> DataFrame:
    """rows in blocks of about DEALT by a hash of the key, saved: (rows), an array of structs in the order of another hash."""
    many = max(16, -(-rows.count() // DEALT))
    one = F.struct(F.xxhash64(key, F.lit(1)).alias("_h"), *rows.columns)
    dealt = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(many)).alias("_b")).agg(F.sort_array(F.collect_list(one)).alias("rows"))
    return saved(dealt.select("rows"))


def dealt_anew(dealt: DataFrame, columns: list[str], column: str, seed: int) -> DataFrame:
    """The rows of blocks with the values of one column dealt anew among the rows of each; nothing is shuffled.

    Rows stand in the order of a hash, so values that all move by the same number of places, drawn by seed and block, meet rows at random.
    """
    values, size = F.col("rows")[column], F.size("rows")
    by = F.when(size > 1, F.pmod(F.xxhash64(F.col("rows")[0]["_h"], F.lit(seed)), size - 1) + 1).otherwise(0).cast("int")
    mixed = F.concat(F.slice(values, by + 1, size), F.slice(values, F.lit(1), by))
    lists = dealt.select(*((mixed if c == column else F.col("rows")[c]).alias(c) for c in columns))
    return lists.select(F.inline(F.arrays_zip(*columns)))


def shuffled_column(rows: DataFrame, key: str, column: str, seed: int) -> DataFrame:
    """rows with the values of one column dealt anew among them, within ranges of a hash.

    The ranges are blocks of about 20,000 rows, as many as the table asks for, so that no task holds all rows.
    """
    return dealt_anew(blocks(rows, key), rows.columns, column, seed)


def permutation_importance(rows: DataFrame, key: str, features: list[str], score, repeats: int = 3) -> DataFrame:
    """(feature, importance): how much score(rows) falls, on average, when a feature is shuffled; score gives a number by a Spark job.

    Rows are put into blocks once, and every repeat deals values anew inside them, so disk does not grow with the repeats.
    """
    whole, dealt = score(rows), blocks(rows, key)
    found = [(f, float(np.mean([whole - score(dealt_anew(dealt, rows.columns, f, 31 * n + i)) for n in range(repeats)]))) for i, f in enumerate(features)]
    discard(dealt)
    return rows.sparkSession.createDataFrame(found, "feature string, importance double")


def sampled_shapley(rows: DataFrame, key: str, features: list[str], predict, permutations: int = 8) -> DataFrame:
    """M17 for any model (Strumbelj & Kononenko 2014): (key, feature, contribution).

    Each row meets, for every permutation, a row drawn by hash; features before a place in the permutation come from
    the row itself, the others from the drawn one. predict(df) adds a column `prediction`; the difference that one
    feature makes, averaged over permutations, is its contribution. A row's predictions stand in one row beside it, so
    only its means are shuffled, to bring rows of one key together.
    """
    n, k = 64, len(features)
    drawn = rows.withColumn("_s", F.pmod(F.xxhash64(key, F.lit(5)), F.lit(n))).groupBy("_s").agg(F.min_by(F.struct(*features), F.xxhash64(key, F.lit(6))).alias("other"))
    drawn = drawn.agg(F.transform(F.array_sort(F.collect_list(F.struct("_s", "other"))), lambda x: x["other"]).alias("_drawn"))  # one row of n at most
    out = rows.select(F.col(key), F.struct(*features).alias("_own"), *(F.lit(0.0).alias(f"_sum{i}") for i in range(k)), *(F.lit(0).cast("long").alias(f"_many{i}") for i in range(k))).crossJoin(F.broadcast(drawn))
    kept = out.columns
    for p in range(permutations):
        order = np.random.default_rng(p).permutation(k).tolist()
        out = out.withColumn("_other", F.element_at("_drawn", (F.pmod(F.xxhash64(key, F.lit(p)), F.size("_drawn")) + 1).cast("int")))
        at = []
        for cut in range(k + 1):
            own = set(order[:cut])
            mixed = out.select(*out.columns, *(F.col(f"_{'own' if i in own else 'other'}.{f}").alias(f) for i, f in enumerate(features)))
            at.append(f"_at{cut}")
            out = predict(mixed).withColumn(at[-1], F.col("prediction").cast("double")).select(*out.columns, at[-1])
        gains = {order[cut]: F.col(at[cut + 1]) - F.col(at[cut]) for cut in range(k)}
        out = out.withColumns({f"_sum{i}": F.col(f"_sum{i}") + F.coalesce(g, F.lit(0.0)) for i, g in gains.items()} | {f"_many{i}": F.col(f"_many{i}") + g.isNotNull().cast("long") for i, g in gains.items()}).select(*kept)
    one = out.groupBy(key).agg(*(F.try_divide(F.sum(f"_sum{i}"), F.sum(f"_many{i}")).alias(f"_mean{i}") for i in range(k)))
    long = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"_mean{i}").alias("contribution")) for i, f in enumerate(features)))
    return one.select(key, F.inline(long))


def local_surrogate(rows: DataFrame, key: str, features: list[str], predict, samples: int = 100, width: float = 0.75) -> DataFrame:
    """(key, feature, weight): for each row a weighted ridge fit of predictions at points around it.

    Points are the row plus normal noise of each feature's deviation, from a hash of row and point; nearer ones weigh more.
    """
    spread = rows.agg(*(F.coalesce(F.stddev_pop(f), F.lit(0.0)).alias(f"_{f}") for f in features))
    points = rows.select(key, *features).crossJoin(F.broadcast(spread)).withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))

    def noise(i: int):
        def u(j: int):
            return (F.pmod(F.xxhash64(key, "_n", F.lit(2 * i + j)), F.lit(1 << 30)) + 0.5) / float(1 << 30)

        return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * np.pi * u(1))

    points = points.select(key, *(F.col(f"_{f}") for f in features), *(noise(i).alias(f"z{i}") for i in range(len(features))), *features)
    moved = points.withColumns({f: F.col(f) + F.col(f"_{f}") * F.col(f"z{i}") for i, f in enumerate(features)})
    z = [F.lit(1.0), *(F.col(f"z{i}") for i in range(len(features)))]
    k = len(z)
    near = F.exp(-sum((c * c for c in z[1:]), F.lit(0.0)) / (len(features) * width**2 * 4))
    scored = predict(moved).withColumn("_w", near)
    # the normal equations are sums, so partial sums go through the shuffle, and whole batches are solved at once
    sums = {f"a{i}_{j}": z[i] * z[j] for i in range(k) for j in range(i, k)} | {f"b{i}": z[i] * F.col("prediction") for i in range(k)}
    normal = scored.groupBy(key).agg(*(F.sum(F.col("_w") * x).alias(n) for n, x in sums.items()))

    def solve(batches):
        for pdf in batches:
            a, b = np.zeros((len(pdf), k, k)), pdf[[f"b{i}" for i in range(k)]].to_numpy()
            for i in range(k):
                for j in range(i, k):
                    a[:, i, j] = a[:, j, i] = pdf[f"a{i}_{j}"].to_numpy()
            beta = np.linalg.solve(a + np.eye(k), b[:, :, None])[:, 1:, 0] if len(pdf) else np.zeros((0, k - 1))
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), k - 1), "feature": features * len(pdf), "weight": beta.ravel()})

    return normal.mapInPandas(solve, f"{key} {rows.schema[key].dataType.simpleString()}, feature string, weight double")


def agreement(one: DataFrame, two: DataFrame, key: str = "vendor_id") -> DataFrame:
    """Whether two methods (key, drivers) agree on the first driver, and the share of the first three they have in common."""
    rows = one.select(key, F.col("drivers").alias("_a")).join(two.select(key, F.col("drivers").alias("_b")), key)
    return rows.select(key, F.when(F.col("_a")[0] == F.col("_b")[0], "YES").otherwise("NO").alias("methods_agree"), F.round(F.size(F.array_intersect("_a", "_b")) / 3, 4).alias("overlap"))


def agreement_share(agreed: DataFrame, least: float = 0.66) -> DataFrame:
    """One row: vendors, those whose methods agree on the first driver, and the share of vendors with an overlap of `least` or more."""
    n = F.count("*")
    return agreed.agg(n.alias("vendors"), F.count_if(F.col("methods_agree") == "YES").alias("agree"), F.round(F.count_if(F.col("overlap") >= least) / n, 4).alias("overlap_share"))


def in_both_tops(ranked: DataFrame, most: int = 10) -> DataFrame:
    """global_importance with both_top: whether both rankings have the feature among their first `most`."""
    return ranked.withColumn("both_top", (F.col("rank_one") <= most) & (F.col("rank_two") <= most))


def global_importance(one: DataFrame, two: DataFrame) -> DataFrame:
    """(feature, rank_one, rank_two, combined_rank) of two importance tables (feature, importance); a row for each feature."""
    def ranked(df: DataFrame, name: str) -> DataFrame:
        return df.select("feature", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")).alias(name))

    rows = reduce(lambda a, b: a.join(b, "feature"), (ranked(one, "rank_one"), ranked(two, "rank_two")))
    return rows.withColumn("combined_rank", F.row_number().over(Window.orderBy((F.col("rank_one") + F.col("rank_two")) / 2, "feature")))
