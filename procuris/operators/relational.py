"""Keyed and ordered operators that the others are built from: latest rows, updates, upserts, ranks, running sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procuris.sources.shared import saved


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which should be total."""
    return top_n(df, keys, order, 1)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each key, with their rank if it is named."""
    out = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first of the rows that agree in keys."""
    return latest_per_key(df, keys, order)


def update_from(target: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of matched rows become those of changes, nulls too; others stay. changes: unique keys."""
    new = changes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_hit"))
    out = target.join(new, target[key] == new["_key"], "left")
    return out.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns))


def combine_first(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left with nulls in the columns filled from the row of the same key in right (unique keys)."""
    other = right.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = left.join(other, left[key] == other["_key"], "left")
    return out.select(*(F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in left.columns))


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Rows of source, and those rows of target whose key is not in it."""
    return target.join(source.select(key), key, "left_anti").unionByName(source, allowMissingColumns=True).select(*target.columns)


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Target, and the first row of each new key of source."""
    return target.unionByName(keep_first(source, keys, order).join(target.select(*keys), keys, "left_anti"))


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Missing columns come in as nulls of the type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def available(df: DataFrame, wanted: list[str]) -> DataFrame:
    """those of the wanted columns that there are."""
    return df.select(*(c for c in wanted if c in df.columns))


def all_of(df: DataFrame, conditions: list[Column | None]) -> DataFrame:
    """F8: rows that meet every condition given; None stands for "all"."""
    given = [c for c in conditions if c is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def id_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many distinct ids both tables have, and only the left or the right one."""
    both = left.select(key).distinct().withColumn("_l", F.lit(1)).join(right.select(key).distinct().withColumn("_r", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"),
                    F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"))


def running(df: DataFrame, value: str, tie: str, amount: Column | None = None, ranges: int | None = None) -> DataFrame:
    """Df with row_rank and running, rank and inclusive sum of amount by falling value, then rising tie. Nulls come last.

    The order is global but no task sorts all rows: sampled splitters of (value, tie) part the rows into ranges, so that
    rows of one value, or without one, are parted too; the ranges' counts and sums are added up (a row for each range),
    and rows are ranked inside their range. Only rows alike in both stay together. df and its ranges are saved, as they
    are read more than once; ranges are as many as shuffles have, or as asked.
    """
    df = saved(df)
    names, order = df.columns, [F.desc_nulls_last(value), F.asc_nulls_first(tie)]
    amount = F.col(value).cast("decimal(38,2)") if amount is None else amount
    dealt = df.withColumn("_amount", amount)
    dealt = dealt.repartitionByRange(ranges, *order) if ranges else dealt.repartitionByRange(*order)
    rows = saved(dealt.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), df)
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    sums = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.coalesce(F.sum("_amount"), F.lit(0)).alias("_sum"))
    ahead = Window.orderBy("_part")  # one row a range
    sums = sums.select("_part", (F.sum("_n").over(ahead) - F.col("_n")).alias("_before"), (F.sum("_sum").over(ahead) - F.col("_sum")).alias("_base"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(sums), "_part")
    return rows.select(*names, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias("row_rank"), (F.col("_base") + F.coalesce(F.sum("_amount").over(inside), F.lit(0))).alias("running"))


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """Df with columns of the whole table's aggregates, which are one row and go to every task.

    Totals that df has already, by name, stay as they are: several steps may share one pass. df is computed twice, so
    what is dear should be saved first.
    """
    new = [c.alias(n) for n, c in totals.items() if n not in df.columns]
    return df.crossJoin(F.broadcast(df.agg(*new))) if new else df


def missing_share(df: DataFrame) -> DataFrame:
    """(column, missing_pct), the share of nulls of every column in percent."""
    names = df.columns
    one = df.agg(*((F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in names))
    return one.unpivot([], names, "column", "missing_pct")
