"""Column standards, type coercion, validation and duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procuris.operators.relational import keep_first


def standardize(df: DataFrame, fields: dict[str, list[str]], required: tuple[str, ...] = ()) -> DataFrame:
    """one column for each field, from the first alias that is there (case aside), else null; other columns go.

    A missing required field raises.
    """
    have = {c.lower().strip(): c for c in df.columns}
    found = {f: next((have[a.lower()] for a in [f, *names] if a.lower() in have), None) for f, names in fields.items()}
    if lost := [f for f in required if found.get(f) is None]:
        raise ValueError(f"required fields are missing: {', '.join(lost)}")
    return df.select(*((F.col(c) if c else F.lit(None).cast("string")).alias(f) for f, c in found.items()))


def coerce(df: DataFrame, types: dict[str, str], formats: dict[str, list[str]] | None = None) -> DataFrame:
    """columns cast where they parse, else null, with _failed, the names of those that had a value and lost it."""
    formats = formats or {}

    def cast(c: str, t: str) -> Column:
        if t in ("date", "timestamp"):
            return F.coalesce(*(F.try_to_timestamp(F.col(c), F.lit(f)) for f in formats.get(c, ["yyyy-MM-dd"]))).cast(t)
        return F.col(c).try_cast(t)

    out = df.withColumns({f"_new_{c}": cast(c, t) for c, t in types.items()})
    failed = F.array_compact(F.array(*(F.when(F.col(c).isNotNull() & F.col(f"_new_{c}").isNull(), F.lit(c)) for c in types)))
    return out.withColumn("_failed", failed).select(*(F.col(f"_new_{c}").alias(c) if c in types else F.col(c) for c in df.columns), "_failed")


def validate(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]], required: list[str]) -> DataFrame:
    """F16: df with row_status (ok, null_found, error) and quality_flags (a map of column to issue); an error outweighs a null."""

    def issue(c: str) -> Column:
        low, high = ranges.get(c, (None, None))
        out = reduce(lambda a, b: a | b, [x for x in (F.col(c) < low if low is not None else None, F.col(c) > high if high is not None else None) if x is not None], F.lit(False))
        return F.when(out, F.lit("out_of_range")).when(F.col(c).isNull(), F.lit("null") if c in required else None)

    columns = list(dict.fromkeys([*ranges, *required]))
    pairs = F.array_compact(F.array(*(F.when(issue(c).isNotNull(), F.struct(F.lit(c).alias("key"), issue(c).alias("value"))) for c in columns)))
    flags = F.map_from_entries(pairs)
    values = F.map_values(flags)
    return df.withColumn("quality_flags", flags).withColumn("row_status", F.when(F.array_contains(values, "out_of_range"), "error").when(F.size(flags) > 0, "null_found").otherwise("ok"))


def quality_summary(df: DataFrame, table: str) -> DataFrame:
    """(table, column, issue, rows)."""
    return df.select(F.explode("quality_flags").alias("column", "issue")).groupBy("column", "issue").agg(F.count("*").alias("rows")).select(F.lit(table).alias("table"), "column", "issue", "rows")


def ingest(df: DataFrame, fields: dict[str, list[str]], types: dict[str, str], ranges: dict, required: list[str], keys: list[str], source: str) -> DataFrame:
    """Standards, types, checks, one row a key (the first by all columns), and the source's name on every row."""
    rows = validate(coerce(standardize(df, fields, tuple(required)), types).drop("_failed"), ranges, required)
    order = [F.asc_nulls_last(F.col(c).cast("string")) for c in fields]
    return keep_first(rows, keys, order).withColumn("source_file", F.lit(source))


def match_table(found: DataFrame, catalogue: dict[str, list[str]], least: int = 2) -> DataFrame:
    """(file, table, score): files (file, columns) by the known table of most key columns, of `least` at least; ties go to the first name. The catalogue is the caller's list."""
    known = found.sparkSession.createDataFrame([(t, [c.upper() for c in cols]) for t, cols in catalogue.items()], "table string, keys array<string>")
    columns = F.transform("columns", lambda c: F.upper(F.trim(c)))
    rows = found.crossJoin(F.broadcast(known)).withColumn("score", F.size(F.array_intersect(columns, "keys"))).filter(F.col("score") >= least)
    best = rows.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("less"), "table")).alias("b"))
    return best.select("file", F.col("b.table").alias("table"), (-F.col("b.less")).alias("score"))


def profile_columns(df: DataFrame, hints: dict[str, list[str]]) -> DataFrame:
    """(column, role, filled, dates): each column's role by its name, and how many values are there and parse as dates."""
    one = df.agg(*(x for c in df.columns for x in (F.count(c).alias(f"{c}|filled"), F.count_if(F.try_to_timestamp(F.col(c).cast("string")).isNotNull()).alias(f"{c}|dates"))))
    long = one.unpivot([], one.columns, "k", "n").select(F.split("k", r"\|")[0].alias("column"), F.split("k", r"\|")[1].alias("what"), "n")
    role = F.coalesce(*(F.when(F.lower("column").rlike("|".join(words)), F.lit(r)) for r, words in hints.items()), F.lit("other"))
    return long.groupBy("column").pivot("what", ["filled", "dates"]).agg(F.first("n")).withColumn("role", role)


def gap_coverage(tables: DataFrame, needs: dict[str, list[str]]) -> DataFrame:
    """(area, found, needed): of the tables that an analytic area needs those that there are (tables: a column table)."""
    need = tables.sparkSession.createDataFrame([(a, t) for a, ts in needs.items() for t in ts], "area string, table string")
    rows = need.join(tables.select("table").distinct().withColumn("_hit", F.lit(1)), "table", "left")
    return rows.groupBy("area").agg(F.array_sort(F.collect_set(F.when(F.col("_hit").isNotNull(), F.col("table")))).alias("found"), F.count("*").alias("needed"))


def synonyms(c: str, table: dict[str, list[str]], default: str) -> Column:
    """a label for each of its spellings, else the default."""
    value = F.lower(F.trim(F.col(c).cast("string")))
    return F.coalesce(*(F.when(value.isin(*names), F.lit(label)) for label, names in table.items()), F.lit(default))
