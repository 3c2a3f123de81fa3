"""Mixing of sources to target weights by Efraimidis-Spirakis sampling (operator 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procuris.llm.common import WORD, free, saved, table

#: No document is taken more often, nor a source beyond so many times its size.
EPOCHS = 3
#: Documents of one source whose keys are summed in order together, about.
GROUP = 20_000


def uniform(id_col: str = "doc_id") -> Column:
    """A number above 0 and below 1 from the id: 48 bits of the md5 of its text."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.col(id_col).cast("string"))), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, total_share: float = 1.0, epochs: int = EPOCHS) -> DataFrame:
    """sizes (source, source_size, n) with _rank, target: shares of total_share of all sizes by weights 1, 2, 3, repeating.

    Sources rank by code point, null last. A target stops at `epochs` times the source's size; what is over goes to the
    others by weight until none is above: sorted by size / weight, the sources up to some place are full, and those
    behind it share the rest by weight. Windows run over one row a source.
    """
    name = F.col("source")
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(name.isNull(), name)))
    ranked = ranked.withColumn("_w", (F.pmod(F.col("_rank") - 1, F.lit(3)) + 1).cast("double"))
    full = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    ranked = ranked.withColumn("_cap", (F.col("source_size") * epochs).cast("double"))
    ranked = ranked.withColumns({
        "_total": F.sum("source_size").over(full).cast("double") * total_share,
        "_done": F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_left": F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)), "_at": F.row_number().over(order)})
    ranked = ranked.withColumn("_level", (F.col("_total") - F.col("_done")) / F.col("_left"))
    free = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_at"))
    ranked = ranked.withColumn("_from", F.min(free).over(full))
    level = F.max(F.when(F.col("_at") == F.col("_from"), F.col("_level"))).over(full)
    ranked = ranked.withColumn("_final", level)
    target = F.when(F.col("_from").isNull() | (F.col("_at") < F.col("_from")), F.col("_cap")).otherwise(F.least(F.col("_final") * F.col("_w"), F.col("_cap")))
    return ranked.select("source", "source_size", "n", "_rank", target.alias("target"))


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with size: the number of words of the whole text, 0 for a null one. A column size is replaced."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))


def mix(docs: DataFrame, quality: Column | None = None, id_col: str = "doc_id", epochs: int = EPOCHS) -> DataFrame:
    """docs (with id, source, size) with source_size, target, times and taken: how often and how many words the mix takes.

    All of a source is taken as often as its target holds it whole; for the rest each document has the key
    -ln(u) / quality (Efraimidis and Spirakis 2006: an exponential of rate quality), and documents go by rising key as
    long as their sizes' sum stays within the rest, the one that crosses it only if that comes nearer. u comes from the
    id, so that reruns agree. Quality has to be positive; null counts as 1. Ties go by id, then size. Rows without an
    id have no key and go behind all others of their source, by size. Columns of docs named as the new ones are replaced.

    A large source's sums run in parts: keys are cut into ranges, each range's sum is taken first and then added to
    the running sums of the later ones. Sizes of 0 are taken with the whole source only. An empty table gives no rows.
    """
    rate = F.coalesce(quality, F.lit(1.0)) if quality is not None else F.lit(1.0)
    rows = docs.drop("source_size", "target", "times", "taken")
    key, part, ahead, upto, rank, source, whole, rest, n = free(rows, "key", "part", "ahead", "upto", "rank", "of_source", "whole", "rest", "n_source")
    rows = rows.withColumn(key, -F.log(uniform(id_col)) / rate)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(sizes, epochs=epochs)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    targets = targets.select(F.col("source").alias(source), "source_size", "target", F.col("_rank").alias(rank), F.col("n").alias(n), times.alias(whole))
    targets = targets.withColumn(rest, F.col("target") - F.col(whole) * F.col("source_size"))
    rows = rows.join(targets, rows["source"].eqNullSafe(targets[source]))
    cuts = F.ceil(F.col(n) / GROUP)
    own = F.coalesce(F.floor((1 - F.exp(-F.col(key))) * cuts), cuts + F.length(F.bin("size")))  # without a key: by the size's bits
    rows = rows.withColumn(part, own.cast("int"))
    sums = rows.groupBy(rank, part).agg(F.sum("size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(rank).orderBy(part)) - F.col("_sum")
    rows = rows.join(sums.select(rank, part, before.alias(ahead)), [rank, part])
    by_key = Window.partitionBy(rank, part).orderBy(F.asc_nulls_last(key), id_col, "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(upto, F.col(ahead) + F.sum("size").over(by_key))
    over, under = F.col(upto) - F.col(rest), F.col(rest) - (F.col(upto) - F.col("size"))
    chosen = (F.col("size") > 0) & ((over <= 0) | ((under > 0) & (over <= under)))
    rows = rows.withColumn("times", F.col(whole) + F.when(chosen, 1).otherwise(0))
    rows = rows.withColumn("taken", F.col("size") * F.col("times"))
    return rows.drop(rank, part, ahead, upto, key, whole, rest, n, source)


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with _quality: 2 where a label calls the document good, else 1."""
    good = labels.filter(F.col("quality") == 1).select("doc_id").distinct().withColumn("_good", F.lit(2.0))
    return docs.join(good, "doc_id", "left").withColumn("_quality", F.coalesce("_good", F.lit(1.0))).drop("_good")


def mixed_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The mix as documents: each row as often as it is taken, columns as they were.

    Rows meet their places in the mix by a hash of id, source and text. Rows alike in these are numbered, and as many
    of them are taken once, twice and so on as the mix says.
    """
    key = F.xxhash64("doc_id", "source", "text")
    marked = sized(docs.select("doc_id", "source", "text")).withColumn("hash", key).drop("text")
    plan = mix(saved(with_quality(marked, labels)), F.col("_quality")).filter("times > 0")
    name, number, times, each = free(docs, "hash", "number", "times", "each")
    at = [f"{times}at{n}" for n in range(1, EPOCHS + 1)]
    plan = saved(plan.groupBy(F.col("hash").alias(name)).agg(*(F.count_if(F.col("times") >= n).alias(a) for n, a in enumerate(at, 1))))
    rows = docs.withColumn(name, key).join(plan, name).withColumn(number, F.row_number().over(Window.partitionBy(name).orderBy("source")))
    rows = rows.withColumn(times, sum((F.col(number) <= F.col(a)).cast("int") for a in at)).filter(F.col(times) > 0)
    return rows.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    rows = mix(saved(with_quality(docs, table(spark, sf_dir, "labels"))), F.col("_quality"))  # read twice, words counted once
    return rows.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = """
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1
), keyed AS (
  SELECT d.*, -ln((CAST(CAST('0x' || substr(md5('mix:' || d.doc_id), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0)
    / CASE WHEN g.doc_id IS NULL THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS k
  FROM docs d LEFT JOIN good g ON d.doc_id = g.doc_id
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM sizes
), weighed AS (
  SELECT *, CAST((r - 1) % 3 + 1 AS DOUBLE) AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM ranked
), placed AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
    sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    row_number() OVER (ORDER BY cap / w, r) AS pos
  FROM weighed
), levels AS (SELECT *, (total - done) / rest AS level FROM placed
), begun AS (SELECT *, min(CASE WHEN level * w <= cap THEN pos END) OVER () AS b FROM levels
), final AS (SELECT *, max(CASE WHEN pos = b THEN level END) OVER () AS f FROM begun
), targets AS (
  SELECT source, source_size, CASE WHEN b IS NULL OR pos < b THEN cap ELSE least(f * w, cap) END AS target FROM final
), whole AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS e FROM targets
), summed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, t.e, t.target - t.e * t.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN whole t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (e + CASE WHEN size > 0 AND (upto - rest <= 0 OR (rest - (upto - size) > 0 AND upto - rest <= rest - (upto - size))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed
"""
