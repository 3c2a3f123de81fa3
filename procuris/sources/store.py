"""A keyed table in buckets with a manifest, of which an update rewrites the touched buckets only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from procuris.operators.relational import latest_per_key

#: Buckets of a store, if it does not say otherwise when it begins.
BUCKETS = 32


def there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _names(spark: SparkSession, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in system.listStatus(where)] if system.exists(where) else []


def whole_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers n of the tables path/v<n> that are written whole, rising."""
    found = (int(n[1:]) for n in _names(spark, path) if n[:1] == "v" and n[1:].isdigit())
    return sorted(n for n in found if there(spark, f"{path}/v{n}/_SUCCESS"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions whose manifest is whole, rising."""
    return whole_versions(spark, f"{path}/manifest")


def manifest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, str]:
    """Where each bucket lies, by the latest version (before the one given): a row for each bucket."""
    own = [n for n in versions(spark, path) if before is None or n < before]
    if not own:
        return {}
    return {r["bucket"]: r["folder"] for r in spark.read.schema("bucket int, folder string, buckets int").parquet(f"{path}/manifest/v{own[-1]}").collect()}


def stored(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The store as it is; a table without rows where there is none."""
    folders = sorted(set(manifest(spark, path).values()))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def apply(path: str, changes: DataFrame, keys: list[str], version: int, merge, buckets: int = BUCKETS) -> list[int]:
    """Write a new version in which merge(old rows, changes) stands in each bucket that changes touch; returns these buckets.

    Other buckets stay where they lie and only the manifest, which is written last, names them anew: bytes written
    follow the change. A version that runs again starts from the one before it and gives the same; a reader sees a
    version when its manifest is whole. keys are dealt by a hash into the number of buckets that the store began with.
    """
    spark = changes.sparkSession
    old = manifest(spark, path, version)
    if own := versions(spark, path):
        buckets = spark.read.parquet(f"{path}/manifest/v{own[0]}").first()["buckets"]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    dealt = changes.withColumn("_bucket", bucket)
    touched = sorted(r[0] for r in dealt.select("_bucket").distinct().collect())  # at most the number of buckets
    if not touched:
        return []
    folders = [old[b] for b in touched if b in old]
    before = spark.read.schema(changes.schema).parquet(*folders) if folders else spark.createDataFrame([], changes.schema)
    rows = merge(before, changes).select(changes.columns).withColumn("_bucket", bucket)
    data = f"{path}/data/v{version}"
    rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(data)
    kept = {n.partition("=")[2] for n in _names(spark, data) if n.startswith("_bucket=")}
    new = {b: f for b, f in old.items() if b not in touched} | {b: f"{data}/_bucket={b}" for b in touched if str(b) in kept}
    spark.createDataFrame([(b, f, buckets) for b, f in sorted(new.items())], "bucket int, folder string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v{version}")
    return touched


def upsert(path: str, changes: DataFrame, keys: list[str], version: int, order: list[Column] | None = None, buckets: int = BUCKETS) -> list[int]:
    """Rows of changes in place of those of their keys, or beside them; with order the first of both by it stays."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        if order is not None:
            return latest_per_key(old.unionByName(new), keys, order)
        same = [old[k].eqNullSafe(new[k]) for k in keys]
        return old.join(new.select(*keys), same, "left_anti").unionByName(new)

    return apply(path, changes, keys, version, merge, buckets)


def update(path: str, changes: DataFrame, keys: list[str], columns: list[str], schema: StructType | str, version: int) -> list[int]:
    """Columns of stored rows that changes (keys and columns, unique keys) names; rows that are not stored are not made."""
    spark = changes.sparkSession
    full = changes.select(*keys, *columns)
    now = stored(spark, path, schema)
    wide = full.select(*(F.col(c) if c in full.columns else F.lit(None).cast(now.schema[c].dataType).alias(c) for c in now.columns))

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        named = new.select(*(F.col(k).alias(f"k_{k}") for k in keys), *(F.col(c).alias(f"n_{c}") for c in columns), F.lit(True).alias("hit"))
        met = old.join(named, [old[k].eqNullSafe(named[f"k_{k}"]) for k in keys], "left")
        return met.select(*(F.when(F.col("hit"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns))

    return apply(path, wide, keys, version, merge)
