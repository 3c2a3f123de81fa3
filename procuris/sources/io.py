"""Readers and writers of files."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from procuris.functions.columns import article_id

ENCODINGS = ("UTF-8", "ISO-8859-1")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_extract(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame | None:
    """A CSV extract of text columns with its header trimmed and in capitals; None if there is no such file.

    UTF-8 is tried first; where that leaves a replacement sign the file is read as Latin-1. Lines that do not parse go.
    """
    if not exists(spark, path):
        return None
    for encoding in ENCODINGS:
        rows = spark.read.option("header", True).option("encoding", encoding).option("mode", "DROPMALFORMED").csv(path)
        rows = rows.toDF(*[c.lstrip("﻿").strip().upper() for c in rows.columns])
        broken = F.exists(F.array(*(F.coalesce(F.contains(F.col(f"`{c}`"), F.lit("�")), F.lit(False)) for c in rows.columns)), lambda x: x)
        if encoding == ENCODINGS[-1] or not rows.filter(broken).limit(1).count():
            return rows.select(*[c for c in columns if c in rows.columns]) if columns else rows
    return None


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, length) of CSV, JSON and Parquet files below a folder; name without ending, in capitals."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,json,parquet}").load(folder)
    return files.select("path", F.upper(F.regexp_extract("path", r"([^/]+)\.[a-z]+$", 1)).alias("name"), "length")


def count_rows(rows: DataFrame) -> DataFrame:
    """S3: (path, rows) of each file that rows come from."""
    return rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))


def with_lineage(spark: SparkSession, rows: DataFrame, paths: list[str]) -> DataFrame:
    """Rows with source_file, file_hash (md5 of the file, which a task reads whole: files of under 2 GB) and ingested_at."""
    hashes = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("_path"), F.md5("content").alias("file_hash"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    rows = rows.withColumn("source_file", F.col("_metadata.file_path"))
    return rows.join(hashes, plain(F.col("source_file")) == plain(F.col("_path")), "left").drop("_path").withColumn("ingested_at", F.current_timestamp())


def first_existing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first path that is there, Parquet or CSV by its ending."""
    for path in paths:
        if exists(spark, path):
            return spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    raise FileNotFoundError(", ".join(paths))


def read_table(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """A query over named tables."""
    return spark.sql(text, **tables)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def report(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """S17."""
    rows.write.mode("overwrite").option("header", True).format(kind).save(path)


ARTICLE = ["article_id", "title", "description", "url", "source_name", "published_at"]


def articles(rows: DataFrame, kind: str) -> DataFrame:
    """Landed feed files of three shapes as one: titles to 500 signs, descriptions to 1000."""
    shapes = {
        "a": ("title", "seendescription", "url", F.col("domain") if kind == "a" else None, "seendate"),
        "b": ("title", "description", "url", F.col("source.name") if kind == "b" else None, "publishedAt"),
        "c": (None, "fields.trailText", "webUrl", F.lit("c"), "webPublicationDate"),
    }
    title, text, url, source, when = shapes[kind]
    name = F.coalesce("fields.headline", "webTitle") if kind == "c" else F.col(title)
    stamp = F.coalesce(*(F.try_to_timestamp(F.col(when), F.lit(f)) for f in ("yyyyMMdd'T'HHmmss'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd")))
    return rows.select(article_id(F.lit(kind), url).alias("article_id"), F.substring(name, 1, 500).alias("title"), F.substring(F.col(text), 1, 1000).alias("description"), F.col(url).alias("url"), source.alias("source_name"), stamp.alias("published_at"))


def read_feed(spark: SparkSession, path: str, schema: StructType | str, kind: str) -> DataFrame:
    return articles(spark.read.schema(schema).json(path), kind)


def store_vectors(vectors: DataFrame, path: str, reset: bool = False) -> None:
    """Write vectors (id, v, text); without reset only ids that are not there yet."""
    spark = vectors.sparkSession
    if not reset and exists(spark, path):
        append(vectors.join(spark.read.parquet(path).select("id"), "id", "left_anti"), path)
    else:
        replace(vectors, path)


def log_run(spark: SparkSession, path: str, run_id: str, counts: dict[str, int], seconds: float) -> None:
    """One row for a run."""
    append(spark.createDataFrame([(run_id, counts, seconds, "ready" if counts and all(counts.values()) else "incomplete")], "run_id string, counts map<string,long>, seconds double, state string"), path)


def logged_write(rows: DataFrame, path: str, log: str, run_id: str, **figures: Column) -> dict:
    """Write rows and append what was observed of them on the way to the log: their count and the named figures.

    Nothing is counted a second time. A run without a row is incomplete.
    """
    began, seen = time.time(), Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.cast("double").alias(n) for n, c in figures.items())).write.mode("overwrite").parquet(path)
    found = seen.get
    spark = rows.sparkSession
    one = (run_id, {"rows": found["rows"]}, {n: found[n] for n in figures}, time.time() - began, "ready" if found["rows"] else "incomplete")
    append(spark.createDataFrame([one], "run_id string, counts map<string,long>, figures map<string,double>, seconds double, state string"), log)
    return found
