"""Tables that cut lineage: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own in local mode, and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("procuris.shared.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="procuris-")
        spark.conf.set("procuris.shared.dir", where)
    return where.rstrip("/")


def saved(df: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and a lost executor costs nothing.

    old: an earlier result of saved() that is not needed any more; its files go. All others go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/procuris/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._procuris_path = path
    at_exit(spark, path)
    if old is not None:
        discard(old)
    return out


def at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder removed when the driver ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def discard(df: DataFrame) -> None:
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._procuris_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
