"""The news feed as streams (E1 to E6). Sources carry `ts` as a timestamp; use as_stream for files with another kind."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from procuris.sources import store

DAY_MS = 86_400_000


def as_stream(spark: SparkSession, folder: str, pattern: str, like: DataFrame, per_trigger: int | None = 1) -> DataFrame:
    """Parquet files of a folder as a stream, with ts cast to a timestamp, which watermarks need; per_trigger None takes all new files at once."""
    reader = spark.readStream.schema(like.schema).option("pathGlobFilter", pattern)
    rows = (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def dedup(feed: DataFrame, keys: list[str], late: str = "7 days") -> DataFrame:
    """The first article of each key within the watermark; state is dropped behind it."""
    return feed.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def rolling_signals(feed: DataFrame, length: str = "30 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """Articles and disruptions of each vendor in sliding windows."""
    rows = feed.withWatermark("ts", late).groupBy(F.window("ts", length, step), "vendor_id")
    return rows.agg(F.count("*").alias("articles"), F.count_if("disruption_flag").alias("disruptions")).select(F.col("window.end").alias("window_end"), "vendor_id", "articles", "disruptions")


class Panes(StatefulProcessor):
    """Articles and disruptions of one vendor by day, from which all windows that a day is in are summed.

    A pane is one day's counts. Panes that no open window holds any more go as the watermark moves, by a timer too where
    a vendor falls silent, so a vendor has about `days` of them and those that the feed may still be late by.
    """

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "day long", "articles long, disruptions long")

    def forget(self, watermark_ms: int) -> None:
        """Drop panes of days that only closed windows hold."""
        oldest = watermark_ms // DAY_MS - self.days
        for (day,) in list(self.panes.keys()):
            if day < oldest:
                self.panes.removeKey((day,))

    def handleInputRows(self, key, rows, timers):
        added: dict[int, list[int]] = {}
        for pdf in rows:
            day = pdf["ts"].astype("datetime64[s]").astype("int64") // 86_400
            sums = pdf.assign(day=day).groupby("day")["disruption_flag"].agg(["size", "sum"])
            for d, n, m in sums.itertuples():
                own = added.setdefault(int(d), [0, 0])
                own[0] += int(n)
                own[1] += int(m)
        for d, (n, m) in added.items():
            old = self.panes.getValue((d,)) if self.panes.containsKey((d,)) else (0, 0)
            self.panes.updateValue((d,), (old[0] + n, old[1] + m))
        known = {k[0]: v for k, v in self.panes.iterator()}
        ends = sorted({d + k for d in added for k in range(1, self.days + 1)})
        inside = [[known[d] for d in range(e - self.days, e) if d in known] for e in ends]
        out = pd.DataFrame({"window_end": pd.to_datetime(np.array(ends, "int64"), unit="D").astype("datetime64[ns]"), "vendor_id": key[0], "articles": [sum(n for n, _ in x) for x in inside], "disruptions": [sum(m for _, m in x) for x in inside]})
        watermark = timers.getCurrentWatermarkInMs()
        if watermark > 0:
            self.forget(watermark)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer((max(known) + self.days + 1) * DAY_MS)  # by then no open window holds any of them
        yield out

    def handleExpiredTimer(self, key, timers, expired):
        self.panes.clear()
        return iter(())

    def close(self) -> None:
        pass


def rolling_panes(feed: DataFrame, days: int = 30, late: str = "1 day") -> DataFrame:
    """Articles and disruptions of each vendor in windows of `days` that end at each midnight, as updates: of one window and vendor the row of most articles is the newest.

    An event is shuffled and kept once, in the pane of its day, and not once for each window. The session takes the
    RocksDB state store, which keyed processors need.
    """
    feed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = feed.withWatermark("ts", late).select("vendor_id", "ts", F.coalesce("disruption_flag", F.lit(False)).alias("disruption_flag")).groupBy("vendor_id")
    kind = f"window_end timestamp, vendor_id {feed.schema['vendor_id'].dataType.simpleString()}, articles long, disruptions long"
    return rows.transformWithStateInPandas(Panes(days), kind, "Update", "EventTime")


def daily_counts(feed: DataFrame, late: str = "1 day") -> DataFrame:
    """Disruptions of each day."""
    rows = feed.withWatermark("ts", late).filter("disruption_flag").groupBy(F.window("ts", "1 day"))
    return rows.count().select(F.col("window.start").alias("day"), F.col("count").alias("disruptions"))


def episodes(feed: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Runs of disruptions of a vendor with less than a gap between them."""
    rows = feed.withWatermark("ts", late).filter("disruption_flag").groupBy(F.session_window("ts", gap), "vendor_id")
    return rows.count().select(F.col("session_window.start").alias("begins"), F.col("session_window.end").alias("ends"), "vendor_id", F.col("count").alias("articles"))


def alerts(signals: DataFrame, least: int) -> DataFrame:
    """E5: windows with so many disruptions."""
    return signals.filter(F.col("disruptions") >= least)


def upsert_into(path: str, keys: list[str], order: list[str]):
    """E5: a foreachBatch function that keeps the newest row of each key, by `order`, in a keyed store (sources.store): a batch rewrites the buckets that it touches.

    A batch that runs again after a failure writes its own version anew, from the one before.
    """

    def write(batch: DataFrame, n: int) -> None:
        store.upsert(path, batch, keys, n, [F.desc_nulls_last(c) for c in order])

    return write


def kept(stream: DataFrame, folder: str, keys: list[str], order: list[str]) -> DataFrame:
    """E5: run a stream of updates over what there is and read the newest row of each key; folder as in drained."""
    write = upsert_into(f"{folder}/out", keys, order)
    stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("update").foreachBatch(write).start().awaitTermination()
    return store.stored(stream.sparkSession, f"{folder}/out", stream.schema)


def late_account(feed: DataFrame, folder: str, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """(batch, rows, late_rows, watermark): for each batch of a feed how many of its rows are behind the watermark, that is of a window that had closed before.

    The watermark of a batch is the newest time of the batches before less `late`, as the engine has it; it is read from
    the account itself, so a run that goes on from the checkpoint, or a batch that runs again, counts the same.
    """
    spark, path = feed.sparkSession, f"{folder}/account"
    kind = "batch long, rows long, late_rows long, watermark timestamp, latest timestamp"

    def write(batch: DataFrame, n: int) -> None:
        before = spark.read.schema(kind).parquet(f"{path}/batch-*").filter(F.col("batch") < n) if store.there(spark, path) else spark.createDataFrame([], kind)
        mark = before.agg((F.max("latest") - F.expr(f"INTERVAL {late}")).alias("watermark"))  # one row
        closed = F.window("ts", window)["end"] <= F.col("watermark")
        rows = batch.select("ts").crossJoin(F.broadcast(mark))
        one = rows.agg(F.count("*").alias("rows"), F.count_if(closed).alias("late_rows"), F.max("watermark").alias("watermark"), F.max("ts").alias("latest"))
        one.select(F.lit(n).cast("long").alias("batch"), "rows", "late_rows", "watermark", "latest").write.mode("overwrite").parquet(f"{path}/batch-{n}")

    feed.writeStream.option("checkpointLocation", f"{folder}/account-state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(kind).parquet(f"{path}/batch-*").drop("latest") if store.there(spark, path) else spark.createDataFrame([], kind).drop("latest")


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is and read its result back; folder is shared by driver and executors.

    Other modes than append write a version for each batch and read the latest whole one, so a batch that fails or runs
    again leaves the one before it as it is.
    """
    spark = stream.sparkSession
    sink = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        sink.format("parquet").option("path", f"{folder}/out").outputMode("append").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    sink.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/v{n}")).start().awaitTermination()
    whole = store.whole_versions(spark, f"{folder}/out")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/v{whole[-1]}") if whole else spark.createDataFrame([], stream.schema)
