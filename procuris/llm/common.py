"""Shared pieces of the text operators: saved cuts of lineage, Arrow words, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procuris.sources.shared import at_exit, discard, saved, shared_dir  # noqa: F401  the operators take them from here

#: Whole documents are handled a slice of this many bytes of text at a time (one document at least).
SLICE_BYTES = 2 << 20
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as text."""
    return F.crc32(F.col(doc_id).cast("string"))


def free(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has (names differ by more than their case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def told_apart(docs: DataFrame, id_col: str, text_col: str, key: str, copy: str) -> tuple[DataFrame, list[str]]:
    """docs and the columns that name its rows: the id where no id repeats, else also key, a hash of the text, and copy.

    copy is 0 for one row of those alike in id and text, and 1 for all others of them; only such rows are numbered, by
    a saved table of them. A null id counts as an id.
    """
    if docs.groupBy(id_col).count().filter("count > 1").isEmpty():
        return docs, [id_col]
    hashed = docs.withColumn(key, F.xxhash64(F.coalesce(text_col, F.lit("")), F.col(text_col).isNull()))
    twice = saved(hashed.groupBy(F.col(id_col).alias("i"), F.col(key).alias("k")).count().filter("count > 1").drop("count"))
    same = hashed[id_col].eqNullSafe(twice["i"]) & (hashed[key] == twice["k"])
    (number,) = free(hashed, "number")
    some = saved(hashed.join(twice, same, "left_semi").withColumn(number, F.monotonically_increasing_id()))
    first = some.groupBy(F.col(id_col).alias("i"), F.col(key).alias("k")).agg(F.min(number).alias("f"))
    some = some.join(first, some[id_col].eqNullSafe(first["i"]) & (some[key] == first["k"])).withColumn(copy, (F.col(number) != F.col("f")).cast("int"))
    names = [*hashed.columns, copy]
    return hashed.join(twice, same, "left_anti").withColumn(copy, F.lit(0)).select(names).union(some.select(names)), [id_col, key, copy]


def slices(batch: pa.RecordBatch, column: str):
    """Parts of a batch whose texts hold about SLICE_BYTES; a single long document stays whole."""
    texts = batch.column(column)
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, base + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The words of each text, parted by ASCII white space: (index of every word, offsets by text, distinct words).

    lower makes A-Z small and leaves other letters. A null is an empty text.
    """
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets, flat = np.asarray(parts.offsets), parts.flatten()
    offsets = offsets - offsets[0]
    blank = pc.equal(flat, "")  # only of texts without a word
    if pc.any(blank).as_py():
        full = ~blank.to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), offsets, coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that it reaches by the links (a, b)."""
    root = np.arange(n)
    while True:
        old = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if np.array_equal(root, old):
            return root


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of a link the smallest node it reaches, by alternating large and small stars.

    Links may repeat and have any order; links of a node with itself add nothing. Each round is written to the
    shared folder; rounds grow with the logarithm of a component's size (Kiveris et al. 2014).
    """
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now, before = saved(links), None
    while True:
        stats = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if stats == before or stats[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select("v", "v").distinct())
        before = stats
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        now = saved(small.select("x.u", "x.v").filter("u <> v").distinct(), now)


def runs(batches, key: list[str], hot: int | None = None):
    """Record batches of a partition sorted by key, cut so that rows of equal key stay together.

    With hot, a key of more rows comes in several parts, none held longer than that takes; they and the last bear metadata.
    """
    held: list[pa.RecordBatch] = []
    parted = False

    def whole():
        out = pa.Table.from_batches(held).combine_chunks()
        return out.replace_schema_metadata({"parted": "1"}) if parted else out

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in key:
            values = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        at = np.flatnonzero(change)
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in key):
            yield whole()
            held, parted = [], False
        if len(at) and parted:  # the parted key's last rows come alone
            held.append(batch.slice(0, int(at[0])))
            yield whole()
            held, parted, batch, at = [], False, batch.slice(int(at[0])), at[1:] - at[0]
        if len(at):
            held.append(batch.slice(0, int(at[-1])))
            yield whole()
            held = [batch.slice(int(at[-1]))]
        else:
            held.append(batch)
        if hot and sum(b.num_rows for b in held) > hot:
            parted = True
            yield whole()
            held = [held[-1].slice(held[-1].num_rows - 1)]
    if held:
        yield whole()


def blocked_pairs(rows: DataFrame, key: str, spread: Column, most: int) -> DataFrame:
    """Deal the rows of each key into blocks of about `most` rows and give every pair of blocks a group of its own.

    Adds columns bi, bj (a group of a key: its blocks bi <= bj) and blk (the row's own block). A key with few rows has one group;
    a hot one has many, none with more than about twice `most` rows.
    """
    hot = rows.groupBy(key).count().filter(F.col("count") > most).select(
        key, F.ceil(F.col("count") / most).cast("int").alias("nb"))
    rows = rows.join(hot, key, "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64(spread), F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return rows.withColumns({"bi": F.least("blk", "other"), "bj": F.greatest("blk", "other")}).drop("nb", "other")
