"""SimHash near-duplicates by bit-sliced comparison (operator 4)."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procuris.llm.common import blocked_pairs, components, free, local_components, runs, saved, told_apart

#: Rows of a bucket that one block may hold.
BLOCK = 2048
#: Rough seconds that a row of a bucket key and a bit-sliced comparison cost; they choose the number of keys, not the result.
COPY, PAIR = 1e-6, 2e-9
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, k: int = 4) -> int:
    """SimHash of a text's k-word shingles (A-Z lower-cased, repeats count, XXH64 of seed 42); 0 if it has no word.

    Fewer than k words form one shingle. A bit is 1 if it is set in over half of the hashes.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    grams = zip(*(tokens[i:] for i in range(k))) if len(tokens) >= k else [tokens]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(g), 42) for g in grams), np.uint64)
    count = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[start:start + (1 << 16)].view(np.uint8), bitorder="little")
        count += bits.reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed long; null and blank texts have 0."""

    def each(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), k) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(each, f"{id_col} {kind}, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes, 64 x words: bit i of plane b is bit b of fingerprint i. Lanes past the end repeat the last one."""
    wide = np.concatenate([fps, np.repeat(fps[-1:], -len(fps) % 64)])
    bits = np.unpackbits(wide.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def sliced_pairs(query: np.ndarray, fps: np.ndarray, first: np.ndarray, stop: np.ndarray, radius: int, step: int = 1 << 16):
    """Yields arrays (i, j) of index pairs, first[i] <= j < stop[i], with at most `radius` differing bits between query[i] and fps[j].

    64 neighbouring fingerprints of fps stand in each word of a plane, whatever buckets they are of: lanes outside a
    query's range count as too far from the start. Three planes at a time go through a carry-save adder into bitwise
    counters, for about `step` words at once; words (blocks of 64) whose lanes all exceed the radius are abandoned
    every nine planes.
    """
    plane, nbits = planes(fps), max(2, int(radius).bit_length())
    low, number = first // 64, np.where(stop > first, (stop - 1) // 64 - first // 64 + 1, 0)
    upto = np.cumsum(number)
    begin = 0
    while begin < len(query):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + step, side="right")))
        own, part = number[begin:end], slice(begin, end)
        q = query[part]
        mask = np.where(np.unpackbits(q.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T, ONES, np.uint64(0))
        qi = np.repeat(np.arange(len(q)), own)
        wi = np.arange(len(qi)) - np.repeat(np.cumsum(own) - own, own) + low[part][qi]
        ahead, behind = np.clip(first[part][qi] - wi * 64, 0, 63), np.clip((wi + 1) * 64 - stop[part][qi], 0, 63)
        over = ~((ONES << ahead.astype(np.uint64)) & (ONES >> behind.astype(np.uint64)))
        counter = [np.zeros(len(qi), np.uint64) for _ in range(nbits)]

        def add(carry, at, counter=counter):
            for n in range(at, nbits):
                counter[n], carry = counter[n] ^ carry, counter[n] & carry
            return carry

        for bit in range(0, 64, 3):
            d = [plane[b][wi] ^ mask[b][qi] for b in range(bit, min(64, bit + 3))]
            if len(d) == 3:
                half = d[0] ^ d[1]
                over |= add(half ^ d[2], 0) | add((d[0] & d[1]) | (half & d[2]), 1)
            else:
                for x in d:
                    over |= add(x, 0)
            if bit % 9 == 6 or bit == 63:
                far, same = over, np.full(len(qi), ONES)
                for n in range(nbits - 1, -1, -1):  # counter > radius, from the highest bit down
                    if radius >> n & 1:
                        same = same & counter[n]
                    else:
                        far, same = far | (same & counter[n]), same & ~counter[n]
                live = np.flatnonzero(far != ONES)
                if len(live) < len(qi):
                    qi, wi, over, far = qi[live], wi[live], over[live], far[live]
                    counter[:] = [c[live] for c in counter]
                if not len(qi):
                    break
        if len(qi):
            lanes = np.unpackbits((~far).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(lanes)
            yield qi[row] + begin, wi[row] * 64 + lane
        begin = end


def agreement(n: int, radius: int) -> int:
    """How many blocks of bits a bucket key should hold for n fingerprints: the cheapest of 1 to 3 by COPY (a row of a key, shuffled and sorted) and PAIR (a comparison)."""

    def cost(agree: int) -> float:
        keys = math.comb(radius + agree, agree)
        return keys * n * (COPY + PAIR * n / 2 ** (64 * agree / (radius + agree)))

    return min((1, 2, 3), key=cost)


def bucket_keys(fp: Column, radius: int, agree: int) -> Column:
    """Keys that fingerprints within the radius share at least one of: radius + agree blocks of bits, `agree` of them equal."""
    n = radius + agree
    cut = [64 * i // n for i in range(n + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(n), agree)):
        key = F.lit(t).cast("long")
        for c in chosen:
            width = cut[c + 1] - cut[c]
            part = F.shiftrightunsigned(fp, cut[c]).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key, width).bitwiseOR(part)
        keys.append(key)
    return F.array(*keys)


def near_links(fps: DataFrame, radius: int = 4, agree: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect what links of distance <= radius connect. fps: distinct fp with their rep; it is read twice.

    Exact: every pair within the radius shares a bucket (pigeonhole). All buckets of a batch, small ones and blocks of
    hot ones, are compared bit-sliced in one go. Only a spanning forest of a batch's links is returned, so that m near
    copies give at most m rows a bucket, not m * m. agree: see bucket_keys; by default the number of rows decides.
    """
    agree = agree or agreement(fps.count(), radius)
    rows = fps.select("fp", "rep", F.explode(bucket_keys(F.col("fp"), radius, agree)).alias("key"))
    rows = blocked_pairs(rows, "key", F.col("fp"), block)
    dealt = rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "blk", "fp")

    def compare(batches):
        for part in runs(batches, ["key", "bi", "bj"]):
            fp = part["fp"].to_numpy().view(np.uint64)
            rep, blk = part["rep"].to_numpy(), part["blk"].to_numpy()
            key, bi, bj = (part[k].to_numpy() for k in ("key", "bi", "bj"))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
            group = np.cumsum(new) - 1
            end = np.append(np.flatnonzero(new)[1:], len(fp))[group]
            # in one block each row meets those behind it; of two blocks, rows of the first meet those of the second
            here = np.arange(len(fp))
            second = np.bincount(group, blk == bi, minlength=group[-1] + 1).astype(np.int64)[group] + np.flatnonzero(new)[group]
            first = np.where(bi == bj, here + 1, second)
            stop = np.where((bi == bj) | (blk == bi), end, first)
            root, found = here, False
            for i, j in sliced_pairs(fp, fp, first, stop, radius):
                root, found = local_components(len(fp), np.append(i, root), np.append(j, here)), True
            if not found:
                continue
            linked = np.flatnonzero(root != here)
            nodes, inverse = np.unique(np.concatenate([rep[linked], rep[root[linked]]]), return_inverse=True)
            root = local_components(len(nodes), inverse[:len(linked)], inverse[len(linked):])
            linked = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root[linked]])], names=["a", "b"])

    return dealt.select("key", "bi", "bj", "blk", "fp", "rep").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, k: int = 4,
                    agree: int | None = None) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable over fingerprints within the radius.

    Equal fingerprints are one node, so exact copies cost nothing. Null, empty and blank texts have fingerprint 0
    and link like any other. An empty table gives no rows. Rows with one id twice give a row each. Rows without an id
    link too; where no row of a component has an id, component_id is null. Other columns of docs are not read. More `agree` makes buckets smaller and keys more (5 at 1, 15 at 2, 35 at 3)
    without changing the result; by default the number of fingerprints decides.
    """
    marked = saved(fingerprints(docs.select(id_col, text_col), id_col, text_col, k))
    reps = marked.groupBy("fp").agg(F.min(id_col).alias("id"))
    nulls = not marked.filter(F.col(id_col).isNull()).isEmpty()
    reps = saved(reps.withColumn("rep", F.col("fp") if nulls else F.col("id")))  # fingerprints of which no row has an id are nodes by themselves
    roots = components(near_links(reps, radius, agree))
    classes = reps.join(roots, reps["rep"] == roots["node"], "left").select("fp", "id", F.coalesce("root", "rep").alias("root"))
    if nulls:
        classes = classes.join(classes.groupBy("root").agg(F.min("id").alias("component_id")), "root")
    else:
        classes = classes.withColumn("component_id", F.col("root"))
    return marked.join(classes.drop("id"), "fp").select(id_col, "fp", "component_id")


def hex_fp(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """docs without near copies: of each component one row stays, that of the smallest id; columns are as they were.

    Rows are told apart by id and text, then by number: of repeated rows, and of rows of one id with near texts, one
    stays too. Rows without an id go behind all others; of rows of one id the one with the smallest hash of its text stays.
    """
    key, copy = free(docs, "key", "copy")
    rows, who = told_apart(docs, id_col, text_col, key, copy)
    (name,) = free(rows, "name")
    parts = [F.col(id_col).isNull().alias("none"), *(F.col(c).alias(f"n{i}") for i, c in enumerate(who))]
    marked = saved(fingerprints(rows.select(F.struct(*parts).alias(name), text_col), name, text_col))
    reps = saved(marked.groupBy("fp").agg(F.min(name).alias("first")))
    roots = components(near_links(reps.select("fp", F.col("fp").alias("rep")), radius))
    kept = reps.join(roots, reps["fp"] == roots["node"], "left").groupBy(F.coalesce("root", "fp")).agg(F.min("first").alias("f")).select("f.*")
    same = [rows[c].eqNullSafe(kept[f"n{i}"]) for i, c in enumerate(who)]
    return rows.join(kept, same, "left_semi").select(*docs.columns)  # a row with copy 1 is never the first, as its like with copy 0 is before it


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", hex_fp().alias("fingerprint"), "component_id")
