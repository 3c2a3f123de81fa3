"""How the sources of a language differ in their words, by run-length columns (operator 11)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procuris.llm.common import runs, saved, table

#: Documents of a language that a term must be in, and the terms that a group reports.
LEAST_DOCS, TOP = 10, 10
#: Terms of a stretch of the vocabulary, and groups whose columns of one stretch meet in a task at a time (of two blocks).
STRETCH, BLOCK = 1 << 14, 128
#: Sources of a language whose counts order its vocabulary.
LEADING = 4
#: Terms that a task counts before it hands them on.
HELD = 400_000
#: What is no letter below 128 parts terms; A-Z are lower-cased, all bytes of other characters stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
SCALE = 1_000_000_000


def counted(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in a group; a group's own row has term ''."""
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))

    def each(batches):
        held, number = {}, 0

        def out():
            for (lang, source), terms in held.items():
                names = pa.array(list(terms), pa.binary()).cast(pa.string())
                both = np.array(list(terms.values()), np.int64).reshape(-1, 2)
                fixed = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(names), np.int32))) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*fixed, names, pa.array(both[:, 0]), pa.array(both[:, 1])], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            texts = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(langs, sources, texts):
                terms = held.setdefault((lang, source), {b"": [0, 0]})
                own: dict[bytes, int] = {}
                for w in text.as_py().translate(LETTERS).split():
                    own[w] = own.get(w, 0) + 1
                before = len(terms)
                for w, n in own.items():
                    if (x := terms.get(w)) is None:
                        terms[w] = [n, 1]
                    else:
                        x[0] += n
                        x[1] += 1
                number += len(terms) - before
                if number > HELD:
                    yield from out()
                    held, number = {}, 0
        yield from out()

    some = plain.mapInArrow(each, "lang string, source string, term string, n long, docs long")
    return some.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * size)), exact."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return F.call_function("div", wide, (total + 2 * size).cast("decimal(20,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of longs up to SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def vocabulary(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, total, stretch, pos): kept terms in an order that brings equal counts together.

    Terms stand by their counts in the LEADING largest sources of the language, the scarcest first, so that a group's
    column falls into few runs. Each range that was sorted is cut into stretches; pos counts up by one inside them.
    """
    sized = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    first = Window.partitionBy("lang").orderBy(F.desc("size"), "source")
    leading = sized.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= LEADING).drop("size")
    placed = counts.filter("term <> ''").join(leading, ["lang", "source"], "left")
    own = [F.coalesce(F.sum(F.when(F.col("place") == i, F.col("n"))), F.lit(0)).alias(f"k{i}") for i in range(1, LEADING + 1)]
    kept = placed.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), *own).filter(F.col("docs") >= least_docs)
    order = ["lang", *(f"k{i}" for i in range(LEADING, 0, -1)), "total", "term"]
    kept = kept.orderBy(*order).withColumn("at", F.monotonically_increasing_id())
    local = F.col("at").bitwiseAND((1 << 33) - 1)
    stretch = F.shiftleft(F.shiftright("at", 33), 33) + F.floor(local / STRETCH)
    return saved(kept.select("lang", "term", "total", stretch.cast("long").alias("stretch"), (local % STRETCH).cast("int").alias("pos")))


def run_columns(known: DataFrame, groups: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, stretch, source, size, start, p): a group's shares over a stretch as runs. start[i] opens a run of equal p[i]; size closes the last.

    known: (lang, source, stretch, pos, p) of terms that a group has; groups: (lang, source, p0), p0 the share of a term without occurrence.
    """
    ends = terms.groupBy("lang", "stretch").agg(F.min("pos").alias("low"), (F.max("pos") + 1).alias("high"))
    own = known.groupBy("lang", "stretch", "source").agg(F.collect_list(F.struct("pos", "p")).alias("at"))
    every = groups.join(ends, "lang").join(own, ["lang", "stretch", "source"], "left")
    kind = "lang string, stretch long, source string, size int, start array<int>, p array<long>"

    def each(batches):
        for batch in batches:
            starts, shares, sizes = [], [], []
            for at, p0, low, high in zip(batch.column("at"), *(batch.column(c).to_numpy() for c in ("p0", "low", "high"))):
                dense = np.full(high - low, p0, np.int64)
                if at.is_valid:
                    dense[at.values.field("pos").to_numpy() - low] = at.values.field("p").to_numpy()
                start = np.flatnonzero(np.append(True, dense[1:] != dense[:-1]))
                starts.append(start.astype(np.int32))
                shares.append(dense[start])
                sizes.append(high - low)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "stretch", "source")), pa.array(sizes, pa.int32()),
                                              pa.array(starts, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.int64()))], names=["lang", "stretch", "source", "size", "start", "p"])

    return every.select("lang", "stretch", "source", "at", "p0", "low", "high").mapInArrow(each, kind)


def pair_sum(start_a: np.ndarray, p_a: np.ndarray, start_b: np.ndarray, p_b: np.ndarray, size: int) -> int:
    """Sum of f over a stretch: the runs of two columns are intersected, and f is taken once for each common run."""
    start = np.union1d(start_a, start_b)
    p, q = p_a[np.searchsorted(start_a, start, "right") - 1], p_b[np.searchsorted(start_b, start, "right") - 1]
    return int(((p - q) ** 2 // (p + q) * np.diff(start, append=size)).sum())


def pair_sums(columns: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, a, b, value): f summed over all stretches, for each two groups of a language, a <> b, either way round.

    Groups of a language are dealt into blocks by a hash of the source; a stretch's columns meet by pairs of blocks.
    """
    number = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    rows = columns.join(number, "lang").withColumn("blk", F.pmod(F.xxhash64("source"), F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.withColumns({"bi": F.least("blk", "other"), "bj": F.greatest("blk", "other")}).drop("nb", "other")
    dealt = rows.repartition("lang", "stretch", "bi", "bj").sortWithinPartitions("lang", "stretch", "bi", "bj", "source")

    def each(batches):
        for part in runs(batches, ["lang", "stretch", "bi", "bj"]):
            new = np.zeros(part.num_rows - 1, bool)
            for x in (part[k].to_numpy() for k in ("lang", "stretch", "bi", "bj")):
                new |= x[1:] != x[:-1]
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), part.num_rows]
            for low, high in zip(edges[:-1], edges[1:]):
                group = part.slice(low, high - low)
                lang, source, blk = group["lang"][0].as_py(), group["source"].to_pylist(), group["blk"].to_numpy()
                bi, bj, size = group["bi"][0].as_py(), group["bj"][0].as_py(), group["size"][0].as_py()
                start, p = ([x.values.to_numpy() for x in group[c]] for c in ("start", "p"))
                left, right = np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)
                for i in left:
                    others = [j for j in right if bi != bj or j > i]
                    value = [pair_sum(start[i], p[i], start[j], p[j], size) for j in others]
                    a, b = [source[i]] * len(others), [source[j] for j in others]
                    if others:
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * 2 * len(others)), pa.array(a + b), pa.array(b + a), pa.array(value + value, pa.int64())], names=["lang", "a", "b", "value"])

    found = dealt.select("lang", "stretch", "bi", "bj", "blk", "source", "size", "start", "p").mapInArrow(each, "lang string, a string, b string, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` is a group's divergence from each other source of its language,
    part `term` its `top` terms that stand out most from the language.

    A term's share is that of the smoothed counts (two more for each) in billionths; divergence is the sum of
    floor((p - q)^2 / (p + q)) over the terms in `least_docs` documents of the language. All of it is exact. Null texts,
    languages and sources are read as ''; a group without terms still has its pairs, of value 0 where its language
    keeps no term; a language of one source has none. Repeated rows are documents of their own. An empty table gives
    no rows. Other columns are not read. Ties go by the item's UTF-8 bytes.
    """
    counts = saved(counted(docs, text_col, lang_col, source_col))
    terms = vocabulary(counts, least_docs)
    langs = terms.groupBy("lang").agg(F.count("*").alias("size"), F.sum("total").alias("all"))
    known = saved(counts.filter("term <> ''").select("lang", "source", "term", "n").join(terms, ["lang", "term"]))
    groups = counts.filter("term = ''").select("lang", "source").join(known.groupBy("lang", "source").agg(F.sum("n").alias("own")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").select("lang", "source", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("size", F.lit(0)).alias("size"), "all")
    groups = saved(groups)
    shared = known.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("own"), F.col("size")))

    full = groups.filter("size > 0").select("lang", "source", share(F.lit(0), F.col("own"), F.col("size")).alias("p0"))
    sums = pair_sums(run_columns(shared.select("lang", "source", "stretch", "pos", "p"), full, terms), full)
    bare = groups.filter("size = 0").select("lang", "source")
    sums = sums.union(bare.select("lang", F.col("source").alias("a")).join(bare.select("lang", F.col("source").alias("b")), "lang").filter("a <> b").select("lang", "a", "b", F.lit(0).cast("long")))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value").withColumn("rank", F.row_number().over(best))

    apart = shared.withColumn("q", share(F.col("total"), F.col("all"), F.col("size"))).filter("p > q")
    apart = apart.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    return pairs.union(apart.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top))


def op11(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as doc,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
     w as (select lang, source, doc, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
     kept as (select lang, term, count(*) as total from w group by lang, term having count(distinct doc) >= 10),
     langs as (select lang, count(*) as v, sum(total) as everything from kept group by lang),
     own as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by lang, source, term),
     grp as (select g.lang, g.source, coalesce(o.n, 0) as n from (select distinct lang, source from d) g
         left join (select lang, source, sum(n) as n from own group by lang, source) o using (lang, source)),
     grid as (select g.lang, g.source, k.term, coalesce(o.n, 0) as n,
         1 + 1000000000::hugeint * (coalesce(o.n, 0) + 2) // (g.n + 2 * l.v) as p,
         1 + 1000000000::hugeint * (k.total + 2) // (l.everything + 2 * l.v) as q
         from grp g join kept k using (lang) join langs l using (lang) left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term),
     pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
         from grid a join grid b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
     every as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0)::bigint as value
         from grp a join grp b on a.lang = b.lang and a.source <> b.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
         union all
         select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from grid where n > 0 and p > q),
     ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank from every)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10
"""
