"""News operators: signals, matching of articles with vendors, summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procuris.functions import params as P
from procuris.functions.columns import alias_keys, first_category, mapped
from procuris.operators.automaton import mentions, occurrences
from procuris.operators.matching import near_names
from procuris.operators.relational import keep_first, top_n
from procuris.sources.shared import saved

#: What parts words: anything but letters, digits, & and #.
SIGNS = r"[^\p{L}\p{N}&#]+"

#: Articles of a block, whose words are told apart together.
ARTICLES = 2048


def signals(news: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Mean mood, disruptions, articles, latest date and latest type of each vendor in the last days."""
    rows = news.filter(F.col("published_at") >= as_of - F.make_interval(days=F.lit(days)))
    mood = F.sum(F.col("sentiment_score").cast("decimal(18,4)")).cast("double") / F.count("*")
    return rows.groupBy("vendor_id").agg(F.round(mood, 4).alias("news_sentiment"), F.count_if("disruption_flag").alias("disruptions"), F.count("*").alias("articles"), F.max("published_at").alias("last_at"),
                                         F.max_by("disruption_type", F.struct("published_at", "article_id")).alias("last_type"))


def by_source(news: DataFrame) -> DataFrame:
    """Articles, disruptions and mean mood of each source."""
    return news.groupBy("source_name").agg(F.count("*").alias("articles"), F.count_if("disruption_flag").alias("disruptions"), F.round(F.sum(F.col("sentiment_score").cast("decimal(18,4)")).cast("double") / F.count("*"), 4).alias("mean_sentiment"))


def mood_band(c: str | Column, edge: float = 0.1) -> Column:
    """R41, R44."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > edge, "Positive").when(c < -edge, "Negative").otherwise("Neutral")


def delay_gap(news: DataFrame, deliveries: DataFrame, edge: float = -0.01) -> DataFrame:
    """Deliveries and mean delay of vendors with bad news and of the others."""
    mood = news.groupBy("vendor_id").agg((F.sum(F.col("sentiment_score").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("_m")).filter(F.col("_m") < edge)
    rows = deliveries.join(mood.select("vendor_id", F.lit(True).alias("_bad")), "vendor_id", "left")
    return rows.groupBy(F.coalesce("_bad", F.lit(False)).alias("bad_news")).agg(F.count("*").alias("deliveries"), F.round(F.sum("delay_days") / F.count("*"), 4).alias("mean_delay"))


def alias_index(vendors: DataFrame, stop: list[str] = P.ALIAS_STOP) -> DataFrame:
    """(key, vendor_id): names in small letters, and first long words that are no stop words; a key may have several vendors."""
    return vendors.select(F.explode(alias_keys("supplier_name", stop)).alias("key"), "vendor_id").distinct()


def grams(text: Column, most: int) -> Column:
    """Distinct runs of 1 to `most` words of a text in small letters; words are runs of letters, digits, & and #."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), SIGNS), lambda w: w != "")) if most == 1 else F.filter(F.split(F.lower(text), SIGNS), lambda w: w != "")

    def runs(n: int) -> Column:
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return words if most == 1 else F.array_distinct(F.flatten(F.array(words, *(runs(n) for n in range(2, most + 1)))))


def match_articles(articles: DataFrame, index: DataFrame) -> DataFrame:
    """(article_id, vendor_id): vendors of whom a key stands in the text at word bounds.

    Texts are parted into runs of up to as many words as the longest key has, in place of a search of every key in every
    text. Runs are told once for each block of ARTICLES texts and meet the keys in a hash join; a block's texts then meet
    the vendors of its runs, so that a pair is made once for an article, however many of its runs and a run's texts tell it.
    """
    parts = F.filter(F.split("key", SIGNS), lambda w: w != "")
    keys = index.withColumn("_n", F.size(parts)).withColumn("key", F.array_join(parts, " "))
    most = max(1, keys.agg(F.max("_n")).first()[0] or 1)
    kind = {c: df.schema[c].dataType.simpleString() for df, c in ((articles, "article_id"), (index, "vendor_id"))}
    nobody = F.when(F.bool_or(F.col("vendor_id").isNull()), F.array(F.lit(None).cast(kind["vendor_id"]))).otherwise(F.array().cast(f"array<{kind['vendor_id']}>"))
    keys = keys.groupBy("key").agg(F.concat(F.collect_set("vendor_id"), nobody).alias("vendors"))
    texts = articles.select("article_id", grams(F.concat_ws(" ", "title", "description"), most).alias("runs"), F.floor(F.monotonically_increasing_id() / ARTICLES).alias("block"))
    texts = saved(texts.filter(F.size("runs") > 0))
    known = texts.select(F.col("block").alias("of"), F.explode("runs").alias("key")).distinct().join(keys, "key").select("of", "key", "vendors")
    pairs = texts.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_told, f"article_id {kind['article_id']}, vendor_id {kind['vendor_id']}")
    return pairs.distinct()


def _told(texts: pa.Table, known: pa.Table) -> pa.Table:
    """Each article's vendors, once each, of a block's texts (article_id, runs) and those runs that are keys (key, vendors)."""
    runs, vendors = texts["runs"].combine_chunks(), known["vendors"].combine_chunks()
    at = pc.index_in(runs.flatten(), value_set=known["key"].combine_chunks())
    hits, rows = at.drop_null().to_numpy(), pc.list_parent_indices(runs).filter(at.is_valid()).to_numpy()
    named = vendors.flatten().dictionary_encode(null_encoding="encode")
    ends = np.cumsum(pc.list_value_length(vendors).to_numpy(zero_copy_only=False))
    alike: dict = {}  # many keys have the same vendors
    own = [alike.setdefault(s, s) for s in (frozenset(x.tolist()) for x in np.split(named.indices.to_numpy(), ends[:-1]))] if len(ends) else []
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    article, vendor = [], []
    for row, found in zip(rows[first].tolist(), np.split(hits, first[1:])):
        told = frozenset().union(*{own[i] for i in found.tolist()})
        article.extend([row] * len(told))
        vendor.extend(told)
    return pa.table({"article_id": texts["article_id"].take(pa.array(article, pa.int64())), "vendor_id": named.dictionary.take(pa.array(vendor, pa.int64()))})


def contains_pairs(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text_id, name_id) where either of (text_id, text) and (name_id, name) contains the other, case aside, each pair once.

    Both ways are walked by an automaton: texts for the names, and names for those texts that are no longer than the
    longest name. An empty text or name is contained in everything; null ones are in nothing.
    """
    found = occurrences(texts, names.select(F.col("name_id").alias("pattern_id"), F.col("name").alias("pattern"))).select("text_id", F.col("pattern_id").alias("name_id"))
    longest = names.agg(F.max(F.length("name"))).first()[0] or 0
    short = texts.filter(F.length("text") <= longest).select(F.col("text_id").alias("pattern_id"), F.col("text").alias("pattern"))
    back = occurrences(names.select(F.col("name_id").alias("text_id"), F.col("name").alias("text")), short).select(F.col("pattern_id").alias("text_id"), F.col("text_id").alias("name_id"))
    t, n = texts.select("text_id", "text").filter("text IS NOT NULL"), names.select("name_id", "name").filter("name IS NOT NULL")
    # what is empty pairs with everything: these pairs are the result itself
    empty = t.filter("text = ''").crossJoin(n).union(t.crossJoin(n.filter("name = ''"))).select("text_id", "name_id")
    return found.union(back).union(empty).distinct()


def disruption_events(articles: DataFrame, categories: dict[str, list[str]] = P.DISRUPTIONS) -> DataFrame:
    """Articles with a category, its severity and a stable event id."""
    text = F.concat_ws(" ", "title", "description")
    rows = articles.withColumn("disruption_type", first_category(text, categories)).filter(F.col("disruption_type").isNotNull())
    return rows.select(F.substring(F.sha2(F.concat_ws("|", "title", "source_name"), 256), 1, 24).alias("event_id"), "article_id", "title", "disruption_type", mapped("disruption_type", P.SEVERITY, "Low").alias("severity"))


def capped(events: DataFrame, most: int = 3) -> DataFrame:
    """C20: at most so many articles of each vendor, the latest first."""
    return top_n(events, ["vendor_id"], [F.desc("published_at"), F.asc("article_id")], most)


def new_companies(texts: DataFrame, known: DataFrame, candidates: DataFrame | list[str], least: float = 85.0) -> DataFrame:
    """(company, mentions, confidence): candidates named in texts that no known vendor bears, with a confidence from the name's length.

    candidates is a list or a table (company) of any length, which an automaton finds. A candidate is known if its name
    has an edit ratio of at least `least` with a vendor's, case aside. mentions counts texts.
    """
    spark = texts.sparkSession
    named = (candidates if isinstance(candidates, DataFrame) else spark.createDataFrame([(c,) for c in candidates], "company string")).select("company").filter("company <> ''").distinct()
    hits = mentions(texts.select(F.lit(None).cast("long").alias("text_id"), "text"), named.select(F.col("company").alias("pattern_id"), F.col("company").alias("pattern")), unique=True)
    found = saved(hits.select(F.col("pattern_id").alias("company"), F.col("texts").alias("mentions")))
    like = near_names(found.select(F.col("company").alias("id"), F.col("company").alias("name")), known.select(F.col("supplier_name").alias("id"), F.col("supplier_name").alias("name")), least)
    rows = found.join(like.select(F.col("left_id").alias("company")).distinct(), "company", "left_anti")
    return rows.withColumn("confidence", F.least(F.lit(0.95), 0.5 + F.length("company") / 50))


def dedup_feed(articles: DataFrame) -> DataFrame:
    """One article for each url, the earliest."""
    return keep_first(articles, ["url"], [F.asc("published_at"), F.asc("article_id")])
