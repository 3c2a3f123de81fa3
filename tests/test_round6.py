"""Steps whose tasks and driver stay small when tables grow."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from procuris.operators import models, news
from procuris.sources import curate


@pytest.mark.parametrize("block", [2048, 2])
def test_pairs_of_articles_and_vendors_are_made_once(spark, block, monkeypatch):
    """F16: a common word with many vendors met every text of it in the join, as texts times vendors."""
    monkeypatch.setattr(news, "ARTICLES", block, raising=False)
    articles = spark.createDataFrame([(1, "Acme beta & co", None), (2, None, "the acme; ACME"), (2, "beta", "gamma"), (None, "delta", ""), (3, None, None), (4, "betaé x", "Co & beta")],
                                     "article_id long, title string, description string").repartition(2)
    index = spark.createDataFrame([("acme", v) for v in range(40)] + [("acme", None), ("beta", 7), ("beta", 50), ("beta & co", 60), ("delta", 3), ("", 9), (None, 9), ("co", None), ("co & beta", 61)], "key string, vendor_id int")
    acme = {*range(40), None}
    want = {(1, v) for v in acme | {7, 50, 60}} | {(2, v) for v in acme | {7, 50}} | {(None, 3), (4, None), (4, 7), (4, 50), (4, 61)}
    found = [tuple(r) for r in news.match_articles(articles, index).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert news.match_articles(articles, index.limit(0)).count() == 0 and news.match_articles(articles.limit(0), index).count() == 0
    named = news.match_articles(articles, index.select("key", F.col("vendor_id").cast("string").alias("vendor_id")))
    assert named.schema["vendor_id"].dataType.simpleString() == "string" and {(a, v if v is None else int(v)) for a, v in named.collect()} == want


def test_a_key_with_its_vendors_meets_a_block_once(spark, monkeypatch):
    """F16"""
    met, told = spark.sparkContext.accumulator(0), news._told
    articles = spark.range(3000).select(F.col("id").alias("article_id"), F.lit("acme beta").alias("title"), F.lit(None).cast("string").alias("description")).coalesce(1)
    index = spark.range(100).select(F.lit("acme").alias("key"), F.col("id").alias("vendor_id"))

    def counted(texts, known):
        met.add(known.num_rows)
        return told(texts, known)

    monkeypatch.setattr(news, "_told", counted)
    assert news.match_articles(articles, index).count() == 300_000
    assert met.value == 2  # not 3,000 texts times 100 vendors


def test_terms_are_counted_in_their_tasks(spark):
    """F21"""
    texts = [["a", "b", "a", "b", "c"], [], ["b", "c", "b"], ["z", "z"], ["é", "a"], ["a", "b"], ["é"]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, w array<string>").repartition(2)
    for pairs in (False, True):
        of = [list(map(" ".join, zip(t, t[1:]))) if pairs else t for t in texts]
        total, docs = Counter(x for t in of for x in t), Counter(x for t in of for x in set(t))
        want = [x for x in sorted(total, key=lambda x: (-total[x], x)) if docs[x] > 1]
        assert want and models.frequent_terms(rows, "w", 9, pairs) == want and models.frequent_terms(rows, "w", 1, pairs) == want[:1]
    words, pairs = ["b", "a", "q"], ["b c", "a b", "q q"]
    made = models.Sublinear("w", words, pairs, ["one", "two"]).transform(rows)
    assert made.columns == ["id", "one", "two"] and made.count() == len(texts)
    for r in made.collect():
        t = texts[r["id"]]
        for got, terms, own in ((r["one"], words, t), (r["two"], pairs, list(map(" ".join, zip(t, t[1:]))))):
            assert got.size == 3 and got.toArray().tolist() == pytest.approx([1 + math.log(own.count(x)) if x in own else 0.0 for x in terms])
    assert models.frequent_terms(rows.limit(0), "w", 9) == [] == models.frequent_terms(rows.limit(0), "w", 9, True)


def test_texts_are_parted_once_for_a_fit(spark):
    """every stage of the fit parted all texts again."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    rows = spark.createDataFrame([(i, "eins zwei drei" if i % 2 else "one two three", "de" if i % 2 else "en", 1.0) for i in range(40)], "id long, text string, lang string, weight double").localCheckpoint()
    model = models.text_classifier(rows.withColumn("text", told.asNondeterministic()("text")), "text", "lang")
    assert seen.value == 40
    out = model.transform(rows.union(spark.createDataFrame([(40, "", "en", 1.0)], rows.schema)))
    assert out.count() == 41 and out.filter("id < 40 AND label <> prediction").count() == 0
    alone = models.text_classifier(rows.withColumn("text", F.col("id").cast("string")), "text", "lang")  # no word of two texts
    assert alone.transform(rows).count() == 40


def test_lines_meet_orders_in_parts_of_bounded_size(spark, monkeypatch):
    """F27"""
    folder = "/root/testdata/sf0.001"
    whole = curate.transactions(spark, folder)
    lines, want = whole.count(), whole.agg(F.sum(F.xxhash64(*whole.columns).cast("decimal(38,0)"))).first()
    monkeypatch.setattr(curate, "PART_ROWS", 500, raising=False)
    cut = curate.transactions(spark, folder)
    sizes = [r["count"] for r in cut.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == lines > 5000 and max(sizes) < 1500
    assert cut.agg(F.sum(F.xxhash64(*cut.columns).cast("decimal(38,0)"))).first() == want
