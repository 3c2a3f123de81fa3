"""Steps that stay small when tables grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from procuris.operators import automaton, models, news, shapley

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    found = spark.range(6000).select("id", (F.col("id") % 5).cast("double").alias("a"), (F.col("id") * 7 % 6007).cast("double").alias("b"))
    return found.withColumn("class", F.when(F.col("a") + F.col("b") / 6007 > 3, "high").otherwise("low")).localCheckpoint()


def test_rows_alike_are_fitted_as_few(rows):
    """F7"""
    cut = models.binned(rows, FEATURES)
    assert cut.select("a").distinct().count() == 5 and cut.select("b").distinct().count() == models.BINS
    order = cut.withColumnRenamed("b", "n").join(rows.select("id", "b"), "id").groupBy("n").agg(F.min("b").alias("low"), F.max("b").alias("high")).orderBy("n").collect()
    assert all(x["high"] < y["low"] for x, y in zip(order, order[1:]))
    few = models.condensed(cut, FEATURES, "class", drawn=500)
    assert few.count() < 1500 and few.agg(F.sum("rows")).first()[0] == pytest.approx(6000)
    assert few.rdd.getNumPartitions() >= 2  # not one task's work
    each = models.condensed(cut, FEATURES, "class")
    assert each.count() == 6000 and each.agg(F.max("rows")).first()[0] == 1
    heavy = {r["class"]: r["w"] for r in models.balanced(few, "class", "rows").groupBy("class").agg(F.sum("weight").alias("w")).collect()}
    assert heavy == pytest.approx({"high": 3000.0, "low": 3000.0})
    assert models.condensed(cut.limit(0), FEATURES, "class").count() == 0


def test_boosted_trees_of_alike_rows_tell_as_those_of_all(rows):
    """F8"""
    small = rows.withColumns({"b": F.floor(F.col("b") / 1000).cast("double"), "class": F.when(F.pmod(F.xxhash64("id"), F.lit(9)) == 0, "low").otherwise(F.col("class"))})
    whole = models.classifier("boosted", FEATURES, "class", rounds=2).fit(small)
    few = models.condensed(small, FEATURES, "class", drawn=0)
    assert few.count() < 200
    model = models.classifier("boosted", FEATURES, "class", rounds=2, times="rows").fit(few)
    one, two = models.metrics(whole.transform(small)), models.metrics(model.transform(few), "rows")
    assert one == pytest.approx(two) and one["accuracy"] < 1
    told = models.predictions(model, small.withColumn("a", F.when(F.col("id") > 9, F.col("a"))), FEATURES, "id", "r")
    assert told.count() == 6000 and told.select("id").distinct().count() == 6000


def test_shapley_values_of_a_cell_are_worked_out_once(spark, rows, monkeypatch):
    """F18, F22"""
    model = models.classifier("forest", FEATURES, "class", trees=3).fit(models.balanced(rows, "class")).stages[-1]
    paths = shapley.leaves(model, spark)
    cuts = shapley.all_cuts(paths, 2)
    x = np.array([[c, 1.0] for c in cuts[0]] + [[np.nextafter(c, 9), 1.0] for c in cuts[0]] + [[np.nan, 1.0], [np.inf, np.nan]])
    code = shapley.cells(cuts, x)
    met = [tuple(int(p.patterns(x[i:i + 1])[0]) for p in paths) for i in range(len(x))]
    assert len(set(code)) == len({(int(c), m) for c, m in zip(code, met)})  # one code, one pattern of every path
    assert shapley.cells([np.arange(1000.0)] * 7, np.zeros((2, 7))) is None
    odd = rows.select("id", F.when(F.col("id") != 3, F.col("a")).alias("a"), "b")
    found = [tuple(r) for r in shapley.forest_shapley(model, odd, FEATURES, "id").orderBy("id").collect()]
    monkeypatch.setattr(shapley, "cells", lambda cuts, x: None)
    assert found == [tuple(r) for r in shapley.forest_shapley(model, odd, FEATURES, "id").orderBy("id").collect()] and len(found) == 6000


@pytest.mark.parametrize("letters", [4_000_000, 5])
def test_texts_are_counted_in_their_tasks(spark, letters, monkeypatch):
    """F17, F23"""
    texts = spark.createDataFrame([(1, "Acme and acme"), (2, "acme, beta"), (2, "ACME"), (3, None), (None, "beta acme"), (None, "beta"), (4, "gamma")], "text_id long, text string").repartition(3)
    names = spark.createDataFrame([(1, "Acme"), (2, "beta"), (3, "acme"), (4, "acme"), (4, "gamma"), (5, "delta"), (6, ""), (7, None), (1, "ACME")], "pattern_id long, pattern string")
    pairs = automaton.occurrences(texts, names, letters).groupBy("pattern_id").agg(F.count("*").alias("texts"))
    got = automaton.mentions(texts, names, shard_letters=letters)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect())) == [(1, 3), (2, 2), (3, 3), (4, 4)]
    monkeypatch.setattr(automaton, "occurrences", None)  # no pairs where ids are single
    monkeypatch.setattr(news, "occurrences", None)
    single = texts.filter("text_id <> 2"), names.filter("pattern_id <> 4")
    assert sorted(map(tuple, automaton.mentions(*single, shard_letters=letters).collect())) == [(1, 1), (3, 1)]
    found = news.new_companies(texts.select("text"), spark.createDataFrame([("Betas",)], "supplier_name string"), ["Acme", "beta", "delta"]).collect()
    assert {(r["company"], r["mentions"]) for r in found} == {("Acme", 4), ("beta", 3)}


def test_small_tables_are_fitted_over_all_cores(rows, monkeypatch):
    """F19, F20"""
    one, met = rows.coalesce(1), []
    scaled, times = models.scaled_vectors, []
    monkeypatch.setattr(models, "scaled_vectors", lambda r, f: times.append(r.rdd.getNumPartitions()) or scaled(r, f))
    assert [r["k"] for r in models.best_k(one, FEATURES, range(2, 4)).collect()] == [2, 3]
    assert times == [4]  # scaled once, by as many tasks as there are cores
    monkeypatch.setattr(models, "spread", lambda r, n, spread=models.spread: met.append(n) or spread(r, n))
    models.cross_validated(one, FEATURES, "class", key="id", folds=2, trees=2).collect()
    assert met == [6000] * 4  # train and test of both folds
