"""Results at the edges of rounding, pairs of names in blocks, and models of the whole size."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from procuris.functions.columns import edit_ratio
from procuris.operators import anomaly, blocks, matching, models
from procuris.plans.registry import QUERIES


@pytest.mark.parametrize("z, flagged", [(2.0003, False), (2.0006, True)])
def test_flags_go_by_the_places_shown(spark, z, flagged):
    """2.0003 is shown as 2.0, which is not above 2, but was flagged."""
    small = math.sqrt((20 / z**2 - 2) / 18)  # so that 1 has this z-score
    rows = spark.createDataFrame([(i, s * (small if i % 10 else 1.0)) for i, s in enumerate([1.0] * 10 + [-1.0] * 10)], "vendor_id long, a double")
    found = {r["vendor_id"]: r for r in anomaly.zscores(rows, ["a"], 2.0).collect()}
    assert found[0]["max_zscore"] == round(z, 4) and {v for v, r in found.items() if r["anomaly_zscore_flag"]} == ({0, 10} if flagged else set())


def test_line_model_fits_models_of_the_whole_size(spark, monkeypatch):
    """50 trees and 10 rounds were fitted, where models have 200 of each."""
    asked, first = [], models.classifier

    def small(kind, features, label, trees, rounds, **more):
        asked.append((kind, trees, rounds))
        return first(kind, features, label, 2, 1, **more)

    monkeypatch.setattr(models, "classifier", small)
    assert sum(r["rows"] for r in QUERIES["line_model"](spark, "/root/testdata/sf0.001").collect()) == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert asked == [("forest", 200, 200), ("boosted", 200, 200)]


def test_boosted_trees_of_alike_rows_are_those_of_all(spark):
    """boosted trees are fitted to rows alike as few."""
    rows = spark.range(600).selectExpr("id AS vendor_id", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 5 AS DOUBLE) AS b", "CASE WHEN id % 7 > 4 AND id % 11 > 0 THEN 'x' ELSE 'y' END AS class").localCheckpoint()
    few = models.condensed(rows, ["a", "b"], "class", drawn=0)
    assert few.count() < 150
    one, all_ = (models.classifier("boosted", ["a", "b"], "class", rounds=5, times="rows").fit(df).transform(rows).select("vendor_id", "prediction").collect() for df in (few, rows.selectExpr("*", "1.0D AS rows")))
    assert sorted(one) == sorted(all_)


def test_a_key_that_all_rows_share_is_many_tasks_work(spark, monkeypatch):
    """pairs of a common key were made row by row in few tasks."""
    monkeypatch.setattr(blocks, "BLOCK", 16)
    monkeypatch.setattr(blocks, "AT_ONCE", 20)
    left, right = (spark.range(100).selectExpr("id", "IF(id < 90, 1, id) AS key") for _ in "ab")

    def tell(a, b):
        assert not (a.groupby("_block").size() > 40).any() and a["_block"].is_monotonic_increasing
        return lambda i, j: pd.DataFrame({"x": a["id"].to_numpy()[i], "y": b["id"].to_numpy()[j], "task": a["_task"].to_numpy()[i], "at_once": len(i)})

    got = blocks.met(left, right, tell, "x long, y long, task long, at_once long").collect()
    assert sorted((r["x"], r["y"]) for r in got) == sorted([(x, y) for x in range(90) for y in range(90)] + [(x, x) for x in range(90, 100)])
    assert len({r["task"] for r in got if r["x"] < 90}) > 8 and max(r["at_once"] for r in got) <= 40
    assert blocks.met(left, right.limit(0), tell, "x long, y long, task long, at_once long").count() == 0


@pytest.mark.parametrize("most", [0, 3, 100])
def test_edits_are_those_of_the_table(most, monkeypatch):
    monkeypatch.setattr(blocks, "CELLS", 5000)
    r = random.Random(3)
    names = ["".join(r.choice("abcé\U0001f600 1") for _ in range(r.randint(0, 9))) for _ in range(60)] + ["x" * 300, "x" * 290 + "y" * 5, "a" * 40, ""]

    def plain(a, b):
        last = list(range(len(b) + 1))
        for n, x in enumerate(a, 1):
            now = [n]
            for k, y in enumerate(b, 1):
                now.append(min(last[k] + 1, now[-1] + 1, last[k - 1] + (x != y)))
            last = now
        return last[-1]

    x, i, j = blocks.Letters(pd.Series(names)), *(m.ravel() for m in np.meshgrid(np.arange(64), np.arange(64)))
    want = np.array([plain(names[a], names[b]) for a, b in zip(i, j)])
    got = blocks.edits(x, x, x.place[i], x.place[j], np.full(len(i), most))
    assert (got[want <= most] == want[want <= most]).all() and (got[want > most] > most).all()
    assert (blocks.lacking(x, x, x.place[i], x.place[j]) <= want).all()


def test_duplicates_in_small_blocks_are_those_of_all_pairs(spark, monkeypatch):
    """F1"""
    monkeypatch.setattr(blocks, "BLOCK", 8)
    monkeypatch.setattr(blocks, "AT_ONCE", 50)
    r = random.Random(4)
    names = spark.createDataFrame([(i, f"brand#{r.randint(1, 3)} {r.choice(['large', 'old', 'lárge'])} {r.choice(['ring', 'rod'])} {r.randint(1, 30)}") for i in range(150)], "id long, name string")
    a, b = names.selectExpr("id AS a", "name AS an"), names.selectExpr("id AS b", "name AS bn")
    all_ = a.join(b, F.col("a") < F.col("b")).withColumn("s", F.round(edit_ratio("an", "bn"), 2)).filter("s >= 85").collect()
    first = {}
    for i, n in sorted(names.collect()):
        first.setdefault(n, i)
    want = {(r["a"], r["b"], r["s"]) for r in all_ if first[r["an"]] == r["a"] and (first[r["bn"]] == r["b"] or r["an"] == r["bn"])}
    got = [tuple(x) for x in matching.duplicate_pairs(names).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


@pytest.mark.parametrize("block, at_once", [(2048, 1 << 18), (4, 9)])
def test_best_names_of_a_common_word_are_those_of_all_pairs(spark, monkeypatch, block, at_once):
    """All pairs of names of a common word were scored row by row, in one task for a word."""
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(blocks, "AT_ONCE", at_once)
    left = spark.createDataFrame([(i, f"Supplier#{i:09d} nation_{i % 2}") for i in range(120)] + [(900, None), (901, ""), (902, "nation_1")], "id long, name string")
    right = spark.createDataFrame([(i, f"trader-{i}" if i % 3 == 0 else f"Supplier#{i:05d} nation_{i % 2}") for i in range(120)] + [(901, ""), (902, "nation_1 nation_1"), (903, None)], "id long, name string")
    got = {(r["left_id"], r["right_id"], r["score"]) for r in matching.fuzzy_match(left, right, 50.0).collect()}
    pairs = left.select(F.col("id").alias("l"), F.lower("name").alias("ln")).crossJoin(right.select(F.col("id").alias("r"), F.lower("name").alias("rn")))
    best = {}
    for r in pairs.withColumn("score", matching.score("ln", "rn")).filter("score >= 50 AND ln <> '' AND rn <> ''").collect():
        best[r["l"]] = min(best.get(r["l"], (0, 0)), (-r["score"], r["r"]))
    assert len(best) > 100 and got == {(i, j, -s) for i, (s, j) in best.items()}
    summary = matching.match_summary(left, right, matching.fuzzy_match(left, right, 50.0)).first()
    assert (summary["left_names"], summary["matched"], summary["right_matched"]) == (123, len(best), len({j for _, j in best.values()}))


def test_edits_are_counted_of_few_pairs_of_a_common_word(spark, monkeypatch):
    """F2, F3"""
    counted, first = spark.sparkContext.accumulator(0), blocks.edits

    def count(x, y, i, j, most):
        counted.add(len(i))
        return first(x, y, i, j, most)

    monkeypatch.setattr(matching, "edits", count)
    r = random.Random(6)
    names = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(300)]
    left, right = (spark.createDataFrame([(i, f"{n[:6]}{x}{n[7:]} germany") for i, n in enumerate(names)], "id long, name string") for x in "xy")
    assert {(x["left_id"], x["right_id"]) for x in matching.fuzzy_match(left, right, 50.0).collect()} == {(i, i) for i in range(300)}
    assert 0 < counted.value < 9000  # of 90,000 pairs
