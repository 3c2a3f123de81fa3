"""Forest Shapley values, name automata, exact quantiles, orders with ties, set-similarity joins against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from procuris.functions.columns import edit_ratio
from procuris.operators import automaton, matching, news, quantiles, relational, served, setjoin, shapley

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def figures(spark):
    r = np.random.default_rng(5)
    rows = [(int(i), *(round(float(x), 2) for x in r.normal(size=4))) for i in range(300)]
    rows = [(*x, float(x[1] > 0) + float(x[2] * x[3] > 0.2), float(x[1] + x[4] > 0)) for x in rows]
    return spark.createDataFrame(rows, "vendor_id long, a double, b double, c double, d double, label double, two double")


def brute(paths, x, index):
    """Shapley values by all sets of features, and the forest's values for none and all of them."""
    def value(known):
        return sum(p.value[index] * math.prod((1.0 if lo < x[f] <= hi else 0.0) if f in known else s for f, lo, hi, s in zip(p.features, p.low, p.high, p.share)) for p in paths)

    n = len(x)
    out = []
    for i in range(n):
        others = [j for j in range(n) if j != i]
        out.append(sum(math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n) * (value({*s, i}) - value(set(s))) for k in range(n) for s in itertools.combinations(others, k)))
    return out, value(set()), value(set(range(n)))


@pytest.mark.parametrize("kind, tabled", [("forest", 8), ("forest", 1), ("boosted", 8), ("regression", 8)])
def test_forest_shapley_is_brute_force(spark, figures, monkeypatch, kind, tabled):
    monkeypatch.setattr(shapley, "TABLED", tabled)
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(figures)
    made = {"forest": RandomForestClassifier(numTrees=5, maxDepth=4, seed=1), "boosted": GBTClassifier(maxIter=4, maxDepth=3, labelCol="two"), "regression": RandomForestRegressor(numTrees=4, maxDepth=3, seed=2)}[kind]
    model = made.fit(data)
    got = shapley.forest_shapley(model, figures.repartition(3), FEATURES)
    want = {r["vendor_id"]: r for r in model.transform(data).collect()}
    paths = shapley.leaves(model, spark)
    for r in got.collect():
        assert abs(sum(r["contributions"]) + r["expected"] - r["prediction"]) < 1e-9
        row = want[r["vendor_id"]]
        told = {"forest": lambda: row["probability"][r["class_index"]], "boosted": lambda: row["rawPrediction"][1] / 1, "regression": lambda: row["prediction"]}[kind]()
        assert abs(r["prediction"] - told) < 1e-9
        if kind == "forest":
            assert r["class_index"] == row["prediction"]
        if r["vendor_id"] < 15:
            values, mean, whole = brute(paths, [row[f] for f in FEATURES], r["class_index"])
            assert np.allclose(values, r["contributions"]) and abs(mean - r["expected"]) < 1e-9 and abs(whole - r["prediction"]) < 1e-9
    long = shapley.contributions_long(got, FEATURES).filter("vendor_id = 3").orderBy("driver").collect()
    assert [r["driver"] for r in long] == [1, 2, 3, 4] and [abs(r["contribution"]) for r in long] == sorted((abs(r["contribution"]) for r in long), reverse=True)


def test_shapley_of_missing_values_and_no_rows(spark, figures):
    model = RandomForestClassifier(numTrees=3, maxDepth=3, seed=1).fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(figures))
    odd = spark.createDataFrame([(1, None, 0.5, None, 1.0), (1, None, 0.5, None, 1.0)], "vendor_id long, a double, b double, c double, d double")
    for r in shapley.forest_shapley(model, odd, FEATURES, of=1).collect():
        assert r["class_index"] == 1 and abs(sum(r["contributions"]) + r["expected"] - r["prediction"]) < 1e-9
    assert shapley.forest_shapley(model, odd.limit(0), FEATURES).count() == 0


@pytest.mark.parametrize("letters", [4_000_000, 60])
def test_occurrences_are_all(spark, letters):
    r = random.Random(2)
    bits = ["Ab", "ba", "É", "x", " ", "abab", "ΣΑΣ", "\U0001f600"]
    texts = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 30)))) for i in range(120)] + [(500, None), (501, ""), (None, "abab"), (7, "abab x")]
    names = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 4)))) for i in range(80)] + [(90, None), (91, ""), (3, "x"), (4, "x"), (4, "X")]
    df = spark.createDataFrame(texts, "text_id long, text string").repartition(3)
    got = automaton.occurrences(df, spark.createDataFrame(names, "pattern_id long, pattern string"), letters)
    low = {t: spark.range(1).select(F.lower(F.lit(t))).first()[0] for t in {*(t for _, t in texts if t), *(n for _, n in names if n)}}
    want = {(i, j) for i, t in texts for j, n in names if t and n and low[n] in low[t]}
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert automaton.occurrences(df, spark.createDataFrame([], "pattern_id long, pattern string")).count() == 0


@pytest.mark.parametrize("few", [20_000, 5])
def test_quantiles_are_exact(spark, few):
    r = np.random.default_rng(8)
    rows = [(float(x), 7.0 if i % 10 else float(i), None, None if i % 3 else float(x * 1e9), int(i)) for i, x in enumerate(r.normal(size=2000).tolist())]
    df = spark.createDataFrame(rows, "x double, tied double, none double, holes double, n long").repartition(4)
    asked = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0]
    got = quantiles.exact_quantiles(df, dict.fromkeys(df.columns, asked), few)
    want = df.agg(*(F.percentile(c, asked).alias(c) for c in df.columns)).first()
    for c in df.columns:
        assert got[c] == (want[c] if want[c] is not None else [None] * len(asked))
    assert quantiles.exact_quantiles(df.limit(0), {"x": [0.5]}) == {"x": [None]}
    one = quantiles.with_quantiles(df, m=("x", 0.5), n=("x", 0.9)).first()
    assert one["m"] == want["x"][3] and one["n"] == rows[0][4] or one["n"] in [x[4] for x in rows]


def names_of(n, seed):
    r = random.Random(seed)
    words = ["acme", "global", "steel", "trade", "north", "delta", "omega", "parts", "labs", "works"]
    return [(i, " ".join(["germany"] * (i % 2) + r.sample(words, r.randint(1, 4))) + r.choice(["", "x", f" {i}"])) for i in range(n)]


@pytest.mark.parametrize("least, contained", [(0.75, 0.55), (0.4, 0.2), (0.1667, -0.03)])
def test_set_pairs_miss_none(spark, least, contained):
    left, right = (spark.createDataFrame(names_of(90, s) + [(200, ""), (201, None)], "id long, norm string") for s in (1, 2))
    got = [tuple(r) for r in setjoin.set_pairs(left, right, least, contained).select("left_id", "right_id", "left_norm", "right_norm").collect()]
    assert len(got) == len(set(got))
    found, shared = {(a, b) for a, b, *_ in got}, 0
    for i, x in names_of(90, 1):
        for j, y in names_of(90, 2):
            a, b = set(x.split()), set(y.split())
            shared += bool(a & b)
            likeness = len(a & b) / len(a | b)
            if a & b and (likeness >= least or ((a <= b or b <= a) and min(len(a), len(b)) / max(len(a), len(b)) >= contained)):
                assert (i, j) in found
    assert len(found) < shared and (least < 0.5 or len(found) < shared / 10)  # half of the names hold one common word


@pytest.mark.parametrize("threshold", [45.0, 60.0, 85.0])
def test_fuzzy_match_is_the_nested_loop(spark, threshold):
    left, right = (spark.createDataFrame(names_of(60, s), "id long, name string") for s in (3, 4))
    got = {(r["left_id"], r["right_id"], r["score"]) for r in matching.fuzzy_match(left, right, threshold).collect()}
    pairs = left.select(F.col("id").alias("l"), F.col("name").alias("ln")).crossJoin(right.select(F.col("id").alias("r"), F.col("name").alias("rn")))
    best = {}
    for r in pairs.withColumns({"ln": matching.normal_name("ln"), "rn": matching.normal_name("rn")}).withColumn("score", matching.score("ln", "rn")).filter(F.col("score") >= threshold).collect():
        best[r["l"]] = min(best.get(r["l"], (0, 0)), (-r["score"], r["r"]))
    assert got == {(i, j, -s) for i, (s, j) in best.items()}
    with pytest.raises(ValueError):
        matching.fuzzy_match(left, right, 40)


def test_near_names(spark):
    left, right = (spark.createDataFrame(names_of(50, s) + [(99, None), (98, ""), (97, "Acme Steel"), (97, "Acme Steel")], "id long, name string") for s in (5, 6))
    got = {(r["left_id"], r["right_id"], r["similarity"]) for r in matching.near_names(left, right, 80).collect()}
    pairs = left.select(F.col("id").alias("l"), F.lower("name").alias("a")).crossJoin(right.select(F.col("id").alias("r"), F.lower("name").alias("b"))).filter("a <> '' AND b <> ''")
    want = {(r["l"], r["r"], r["s"]) for r in pairs.withColumn("s", F.round(edit_ratio("a", "b"), 2)).filter("s >= 80").collect()}
    assert got == want and (97, 97, 100.0) in got


def test_names_either_way(spark):
    texts = spark.createDataFrame([(1, "all about acme ltd"), (2, "acm"), (3, ""), (4, None), (5, "Acme"), (5, "Acme")], "text_id long, text string")
    names = spark.createDataFrame([(10, "ACME"), (11, "acme ltd"), (12, ""), (13, None)], "name_id long, name string")
    got = sorted((r["text_id"], r["name_id"]) for r in news.contains_pairs(texts, names).collect())
    assert got == [(1, 10), (1, 11), (1, 12), (2, 10), (2, 11), (2, 12), (3, 10), (3, 11), (3, 12), (5, 10), (5, 11), (5, 12)]
    people = spark.createDataFrame([(3, "Acme Steel"), (1, "acme works"), (2, "Delta"), (4, None)], "id long, name string")
    asked = spark.createDataFrame([("q", "ACME"), ("r", "none"), ("s", ""), ("t", None)], "question string, part string")
    assert sorted((r["question"], r["id"]) for r in served.find_names(people, asked).collect()) == [("q", 1), ("s", 1)]
    found = news.new_companies(texts.select("text"), spark.createDataFrame([("Acme Ltda",)], "supplier_name string"), ["Acme Ltd", "about", "gone"]).collect()
    assert [(r["company"], r["mentions"]) for r in found] == [("about", 1)]


def test_running_parts_ties(spark):
    r = np.random.default_rng(3)
    rows = [(i, 5.0 if i % 10 else float(r.integers(100)), int(r.integers(50))) for i in range(4000)] + [(i, None, 1) for i in range(4000, 5000)]
    df = spark.createDataFrame(rows, "id long, v double, m long").repartition(4)
    got = relational.running(df, "v", "id", F.col("m"), ranges=8)
    assert got.columns == ["id", "v", "m", "row_rank", "running"]
    have = {x["id"]: (x["row_rank"], x["running"]) for x in got.collect()}
    total = 0
    for n, (i, _, m) in enumerate(sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0])), 1):
        total += m
        assert have[i] == (n, total)
    sizes = [x["count"] for x in df.repartitionByRange(8, F.desc_nulls_last("v"), F.asc_nulls_first("id")).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * len(rows) / 8


def test_grouped_quantiles(spark):
    rows = [("a" if i % 3 else None, float(i * i % 101)) for i in range(200)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {r["g"]: (r["lo"], r["hi"]) for r in df.groupBy("g").agg(F.percentile("v", 0.25).alias("lo"), F.percentile("v", 0.9).alias("hi")).collect()}
    assert {r["g"]: (r["lo"], r["hi"]) for r in quantiles.grouped_quantiles(df, "g", "v", {"lo": 0.25, "hi": 0.9}).collect()} == want
    assert not math.isnan(want["a"][0])


def test_panes_over_deliveries_are_the_batch_windows(spark, tmp_path):
    from datetime import datetime, timedelta

    from procuris.streaming import feeds

    r = np.random.default_rng(4)
    begin = datetime(2024, 1, 1)
    rows = [(begin + timedelta(hours=float(h)), int(v), bool(f), str(i)) for i, (h, v, f) in enumerate(zip(np.sort(r.uniform(0, 24 * 20, 400)), r.integers(0, 4, 400), r.integers(0, 2, 400)))]
    kind = "ts timestamp, vendor_id long, disruption_flag boolean, url string"
    like, folder = spark.createDataFrame([], kind), str(tmp_path)
    for part in (rows[:150], rows[150:300], rows[300:]):
        spark.createDataFrame(part, kind).write.mode("append").parquet(f"{folder}/in")
        feed = feeds.as_stream(spark, f"{folder}/in", "*.parquet", like, None)
        got = feeds.kept(feeds.rolling_panes(feed, days=3), folder, ["window_end", "vendor_id"], ["articles"])
    want = {}
    for ts, v, f, _ in rows:
        for k in range(1, 4):
            own = want.setdefault((datetime(ts.year, ts.month, ts.day) + timedelta(days=k), v), [0, 0])
            own[0] += 1
            own[1] += f
    assert {(x["window_end"], x["vendor_id"]): [x["articles"], x["disruptions"]] for x in got.collect()} == want


def test_late_rows_are_accounted_and_a_batch_that_runs_twice_counts_once(spark, tmp_path):
    from datetime import datetime

    from procuris.streaming import feeds

    kind, folder = "ts timestamp, vendor_id long", str(tmp_path)
    days = [[(datetime(2024, 1, d), 1) for d in part] for part in ([1, 2, 9], [3, 8, 9, 10], [1, 9, 12])]
    for part in days:
        spark.createDataFrame(part, kind).write.mode("append").parquet(f"{folder}/in")
        feed = feeds.as_stream(spark, f"{folder}/in", "*.parquet", spark.createDataFrame([], kind), None)
        got = feeds.late_account(feed, folder, "2 days")
    got = feeds.late_account(feed, folder, "2 days")  # nothing new
    assert [(r["batch"], r["rows"], r["late_rows"]) for r in got.orderBy("batch").collect()] == [(0, 3, 0), (1, 4, 1), (2, 3, 1)]


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    import os

    from procuris.sources import store

    path, kind = str(tmp_path / "s"), "id long, v string, at long"
    rows = spark.createDataFrame([(i, f"v{i}", 0) for i in range(400)], kind)
    assert store.stored(spark, path, kind).count() == 0
    assert len(store.upsert(path, rows, ["id"], 0, buckets=8)) == 8
    one = store.manifest(spark, path)
    change = spark.createDataFrame([(7, "new", 1), (1000, "more", 1), (7, "old", 0)], kind)
    order = [F.desc("at")]
    touched = store.upsert(path, change, ["id"], 1, order)
    two = store.manifest(spark, path)
    assert 1 <= len(touched) <= 2 and {b for b in two if two[b] != one[b]} == set(touched)
    assert {n for n in os.listdir(f"{path}/data/v1") if n.startswith("_bucket")} == {f"_bucket={b}" for b in touched}
    want = {i: f"v{i}" for i in range(400)} | {7: "new", 1000: "more"}
    have = lambda: {r["id"]: r["v"] for r in store.stored(spark, path, kind).collect()}
    assert have() == want
    store.upsert(path, change, ["id"], 1, order)  # the batch runs again
    assert have() == want and store.versions(spark, path) == [0, 1]
    store.update(path, spark.createDataFrame([(9, None), (5000, "none")], "id long, v string"), ["id"], ["v"], kind, 2)
    assert have() == want | {9: None}
    assert store.upsert(path, change.limit(0), ["id"], 3) == [] and have() == want | {9: None}


def test_logged_write_counts_on_the_way(spark, tmp_path):
    from procuris.sources import io

    rows, log = spark.range(50).select("id", (F.col("id") * 2).alias("x")), str(tmp_path / "log")
    assert io.logged_write(rows, str(tmp_path / "a"), log, "r1", total=F.sum("x")) == {"rows": 50, "total": 2450.0}
    io.logged_write(rows.limit(0), str(tmp_path / "b"), log, "r2", total=F.sum("x"))
    got = {r["run_id"]: (r["counts"]["rows"], r["figures"]["total"], r["state"]) for r in spark.read.parquet(log).collect()}
    assert got == {"r1": (50, 2450.0, "ready"), "r2": (0, None, "incomplete")}


def test_vector_index(spark):
    from procuris.operators import retrieve, vectorindex

    r = np.random.default_rng(7)
    rows = [(i, r.normal(size=8).tolist()) for i in range(400)] + [(i, None) for i in (500, 501)] + [(502, [0.0] * 8), (503, [float("nan")] * 8), (504, [1.0, 2.0]), (505, [2.0, 4.0]), (506, [1.0, None])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = vectors.filter("vec_id % 40 = 0 OR vec_id IN (500, 502, 504)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    index = vectorindex.build(vectors, cells=16, sample=200)
    assert index.rows.count() == 402 and len(index.cells) == 16
    exact = {(x["query_id"], x["vec_id"], x["rank"]) for x in retrieve.top_k(vectors.filter("vec_id <= 502 OR vec_id IN (504, 505)").select("vec_id", F.col("embedding").alias("v")), queries, 5).collect()}
    assert {(x["query_id"], x["vec_id"], x["rank"]) for x in vectorindex.search(index, queries, 5, 16).collect()} == exact
    some = vectorindex.search(index, queries, 5, 10)
    got = vectorindex.recall(some, vectorindex.search(index, queries, 5, 16)).first()
    assert got["recall"] >= 0.8 and got["queries"] == 11
    named = vectorindex.with_texts(some, spark.createDataFrame([(505, "a text")], "vec_id long, text string")).filter("query_id = 504 AND vec_id = 505").first()
    assert named["text"] == "a text"
    assert vectorindex.search(vectorindex.build(vectors.limit(0)), queries, 5, 3).count() == 0


def test_entry_without_what_the_text_operators_need(monkeypatch):
    import sys

    import __spark_entry__ as entry

    pytest.importorskip("procuris.llm.queries")
    whole = set(entry.queries())
    for name in [m for m in sys.modules if m.startswith("procuris.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    import procuris

    monkeypatch.delattr(procuris, "llm", raising=False)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    left = set(entry.queries())
    assert left < whole and not any(n.startswith("op") and n[2].isdigit() for n in left) and "pipeline" not in left
    assert set(entry.oracle_sql()) <= left


def test_models_measures(spark, figures):
    from pyspark.ml.linalg import Vectors

    from procuris.operators import models

    rows = figures.drop("label").withColumn("class", F.when(F.col("two") > 0, "High").otherwise("Low"))
    got = models.cross_validated(rows, FEATURES, "class", folds=3, kinds=("forest", "boosted"), trees=4, rounds=2).collect()
    assert sorted((r["model"], r["fold"]) for r in got) == [(k, n) for k in ("boosted", "forest") for n in range(3)]
    assert all(0.6 < r["accuracy"] <= 1 and 0.6 < r["f1"] <= 1 for r in got)
    damped = models.Sublinear("v", "w").transform(spark.createDataFrame([(Vectors.sparse(5, [1, 4], [1.0, 3.0]),), (Vectors.sparse(5, [], []),)], ["v"])).collect()
    assert damped[0]["w"].toArray().tolist() == [0, 1, 0, 0, 1 + math.log(3)] and damped[1]["w"].numNonzeros() == 0
    told = spark.createDataFrame([("a", 0.9), ("a", 0.5), ("b", 0.5), ("b", 0.1), ("a", 0.2)], "label string, s double")
    auc = {r["label"]: (r["auc"], r["positives"]) for r in models.rank_auc(told, "label", {"a": "s", "c": "s"}).collect()}
    assert auc == {"a": ((2 + 1.5 + 1) / 6, 3), "c": (None, 0)}


@pytest.mark.parametrize("parts", [None, 7])
def test_pack_in_order(spark, parts):
    from procuris.operators import retrieve

    r = random.Random(1)
    rows = [(["x", "y", None][i % 3], i, "t" * r.choice([0, 3, 9])) for i in range(300)] + [("z", 1, None), ("z", 2, "abcd")]
    df = spark.createDataFrame(rows, "query_id string, doc_id long, text string")
    got = {(x["query_id"], x["doc_id"], x["cost"]) for x in retrieve.pack_in_order(df.repartition(parts) if parts else df, 40).collect()}
    want, cost = set(), {}
    for q, i, t in sorted(rows, key=lambda x: x[1]):
        cost[q] = cost.get(q, 0) + len(t or "") * 0.25
        if cost[q] <= 40 and not (q == "z" and i == 1):
            want.add((q, i, cost[q]))
    assert {x for x in got if x[:2] != ("z", 1)} == want


def test_compared_vendors(spark):
    from procuris.operators import cards

    rows = spark.createDataFrame([(1, "One", 0.5, 10.0), (2, "Two", 0.4, None), (3, "Three", 0.4, 7.0)], "vendor_id long, supplier_name string, composite_risk_score double, total_spend double")
    got = cards.compared(rows, spark.createDataFrame([(1, 2), (2, 3), (1, 9)], "a_id long, b_id long"), {"composite_risk_score": "Risk", "total_spend": "Spend"})
    assert sorted(tuple(x) for x in got.collect()) == [(1, 2, "Risk", 0.5, 0.4, "Two"), (1, 2, "Spend", 10.0, None, "Two"), (2, 3, "Risk", 0.4, 0.4, "Three"), (2, 3, "Spend", None, 7.0, "Three")]
