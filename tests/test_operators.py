"""Small tables with results worked out by hand."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from procuris.functions import columns as X
from procuris.operators import anomaly, explain, features, matching, news, quality, relational, spend, taxonomy
from procuris.sources import curate, io


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [(" 000123 ", "123"), ("123", "123"), ("0000", "")])
def test_normal_id(spark, raw, want):
    assert one(spark, X.normal_id(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("Acme Corp.", "acme"), ("Sanofi SA", "sanofi"), ("Foo Holdings Ltd", "foo"), (" A  B ", "a b")])
def test_normal_name(spark, raw, want):
    assert one(spark, X.normal_name(F.lit(raw))) == want


def test_sentiment_and_categories(spark):
    assert one(spark, X.sentiment(F.lit("Growth, growth and delay; strike"))) == -0.333
    assert one(spark, X.sentiment(F.lit("nothing"))) == 0.0
    assert one(spark, X.sentiment(F.lit(None).cast("string"))) == 0.0
    assert one(spark, X.first_category(F.lit("A shortage after a strike"))) == "shortage"
    assert one(spark, X.first_category(F.lit("bank"))) == "regulatory"
    assert one(spark, X.first_category(F.lit("bank"), whole_words=True)) is None


@pytest.mark.parametrize("value, want", [(0.25, "Low"), (0.2501, "Medium"), (0.45, "Medium"), (0.46, "High"), (None, None)])
def test_bins_are_closed_on_the_right(spark, value, want):
    assert one(spark, X.binned(F.lit(value).cast("double"), [0.25, 0.45], ["Low", "Medium", "High"])) == want


def test_country_risk(spark):
    assert one(spark, X.country_risk(F.lit(" ru "))) == 0.95
    assert one(spark, X.country_risk(F.lit("XX"))) == 0.45


def test_running_is_exact_with_ties(spark):
    rows = spark.createDataFrame([(i, float(i % 7)) for i in range(200)], "id long, v double")
    got = {r["id"]: (r["row_rank"], float(r["running"])) for r in relational.running(rows, "v", "id", ranges=8).collect()}
    total = 0.0
    for rank, (i, v) in enumerate(sorted(((i, float(i % 7)) for i in range(200)), key=lambda x: (-x[1], x[0])), 1):
        total += v
        assert got[i] == (rank, total)


def test_abc_edges(spark):
    rows = spark.createDataFrame([(1, 70.0), (2, 20.0), (3, 10.0)], "vendor_id long, total_spend double")
    assert values(spend.abc(rows), "vendor_id", "abc_class") == [(1, "A"), (2, "B"), (3, "C")]
    whale = spark.createDataFrame([(1, 80.0), (2, 20.0)], "vendor_id long, total_spend double")
    assert values(spend.abc(whale), "vendor_id", "abc_class") == [(1, "B"), (2, "C")]


def test_update_upsert_insert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    assert values(relational.update_from(old, new, "k", ["v"]).fillna("-"), "k", "v") == [(1, "a"), (2, "-")]
    once = relational.upsert(old, new, "k")
    assert values(once.fillna("-"), "k", "v") == [(1, "a"), (2, "-"), (3, "c")]
    assert values(relational.upsert(once, new, "k").fillna("-"), "k", "v") == values(once.fillna("-"), "k", "v")
    assert values(relational.insert_ignore(old, new.union(new), ["k"], [F.asc("v")]), "k", "v") == [(1, "a"), (2, "b"), (3, "c")]


def test_contract_bands(spark):
    as_of = F.lit("2024-01-01").cast("date")
    days = [0, 30, 31, 60, 61, 90, 91, -1, None]
    rows = spark.createDataFrame([(n, dt.date(2024, 1, 1) + dt.timedelta(days=n) if n is not None else None) for n in days], "n int, e date")
    got = {r["n"]: r["s"] for r in rows.select("n", curate.contract_status("e", as_of).alias("s")).collect()}
    assert [got[n] for n in days] == ["Expires <30d"] * 2 + ["Expires <60d"] * 2 + ["Expires <90d"] * 2 + ["Active", "Expired", "Expired"]


def test_deliveries_outer(spark):
    promised = spark.createDataFrame([("1", dt.date(2024, 1, 1), 10.0), ("2", dt.date(2024, 1, 1), 5.0)], "k string, promised_date date, promised_qty double")
    actual = spark.createDataFrame([("1", dt.date(2024, 1, 3), 9.9), ("3", dt.date(2024, 1, 1), 1.0)], "k string, actual_date date, actual_qty double")
    got = values(curate.delivery_rows(promised, actual, ["k"]), "k", "delay_days", "on_time", "in_full", "otif")
    assert got == [("1", 2, 0, 1, 0), ("2", 0, 1, 0, 0), ("3", 0, 1, 1, 1)]


def test_raw_extracts(spark):
    lfa1 = spark.createDataFrame([("000123", "Acme", "DE", "Bonn", "A", None), ("123", "Acme 2", "DE", "Bonn", "A", None), ("7", "X", "US", "", "B", None), ("8", "Gone", "US", "", "B", "X"), ("nan", "Nope", "US", "", "B", None)],
                                 "LIFNR string, NAME1 string, LAND1 string, ORT01 string, BRSCH string, LOEVM string")
    vendors = curate.build_vendors(lfa1, {"A": ("Autos", "Automotive")})
    assert values(vendors, "vendor_id", "supplier_name", "industry", "geo_risk") == [("123", "Acme", "Autos", "Low")]
    ekko = spark.createDataFrame([("E1", "0123", "20240105", "F", "1", "O", "EUR", None, None), ("E2", "123", "20240105", "K", "1", "O", "EUR", "20240101", "20240201")],
                                 "EBELN string, LIFNR string, BEDAT string, BSTYP string, BUKRS string, EKORG string, WAERS string, KDATB string, KDATE string")
    ekpo = spark.createDataFrame([("E1", "1", "M", "G", "2", "3.5", None), ("E1", "2", "M", "G", "2", "0", None), ("E9", "1", "M", "G", "2", "3", None)], "EBELN string, EBELP string, MATNR string, MATKL string, MENGE string, NETPR string, NETWR string")
    assert values(curate.build_transactions(ekko, ekpo, vendors), "po_number", "po_line", "transaction_amount", "year_quarter", "supplier_name") == [("E1", "1", 7.0, "2024-Q1", "Acme")]
    assert values(curate.build_contracts(ekko, F.lit("2024-01-15").cast("date")), "contract_number", "contract_status") == [("E2", "Expires <30d")]


def test_quality(spark):
    rows = spark.createDataFrame([("1", "5", "a"), ("2", "x", None), ("3", "-1", "b")], "`Order No` string, QTY string, flag string")
    plain = quality.standardize(rows, {"order_no": ["Order No"], "quantity": ["qty"], "flag": [], "lost": ["nope"]}, ("order_no",))
    assert plain.columns == ["order_no", "quantity", "flag", "lost"]
    typed = quality.coerce(plain, {"quantity": "int"})
    assert values(typed.filter("size(_failed) > 0"), "order_no") == [("2",)]
    checked = quality.validate(typed, {"quantity": (0, None)}, ["quantity", "flag"])
    assert values(checked, "order_no", "row_status") == [("1", "ok"), ("2", "null_found"), ("3", "error")]
    with pytest.raises(ValueError):
        quality.standardize(rows, {"gone": []}, ("gone",))


def test_articles_meet_vendors(spark):
    index = news.alias_index(spark.createDataFrame([(1, "Siemens AG"), (2, "Global Foods Limited")], "vendor_id long, supplier_name string"))
    assert ("siemens", 1) in values(index, "key", "vendor_id")
    articles = spark.createDataFrame([(1, "SIEMENS, again", None), (2, "siemensstadt", "Global foods limited grows"), (3, "none", "")], "article_id long, title string, description string")
    assert values(news.match_articles(articles, index), "article_id", "vendor_id") == [(1, 1), (2, 2)]


def test_matching(spark):
    left = spark.createDataFrame([(1, "Acme Metal Ltd"), (2, "Nothing Alike")], "id long, name string")
    right = spark.createDataFrame([(10, "ACME metal gmbh"), (11, "Acme Metals")], "id long, name string")
    got = matching.fuzzy_match(left, right)
    assert values(got, "left_id", "right_id", "confidence") == [(1, 10, "Exact")]
    assert values(matching.unmatched(left, got), "id") == [(2,)]
    names = spark.createDataFrame([(1, "acme metal works"), (2, "acme metal work"), (3, "acme metl work"), (4, "other")], "id long, name string")
    groups = matching.groups(matching.duplicate_pairs(names, 90.0), names)
    assert values(groups, "id", "master") == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_scaling_and_z(spark):
    rows = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, None, 5.0)], "vendor_id long, a double, b double")
    assert values(features.scaled(rows, ["a", "b"]), "vendor_id", "a_scaled", "b_scaled") == [(1, 0.0, 0.5), (2, 1.0, 0.5), (3, 0.5, 0.5)]
    z = anomaly.zscores(rows, ["a", "b"])
    assert values(z, "vendor_id", "zscore_feature") == [(1, "a"), (2, "a"), (3, "a")]


def test_isolation_forest_finds_the_outlier(spark):
    rows = spark.createDataFrame([(i, float(i % 10), float(i % 7)) for i in range(200)] + [(999, 500.0, -400.0)], "vendor_id long, a double, b double")
    got = anomaly.isolation_forest(rows, ["a", "b"], trees=30, contamination=0.02)
    assert got.orderBy(F.desc("anomaly_score")).first()["vendor_id"] == 999


def test_extract_encodings(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes(" lifnr ,Name1\n1,Müller\n".encode("latin-1"))
    rows = io.read_extract(spark, str(tmp_path / "latin.csv"))
    assert rows.columns == ["LIFNR", "NAME1"] and rows.first()["NAME1"] == "Müller"
    assert io.read_extract(spark, str(tmp_path / "none.csv")) is None


@pytest.mark.parametrize("group, want", [(None, "Unclassified"), ("  ", "Unclassified"), ("CONS", "72"), ("it", "43"), ("0ELEC", "43"), ("0001", "Unclassified"), ("XYZ", "Unclassified")])
def test_taxonomy_lookup(spark, group, want):
    rows = spark.createDataFrame([(group, None)], "material_group string, description string")
    assert taxonomy.classify(rows, {"31": ["steel"]}).first()["segment"] == want


def test_sampled_shapley_adds_up(spark):
    rows = spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(30)], "vendor_id long, a double, b double")
    got = explain.sampled_shapley(rows, "vendor_id", ["a", "b"], lambda df: df.withColumn("prediction", 2 * F.col("a") + F.col("b")), permutations=4)
    assert got.count() == 60
    weights = explain.local_surrogate(rows, "vendor_id", ["a", "b"], lambda df: df.withColumn("prediction", 2 * F.col("a") + F.col("b")), samples=50)
    means = {r["feature"]: r["m"] for r in weights.groupBy("feature").agg(F.avg("weight").alias("m")).collect()}
    assert means["a"] > means["b"] > 0


def test_late_rows_are_dropped(spark, tmp_path):
    """Behind the watermark a row no longer counts; in front of it, it does."""
    from procuris.streaming import feeds

    def rows(*days):
        return spark.createDataFrame([(f"2024-01-{d:02d} 10:00:00", 1, True, str(d)) for d in days], "t string, vendor_id long, disruption_flag boolean, url string").selectExpr("CAST(t AS timestamp) AS ts", "vendor_id", "disruption_flag", "url")

    for days in ((1, 2), (20, 21), (22,), (3, 20)):  # the third of January comes far too late, the twentieth in time; the mark counts a batch later
        rows(*days).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
        time.sleep(1.1)
    stream = feeds.as_stream(spark, f"{tmp_path}/feed", "*.parquet", rows(1))
    got = feeds.kept(feeds.daily_counts(stream), f"file://{tmp_path}/out", ["day"], ["disruptions"])
    assert sorted((r["day"].day, r["disruptions"]) for r in got.collect()) == [(1, 1), (2, 1), (20, 2), (21, 1), (22, 1)]


def test_names_of_like_spelling_are_all_found(spark):
    from itertools import combinations

    r = random.Random(5)
    words = ["".join(r.choice("abc ") for _ in range(r.randint(4, 26))).strip() or "a" for _ in range(120)]
    words += [w[:k] + r.choice(["", "x"]) + w[k + 1:] for w in words[:60] for k in [r.randrange(len(w))]]
    names = spark.createDataFrame(list(enumerate(words)), "id long, name string").repartition(3)
    got = {(p["a"], p["b"]) for p in matching.duplicate_pairs(names, 80.0).collect()}
    norm = {i: " ".join(w.split()) for i, w in enumerate(words)}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    first = {}
    for i, n in norm.items():
        first.setdefault(n, i)
    want = {(first[n], i) for i, n in norm.items() if n and first[n] != i}
    want |= {(min(i, j), max(i, j)) for (a, i), (b, j) in combinations([(n, i) for n, i in first.items() if n], 2) if round((1 - edits(a, b) / max(len(a), len(b))) * 100, 2) >= 80}
    assert got == want


def test_groups_are_components(spark):
    r = random.Random(9)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(n, n + 1) for n in range(400, 440)]
    root = {i: i for i in range(500)}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = matching.groups(spark.createDataFrame(pairs, "a long, b long"), spark.range(500)).collect()
    assert {g["id"]: g["master"] for g in got} == {i: top(i) for i in root}
