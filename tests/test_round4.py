"""Steps that have to stay small on large tables: their results against plain versions, and what their plans may not hold."""

import pytest
from pyspark.sql import functions as F

from procuris.functions.columns import rounded
from procuris.operators import anomaly, explain, features, matching, retrieve


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_segment_keys_are_not_broadcast(spark):
    names = spark.createDataFrame([(1, "acme metal works"), (2, "acme metal work"), (3, "zenith"), (4, "acme metal works"), (5, "acne metal works")], "id long, name string")
    got = matching.duplicate_pairs(names)
    assert "Broadcast" not in "".join(line for line in plan(got).splitlines() if "key#" in line)
    want = {(1, 2, 93.75), (1, 5, 93.75), (2, 5, 87.5), (1, 4, 100.0)}
    assert {tuple(r) for r in got.collect()} == want


def test_sampled_shapley_shuffles_means_alone(spark):
    rows = spark.createDataFrame([(i, float(i % 5), float(i % 3)) for i in range(40)], "vendor_id long, a double, b double")
    got = explain.sampled_shapley(rows, "vendor_id", ["a", "b"], lambda df: df.withColumn("prediction", 2 * F.col("a") + F.col("b")))
    assert "Window" not in plan(got)
    found = {(r["vendor_id"], r["feature"]): r["contribution"] for r in got.collect()}
    assert len(found) == 80 and found[4, "a"] > found[0, "a"]
    # of a sum, a feature's contribution depends on nothing but its distance from the drawn values
    assert all(-8 <= v <= 8 for v in found.values())


def test_values_are_dealt_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(explain, "DEALT", 10)
    rows = spark.createDataFrame([(i, i * 10, None if i == 3 else i) for i in range(200)], "vendor_id long, a long, b long")
    got = explain.dealt_anew(explain.blocks(rows, "vendor_id"), rows.columns, "a", 7)
    assert "Exchange" not in plan(got)
    found = got.collect()
    assert sorted((r["vendor_id"], r["b"]) for r in found if r["b"] is not None) == [(i, i) for i in range(200) if i != 3]
    assert sorted(r["a"] for r in found) == [i * 10 for i in range(200)] and sum(r["a"] == r["vendor_id"] * 10 for r in found) < 40


@pytest.mark.parametrize("most", [3, 4000])
def test_alternatives_leave_tasks_as_the_best_alone(spark, most):
    rows = spark.createDataFrame([(i, "AB"[i % 2], "xyz"[i % 3], (i % 7) / 7 + 0.3, float(i % 5), float(i % 4)) for i in range(23)],
                                 "vendor_id long, country_code string, industry_category string, composite_risk_score double, delivery_performance double, financial_stability double").localCheckpoint()
    got = anomaly.alternatives(rows, ["delivery_performance", "financial_stability"], n=2, most=most)
    assert "FlatMapCoGroupsIn" in plan(got)
    z = {r["vendor_id"]: (r, r["z_delivery_performance"], r["z_financial_stability"]) for r in anomaly.standard(rows, ["delivery_performance", "financial_stability"], null_as=0.0).collect()}
    want = set()
    for i, (a, *x) in z.items():
        scored = []
        for j, (b, *y) in z.items():
            norm = (sum(v * v for v in x) ** 0.5) * (sum(v * v for v in y) ** 0.5)
            s = round(sum(p * q for p, q in zip(x, y)) / norm, 6)
            v = round(s * (1.2 if a["industry_category"] == b["industry_category"] else 0.8) * (1.1 if a["country_code"] != b["country_code"] else 1.0) * (1.15 if b["composite_risk_score"] < a["composite_risk_score"] else 1.0), 6)
            if i != j and v > 0:
                scored.append((-v, j))
        want |= {(i, j, k + 1) for k, (_, j) in enumerate(sorted(scored)[:2])}
    assert {(r["vendor_id"], r["alt_vendor_id"], r["alternative_rank"]) for r in got.collect()} == want


def test_repeated_names_are_scored_once(spark, monkeypatch):
    left = spark.createDataFrame([(i, f"acme {i % 2}") for i in range(40)], "id long, name string")
    right = spark.createDataFrame([(i, f"acme {i % 4}") for i in range(40)], "id long, name string")
    first, seen = matching.set_pairs, []
    monkeypatch.setattr(matching, "set_pairs", lambda a, b, *x, **y: seen.append((a.count(), b.count())) or first(a, b, *x, **y))
    got = matching.fuzzy_match(left, right, 50.0).collect()
    assert seen == [(2, 4)]
    assert {(r["left_id"], r["right_id"], r["score"]) for r in got} == {(i, i % 2, 100.0) for i in range(40)}


def test_rounding_is_that_of_sql(spark):
    import duckdb

    values = [0.39465, 0.603170500000, 0.11375, 1.0000005, 0.34195, 0.42265, -0.39465, 2.5]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(rounded("x", 4).alias("a"), rounded("x", 6).alias("b")).collect()
    con = duckdb.connect()
    # 0.39465 is a little less than a half of the last place, yet times 10,000 it is one
    assert [tuple(r) for r in got] == [con.execute("SELECT round(?::DOUBLE, 4), round(?::DOUBLE, 6)", [v, v]).fetchone() for v in values]


def test_composite_risk_at_a_half(spark):
    import duckdb

    rows = spark.createDataFrame([(i, (i % 97) / 97 + 0.001 * i, (i % 13) / 13, (i % 50) / 50) for i in range(4000)], "vendor_id long, delivery_risk_numeric double, industry_risk_numeric double, disruption_freq_norm double")
    rows = rows.withColumns({"geo_risk_numeric": F.lit(0.42), "spend_concentration_flag": F.lit(0), "is_maverick": F.lit(False), "sum_percentage": F.lit(100.0), "concentration_risk": F.lit("LOW")})
    got = features.composite_risk(rows).select("vendor_id", "delivery_risk_numeric", "industry_risk_numeric", "disruption_freq_norm", "composite_risk_score").toPandas()
    con = duckdb.connect()
    con.register("got", got)
    assert con.execute("""WITH a AS (SELECT *, round(least(1, greatest(0, 0.42::DOUBLE * 0.30::DOUBLE + industry_risk_numeric * 0.25::DOUBLE + delivery_risk_numeric * 0.25::DOUBLE + 0 * 0.20::DOUBLE)), 4) AS b FROM got),
      n AS (SELECT *, round(least(1, greatest(0, b * 0.85::DOUBLE + disruption_freq_norm * 0.15::DOUBLE)), 4) AS n FROM a)
      SELECT count(*) FROM n WHERE composite_risk_score <> round(least(1, greatest(0, n * 0.90::DOUBLE + 1.0::DOUBLE * 0.10::DOUBLE)), 4)""").fetchone() == (0,)


def test_vector_search_holds_few_similarities_at_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7) - 3, float(i % 5) - 2, 1.0]) for i in range(60)], "vec_id long, v array<double>")
    asked = rows.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    assert retrieve.AT_ONCE * retrieve.VECTORS * 8 <= 8_000_000  # bytes of a task's similarities
    whole = sorted(map(tuple, retrieve.top_k(rows, asked, 4).collect()))
    monkeypatch.setattr(retrieve, "AT_ONCE", 3)
    assert sorted(map(tuple, retrieve.top_k(rows, asked, 4).collect())) == whole and len(whole) == 80
