"""Queries of the reports that readers ask for by name, and of functions that only those use."""

from __future__ import annotations

from pyspark.sql import functions as F

from procuris.functions import columns as K
from procuris.functions import params as P
from procuris.operators import anomaly as A
from procuris.operators import explain as E
from procuris.operators import features as X
from procuris.operators import served as R
from procuris.operators import spend as S
from procuris.plans.delivery import risk_case
from procuris.plans.extracts import case_of
from procuris.plans.features import ADDITIVE, FEATURES, FORECAST, KRALJIC, forecasts, matrix
from procuris.plans.matching import RULES
from procuris.plans.registry import SQL, query
from procuris.plans.spend import ABC
from procuris.plans.tables import SPEND, TRANSACTIONS, VENDORS, listed, sql
from procuris.sources import curate as C
from procuris.sources.shared import saved

CENTS = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
DRIVERS = ("long AS (" + " UNION ALL ".join(f"SELECT vendor_id, '{c}' AS feature, round({w}::DOUBLE * ({c} - (SELECT CAST(sum(CAST({c} AS DECIMAL(28,12))) AS DOUBLE) / count(*) FROM risk)), 6) AS contribution FROM risk" for c, w in ADDITIVE.items()) + ")",
           "ranked AS (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY abs(contribution) DESC, feature) AS driver FROM long)")


@query(sql(*FEATURES, KRALJIC, ABC, "quad AS (SELECT vendor_id, composite_risk_score >= (SELECT quantile_cont(composite_risk_score, 0.5) FROM risk) AS qr, total_spend >= (SELECT quantile_cont(total_spend, 0.5) FROM risk) AS hs FROM risk)",
           select="""SELECT k.vendor_id, kraljic_segment, k.composite_risk_score, k.profit_impact_score, c.abc_class, c.spend_rank,
  CASE WHEN qr AND hs THEN 'High Risk / High Spend' WHEN qr THEN 'High Risk / Low Spend' WHEN hs THEN 'Low Risk / High Spend' ELSE 'Low Risk / Low Spend' END AS risk_spend_quadrant, v.supplier_name, v.country_code, v.industry_category
  FROM kraljic k LEFT JOIN classed c USING (vendor_id) JOIN quad USING (vendor_id) JOIN vendors v USING (vendor_id)"""))
def segments_with_attributes(spark, d):
    """R10."""
    rows = matrix(spark, d)
    segments = X.risk_spend_quadrant(X.kraljic(rows)).select("vendor_id", "kraljic_segment", "composite_risk_score", "profit_impact_score", "risk_spend_quadrant")
    classes = S.abc(saved(C.spend(C.transactions(spark, d)))).select("vendor_id", "abc_class", "spend_rank")
    return R.segments_with_attributes(segments.join(classes, "vendor_id", "left"), C.vendors(spark, d))


@query(sql(*FEATURES, RULES, f"""g AS (SELECT coalesce(nullif(trim(material_group), ''), 'Unclassified') AS material_group, t.vendor_id, transaction_amount, r.r <> '' AS odd FROM transactions t JOIN reasons r USING (vendor_id) WHERE transaction_amount > 0)""",
           f"o AS (SELECT material_group, count(DISTINCT vendor_id) AS total_vendors, count(DISTINCT CASE WHEN odd THEN vendor_id END) AS anomalous_vendors, {CENTS.format('transaction_amount')} AS total_spend, coalesce(CAST(sum(CASE WHEN odd THEN CAST(transaction_amount AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS anomalous_spend FROM g GROUP BY 1)",
           select="SELECT *, round(anomalous_vendors / total_vendors * 100, 4) AS anomaly_rate FROM o WHERE anomalous_vendors > 0 ORDER BY anomalous_vendors DESC, material_group LIMIT 20"))
def anomalies_by_category(spark, d):
    """Of vendors that the business rules flag."""
    flags = A.rules(matrix(spark, d)).select("vendor_id", F.col("rule_based_flag").alias("is_anomalous"))
    return R.anomalies_by_category(C.transactions(spark, d, with_group=True), flags)


@query("""WITH s AS (SELECT s_suppkey AS vendor_id, round(s_acctbal / 100, 2) AS esg_score FROM supplier), w AS (SELECT *, count(*) OVER () AS covered, round(CAST(sum(CAST(esg_score AS DECIMAL(18,6))) OVER () AS DOUBLE) / count(*) OVER (), 4) AS mean_score FROM s WHERE esg_score > 0),
r AS (SELECT *, row_number() OVER (ORDER BY esg_score DESC, vendor_id) AS t, row_number() OVER (ORDER BY esg_score, vendor_id) AS b FROM w)
SELECT 'top' AS kind, CAST(t AS INT) AS place, vendor_id, esg_score, covered, mean_score FROM r WHERE t <= 5 UNION ALL SELECT 'bottom', CAST(b AS INT), vendor_id, esg_score, covered, mean_score FROM r WHERE b <= 5""")
def esg_report(spark, d):
    """With a score made from balances."""
    return R.esg(C.read(spark, d, "supplier").select(F.col("s_suppkey").alias("vendor_id"), F.round(F.col("s_acctbal") / 100, 2).alias("esg_score")))


@query(sql(*FEATURES, *DRIVERS, "i AS (SELECT industry_category, count(*) AS n FROM risk WHERE risk_label_3class <> 'Low' GROUP BY 1 ORDER BY n DESC, industry_category LIMIT 3)",
           select="""SELECT 'feature' AS kind, feature AS name, round(CAST(sum(CAST(abs(contribution) AS DECIMAL(28,12))) AS DOUBLE) / count(*), 6) AS value FROM long GROUP BY 2 UNION ALL
  SELECT 'geography', 'vendors in high-risk countries', CAST(count(CASE WHEN geo_risk_numeric >= 0.65 THEN 1 END) AS DOUBLE) FROM risk UNION ALL SELECT 'industry', industry_category, CAST(n AS DOUBLE) FROM i"""))
def risk_driver_report(spark, d):
    """With vendors above the low tier as those at high risk."""
    rows = matrix(spark, d)
    vendors = rows.select(F.col("geo_risk_tier").alias("geo_risk"), F.when(F.col("risk_label_3class") != "Low", "High").alias("risk_label"), "industry_category")
    return R.risk_drivers(vendors, E.additive_drivers(rows, ADDITIVE))


@query(sql(*FORECAST, KRALJIC, *DRIVERS, RULES,
           select="""SELECT k.vendor_id, k.risk_label_3class, k.composite_risk_score, k.kraljic_segment, f.disruption_prob_30d, f.disruption_prob_90d, g.feature AS top_driver, nullif(w.r, '') AS anomaly FROM kraljic k JOIN forecasts f USING (vendor_id)
  LEFT JOIN (SELECT vendor_id, feature FROM ranked WHERE driver = 1) g USING (vendor_id) LEFT JOIN reasons w USING (vendor_id)"""))
def whole_profiles(spark, d):
    """Risk, segment, forecast, first driver and anomaly of every vendor."""
    rows = matrix(spark, d)
    first = E.additive_drivers(rows, ADDITIVE).filter("driver = 1").select("vendor_id", F.col("feature").alias("top_driver"))
    reasons = A.rules(rows).select("vendor_id", F.nullif("rule_based_reason", F.lit("")).alias("anomaly"))
    chances = forecasts(spark, d, rows).select("vendor_id", "disruption_prob_30d", "disruption_prob_90d")
    return R.whole_profile(X.kraljic(rows).select("vendor_id", "risk_label_3class", "composite_risk_score", "kraljic_segment"), chances, first, reasons)


ASKED = "asked AS (SELECT n_nationkey AS question, substr(n_name, 1, 4) || ' ' || r_name AS part FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(sql(ASKED, "w AS (SELECT DISTINCT question, unnest(string_split(lower(part), ' ')) AS word FROM asked)", "n AS (SELECT DISTINCT c_custkey AS id, unnest(string_split(lower(c_name || ' ' || r_name), ' ')) AS word FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
           "h AS (SELECT DISTINCT question, id FROM w JOIN n USING (word) WHERE length(word) > 3)", select="SELECT question, id, CAST(row_number() OVER (PARTITION BY question ORDER BY id) AS INT) AS place FROM h QUALIFY row_number() OVER (PARTITION BY question ORDER BY id) <= 4"))
def name_suggestions(spark, d):
    """Four names that share a word with one that was not found."""
    places = C.read(spark, d, "nation").join(F.broadcast(C.read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    asked = places.select(F.col("n_nationkey").alias("question"), F.concat_ws(" ", F.substring("n_name", 1, 4), F.col("r_name")).alias("part"))
    names = C.read(spark, d, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_name", "r_name").alias("name"))
    return R.similar_names(names, asked)


@query("SELECT n_nationkey AS question, min(s_suppkey) AS id FROM supplier, nation WHERE contains(lower(s_name), lower('#00000000' || n_nationkey % 10)) GROUP BY 1")
def find_vendor(spark, d):
    """for each of some parts of names the first vendor that has it."""
    names = C.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    asked = C.read(spark, d, "nation").select(F.col("n_nationkey").alias("question"), F.concat(F.lit("#00000000"), F.col("n_nationkey") % 10).alias("part"))
    return R.find_names(names, asked)


@query("""WITH q AS (SELECT o_orderkey AS id, 'Spend in Q' || o_orderkey % 6 || ', shift ' || o_custkey % 90 || '% within ' || o_orderkey % 40 || ' days' AS t FROM orders)
SELECT id, CAST(nullif(regexp_extract(lower(t), '\\bq([1-4])\\b', 1), '') AS INT) AS quarter, CAST(nullif(regexp_extract(lower(t), '(\\d+)\\s*day', 1), '') AS INT) AS days,
  CAST(coalesce(nullif(regexp_extract(lower(t), '(\\d+)%?\\s*(?:shift|move|transfer|reallocate)', 1), ''), nullif(regexp_extract(lower(t), '(?:shift|move|transfer|reallocate)[^\\d]*(\\d+)%?', 1), '')) AS INT) AS pct FROM q""")
def asked_figures(spark, d):
    """quarter, days and share that questions name."""
    o = C.read(spark, d, "orders")
    text = F.concat(F.lit("Spend in Q"), F.col("o_orderkey") % 6, F.lit(", shift "), F.col("o_custkey") % 90, F.lit("% within "), F.col("o_orderkey") % 40, F.lit(" days"))
    return o.select(F.col("o_orderkey").alias("id"), text.alias("t")).select("id", K.quarter_asked("t").alias("quarter"), K.days_asked("t").alias("days"), K.percent_asked("t").alias("pct"))


REGION_CASE = "CASE " + " ".join(f"WHEN list_contains({listed(codes)}, country_code) THEN '{region}'" for region, codes in P.REGIONS.items()) + " END"


@query(sql(TRANSACTIONS, SPEND, VENDORS, select=f"SELECT {REGION_CASE} AS region, count(*) AS vendors, {CENTS.format('total_spend')} AS spend FROM spend JOIN vendors USING (vendor_id) GROUP BY 1"))
def spend_of_regions(spark, d):
    """Regions of country codes; countries in none are together."""
    return R.spend_of_regions(C.spend(C.transactions(spark, d)), C.vendors(spark, d))


@query(f"""WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Intel ' WHEN 1 THEN 'Ford ' WHEN 2 THEN 'Roche ' WHEN 3 THEN 'BP ' ELSE 'Acme ' END || p_type AS t FROM part) SELECT p_partkey, coalesce({case_of('lower(t)', P.INDUSTRY_WORDS)}, 'Other') AS industry FROM t""")
def guessed_industry(spark, d):
    """X34."""
    key = F.col("p_partkey") % 5
    name = F.concat(F.when(key == 0, "Intel ").when(key == 1, "Ford ").when(key == 2, "Roche ").when(key == 3, "BP ").otherwise("Acme "), F.col("p_type"))
    return C.read(spark, d, "part").select("p_partkey", K.guessed_industry(name).alias("industry"))


SHOWN = ["financial_stability", "spend_pct_of_portfolio", "disruption_count", "days_since_last_disruption", "geo_risk_flag", "historical_risk_numeric", "quadrant_score", "other", "total_annual_spend"]


@query(f"""WITH v AS (SELECT o_orderkey AS id, ({listed(SHOWN)})[CAST(o_orderkey % {len(SHOWN)} AS INT) + 1] AS f, (o_orderkey % 1000)::DOUBLE / 1000 AS x FROM orders),
w AS (SELECT id, f, CASE WHEN f IN ('financial_stability', 'disruption_count', 'days_since_last_disruption', 'total_annual_spend') THEN x * 100000 ELSE x END AS x FROM v)
SELECT id, CASE f WHEN 'financial_stability' THEN printf('%.1f/100', x) WHEN 'spend_pct_of_portfolio' THEN printf('%.1f%%', x * 100) WHEN 'disruption_count' THEN CAST(trunc(x) AS BIGINT) || ' events' WHEN 'days_since_last_disruption' THEN CAST(trunc(x) AS BIGINT) || ' days'
  WHEN 'geo_risk_flag' THEN CASE WHEN x > 0.5 THEN 'Yes' ELSE 'No' END WHEN 'historical_risk_numeric' THEN CASE WHEN x > 0.7::DOUBLE THEN 'High' WHEN x > 0.3::DOUBLE THEN 'Medium' ELSE 'Low' END
  WHEN 'quadrant_score' THEN CASE WHEN x >= 0.9::DOUBLE THEN 'Strategic' WHEN x >= 0.7::DOUBLE THEN 'Bottleneck' WHEN x >= 0.4::DOUBLE THEN 'Leverage' ELSE 'Tactical' END WHEN 'total_annual_spend' THEN '$' || format('{{:,}}', CAST(round_even(x, 0) AS BIGINT)) ELSE printf('%.3f', x) END AS shown FROM w""")
def shown_features(spark, d):
    """Values as readers see them, by the feature's name."""
    key = F.col("o_orderkey")
    name, x = F.array(*map(F.lit, SHOWN))[(key % len(SHOWN)).cast("int")], (key % 1000).cast("double") / 1000
    value = F.when(name.isin("financial_stability", "disruption_count", "days_since_last_disruption", "total_annual_spend"), x * 100000).otherwise(x)
    return C.read(spark, d, "orders").select(key.alias("id"), K.shown_feature(name, value).alias("shown"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS next_month, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS third_month FROM orders")
def forecast_months(spark, d):
    """The months that a forecast is made for."""
    day = F.to_date("o_orderdate")
    return C.read(spark, d, "orders").select("o_orderkey", K.months_later(day, 1).alias("next_month"), K.months_later(day, 3).alias("third_month"))


IMPORTANCE = "imp AS (SELECT feature, round(CAST(sum(CAST(abs(contribution) AS DECIMAL(28,12))) AS DOUBLE) / count(*), 6) AS importance FROM long GROUP BY 1)"


def _importance(rows):
    drivers = E.additive_drivers(rows, ADDITIVE)
    return drivers, drivers.groupBy("feature").agg(F.round(F.avg(F.abs("contribution").cast("decimal(28,12)")).cast("double"), 6).alias("importance"))


@query(sql(*FEATURES, *DRIVERS, IMPORTANCE, select="SELECT vendor_id, feature, round(importance / (SELECT max(importance) FROM imp), 6) AS contribution FROM risk, imp"))
def tiled_importance(spark, d):
    """Each vendor with the portfolio's importances."""
    rows = matrix(spark, d)
    return E.tiled_importance(rows, _importance(rows)[1]).withColumn("contribution", F.round("contribution", 6))


@query(sql(*FEATURES, *DRIVERS, IMPORTANCE, "spread AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(stddev_pop({c}), 6) AS importance FROM risk" for c in ADDITIVE) + ")",
           "a AS (SELECT feature, row_number() OVER (ORDER BY importance DESC, feature) AS rank_one FROM imp)", "b AS (SELECT feature, row_number() OVER (ORDER BY importance DESC, feature) AS rank_two FROM spread)",
           select="SELECT feature, CAST(rank_one AS INT) AS rank_one, CAST(rank_two AS INT) AS rank_two, CAST(row_number() OVER (ORDER BY (rank_one + rank_two) / 2, feature) AS INT) AS combined_rank FROM a JOIN b USING (feature)"))
def global_importance(spark, d):
    """Two rankings of features and their mean."""
    rows = matrix(spark, d)
    spread = rows.agg(*(F.round(F.stddev_pop(c), 6).alias(c) for c in ADDITIVE)).unpivot([], list(ADDITIVE), "feature", "importance")
    return E.global_importance(_importance(rows)[1], spread)


@query(sql(*FEATURES, *DRIVERS, "one AS (SELECT vendor_id, list(feature ORDER BY driver) AS x FROM ranked GROUP BY 1)", "raw AS (" + " UNION ALL ".join(f"SELECT vendor_id, '{c}' AS feature, {c} AS v FROM risk" for c in ADDITIVE) + ")",
           "two AS (SELECT vendor_id, list(feature ORDER BY v DESC, feature) AS y FROM raw GROUP BY 1)",
           select="SELECT vendor_id, CASE WHEN x[1] = y[1] THEN 'YES' ELSE 'NO' END AS methods_agree, round(len(list_intersect(x, y)) / 3, 4) AS overlap FROM one JOIN two USING (vendor_id)"))
def methods_agreement(spark, d):
    """Drivers by contribution against the features of most value."""
    rows = matrix(spark, d)
    one = E.driver_rows(E.additive_drivers(rows, ADDITIVE)).select("vendor_id", "drivers")
    long = rows.select("vendor_id", *ADDITIVE).unpivot("vendor_id", list(ADDITIVE), "feature", "v")
    two = long.groupBy("vendor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("v"), "feature"))), lambda s: s["feature"]).alias("drivers"))
    return E.agreement(one, two)


@query("SELECT count(*) AS vendors, count(CASE WHEN methods_agree = 'YES' THEN 1 END) AS agree, round(count(CASE WHEN overlap >= 0.66 THEN 1 END) / count(*), 4) AS overlap_share FROM (" + SQL["methods_agreement"] + ")")
def methods_agreement_share(spark, d):
    """How far two methods agree over the portfolio."""
    return E.agreement_share(methods_agreement(spark, d))


@query("SELECT *, rank_one <= 2 AND rank_two <= 2 AS both_top FROM (" + SQL["global_importance"] + ")")
def importance_tops(spark, d):
    """Features that both rankings have among their first two."""
    return E.in_both_tops(global_importance(spark, d), 2)


@query(sql(*FEATURES, select=f"""SELECT count(*) AS total_vendors, count(CASE WHEN risk_label_3class = 'High' THEN 1 END) AS high_risk, count(CASE WHEN risk_label_3class = 'Medium' THEN 1 END) AS medium_risk, count(CASE WHEN risk_label_3class = 'Low' THEN 1 END) AS low_risk,
  {CENTS.format('total_spend')} AS total_spend, round(CAST(sum(CAST(otif_rate AS DECIMAL(18,6))) AS DOUBLE) / count(*), 6) AS mean_otif, CAST(sum(disruption_count_30d) AS BIGINT) AS alerts FROM risk WHERE industry_category IN ('Chemicals', 'Automotive') AND total_spend > 1000"""))
def portfolio_filtered(spark, d):
    """The portfolio's figures under the reader's filters."""
    rows = matrix(spark, d).filter(F.col("industry_category").isin("Chemicals", "Automotive") & (F.col("total_spend") > 1000))
    label = F.col("risk_label_3class")
    return rows.agg(F.count("*").alias("total_vendors"), *(F.count_if(label == x).alias(f"{x.lower()}_risk") for x in ("High", "Medium", "Low")), K.total("total_spend").alias("total_spend"),
                    F.round(F.avg(F.col("otif_rate").cast("decimal(18,6)")).cast("double"), 6).alias("mean_otif"), F.sum("disruption_count_30d").alias("alerts"))
