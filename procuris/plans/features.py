"""Feature, risk, segment and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from procuris.functions import params as P
from procuris.functions.columns import rounded, total
from procuris.operators import delivery as D
from procuris.operators import features as X
from procuris.operators import spend as S
from procuris.operators.quantiles import grouped_quantiles
from procuris.operators.relational import missing_share, with_totals
from procuris.plans.delivery import BASE_RISK, OTIF, STABILITY, base_risk, risk_case
from procuris.plans.registry import query
from procuris.plans.spend import MANAGED, MAVERICK
from procuris.plans.tables import ACTIVE, CONTRACTS, DELIVERIES, NEWS, SPEND, TRANSACTIONS, VENDORS, sql
from procuris.sources import curate as C
from procuris.sources.shared import saved

CENTS = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
INDUSTRY = "CAST(CASE industry_category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.INDUSTRY_RISK.items()) + f" ELSE {P.INDUSTRY_RISK_DEFAULT} END AS DOUBLE)"
SANCTIONED = "(" + ", ".join(f"'{c}'" for c in P.SANCTIONED) + ")"

#: One row a vendor with everything the features are made from, as SQL and as a DataFrame.
BASE = (TRANSACTIONS, SPEND, VENDORS, DELIVERIES, OTIF, CONTRACTS, ACTIVE, MANAGED, MAVERICK, STABILITY, BASE_RISK, NEWS,
        "quarters AS (SELECT vendor_id, count(DISTINCT year_quarter) AS active_quarters FROM transactions GROUP BY 1)",
        """signals AS (SELECT vendor_id, round(CAST(sum(CAST(sentiment_score AS DECIMAL(18,4))) AS DOUBLE) / count(*), 4) AS news_sentiment_30d, count(CASE WHEN disruption_flag THEN 1 END) AS disruption_count_30d
    FROM news WHERE published_at >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY GROUP BY 1)""",
        """base AS (SELECT v.vendor_id, v.supplier_name, v.country_code, v.industry_category, s.total_spend, s.tx_count, q.active_quarters, o.otif_rate, o.avg_delay_days, o.delivery_performance, f.financial_stability, l.risk_label,
      n.news_sentiment_30d, n.disruption_count_30d, m.is_maverick, CASE WHEN m.is_maverick THEN 0.0 ELSE 100.0 END::DOUBLE AS sum_percentage
    FROM vendors v LEFT JOIN spend s USING (vendor_id) LEFT JOIN quarters q USING (vendor_id) LEFT JOIN otif o USING (vendor_id) LEFT JOIN stability f USING (vendor_id) LEFT JOIN labelled l USING (vendor_id)
      LEFT JOIN signals n USING (vendor_id) LEFT JOIN saved m USING (vendor_id))""")
FEATURES = (*BASE, f"""feat AS (SELECT *, round((financial_stability * 0.35::DOUBLE + delivery_performance * 0.40::DOUBLE + (1 - historical_risk_numeric) * 100 * 0.25::DOUBLE) / 100, 6) AS performance_composite,
    total_spend / CAST(sum(CAST(total_spend AS DECIMAL(18,2))) OVER () AS DOUBLE) AS spend_share, least(1, greatest(0, coalesce(active_quarters, 1) / 4)) AS spend_trend_numeric,
    round(CASE WHEN max(lvl) OVER g > min(lvl) OVER g THEN (lvl - min(lvl) OVER g) / (max(lvl) OVER g - min(lvl) OVER g) ELSE 0.5 END, 6) AS profit_impact_score,
    coalesce(disruption_count_30d / nullif(max(disruption_count_30d) OVER (), 0), 0) AS disruption_freq_norm, CAST(news_sentiment_30d < -0.2::DOUBLE OR disruption_count_30d > 0 AS INT) AS news_risk_flag,
    {risk_case()} AS geo_risk_numeric, CAST(country_code IN {SANCTIONED} AS INT) AS sanctioned_country, {INDUSTRY} AS industry_risk_numeric,
    least(1, greatest(0, 1 - otif_rate)) AS delivery_risk_numeric, CAST(avg_delay_days > 5 AS INT) AS significant_delay_flag
  FROM (SELECT * REPLACE (coalesce(total_spend, 500000) AS total_spend, coalesce(otif_rate, 0.75::DOUBLE) AS otif_rate, coalesce(avg_delay_days, 0) AS avg_delay_days, coalesce(news_sentiment_30d, 0) AS news_sentiment_30d, coalesce(disruption_count_30d, 0) AS disruption_count_30d),
      CASE lower(trim(risk_label)) WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.1 ELSE 0.5 END::DOUBLE AS historical_risk_numeric, ln(1 + greatest(coalesce(total_spend, 500000), 0)) AS lvl FROM base)
  WINDOW g AS (PARTITION BY industry_category))""",
            """risk1 AS (SELECT *, CAST(spend_share > 0.1::DOUBLE AS INT) AS spend_concentration_flag, round(least(1, greatest(0, geo_risk_numeric * 0.30::DOUBLE + industry_risk_numeric * 0.25::DOUBLE + delivery_risk_numeric * 0.25::DOUBLE + CAST(spend_share > 0.1::DOUBLE AS INT) * 0.20::DOUBLE)), 4) AS b FROM feat)""",
            """risk2 AS (SELECT *, round(least(1, greatest(0, b * 0.85::DOUBLE + disruption_freq_norm * 0.15::DOUBLE)), 4) AS n,
    round(CASE WHEN coalesce(is_maverick, false) THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN coalesce(sum_percentage, 100) < 60 THEN 0.3 ELSE 0 END::DOUBLE + 0.1::DOUBLE * 0.2::DOUBLE, 6) AS sp FROM risk1)""",
            "risk3 AS (SELECT *, round(least(1, greatest(0, n * 0.90::DOUBLE + coalesce(sp / nullif(max(sp) OVER (), 0), 0) * 0.10::DOUBLE)), 4) AS composite_risk_score FROM risk2)",
            "risk AS (SELECT *, CASE WHEN composite_risk_score <= 0.25::DOUBLE THEN 'Low' WHEN composite_risk_score <= 0.45::DOUBLE THEN 'Medium' ELSE 'High' END AS risk_label_3class FROM risk3)")


def signals(spark, d):
    n = C.news(spark, d).filter(F.col("published_at") >= F.expr(f"timestamp '{C.NEWS_AS_OF}' - interval 30 days"))
    return n.groupBy("vendor_id").agg(rounded(F.sum(F.col("sentiment_score").cast("decimal(18,4)")).cast("double") / F.count("*"), 4).alias("news_sentiment_30d"), F.count_if("disruption_flag").alias("disruption_count_30d"))


def base(spark, d):
    """One row a vendor. Lines are read once for spend and once for deliveries; both results, a row a vendor, are saved as several columns need them."""
    c = C.contracts(spark, d)
    measures = saved(C.transactions(spark, d).groupBy("vendor_id").agg(total("transaction_amount").alias("total_spend"), F.count("*").alias("tx_count"), F.countDistinct("year_quarter").alias("active_quarters")))
    s, otif = measures.drop("active_quarters"), saved(D.otif(C.deliveries(spark, d)))
    off = S.maverick(s, c).select("vendor_id", "is_maverick", F.when(F.col("is_maverick"), 0.0).otherwise(100.0).alias("sum_percentage"))
    rows = C.vendors(spark, d).select("vendor_id", "supplier_name", "country_code", "industry_category")
    for part in (measures, otif, D.financial_stability(s), base_risk(spark, d, s, otif).select("vendor_id", "risk_label"), signals(spark, d), off):
        rows = rows.join(part, "vendor_id", "left")
    return saved(rows)


def matrix(spark, d):
    """The vendor matrix, saved: what follows reads one row a vendor however often it needs totals of it."""
    return saved(X.matrix(base(spark, d).withColumn("concentration_risk", F.lit("LOW"))))


MATRIX = ["vendor_id", "total_spend", "financial_stability", "delivery_performance", "historical_risk_numeric", "performance_composite", "spend_share", "spend_concentration_flag", "spend_trend_numeric",
          "profit_impact_score", "news_sentiment_30d", "disruption_count_30d", "news_risk_flag", "disruption_freq_norm", "geo_risk_numeric", "sanctioned_country", "industry_risk_numeric",
          "delivery_risk_numeric", "significant_delay_flag"]
MATRIX_SQL = ", ".join(f"round({c}, {10 if c == 'spend_share' else 6}) AS {c}" if c in ("spend_share", "disruption_freq_norm", "delivery_risk_numeric") else c for c in MATRIX)


@query(sql(*FEATURES, select=f"SELECT {MATRIX_SQL} FROM risk"))
def feature_matrix(spark, d):
    """B11 to B15."""
    rounded = {"spend_share": 10, "disruption_freq_norm": 6, "delivery_risk_numeric": 6}
    return matrix(spark, d).select(*(F.round(n, rounded[n]).alias(n) if n in rounded else n for n in MATRIX))


@query(sql(*FEATURES, select="SELECT vendor_id, composite_risk_score, risk_label_3class FROM risk"))
def composite_risk(spark, d):
    return matrix(spark, d).select("vendor_id", "composite_risk_score", "risk_label_3class")


@query(sql(*FEATURES, select="""SELECT count(*) AS vendors, round(CAST(sum(CAST(composite_risk_score AS DECIMAL(18,8))) AS DOUBLE) / count(*), 4) AS mean_risk, count(CASE WHEN risk_label_3class = 'High' THEN 1 END) AS high,
  count(CASE WHEN risk_label_3class = 'Medium' THEN 1 END) AS medium, count(CASE WHEN risk_label_3class = 'Low' THEN 1 END) AS low FROM risk"""))
def feature_summary(spark, d):
    return X.feature_summary(matrix(spark, d))


KRALJIC = """kr AS (SELECT *, composite_risk_score >= (SELECT quantile_cont(composite_risk_score, 0.5) FROM risk) AS hr, profit_impact_score >= (SELECT quantile_cont(profit_impact_score, 0.5) FROM risk) AS hp FROM risk),
  kraljic AS (SELECT *, CASE WHEN hr AND hp THEN 'Strategic' WHEN hp THEN 'Leverage' WHEN hr THEN 'Bottleneck' ELSE 'Tactical' END AS kraljic_segment FROM kr)"""


@query(sql(*FEATURES, KRALJIC, select="SELECT vendor_id, kraljic_segment, CASE kraljic_segment WHEN 'Strategic' THEN 'Build partnership' WHEN 'Leverage' THEN 'Negotiate volume' WHEN 'Bottleneck' THEN 'Secure supply' ELSE 'Automate purchasing' END AS strategic_action FROM kraljic"))
def kraljic_quadrants(spark, d):
    return X.kraljic(matrix(spark, d)).select("vendor_id", "kraljic_segment", "strategic_action")


@query(sql(*FEATURES, KRALJIC, select="SELECT kraljic_segment, count(*) AS vendors, min(vendor_id) AS first_vendor FROM kraljic GROUP BY 1"))
def segment_overview(spark, d):
    """R13, R37."""
    return X.kraljic(matrix(spark, d)).groupBy("kraljic_segment").agg(F.count("*").alias("vendors"), F.min("vendor_id").alias("first_vendor"))


@query(sql(*FEATURES, KRALJIC, select="""SELECT vendor_id, CASE kraljic_segment WHEN 'Strategic' THEN 1.0 WHEN 'Bottleneck' THEN 0.75 WHEN 'Leverage' THEN 0.5 ELSE 0.25 END::DOUBLE AS quadrant_score, round(0.6::DOUBLE * composite_risk_score + 0.4::DOUBLE * profit_impact_score, 6) AS criticality_index,
  CAST(composite_risk_score >= 0.5 AS INT) AS label_binary, CASE WHEN composite_risk_score <= 0.33::DOUBLE THEN 'Low' WHEN composite_risk_score <= 0.66::DOUBLE THEN 'Medium' ELSE 'High' END AS label_3class FROM kraljic"""))
def strategic_features(spark, d):
    return X.strategic_features(X.kraljic(matrix(spark, d)))


@query(sql(*FEATURES, """q AS (SELECT *, composite_risk_score >= (SELECT quantile_cont(composite_risk_score, 0.5) FROM risk) AS hr, total_spend >= (SELECT quantile_cont(total_spend, 0.5) FROM risk) AS hs FROM risk)""",
           select="SELECT vendor_id, CASE WHEN hr AND hs THEN 'High Risk / High Spend' WHEN hr THEN 'High Risk / Low Spend' WHEN hs THEN 'Low Risk / High Spend' ELSE 'Low Risk / Low Spend' END AS risk_spend_quadrant FROM q"))
def risk_spend_quadrant(spark, d):
    return X.risk_spend_quadrant(matrix(spark, d)).select("vendor_id", "risk_spend_quadrant")


@query(sql(TRANSACTIONS, SPEND, select="SELECT vendor_id, round((total_spend - min(total_spend) OVER ()) / (max(total_spend) OVER () - min(total_spend) OVER ()), 6) AS total_spend_scaled, round((tx_count - min(tx_count) OVER ()) / (max(tx_count) OVER () - min(tx_count) OVER ()), 6) AS tx_count_scaled FROM spend"))
def scaled_features(spark, d):
    return X.scaled(C.spend(C.transactions(spark, d)), ["total_spend", "tx_count"]).select("vendor_id", "total_spend_scaled", "tx_count_scaled")


@query(sql(TRANSACTIONS, f"months AS (SELECT vendor_id, year * 12 + month AS m, {CENTS.format('transaction_amount')} AS s FROM transactions GROUP BY 1, 2)",
           "r AS (SELECT vendor_id, count(*) AS months, round(regr_slope(s, m) / avg(s), 6) AS slope FROM months GROUP BY 1)",
           select="SELECT *, CASE WHEN months < 3 THEN 'stable' WHEN slope > 0.05::DOUBLE THEN 'increasing' WHEN slope < -0.05::DOUBLE THEN 'decreasing' ELSE 'stable' END AS trend FROM r"))
def trend_slope(spark, d):
    return X.monthly_slope(C.transactions(spark, d))


@query(sql(NEWS, "m AS (SELECT vendor_id, disruption_type, row_number() OVER (PARTITION BY vendor_id ORDER BY count(*) DESC, disruption_type) AS k FROM news GROUP BY 1, 2)",
           """r AS (SELECT vendor_id, count(*) AS disruptions, CAST(DATE '2024-01-31' - CAST(max(published_at) AS DATE) AS INT) AS days_since FROM news GROUP BY 1)""",
           select="SELECT r.*, m.disruption_type AS main_type, round(disruptions / 3, 6) AS frequency, CASE WHEN days_since <= 90 THEN 1.0 WHEN days_since <= 365 THEN 0.5 ELSE 0.1 END::DOUBLE AS recency_risk FROM r JOIN m ON r.vendor_id = m.vendor_id AND k = 1"))
def disruption_features(spark, d):
    return X.disruption_features(C.news(spark, d), F.lit(C.NEWS_AS_OF).cast("date"))


FORECAST = (NEWS, *[x for x in FEATURES if x != NEWS], """yearly AS (SELECT vendor_id, count(CASE WHEN disruption_flag THEN 1 END) / 12 AS f FROM news GROUP BY 1)""",
            "rates AS (SELECT vendor_id, coalesce(f, 0.5) / 365.0::DOUBLE * (1 + composite_risk_score) AS r FROM risk LEFT JOIN yearly USING (vendor_id))",
            """forecast AS (SELECT vendor_id, round(1 - exp(-r * 30), 4) AS disruption_prob_30d, round(1 - exp(-r * 60), 4) AS disruption_prob_60d, round(1 - exp(-r * 90), 4) AS disruption_prob_90d,
    CAST(round(least(3650, 1 / greatest(r, 0.000001::DOUBLE))) AS INT) AS expected_days_to_disruption FROM rates)""",
            "forecasts AS (SELECT *, CASE WHEN disruption_prob_30d <= 0.2::DOUBLE THEN 'Low' WHEN disruption_prob_30d <= 0.5::DOUBLE THEN 'Medium' ELSE 'High' END AS forecast_risk_30d, CAST(disruption_prob_30d >= 0.5 AS INT) AS early_warning_flag FROM forecast)")


def forecasts(spark, d, rows=None):
    yearly = C.news(spark, d).groupBy("vendor_id").agg((F.count_if("disruption_flag") / 12).alias("disruption_frequency"))
    rows = (rows or matrix(spark, d)).select("vendor_id", "composite_risk_score").join(yearly, "vendor_id", "left")
    return X.disruption_forecast(rows).drop("composite_risk_score", "disruption_frequency")


@query(sql(*FORECAST, select="SELECT * FROM forecasts"))
def poisson_forecast(spark, d):
    return forecasts(spark, d)


@query(sql(*FORECAST, select="SELECT count(CASE WHEN disruption_prob_30d >= 0.1 THEN 1 END) AS over_30d, count(CASE WHEN disruption_prob_60d >= 0.1 THEN 1 END) AS over_60d, count(CASE WHEN disruption_prob_90d >= 0.1 THEN 1 END) AS over_90d FROM forecasts"))
def forecast_report(spark, d):
    """R36, with a level that this table reaches."""
    return forecasts(spark, d).agg(*(F.count_if(F.col(f"disruption_prob_{h}d") >= 0.1).alias(f"over_{h}d") for h in P.HORIZONS))


@query(sql(*FORECAST, select="SELECT vendor_id, disruption_prob_90d FROM forecasts WHERE forecast_risk_30d <> 'Low' OR disruption_prob_90d >= 0.15 ORDER BY disruption_prob_90d DESC, vendor_id"))
def early_warnings(spark, d):
    """B29."""
    return forecasts(spark, d).filter("forecast_risk_30d <> 'Low' OR disruption_prob_90d >= 0.15").select("vendor_id", "disruption_prob_90d").orderBy(F.desc("disruption_prob_90d"), "vendor_id")


@query(sql("h AS (SELECT CAST(dayofyear(ts) AS INT) AS period, count(*)::DOUBLE AS value FROM events GROUP BY 1)",
           "o AS (SELECT count(*) AS n, max(period) AS last, regr_slope(value, period) AS s, regr_intercept(value, period) AS i, regr_sxx(value, period) AS sxx, regr_syy(value, period) AS syy, regr_sxy(value, period) AS sxy FROM h)",
           "f AS (SELECT last + k AS period, i + s * (last + k) AS g, sqrt(greatest(0, (syy - sxy * sxy / sxx) / ((n - 2) * sxx))) AS e FROM o, (VALUES (1), (2), (3)) t(k))",
           select="SELECT period, value, NULL::DOUBLE AS low, NULL::DOUBLE AS high, 'history' AS kind FROM h UNION ALL SELECT CAST(period AS INT), round(greatest(0, g), 4), round(greatest(0, g - 2 * e), 4), round(g + 2 * e, 4), 'forecast' FROM f"))
def portfolio_forecast(spark, d):
    return X.portfolio_forecast(C.read(spark, d, "events").select(F.dayofyear("ts").alias("period")))


@query("""WITH c AS (SELECT l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t FROM lineitem)
SELECT 'q' AS a, 'p' AS b, round(corr(q, p), 4) AS r FROM c UNION ALL SELECT 'q', 'd', round(corr(q, d), 4) FROM c UNION ALL SELECT 'q', 't', round(corr(q, t), 4) FROM c
UNION ALL SELECT 'p', 'd', round(corr(p, d), 4) FROM c UNION ALL SELECT 'p', 't', round(corr(p, t), 4) FROM c UNION ALL SELECT 'd', 't', round(corr(d, t), 4) FROM c""")
def correlation_matrix(spark, d):
    rows = C.read(spark, d, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))
    return X.correlations(rows, ["q", "p", "d", "t"])


@query("""WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT CAST(least(19, floor((l_extendedprice - lo) / ((hi - lo) / 20))) AS INT) AS bin, count(*) AS count FROM lineitem, b GROUP BY 1""")
def histogram(spark, d):
    return X.histogram(C.read(spark, d, "lineitem"), "l_extendedprice", 20)


@query("SELECT p_brand, p_type FROM part GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) = 1")
def mode_by_group(spark, d):
    """A12."""
    return C.read(spark, d, "part").groupBy("p_brand").agg(F.mode("p_type", True).alias("p_type"))


@query("""SELECT p_brand, round(avg(p_retailprice), 4) AS mean_price, mode_type AS main_type, first_name FROM (SELECT p_brand, p_retailprice, first_value(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS first_name,
  (SELECT p_type FROM part q WHERE q.p_brand = p.p_brand GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 1) AS mode_type FROM part p) GROUP BY ALL""")
def product_to_supplier(spark, d):
    """Means, commonest category and first name of each group of products."""
    return C.read(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("mean_price"), F.mode("p_type", True).alias("main_type"), F.min_by("p_name", "p_partkey").alias("first_name"))


@query("""SELECT 'o_orderstatus' AS "column", avg(CASE WHEN o_orderstatus IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE * 100 AS missing_pct FROM orders UNION ALL SELECT 'status_p', avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END)::DOUBLE * 100 FROM orders""")
def missing_values(spark, d):
    """A19, with a column that has nulls made from a status."""
    rows = C.read(spark, d, "orders").select("o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status_p"))
    return missing_share(rows)


@query("""SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders GROUP BY 1""")
def price_percentiles(spark, d):
    """A10, A11."""
    rows = grouped_quantiles(C.read(spark, d, "orders"), "o_orderpriority", "o_totalprice", {"p10": 0.1, "median": 0.5, "p95": 0.95})
    return rows.select("o_orderpriority", *(F.round(n, 4).alias(n) for n in ("p10", "median", "p95")))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS orders FROM orders GROUP BY 1, 2")
def value_counts(spark, d):
    """A14."""
    return C.read(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("orders"))


@query(sql(*FEATURES, select=f"SELECT risk_label_3class, count(*) AS vendors, {CENTS.format('total_spend')} AS total_spend, round(CAST(sum(CAST(composite_risk_score AS DECIMAL(18,8))) AS DOUBLE) / count(*), 6) AS mean_risk FROM risk GROUP BY 1"))
def risk_tiers(spark, d):
    return matrix(spark, d).groupBy("risk_label_3class").agg(F.count("*").alias("vendors"), total("total_spend").alias("total_spend"), F.round(F.sum(F.col("composite_risk_score").cast("decimal(18,8)")).cast("double") / F.count("*"), 6).alias("mean_risk"))


@query(sql(*FEATURES, select="""SELECT vendor_id, concat_ws('; ', CASE WHEN geo_risk_numeric >= 0.5 THEN 'High country risk' END, CASE WHEN otif_rate < 0.8::DOUBLE THEN 'Low OTIF' END, CASE WHEN financial_stability < 50 THEN 'Weak finances' END, CASE WHEN disruption_count_30d > 0 THEN 'Recent disruptions' END) AS factors FROM risk"""))
def rule_based_factors(spark, d):
    """R42."""
    return matrix(spark, d).select("vendor_id", F.concat_ws("; ", F.when(F.col("geo_risk_numeric") >= 0.5, "High country risk"), F.when(F.col("otif_rate") < 0.8, "Low OTIF"), F.when(F.col("financial_stability") < 50, "Weak finances"), F.when(F.col("disruption_count_30d") > 0, "Recent disruptions")).alias("factors"))


ADDITIVE = {"geo_risk_numeric": 0.30, "industry_risk_numeric": 0.25, "delivery_risk_numeric": 0.25}


@query(sql(*FEATURES, "long AS (" + " UNION ALL ".join(f"SELECT vendor_id, '{c}' AS feature, round({w}::DOUBLE * ({c} - (SELECT CAST(sum(CAST({c} AS DECIMAL(28,12))) AS DOUBLE) / count(*) FROM risk)), 6) AS contribution FROM risk" for c, w in ADDITIVE.items()) + ")",
           "ranked AS (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY abs(contribution) DESC, feature) AS driver FROM long)", select="SELECT * FROM ranked"))
def additive_attribution(spark, d):
    """Exact Shapley values of the additive score: weight times distance from the mean, ranked."""
    from procuris.operators.explain import additive_drivers

    return additive_drivers(matrix(spark, d), ADDITIVE)


@query(sql(*FEATURES, """w AS (SELECT quantile_cont(composite_risk_score, 0.75) AS r75, quantile_cont(spend_share, 0.9) AS s90 FROM risk)""", select="SELECT vendor_id FROM risk, w WHERE composite_risk_score >= r75 AND spend_share >= s90"))
def high_risk_high_spend(spark, d):
    """The riskiest quarter within the largest tenth."""
    rows = with_totals(matrix(spark, d).select("vendor_id", "composite_risk_score", "spend_share"), r=F.percentile("composite_risk_score", 0.75), s=F.percentile("spend_share", 0.9))
    return rows.filter((F.col("composite_risk_score") >= F.col("r")) & (F.col("spend_share") >= F.col("s"))).select("vendor_id")
