"""Reports about single vendors and the portfolio: risk cards, comparisons, dashboard figures, anomalies with their reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from procuris.functions.columns import rounded
from procuris.operators import anomaly as A
from procuris.operators import cards as K
from procuris.operators.explain import additive_drivers
from procuris.plans.features import ADDITIVE, FEATURES, matrix
from procuris.plans.matching import RULES, ZSQL
from procuris.plans.registry import query
from procuris.plans.tables import CONTRACTS, sql
from procuris.sources import curate as C

DRIVEN = ("mean AS (SELECT " + ", ".join(f"CAST(sum(CAST({c} AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS {c}" for c in ADDITIVE) + " FROM risk)",
          "pushed AS (" + " UNION ALL ".join(f"SELECT vendor_id, '{c}' AS feature, round({w}::DOUBLE * (risk.{c} - mean.{c}), 6) AS contribution FROM risk, mean" for c, w in ADDITIVE.items()) + ")",
          "firsts AS (SELECT vendor_id, feature AS driver FROM pushed QUALIFY row_number() OVER (PARTITION BY vendor_id ORDER BY abs(contribution) DESC, feature) = 1)",
          "eased AS (SELECT vendor_id, feature AS mitigator FROM pushed WHERE contribution < 0 QUALIFY row_number() OVER (PARTITION BY vendor_id ORDER BY abs(contribution) DESC, feature) = 1)")
QUADRANTS = """quads AS (SELECT vendor_id, CASE WHEN composite_risk_score >= r AND profit_impact_score >= p THEN 'Strategic' WHEN composite_risk_score >= r THEN 'Bottleneck' WHEN profit_impact_score >= p THEN 'Leverage' ELSE 'Tactical' END AS quadrant
  FROM risk, (SELECT median(composite_risk_score) AS r, median(profit_impact_score) AS p FROM risk))"""
HELD = "held AS (SELECT vendor_id, count(*) AS contracts, min(contract_number ORDER BY contract_end, contract_number) AS first_contract FROM contracts WHERE contract_status <> 'Expired' GROUP BY 1)"


@query(sql(*FEATURES, *([] if CONTRACTS in FEATURES else [CONTRACTS]), *DRIVEN, QUADRANTS, HELD,
           select="""SELECT vendor_id, supplier_name, risk_label_3class AS tier, composite_risk_score AS score, round(total_spend, 2) AS total_spend, round(spend_share * 100, 4) AS spend_pct, otif_rate, financial_stability, disruption_count_30d AS disruptions, quadrant,
  coalesce(contracts, 0) AS contracts, first_contract, driver, 'This supplier is classified as ' || risk_label_3class || ' risk, primarily driven by ' || driver || '. Financial stability: ' || CAST(round(financial_stability) AS INT) || '/100. Delivery performance (OTIF): ' || CAST(round(delivery_performance) AS INT) || '%.'
  || coalesce(' Mitigating factor: ' || mitigator || '.', '') AS narrative FROM risk JOIN firsts USING (vendor_id) LEFT JOIN eased USING (vendor_id) JOIN quads USING (vendor_id) LEFT JOIN held USING (vendor_id)"""))
def risk_cards(spark, d):
    """Every vendor's card: tier, score, spend, delivery, segment, contracts in force, first driver and a narrative."""
    rows = matrix(spark, d)
    return K.risk_cards(rows, additive_drivers(rows, ADDITIVE), C.contracts(spark, d))


METRICS = {"composite_risk_score": "Risk Score", "total_spend": "Annual Spend", "delivery_performance": "Delivery Perf.", "otif_rate": "OTIF Rate", "financial_stability": "Financial Stability", "news_sentiment_30d": "News Sentiment", "geo_risk_numeric": "Geo Risk"}


@query(sql(*FEATURES, "pairs AS (SELECT a.vendor_id AS a_id, b.vendor_id AS b_id, CASE WHEN a.composite_risk_score < b.composite_risk_score THEN a.supplier_name ELSE b.supplier_name END AS safer FROM risk a JOIN risk b ON b.vendor_id = a.vendor_id + 1)",
           "long AS (" + " UNION ALL ".join(f"SELECT vendor_id, '{n}' AS metric, {c}::DOUBLE AS v FROM risk" for c, n in METRICS.items()) + ")",
           select="SELECT a_id, b_id, x.metric, round(x.v, 4) AS a, round(y.v, 4) AS b, safer FROM pairs JOIN long x ON x.vendor_id = a_id JOIN long y ON y.vendor_id = b_id AND y.metric = x.metric"))
def safer_vendor(spark, d):
    """Two vendors side by side by all their figures, and which has the lower risk; here each vendor and the next one."""
    rows = matrix(spark, d)
    asked = rows.select(F.col("vendor_id").alias("a_id"), (F.col("vendor_id") + 1).alias("b_id"))
    return K.compared(rows, asked, METRICS).withColumns({c: F.round(c, 4) for c in ("a", "b")})


@query(sql(*FEATURES, *DRIVEN, QUADRANTS, select="""SELECT (SELECT count(*) FROM risk) AS vendors, """ + ", ".join(f"(SELECT count(*) FROM quads WHERE quadrant = '{q}') AS {q.lower()}" for q in ("Strategic", "Bottleneck", "Leverage", "Tactical")) + """,
  (SELECT string_agg(vendor_id, ',' ORDER BY composite_risk_score DESC, vendor_id) FROM (SELECT * FROM risk ORDER BY composite_risk_score DESC, vendor_id LIMIT 3)) AS riskiest,
  (SELECT feature FROM pushed GROUP BY 1 ORDER BY round(CAST(sum(CAST(abs(contribution) AS DECIMAL(28,12))) AS DOUBLE), 6) DESC, feature LIMIT 1) AS top_driver"""))
def portfolio_summary(spark, d):
    """Quadrants, the three riskiest vendors and the driver that moves most scores."""
    rows = matrix(spark, d)
    return K.portfolio(rows, additive_drivers(rows, ADDITIVE))


@query(sql(*FEATURES, RULES, "st AS (SELECT " + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in A.ANOMALY_FEATURES) + " FROM risk)", f"z AS (SELECT vendor_id, {ZSQL} FROM risk, st)",
           "zs AS (SELECT vendor_id, list_max([" + ", ".join(f"struct_pack(z := round(round(coalesce(z_{c}, 0), 4), 3), i := {-i}, c := '{c}')" for i, c in enumerate(A.ANOMALY_FEATURES)) + "]) AS top FROM z)",
           select="SELECT vendor_id, supplier_name, CAST(CAST(top.z > 2 AS INT) + CAST(r <> '' AS INT) AS INT) AS total_anomaly_flags, top.z > 2 OR r <> '' AS is_anomalous, top.z AS max_zscore, top.z > 2 AS anomaly_zscore_flag, r <> '' AS rule_based_flag, r AS rule_based_reason, composite_risk_score FROM risk JOIN zs USING (vendor_id) JOIN reasons USING (vendor_id)"))
def anomaly_flags(spark, d):
    """M16, A22, R38 in the older form, of which one flag is enough and the forest is no part: flags, figures and reasons."""
    rows = matrix(spark, d)
    out = A.report(rows, A.rules(rows), A.zscores(rows, A.ANOMALY_FEATURES, 2.0), least=1)
    return out.select("vendor_id", "supplier_name", "total_anomaly_flags", "is_anomalous", rounded("max_zscore", 3).alias("max_zscore"), "anomaly_zscore_flag", "rule_based_flag", "rule_based_reason", "composite_risk_score")


@query()
def anomaly_report(spark, d):
    """Rules, z-scores and the forest, of which two have to agree, with scores, features and reasons; the first by the forest's score come first."""
    rows = matrix(spark, d)
    forest = A.isolation_forest(rows, A.ANOMALY_FEATURES)
    return A.report(rows, A.rules(rows), A.zscores(rows, A.ANOMALY_FEATURES, 2.0), forest).orderBy(F.desc("anomaly_score"), "vendor_id")


@query()
def anomaly_summary(spark, d):
    """How many vendors each detector flags, and the five that stand out most."""
    rows = matrix(spark, d)
    forest = A.isolation_forest(rows, A.ANOMALY_FEATURES)
    return A.summary(A.report(rows, A.rules(rows), A.zscores(rows, A.ANOMALY_FEATURES, 2.0), forest))
