"""Delivery, contract and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from procuris.functions.columns import total
from procuris.operators import delivery as D
from procuris.operators import spend as S
from procuris.plans.registry import query
from procuris.plans.tables import CONTRACTS, DELIVERIES, SPEND, TRANSACTIONS, VENDORS, sql
from procuris.sources import curate as C
from procuris.sources.shared import saved

ST = (TRANSACTIONS, SPEND)
OTIF = """otif AS (SELECT vendor_id, count(*) AS total_deliveries, round(sum(otif) / count(*), 6) AS otif_rate, round(sum(delay_days) / count(*), 4) AS avg_delay_days, round(sum(otif) / count(*) * 100, 4) AS delivery_performance FROM deliveries GROUP BY 1)"""


@query(sql(DELIVERIES, select="SELECT * FROM deliveries"))
def delivery_events(spark, d):
    return C.deliveries(spark, d)


@query(sql(DELIVERIES, OTIF, select="SELECT * FROM otif"))
def otif_by_vendor(spark, d):
    return D.otif(C.deliveries(spark, d))


@query(sql(DELIVERIES, select="""SELECT vendor_id, count(*) AS deliveries, round(sum(on_time) / count(*), 6) AS on_time_rate, round(sum(in_full) / count(*), 6) AS in_full_rate, round(sum(otif) / count(*), 6) AS otif_rate,
  round(sum(CASE WHEN delay_days > 0 THEN delay_days END) / count(CASE WHEN delay_days > 0 THEN 1 END), 4) AS mean_late_days, count(CASE WHEN delay_days > 5 THEN 1 END) AS significant_delays FROM deliveries GROUP BY 1"""))
def otif_summary(spark, d):
    return D.otif_summary(C.deliveries(spark, d))


@query(sql(DELIVERIES, OTIF, select="SELECT vendor_id, otif_rate, avg_delay_days FROM otif ORDER BY otif_rate, vendor_id LIMIT 10"))
def lowest_otif(spark, d):
    """R40."""
    return D.otif(C.deliveries(spark, d)).select("vendor_id", "otif_rate", "avg_delay_days").orderBy("otif_rate", "vendor_id").limit(10)


@query(sql(DELIVERIES, OTIF, select="SELECT vendor_id, 'High delay' AS reason FROM otif WHERE avg_delay_days > 2 UNION SELECT s_suppkey, 'Negative balance' FROM supplier WHERE s_acctbal < 0"))
def improvement_candidates(spark, d):
    """The union of two sets of candidates, without repeats."""
    late = D.otif(C.deliveries(spark, d)).filter("avg_delay_days > 2").select("vendor_id", F.lit("High delay").alias("reason"))
    poor = C.vendors(spark, d).filter("balance < 0").select("vendor_id", F.lit("Negative balance").alias("reason"))
    return late.union(poor).distinct()


@query(sql(CONTRACTS, select="SELECT * FROM contracts"))
def contracts_status(spark, d):
    return C.contracts(spark, d)


@query(sql(*ST, VENDORS, CONTRACTS, select="SELECT contract_number, vendor_id, supplier_name, contract_end, days_to_expiry, contract_status, total_spend FROM contracts LEFT JOIN vendors USING (vendor_id) LEFT JOIN spend USING (vendor_id) WHERE days_to_expiry BETWEEN 0 AND 60"))
def contracts_expiring(spark, d):
    return D.expiring(C.contracts(spark, d), C.vendors(spark, d), C.spend(C.transactions(spark, d)), 60)


@query(sql(*ST, CONTRACTS, select="SELECT contract_status, count(*) AS contracts, coalesce(CAST(sum(CAST(total_spend AS DECIMAL(18,2))) AS DOUBLE), 0) AS spend FROM contracts LEFT JOIN spend USING (vendor_id) GROUP BY 1"))
def contract_status_totals(spark, d):
    return D.status_totals(C.contracts(spark, d), C.spend(C.transactions(spark, d)))


STABILITY = "stability AS (SELECT vendor_id, round(least(95, greatest(20, 50 * ln(greatest(total_spend, 1)) / ln(max(total_spend) OVER ()) + 30 * tx_count / max(tx_count) OVER () + 20)), 4) AS financial_stability FROM spend)"


@query(sql(*ST, STABILITY, select="SELECT * FROM stability"))
def financial_stability(spark, d):
    return D.financial_stability(saved(C.spend(C.transactions(spark, d))))


def risk_case(column: str = "country_code") -> str:
    from procuris.functions import params as P

    known = " ".join(f"WHEN '{k}' THEN {max(v, P.SANCTION_FLOOR) if k in P.SANCTIONED else v}" for k, v in P.COUNTRY_RISK.items())
    return f"CAST(CASE {column} {known} ELSE {P.COUNTRY_RISK_DEFAULT} END AS DOUBLE)"


BASE_RISK = f"""base_risk AS (SELECT v.vendor_id, round(0.30::DOUBLE * {risk_case()} + 0.25::DOUBLE * (1 - coalesce(otif_rate, 0.75::DOUBLE)) + 0.20::DOUBLE * CASE WHEN total_spend / t > 0.1::DOUBLE THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END + 0.25::DOUBLE * 0.5::DOUBLE, 4) AS supply_risk_score
  FROM vendors v LEFT JOIN otif o ON v.vendor_id = o.vendor_id LEFT JOIN spend s ON v.vendor_id = s.vendor_id, (SELECT sum(total_spend) AS t FROM spend)),
  labelled AS (SELECT *, CASE WHEN supply_risk_score >= 0.65::DOUBLE THEN 'High' WHEN supply_risk_score >= 0.35::DOUBLE THEN 'Medium' ELSE 'Low' END AS risk_label FROM base_risk)"""


def base_risk(spark, d, spend=None, otif=None):
    spend, otif = spend or saved(C.spend(C.transactions(spark, d))), otif or D.otif(C.deliveries(spark, d))
    rows = C.vendors(spark, d).join(otif, "vendor_id", "left").join(S.share_of_total(spend), "vendor_id", "left")
    return D.base_supply_risk(rows)


@query(sql(*ST, VENDORS, DELIVERIES, OTIF, BASE_RISK, select="SELECT * FROM labelled"))
def base_supply_risk(spark, d):
    return base_risk(spark, d)


@query(sql(*ST, VENDORS, DELIVERIES, OTIF, BASE_RISK, select="SELECT risk_label, count(*) AS vendors, round(CAST(sum(CAST(total_spend AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2) AS mean_spend FROM labelled LEFT JOIN spend USING (vendor_id) GROUP BY 1"))
def risk_label_distribution(spark, d):
    """R32."""
    spend = saved(C.spend(C.transactions(spark, d)))
    return base_risk(spark, d, spend).join(spend, "vendor_id", "left").groupBy("risk_label").agg(F.count("*").alias("vendors"), F.round(total("total_spend") / F.count("*"), 2).alias("mean_spend"))


@query(sql(*ST, VENDORS, DELIVERIES, OTIF, BASE_RISK, select="""SELECT risk_label, count(*) AS vendors, CAST(sum(CAST(total_spend AS DECIMAL(18,2))) AS DOUBLE) AS total_spend,
  round(CAST(sum(CAST(total_spend * supply_risk_score AS DECIMAL(28,6))) AS DOUBLE), 2) AS spend_at_risk FROM labelled JOIN spend USING (vendor_id) GROUP BY 1"""))
def spend_at_risk(spark, d):
    spend = saved(C.spend(C.transactions(spark, d)))
    rows = base_risk(spark, d, spend).withColumnRenamed("supply_risk_score", "composite_risk_score").join(spend, "vendor_id")
    return S.spend_at_risk(rows)


@query(sql(*ST, VENDORS, DELIVERIES, OTIF, BASE_RISK, select="SELECT vendor_id, supplier_name, supply_risk_score, risk_label FROM labelled JOIN vendors USING (vendor_id) WHERE risk_label = 'Medium'"))
def vendors_by_risk(spark, d):
    """R3, F1."""
    return base_risk(spark, d).filter("risk_label = 'Medium'").join(C.vendors(spark, d).select("vendor_id", "supplier_name"), "vendor_id")


@query(sql(*ST, VENDORS, DELIVERIES, OTIF, BASE_RISK, select="SELECT country, risk_label, count(*) AS vendors, CAST(grouping(country) * 2 + grouping(risk_label) AS BIGINT) AS level FROM labelled JOIN vendors USING (vendor_id) GROUP BY CUBE (country, risk_label)"))
def risk_cube(spark, d):
    """A21."""
    rows = base_risk(spark, d).join(C.vendors(spark, d), "vendor_id")
    return rows.cube("country", "risk_label").agg(F.count("*").alias("vendors"), F.grouping_id().cast("long").alias("level"))


EVALUATION = """one AS (SELECT vendor_id, round(sum(on_time) / count(*) * 100, 4) AS ottr_rate, CASE WHEN count(*) >= 3 THEN round(stddev_samp(delay_days), 4) END AS lead_time_variability,
    round(CAST(sum(CAST(least(actual_qty / promised_qty, 1) AS DECIMAL(18,12))) AS DOUBLE) / count(*) * 100, 4) AS order_accuracy_rate FROM deliveries GROUP BY 1),
  price AS (SELECT vendor_id, material_number, min(unit_price) AS lo, max(unit_price) AS hi, CAST(sum(CAST(unit_price AS DECIMAL(28,10))) AS DOUBLE) / count(*) AS mean FROM transactions WHERE unit_price > 0 GROUP BY 1, 2 HAVING max(unit_price) > min(unit_price)),
  two AS (SELECT vendor_id, round(CAST(sum(CAST((hi - lo) / mean * 100 AS DECIMAL(28,10))) AS DOUBLE) / count(*), 4) AS avg_price_variance_pct FROM price GROUP BY 1),
  metrics AS (SELECT * FROM one FULL JOIN two USING (vendor_id))"""


def _evaluation(spark, d):
    return D.evaluation(C.deliveries(spark, d), C.transactions(spark, d))


@query(sql(TRANSACTIONS, DELIVERIES, EVALUATION, select="SELECT * FROM metrics"))
def evaluation_metrics(spark, d):
    return _evaluation(spark, d)


@query(sql(TRANSACTIONS, DELIVERIES, EVALUATION, select="""SELECT vendor_id, metric, value, CASE metric WHEN 'ottr_rate' THEN 95.0 ELSE 98.0 END::DOUBLE AS target, value >= CASE metric WHEN 'ottr_rate' THEN 95.0 ELSE 98.0 END AS met
  FROM (SELECT vendor_id, 'ottr_rate' AS metric, ottr_rate AS value FROM metrics UNION ALL SELECT vendor_id, 'order_accuracy_rate', order_accuracy_rate FROM metrics) WHERE value IS NOT NULL"""))
def scorecard(spark, d):
    return D.scorecard(_evaluation(spark, d))


@query(sql(TRANSACTIONS, DELIVERIES, EVALUATION, "long AS (UNPIVOT metrics ON ottr_rate, lead_time_variability, order_accuracy_rate, avg_price_variance_pct INTO NAME metric VALUE value)",
           select="SELECT metric, count(value) AS covered, round(CAST(sum(CAST(value AS DECIMAL(28,10))) AS DOUBLE) / count(value), 4) AS mean FROM long GROUP BY 1"))
def metric_coverage(spark, d):
    return D.metric_coverage(_evaluation(spark, d))


