"""Delivery, contract and evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procuris.functions import params as P
from procuris.functions.columns import country_risk, total
from procuris.operators.relational import with_totals


def otif(events: DataFrame) -> DataFrame:
    """On-time-in-full rate, mean delay, deliveries and delivery performance of each vendor."""
    rate = F.sum("otif") / F.count("*")
    return events.groupBy("vendor_id").agg(F.count("*").alias("total_deliveries"), F.round(rate, 6).alias("otif_rate"), F.round(F.sum("delay_days") / F.count("*"), 4).alias("avg_delay_days"),
                                           F.round(rate * 100, 4).alias("delivery_performance"))


def otif_summary(events: DataFrame) -> DataFrame:
    """Deliveries, rates, mean delay of late ones and significant delays of each vendor."""
    n, late = F.count("*"), F.col("delay_days") > 0
    return events.groupBy("vendor_id").agg(
        n.alias("deliveries"), F.round(F.sum("on_time") / n, 6).alias("on_time_rate"), F.round(F.sum("in_full") / n, 6).alias("in_full_rate"), F.round(F.sum("otif") / n, 6).alias("otif_rate"),
        F.round(F.sum(F.when(late, F.col("delay_days"))) / F.count_if(late), 4).alias("mean_late_days"), F.count_if(F.col("delay_days") > P.SIGNIFICANT_DELAY).alias("significant_delays"))


def financial_stability(spend: DataFrame) -> DataFrame:
    """50 ln(spend) / ln(max) + 30 count / max + 20, held between 20 and 95."""
    rows = with_totals(spend, _spend=F.max("total_spend"), _count=F.max("tx_count"))
    raw = 50 * F.try_divide(F.ln(F.greatest("total_spend", F.lit(1.0))), F.ln(F.greatest("_spend", F.lit(1.0)))) + 30 * F.try_divide("tx_count", "_count") + 20
    return rows.select("vendor_id", F.round(F.least(F.lit(95.0), F.greatest(F.lit(20.0), F.coalesce(raw, F.lit(20.0)))), 4).alias("financial_stability"))


def base_supply_risk(rows: DataFrame) -> DataFrame:
    """0.30 geography + 0.25 (1 - otif, or 0.75) + 0.20 (0.8 above a tenth of spend, else 0.2) + 0.25 half; labels at 0.65 and 0.35.

    rows: vendor_id, country_code, otif_rate, share (a fraction).
    """
    risk = (0.30 * country_risk("country_code") + 0.25 * (1 - F.coalesce("otif_rate", F.lit(0.75))) + 0.20 * F.when(F.col("share") > 0.10, 0.8).otherwise(0.2) + 0.25 * 0.5)
    risk = F.round(risk, 4)
    return rows.select("vendor_id", risk.alias("supply_risk_score"), F.when(risk >= P.LOADER_HIGH, "High").when(risk >= P.LOADER_MEDIUM, "Medium").otherwise("Low").alias("risk_label"))


def evaluation(events: DataFrame, transactions: DataFrame) -> DataFrame:
    """On-time rate, deviation of delays (of three deliveries on), order accuracy, and the spread of prices in percent."""
    kept = events.filter(F.col("promised_date").isNotNull() & F.col("actual_date").isNotNull())
    spread = F.when(F.count("*") >= 3, F.round(F.stddev_samp("delay_days"), 4))
    accuracy = F.avg(F.least(F.try_divide("actual_qty", "promised_qty"), F.lit(1.0)).cast("decimal(18,12)")).cast("double")
    one = kept.groupBy("vendor_id").agg(F.round(F.sum("on_time") / F.count("*") * 100, 4).alias("ottr_rate"), spread.alias("lead_time_variability"), F.round(accuracy * 100, 4).alias("order_accuracy_rate"))
    price = transactions.filter("unit_price > 0").groupBy("vendor_id", "material_number").agg(
        F.min("unit_price").alias("lo"), F.max("unit_price").alias("hi"), (F.sum(F.col("unit_price").cast("decimal(28,10)")) / F.count("*")).cast("double").alias("mean")).filter("hi > lo")
    two = price.groupBy("vendor_id").agg(F.round(F.avg(((F.col("hi") - F.col("lo")) / F.col("mean") * 100).cast("decimal(28,10)")).cast("double"), 4).alias("avg_price_variance_pct"))
    return one.join(two, "vendor_id", "full")


def scorecard(metrics: DataFrame) -> DataFrame:
    """(vendor_id, metric, value, target, met): metrics against their targets, and flags of high variance."""
    targets = {"ottr_rate": 95.0, "order_accuracy_rate": 98.0}
    long = metrics.select("vendor_id", *targets).unpivot("vendor_id", list(targets), "metric", "value")
    aim = F.create_map(*(F.lit(x) for kv in targets.items() for x in kv))[F.col("metric")]
    return long.filter(F.col("value").isNotNull()).select("vendor_id", "metric", "value", aim.alias("target"), (F.col("value") >= aim).alias("met"))


def metric_coverage(metrics: DataFrame) -> DataFrame:
    """How many vendors have each metric, and its mean."""
    names = [c for c in metrics.columns if c != "vendor_id"]
    long = metrics.unpivot("vendor_id", names, "metric", "value")
    return long.groupBy("metric").agg(F.count("value").alias("covered"), F.round(F.avg(F.col("value").cast("decimal(28,10)")).cast("double"), 4).alias("mean"))


def expiring(contracts: DataFrame, vendors: DataFrame, spend: DataFrame, days: int) -> DataFrame:
    """Contracts that end within so many days, with the vendor and its spend."""
    rows = contracts.filter(F.col("days_to_expiry").between(0, days))
    return rows.join(vendors.select("vendor_id", "supplier_name"), "vendor_id", "left").join(spend.select("vendor_id", "total_spend"), "vendor_id", "left").select(
        "contract_number", "vendor_id", "supplier_name", "contract_end", "days_to_expiry", "contract_status", "total_spend")


def status_totals(contracts: DataFrame, spend: DataFrame) -> DataFrame:
    return contracts.join(spend, "vendor_id", "left").groupBy("contract_status").agg(F.count("*").alias("contracts"), F.coalesce(total("total_spend"), F.lit(0.0)).alias("spend"))
