"""Cards of vendors and figures of the portfolio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procuris.operators.features import kraljic

QUADRANTS = ("Strategic", "Bottleneck", "Leverage", "Tactical")


def narrative(tier: str, driver: str, stability: str, delivery: str, mitigator: str) -> Column:
    """A card's sentences; what is not known is left out."""
    whole = lambda c: F.round(F.col(c)).cast("int").cast("string")
    return F.concat(F.lit("This supplier is classified as "), F.col(tier), F.lit(" risk, primarily driven by "), F.col(driver), F.lit("."), F.coalesce(F.concat(F.lit(" Financial stability: "), whole(stability), F.lit("/100.")), F.lit("")),
                    F.coalesce(F.concat(F.lit(" Delivery performance (OTIF): "), whole(delivery), F.lit("%.")), F.lit("")), F.coalesce(F.concat(F.lit(" Mitigating factor: "), F.col(mitigator), F.lit(".")), F.lit("")))


def risk_cards(rows: DataFrame, drivers: DataFrame, contracts: DataFrame) -> DataFrame:
    """A card for each vendor of the matrix: figures, segment, contracts in force, the first of its drivers (vendor_id, feature,
    contribution, driver) and mitigators, and a narrative. All parts are reduced to a row a vendor before they are joined."""
    eases = F.col("contribution") < 0
    pushed = drivers.groupBy("vendor_id").agg(F.min_by("feature", "driver").alias("driver"), F.min_by(F.when(eases, F.col("feature")), F.when(eases, F.col("driver"))).alias("mitigator"))
    held = contracts.filter("contract_status <> 'Expired'").groupBy("vendor_id").agg(F.count("*").alias("contracts"), F.min_by("contract_number", F.struct("contract_end", "contract_number")).alias("first_contract"))
    out = kraljic(rows).join(pushed, "vendor_id").join(held, "vendor_id", "left")
    return out.select("vendor_id", "supplier_name", F.col("risk_label_3class").alias("tier"), F.col("composite_risk_score").alias("score"), F.round("total_spend", 2).alias("total_spend"), F.round(F.col("spend_share") * 100, 4).alias("spend_pct"), "otif_rate", "financial_stability",
                      F.col("disruption_count_30d").alias("disruptions"), F.col("kraljic_segment").alias("quadrant"), F.coalesce("contracts", F.lit(0)).alias("contracts"), "first_contract", "driver", narrative("risk_label_3class", "driver", "financial_stability", "delivery_performance", "mitigator").alias("narrative"))


def compared(rows: DataFrame, asked: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """(a_id, b_id, metric, a, b, safer): asked pairs (a_id, b_id) of vendors, a row for each metric (column to its name), and the name of the one with the lower risk; b's where they are equal."""
    long = F.map_from_arrays(F.array(*map(F.lit, metrics.values())), F.array(*(F.col(c).cast("double") for c in metrics)))
    one = rows.select("vendor_id", "supplier_name", "composite_risk_score", long.alias("figures"))
    a, b = (one.select(*(F.col(c).alias(f"{s}_{c}") for c in one.columns)) for s in ("a", "b"))
    pairs = asked.join(a, F.col("a_id") == F.col("a_vendor_id")).join(b, F.col("b_id") == F.col("b_vendor_id"))
    safer = F.when(F.col("a_composite_risk_score") < F.col("b_composite_risk_score"), F.col("a_supplier_name")).otherwise(F.col("b_supplier_name"))
    each = pairs.select("a_id", "b_id", safer.alias("safer"), "b_figures", F.explode("a_figures").alias("metric", "a"))
    return each.select("a_id", "b_id", "metric", "a", F.element_at("b_figures", F.col("metric")).alias("b"), "safer")


def portfolio(rows: DataFrame, drivers: DataFrame, riskiest: int = 3) -> DataFrame:
    """One row: vendors, vendors of each quadrant, the riskiest ids and the driver of most weight over all."""
    placed = kraljic(rows)
    counts = placed.agg(F.count("*").alias("vendors"), *(F.count_if(F.col("kraljic_segment") == q).alias(q.lower()) for q in QUADRANTS))
    first = placed.select("vendor_id", "composite_risk_score").orderBy(F.desc("composite_risk_score"), "vendor_id").limit(riskiest)
    named = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("composite_risk_score")).alias("s"), "vendor_id"))), lambda x: x["vendor_id"].cast("string")), ",").alias("riskiest"))
    weight = drivers.groupBy("feature").agg(F.round(F.sum(F.abs("contribution").cast("decimal(28,12)")).cast("double"), 6).alias("w"))
    top = weight.agg(F.min_by("feature", F.struct((-F.col("w")).alias("w"), "feature")).alias("top_driver"))
    return counts.crossJoin(F.broadcast(named)).crossJoin(F.broadcast(top))  # one row each
