"""Spend operators: management, off-contract, concentration, trends, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procuris.functions import params as P
from procuris.functions.columns import binned, mapped, total
from procuris.operators.relational import latest_per_key, running, with_totals


def active_vendors(contracts: DataFrame) -> DataFrame:
    """Vendors with a contract that has not expired."""
    return contracts.filter(F.col("contract_status") != "Expired").select("vendor_id").distinct().withColumn("_active", F.lit(True))


def flag_active(df: DataFrame, contracts: DataFrame) -> DataFrame:
    """Df with under_contract, by a left join whose unmatched rows count as false."""
    return df.join(active_vendors(contracts), "vendor_id", "left").withColumn("under_contract", F.coalesce("_active", F.lit(False))).drop("_active")


def share_of_total(spend: DataFrame) -> DataFrame:
    """Spend with share, a fraction of the total."""
    return with_totals(spend, _all=total("total_spend")).withColumn("share", F.try_divide("total_spend", "_all")).drop("_all")


def under_management(spend: DataFrame, contracts: DataFrame) -> DataFrame:
    """B1: managed spend and the gap of each vendor, in percent."""
    rows = flag_active(spend, contracts)
    managed = F.when(F.col("under_contract"), F.col("total_spend")).otherwise(0.0)
    return rows.select("vendor_id", "total_spend", "under_contract", managed.alias("managed_spend"), F.when(F.col("under_contract"), 100.0).otherwise(0.0).alias("sum_percentage"),
                       (F.col("total_spend") - managed).alias("contract_gap"))


def management_summary(managed: DataFrame) -> DataFrame:
    """B1: the portfolio's share under contract against the target."""
    pct = F.round(F.sum(F.col("managed_spend").cast("decimal(18,2)")).cast("double") / total("total_spend") * 100, 4)
    return managed.agg(total("total_spend").alias("total_spend"), total("managed_spend").alias("managed_spend"), pct.alias("sum_pct"), (pct >= P.SUM_TARGET).alias("target_met"))


def maverick(spend: DataFrame, contracts: DataFrame) -> DataFrame:
    """B2: spend without an active contract, its kind by the 75th percentile of all spend and single lines, and savings."""
    rows = with_totals(flag_active(spend, contracts), _p75=F.percentile("total_spend", 0.75))
    kind = (F.when(F.col("under_contract"), "Contracted").when(F.col("total_spend") > F.col("_p75"), "Off-Contract (High Value)")
            .when(F.col("tx_count") == 1, "Emergency / One-Off").otherwise("Off-Contract (Regular)"))
    rows = rows.withColumn("maverick_type", kind)
    return rows.select("vendor_id", "total_spend", "tx_count", (~F.col("under_contract")).alias("is_maverick"), "maverick_type",
                       F.round(F.col("total_spend") * P.ADDRESSABLE * mapped("maverick_type", P.SAVINGS_RATE, 0.0), 2).alias("savings_opportunity"))


def concentration(spend: DataFrame, high: float = P.CONCENTRATION_HIGH, medium: float = P.CONCENTRATION_MEDIUM) -> DataFrame:
    """Each vendor's share in percent, its average rank cut to a whole number, tier and flag."""
    rows = running(share_of_total(spend), "total_spend", "vendor_id")
    ties = Window.partitionBy("total_spend")
    rank = F.min("row_rank").over(ties) + (F.count("*").over(ties) - 1) / 2
    pct = F.col("share") * 100
    tier = F.when(pct >= high, "HIGH").when(pct >= medium, "MEDIUM").otherwise("LOW")
    return rows.select("vendor_id", "total_spend", F.round(pct, 4).alias("share_pct"), F.floor(rank).cast("int").alias("spend_rank"), tier.alias("concentration_risk"),
                       F.when(pct >= high, 1).otherwise(0).alias("diversification_needed"))


def concentration_summary(spend: DataFrame) -> DataFrame:
    """Herfindahl index and the shares of the first 1, 5 and 10 vendors with their limits."""
    rows = running(share_of_total(spend), "total_spend", "vendor_id")
    pct = F.col("share") * 100

    def top(n: int) -> Column:
        return F.sum(F.when(F.col("row_rank") <= n, F.col("total_spend").cast("decimal(18,2)"))).cast("double") / total("total_spend")

    one = rows.agg(F.sum((pct * pct).cast("decimal(28,12)")).cast("double").alias("_hhi"), *(top(n).alias(f"_top{n}") for n in (1, 5, 10)))
    hhi = F.col("_hhi")
    return one.select(F.round(hhi, 2).alias("hhi"), F.when(hhi >= P.HHI_MODERATE, "High").when(hhi >= P.HHI_HEALTHY, "Moderate").otherwise("Healthy").alias("hhi_status"),
                      *(F.round(F.col(f"_top{n}") * 100, 4).alias(f"top{n}_pct") for n in (1, 5, 10)),
                      (F.col("_top1") > P.TOP1_MAX).alias("top1_over"), (F.col("_top5") > P.TOP5_MAX).alias("top5_over"), (F.col("_top10") > P.TOP10_MAX).alias("top10_over"))


def quarter_trend(transactions: DataFrame) -> DataFrame:
    """Each vendor's latest quarter, its change on the quarter row before in percent and the trend."""
    rows = transactions.groupBy("vendor_id", "year", "quarter").agg(total("transaction_amount").alias("spend"))
    before = F.lag("spend").over(Window.partitionBy("vendor_id").orderBy("year", "quarter"))
    change = F.round(F.try_divide(F.col("spend") - before, before) * 100, 4)
    rows = rows.withColumn("qoq_change_pct", change)
    rows = rows.withColumn("spend_trend", F.coalesce(binned("qoq_change_pct", [-10.0, 10.0], ["Decreasing", "Stable", "Increasing"]), F.lit("Stable")))
    return latest_per_key(rows, ["vendor_id"], [F.desc("year"), F.desc("quarter")])


def by_category(transactions: DataFrame, contracts: DataFrame, high_risk: DataFrame) -> DataFrame:
    """Spend of each material group, with what is off contract, with vendors of high risk, and savings."""
    group = F.coalesce(F.nullif(F.trim("material_group"), F.lit("")), F.lit("Unclassified")).alias("material_group")
    # first one row for each group and vendor, then the vendor's flags
    rows = transactions.filter("transaction_amount > 0").groupBy(group, "vendor_id").agg(F.sum(F.col("transaction_amount").cast("decimal(18,2)")).alias("s"), F.count("*").alias("n"))
    rows = flag_active(rows, contracts).join(high_risk.select("vendor_id").distinct().withColumn("_high", F.lit(True)), "vendor_id", "left")
    off = ~F.col("under_contract")
    out = rows.groupBy("material_group").agg(
        F.count("*").alias("vendor_count"), F.sum("n").alias("transaction_count"), F.sum("s").cast("double").alias("total_spend"), F.count_if(off).alias("maverick_vendor_count"),
        F.coalesce(F.sum(F.when(off, F.col("s"))).cast("double"), F.lit(0.0)).alias("maverick_spend"), F.coalesce(F.sum(F.when(F.col("_high"), F.col("s"))).cast("double"), F.lit(0.0)).alias("high_risk_spend"))
    out = with_totals(out, _all=total("total_spend"))
    return out.select("material_group", "vendor_count", "transaction_count", "total_spend", "maverick_vendor_count", "maverick_spend", "high_risk_spend",
                      F.round(F.col("total_spend") / F.col("_all") * 100, 4).alias("spend_pct"), F.round(F.col("maverick_spend") / F.col("total_spend") * 100, 4).alias("maverick_pct"),
                      F.round(F.col("maverick_spend") * P.ADDRESSABLE * P.CATEGORY_SAVINGS_RATE, 2).alias("savings_opportunity"))


def spend_report(managed: DataFrame, off: DataFrame, portfolio: DataFrame, trend: DataFrame) -> DataFrame:
    """The portfolio's figures in one row."""
    one = management_summary(managed).select("total_spend", "sum_pct")
    two = off.agg(F.count_if(F.col("is_maverick")).alias("maverick_vendors"), F.round(total("savings_opportunity"), 2).alias("savings"))
    three = trend.agg(*(F.count_if(F.col("spend_trend") == t).alias(t.lower()) for t in ("Increasing", "Stable", "Decreasing")))
    return one.crossJoin(two).crossJoin(portfolio.select("hhi", "hhi_status")).crossJoin(three)


def spend_metrics(managed: DataFrame, off: DataFrame, concentrated: DataFrame, trend: DataFrame) -> DataFrame:
    """The metrics of every vendor that any of the tables knows, in full outer joins."""
    out = managed.select("vendor_id", "sum_percentage", "contract_gap")
    for part in (off.select("vendor_id", "is_maverick", "maverick_type", "savings_opportunity"), concentrated.select("vendor_id", "share_pct", "concentration_risk"), trend.select("vendor_id", "qoq_change_pct", "spend_trend")):
        out = out.join(part, "vendor_id", "full")
    return out


def category_shares(transactions: DataFrame, vendors: DataFrame) -> DataFrame:
    """Each vendor's share of its category and of all, in percent."""
    from procuris.sources.curate import spend

    rows = spend(transactions).join(vendors.select("vendor_id", "industry_category"), "vendor_id")
    sums = rows.groupBy("industry_category").agg(total("total_spend").alias("_category"))
    rows = with_totals(rows.join(sums, "industry_category"), _all=total("total_spend"))
    return rows.select("vendor_id", "industry_category", F.round(F.col("total_spend") / F.col("_category") * 100, 4).alias("category_share_pct"), F.round(F.col("total_spend") / F.col("_all") * 100, 4).alias("enterprise_share_pct"))


def supplier_summary(metrics: DataFrame) -> DataFrame:
    """Vendors with the rule that asks for diversification: little under contract, off contract, or a large share."""
    needed = (F.coalesce("sum_percentage", F.lit(0.0)) < 75) | F.coalesce("is_maverick", F.lit(False)) | (F.coalesce("share_pct", F.lit(0.0)) > 15)
    return metrics.select("vendor_id", "sum_percentage", "is_maverick", "share_pct", needed.alias("diversify"))


def large_lines(transactions: DataFrame, k: float = 2.0) -> DataFrame:
    """Per vendor the lines above k times the vendor's mean, which count as off contract."""
    mean = total("transaction_amount") / F.count("*")
    means = transactions.groupBy("vendor_id").agg(mean.alias("_mean"))
    rows = transactions.join(means, "vendor_id").filter(F.col("transaction_amount") > k * F.col("_mean"))
    return rows.groupBy("vendor_id").agg(F.count("*").alias("large_lines"), total("transaction_amount").alias("large_spend"))


def abc(spend: DataFrame, a: float = P.ABC_A, b: float = P.ABC_B) -> DataFrame:
    """Class A up to a share `a` of cumulative spend, B up to `b`, else C; ties by vendor."""
    rows = running(with_totals(spend, _all=total("total_spend")), "total_spend", "vendor_id")
    cum = F.col("running").cast("double") / F.col("_all")
    return rows.select("vendor_id", "total_spend", F.col("row_rank").cast("long").alias("spend_rank"), F.round(cum, 6).alias("cum_spend_pct"),
                       F.when(cum <= a, "A").when(cum <= b, "B").otherwise("C").alias("abc_class"))


def spend_at_risk(rows: DataFrame) -> DataFrame:
    """Spend times risk by label; rows: vendor_id, total_spend, composite_risk_score, risk_label."""
    at_risk = (F.col("total_spend") * F.col("composite_risk_score")).cast("decimal(28,6)")
    return rows.groupBy("risk_label").agg(F.count("*").alias("vendors"), total("total_spend").alias("total_spend"), F.round(F.sum(at_risk).cast("double"), 2).alias("spend_at_risk"))


def next_quarter(transactions: DataFrame, cap: float = 0.5) -> DataFrame:
    """Next quarter's spend of a vendor: the last quarter times its growth on the one before, capped; flat without one."""
    rows = transactions.groupBy("vendor_id", "year", "quarter").agg(total("transaction_amount").alias("spend"))
    before = F.lag("spend").over(Window.partitionBy("vendor_id").orderBy("year", "quarter"))
    rows = latest_per_key(rows.withColumn("previous", before), ["vendor_id"], [F.desc("year"), F.desc("quarter")])
    growth = F.coalesce(F.greatest(F.lit(-cap), F.least(F.lit(cap), F.try_divide(F.col("spend") - F.col("previous"), F.col("previous")))), F.lit(0.0))
    return rows.select("vendor_id", "spend", "previous", F.round(growth, 6).alias("growth"), F.round(F.col("spend") * (1 + growth), 4).alias("forecast"))


def shift_spend(spend: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Scenarios (from_id, to_id, pct): a share of one vendor's spend goes to another; new spends and shares of all."""
    rows = share_of_total(spend).select("vendor_id", "total_spend", "share")
    giver, taker = (rows.select(F.col("vendor_id").alias(f"{k}_id"), F.col("total_spend").alias(f"{k}_spend"), F.col("share").alias(f"{k}_share")) for k in ("from", "to"))
    out = scenarios.join(giver, "from_id").join(taker, "to_id")
    moved, part = F.col("from_spend") * F.col("pct") / 100, F.col("from_share") * F.col("pct") / 100
    return out.select("from_id", "to_id", "pct", F.round(moved, 4).alias("moved"), F.round(F.col("from_spend") - moved, 4).alias("from_after"), F.round(F.col("to_spend") + moved, 4).alias("to_after"),
                      F.round((F.col("from_share") - part) * 100, 4).alias("from_share_pct"), F.round((F.col("to_share") + part) * 100, 4).alias("to_share_pct"))


def loss_impact(spend: DataFrame) -> DataFrame:
    """What losing a vendor exposes, in percent of all spend, with bands at 10 and 5."""
    pct = F.col("share") * 100
    return share_of_total(spend).select("vendor_id", F.round(pct, 4).alias("exposure_pct"), F.when(pct >= 10, "Critical").when(pct >= 5, "High").when(pct >= 1, "Moderate").otherwise("Low").alias("impact"))
