"""Spend queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from procuris.functions.columns import shown_money, total
from procuris.operators import spend as S
from procuris.operators.relational import top_n
from procuris.plans.registry import query
from procuris.plans.tables import ACTIVE, CONTRACTS, SPEND, TRANSACTIONS, VENDORS, sql
from procuris.sources import curate as C
from procuris.sources.shared import saved

T, ST = (TRANSACTIONS,), (TRANSACTIONS, SPEND)
STC = (TRANSACTIONS, SPEND, CONTRACTS, ACTIVE)
CENTS = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


def _spend(spark, d, more=True):
    """Spend by vendor; saved where it is read more than once."""
    rows = C.spend(C.transactions(spark, d))
    return saved(rows) if more else rows


@query(sql(*T, select=f"""SELECT vendor_id, {CENTS.format('transaction_amount')} AS total_spend, count(*) AS tx_count,
  round({CENTS.format('transaction_amount')} / count(*), 4) AS avg_amount, round(stddev_samp(transaction_amount), 2) AS std_amount, min(po_date) AS first_date, max(po_date) AS last_date,
  count(DISTINCT year_quarter) AS active_quarters FROM transactions GROUP BY vendor_id"""))
def vendor_spend_rollup(spark, d):
    t = C.transactions(spark, d)
    return t.groupBy("vendor_id").agg(
        total("transaction_amount").alias("total_spend"), F.count("*").alias("tx_count"), F.round(total("transaction_amount") / F.count("*"), 4).alias("avg_amount"),
        F.round(F.stddev_samp("transaction_amount"), 2).alias("std_amount"), F.min("po_date").alias("first_date"), F.max("po_date").alias("last_date"), F.countDistinct("year_quarter").alias("active_quarters"))


@query(sql(*ST, select="SELECT vendor_id, total_spend, tx_count, round(total_spend / sum(CAST(total_spend AS DECIMAL(18,2))) OVER (), 10) AS share FROM spend"))
def vendor_share(spark, d):
    return S.share_of_total(_spend(spark, d)).withColumn("share", F.round("share", 10))


@query(sql(*STC, VENDORS, select=f"""SELECT count(*) AS vendors, count(s.vendor_id) AS vendors_with_spend, {CENTS.format('total_spend')} AS total_spend, CAST(sum(tx_count) AS BIGINT) AS transactions,
  count(a.vendor_id) AS under_contract, count(DISTINCT country) AS countries FROM vendors v LEFT JOIN spend s ON v.vendor_id = s.vendor_id LEFT JOIN active a ON v.vendor_id = a.vendor_id"""))
def portfolio_summary(spark, d):
    rows = C.vendors(spark, d).join(_spend(spark, d, more=False), "vendor_id", "left").join(S.active_vendors(C.contracts(spark, d)), "vendor_id", "left")
    return rows.agg(F.count("*").alias("vendors"), F.count("total_spend").alias("vendors_with_spend"), total("total_spend").alias("total_spend"), F.sum("tx_count").alias("transactions"),
                    F.count("_active").alias("under_contract"), F.countDistinct("country").alias("countries"))


ABC = """abc AS (SELECT vendor_id, total_spend, row_number() OVER (ORDER BY total_spend DESC, vendor_id) AS spend_rank,
    CAST(sum(CAST(total_spend AS DECIMAL(18,2))) OVER (ORDER BY total_spend DESC, vendor_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(CAST(total_spend AS DECIMAL(18,2))) OVER () AS DOUBLE) AS cum FROM spend),
  classed AS (SELECT *, CASE WHEN cum <= 0.7::DOUBLE THEN 'A' WHEN cum <= 0.9::DOUBLE THEN 'B' ELSE 'C' END AS abc_class FROM abc)"""


@query(sql(*ST, ABC, select="SELECT vendor_id, total_spend, spend_rank, round(cum, 6) AS cum_spend_pct, abc_class FROM classed"))
def abc_classification(spark, d):
    return S.abc(_spend(spark, d))


@query(sql(*ST, ABC, select=f"SELECT abc_class, count(*) AS vendors, {CENTS.format('total_spend')} AS total_spend FROM classed GROUP BY abc_class"))
def abc_totals(spark, d):
    return S.abc(_spend(spark, d)).groupBy("abc_class").agg(F.count("*").alias("vendors"), total("total_spend").alias("total_spend"))


SHARE = "shares AS (SELECT *, total_spend / CAST(sum(CAST(total_spend AS DECIMAL(18,2))) OVER () AS DOUBLE) * 100 AS pct FROM spend)"


@query(sql(*ST, SHARE, select="""SELECT vendor_id, total_spend, round(pct, 4) AS share_pct, CAST(floor(rank() OVER (ORDER BY total_spend DESC) + (count(*) OVER (PARTITION BY total_spend) - 1) / 2.0) AS INT) AS spend_rank,
  CASE WHEN pct >= 1.05::DOUBLE THEN 'HIGH' WHEN pct >= 1.0::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS concentration_risk, CASE WHEN pct >= 1.05::DOUBLE THEN 1 ELSE 0 END AS diversification_needed FROM shares"""))
def concentration_vendor(spark, d):
    return S.concentration(_spend(spark, d), high=1.05, medium=1.0)


@query(sql(*ST, SHARE, "r AS (SELECT *, row_number() OVER (ORDER BY total_spend DESC, vendor_id) AS n FROM shares)",
           """o AS (SELECT CAST(sum(CAST(pct * pct AS DECIMAL(28,12))) AS DOUBLE) AS h, CAST(sum(CAST(total_spend AS DECIMAL(18,2))) AS DOUBLE) AS t,
    CAST(sum(CASE WHEN n <= 1 THEN CAST(total_spend AS DECIMAL(18,2)) END) AS DOUBLE) AS a, CAST(sum(CASE WHEN n <= 5 THEN CAST(total_spend AS DECIMAL(18,2)) END) AS DOUBLE) AS b,
    CAST(sum(CASE WHEN n <= 10 THEN CAST(total_spend AS DECIMAL(18,2)) END) AS DOUBLE) AS c FROM r)""",
           select="""SELECT round(h, 2) AS hhi, CASE WHEN h >= 2500 THEN 'High' WHEN h >= 1500 THEN 'Moderate' ELSE 'Healthy' END AS hhi_status, round(a / t * 100, 4) AS top1_pct, round(b / t * 100, 4) AS top5_pct,
  round(c / t * 100, 4) AS top10_pct, a / t > 0.1::DOUBLE AS top1_over, b / t > 0.4::DOUBLE AS top5_over, c / t > 0.65::DOUBLE AS top10_over FROM o"""))
def concentration_portfolio(spark, d):
    return S.concentration_summary(_spend(spark, d))


MANAGED = "managed AS (SELECT s.*, a.vendor_id IS NOT NULL AS under_contract FROM spend s LEFT JOIN active a ON s.vendor_id = a.vendor_id)"


@query(sql(*STC, MANAGED, select="""SELECT vendor_id, total_spend, under_contract, CASE WHEN under_contract THEN total_spend ELSE 0 END AS managed_spend,
  CASE WHEN under_contract THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS sum_percentage, CASE WHEN under_contract THEN 0 ELSE total_spend END AS contract_gap FROM managed"""))
def spend_under_management(spark, d):
    return S.under_management(_spend(spark, d, more=False), C.contracts(spark, d))


@query(sql(*STC, MANAGED, "o AS (SELECT CAST(sum(CAST(total_spend AS DECIMAL(18,2))) AS DOUBLE) AS t, CAST(sum(CASE WHEN under_contract THEN CAST(total_spend AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS m FROM managed)",
           select="SELECT t AS total_spend, m AS managed_spend, round(m / t * 100, 4) AS sum_pct, m / t * 100 >= 80 AS target_met FROM o"))
def spend_management_summary(spark, d):
    return S.management_summary(S.under_management(_spend(spark, d, more=False), C.contracts(spark, d)))


MAVERICK = """maverick AS (SELECT vendor_id, total_spend, tx_count, NOT under_contract AS is_maverick, CASE WHEN under_contract THEN 'Contracted'
    WHEN total_spend > (SELECT quantile_cont(total_spend, 0.75) FROM spend) THEN 'Off-Contract (High Value)' WHEN tx_count = 1 THEN 'Emergency / One-Off' ELSE 'Off-Contract (Regular)' END AS maverick_type FROM managed),
  saved AS (SELECT *, round(total_spend * 0.4::DOUBLE * CASE maverick_type WHEN 'Contracted' THEN 0.0 WHEN 'Off-Contract (High Value)' THEN 0.2 WHEN 'Emergency / One-Off' THEN 0.25 ELSE 0.15 END::DOUBLE, 2) AS savings_opportunity FROM maverick)"""


@query(sql(*STC, MANAGED, MAVERICK, select="SELECT * FROM saved"))
def maverick_spend(spark, d):
    return S.maverick(_spend(spark, d), C.contracts(spark, d))


@query(sql(*STC, MANAGED, MAVERICK, select="SELECT maverick_type, count(*) AS vendors, CAST(sum(CAST(total_spend AS DECIMAL(18,2))) AS DOUBLE) AS total_spend, CAST(sum(CAST(savings_opportunity AS DECIMAL(18,2))) AS DOUBLE) AS savings FROM saved GROUP BY 1"))
def maverick_report(spark, d):
    """R24."""
    return S.maverick(_spend(spark, d), C.contracts(spark, d)).groupBy("maverick_type").agg(F.count("*").alias("vendors"), total("total_spend").alias("total_spend"), total("savings_opportunity").alias("savings"))


CATEGORY = """cat AS (SELECT coalesce(nullif(trim(material_group), ''), 'Unclassified') AS material_group, count(DISTINCT t.vendor_id) AS vendor_count, count(*) AS transaction_count, CAST(sum(CAST(transaction_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_spend,
    count(DISTINCT CASE WHEN a.vendor_id IS NULL THEN t.vendor_id END) AS maverick_vendor_count,
    coalesce(CAST(sum(CASE WHEN a.vendor_id IS NULL THEN CAST(transaction_amount AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS maverick_spend,
    coalesce(CAST(sum(CASE WHEN s.s_acctbal < 0 THEN CAST(transaction_amount AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS high_risk_spend
  FROM transactions t LEFT JOIN active a ON t.vendor_id = a.vendor_id JOIN supplier s ON t.vendor_id = s.s_suppkey WHERE transaction_amount > 0 GROUP BY 1)"""
CATEGORY_OUT = """SELECT *, round(total_spend / CAST(sum(CAST(total_spend AS DECIMAL(18,2))) OVER () AS DOUBLE) * 100, 4) AS spend_pct, round(maverick_spend / total_spend * 100, 4) AS maverick_pct,
  round(maverick_spend * 0.4::DOUBLE * 0.18::DOUBLE, 2) AS savings_opportunity FROM cat"""


def _categories(spark, d):
    high = C.vendors(spark, d).filter("balance < 0")
    return S.by_category(C.transactions(spark, d, with_group=True), C.contracts(spark, d), high)


@query(sql(*T, CONTRACTS, ACTIVE, CATEGORY, select=CATEGORY_OUT))
def spend_by_category(spark, d):
    return _categories(spark, d)


@query(sql(*T, CONTRACTS, ACTIVE, CATEGORY, f"o AS ({CATEGORY_OUT})", select="SELECT material_group, total_spend, savings_opportunity FROM o ORDER BY savings_opportunity DESC, material_group LIMIT 10"))
def savings_report(spark, d):
    """The ten groups with most savings."""
    return _categories(spark, d).select("material_group", "total_spend", "savings_opportunity").orderBy(F.desc("savings_opportunity"), "material_group").limit(10)


QOQ = """q AS (SELECT vendor_id, year, quarter, CAST(sum(CAST(transaction_amount AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM transactions GROUP BY 1, 2, 3),
  l AS (SELECT *, lag(spend) OVER w AS previous, row_number() OVER (PARTITION BY vendor_id ORDER BY year DESC, quarter DESC) AS n FROM q WINDOW w AS (PARTITION BY vendor_id ORDER BY year, quarter)),
  trend AS (SELECT vendor_id, year, quarter, spend, round((spend - previous) / previous * 100, 4) AS qoq_change_pct FROM l WHERE n = 1)"""
QOQ_OUT = "SELECT *, CASE WHEN qoq_change_pct IS NULL THEN 'Stable' WHEN qoq_change_pct <= -10 THEN 'Decreasing' WHEN qoq_change_pct <= 10 THEN 'Stable' ELSE 'Increasing' END AS spend_trend FROM trend"


@query(sql(*T, QOQ, select=QOQ_OUT))
def qoq_trend(spark, d):
    return S.quarter_trend(C.transactions(spark, d))


@query(sql(*T, QOQ, select="""SELECT vendor_id, spend, previous, round(coalesce(greatest(-0.5, least(0.5, (spend - previous) / previous)), 0), 6) AS growth,
  round(spend * (1 + coalesce(greatest(-0.5, least(0.5, (spend - previous) / previous)), 0)), 4) AS forecast FROM l WHERE n = 1"""))
def next_quarter_forecast(spark, d):
    return S.next_quarter(C.transactions(spark, d))


@query(sql(*T, select=f"SELECT year_quarter, {CENTS.format('transaction_amount')} AS spend, count(*) AS lines, count(DISTINCT vendor_id) AS vendors FROM transactions GROUP BY 1"))
def quarterly_spend(spark, d):
    t = C.transactions(spark, d).groupBy("year_quarter", "vendor_id").agg(F.sum(F.col("transaction_amount").cast("decimal(18,2)")).alias("s"), F.count("*").alias("n"))
    return t.groupBy("year_quarter").agg(F.sum("s").cast("double").alias("spend"), F.sum("n").alias("lines"), F.count("*").alias("vendors"))


@query(sql(*T, select=f"SELECT vendor_id, {CENTS.format('transaction_amount')} AS spend FROM transactions WHERE year = 1997 AND quarter = 2 GROUP BY 1"))
def quarter_by_supplier(spark, d):
    """One quarter's spend by supplier."""
    return C.transactions(spark, d).filter("year = 1997 AND quarter = 2").groupBy("vendor_id").agg(total("transaction_amount").alias("spend"))


@query(sql(*ST, VENDORS, select=f"SELECT country, {CENTS.format('total_spend')} AS spend FROM spend JOIN vendors USING (vendor_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def spend_by_country_top10(spark, d):
    """R11."""
    return _spend(spark, d, more=False).join(C.vendors(spark, d), "vendor_id").groupBy("country").agg(total("total_spend").alias("spend")).orderBy(F.desc("spend"), "country").limit(10)


@query(sql(*ST, VENDORS, select=f"SELECT industry_category, {CENTS.format('total_spend')} AS spend, count(*) AS vendors, CAST(sum(CASE WHEN balance < 0 THEN 1 ELSE 0 END) AS BIGINT) AS risky FROM spend JOIN vendors USING (vendor_id) GROUP BY 1"))
def spend_by_industry(spark, d):
    """R12, A20."""
    return _spend(spark, d, more=False).join(C.vendors(spark, d), "vendor_id").groupBy("industry_category").agg(total("total_spend").alias("spend"), F.count("*").alias("vendors"), F.count_if(F.col("balance") < 0).alias("risky"))


@query(sql(*ST, VENDORS, select=f"SELECT region, country, {CENTS.format('total_spend')} AS spend, count(*) AS vendors, CAST(grouping(region) * 2 + grouping(country) AS BIGINT) AS level FROM spend JOIN vendors USING (vendor_id) GROUP BY ROLLUP (region, country)"))
def spend_rollup(spark, d):
    """Subtotals of region and country in one pass."""
    return _spend(spark, d, more=False).join(C.vendors(spark, d), "vendor_id").rollup("region", "country").agg(total("total_spend").alias("spend"), F.count("*").alias("vendors"), F.grouping_id().cast("long").alias("level"))


@query(sql(*ST, VENDORS, select="SELECT vendor_id, supplier_name, industry_category, total_spend FROM spend JOIN vendors USING (vendor_id) QUALIFY row_number() OVER (PARTITION BY industry_category ORDER BY total_spend DESC, vendor_id) <= 3"))
def top_vendors_by_industry(spark, d):
    """W10."""
    rows = _spend(spark, d, more=False).join(C.vendors(spark, d), "vendor_id").select("vendor_id", "supplier_name", "industry_category", "total_spend")
    return top_n(rows, ["industry_category"], [F.desc("total_spend"), F.asc("vendor_id")], 3)


@query(sql(*ST, VENDORS, """c AS (SELECT vendor_id, industry_category, total_spend, CAST(sum(CAST(total_spend AS DECIMAL(18,2))) OVER (PARTITION BY industry_category) AS DOUBLE) AS ct, CAST(sum(CAST(total_spend AS DECIMAL(18,2))) OVER () AS DOUBLE) AS tt FROM spend JOIN vendors USING (vendor_id))""",
           select="SELECT vendor_id, industry_category, round(total_spend / ct * 100, 4) AS category_share_pct, round(total_spend / tt * 100, 4) AS enterprise_share_pct FROM c"))
def category_share(spark, d):
    return S.category_shares(C.transactions(spark, d), C.vendors(spark, d))


@query(sql(*ST, "m AS (SELECT t.vendor_id, t.transaction_amount, s.total_spend / s.tx_count AS mean FROM transactions t JOIN spend s ON t.vendor_id = s.vendor_id)",
           select=f"SELECT vendor_id, count(*) AS large_lines, {CENTS.format('transaction_amount')} AS large_spend FROM m WHERE transaction_amount > 2 * mean GROUP BY 1"))
def large_lines(spark, d):
    return S.large_lines(C.transactions(spark, d).select("vendor_id", "transaction_amount"))


METRICS = (MANAGED, MAVERICK, SHARE, QOQ, f"""metrics AS (SELECT m.vendor_id, CASE WHEN m.under_contract THEN 100.0 ELSE 0.0 END::DOUBLE AS sum_percentage, CASE WHEN m.under_contract THEN 0 ELSE m.total_spend END AS contract_gap,
    s.is_maverick, s.maverick_type, s.savings_opportunity, round(h.pct, 4) AS share_pct, CASE WHEN h.pct >= 10 THEN 'HIGH' WHEN h.pct >= 6.7 THEN 'MEDIUM' ELSE 'LOW' END AS concentration_risk, q.qoq_change_pct, q.spend_trend
  FROM managed m FULL JOIN saved s ON m.vendor_id = s.vendor_id FULL JOIN shares h ON m.vendor_id = h.vendor_id FULL JOIN ({QOQ_OUT}) q ON m.vendor_id = q.vendor_id)""")


def _metrics(spark, d):
    s, c = _spend(spark, d), C.contracts(spark, d)
    return S.spend_metrics(S.under_management(s, c), S.maverick(s, c), S.concentration(s), S.quarter_trend(C.transactions(spark, d)))


@query(sql(*STC, *METRICS, select="SELECT * FROM metrics"))
def spend_metrics(spark, d):
    """B7."""
    return _metrics(spark, d)


@query(sql(*STC, *METRICS, select="SELECT vendor_id, sum_percentage, is_maverick, share_pct, coalesce(sum_percentage, 0) < 75 OR coalesce(is_maverick, false) OR coalesce(share_pct, 0) > 15 AS diversify FROM metrics"))
def supplier_summary(spark, d):
    """B9."""
    return S.supplier_summary(_metrics(spark, d))


@query(sql(*STC, MANAGED, MAVERICK, SHARE, QOQ, f"trends AS ({QOQ_OUT})", """p AS (SELECT CAST(sum(CAST(pct * pct AS DECIMAL(28,12))) AS DOUBLE) AS h FROM shares)""",
           select="""SELECT (SELECT CAST(sum(CAST(total_spend AS DECIMAL(18,2))) AS DOUBLE) FROM spend) AS total_spend,
  (SELECT round(CAST(sum(CASE WHEN under_contract THEN CAST(total_spend AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) / CAST(sum(CAST(total_spend AS DECIMAL(18,2))) AS DOUBLE) * 100, 4) FROM managed) AS sum_pct,
  (SELECT count(*) FROM saved WHERE is_maverick) AS maverick_vendors, (SELECT round(CAST(sum(CAST(savings_opportunity AS DECIMAL(18,2))) AS DOUBLE), 2) FROM saved) AS savings, round(h, 2) AS hhi,
  CASE WHEN h >= 2500 THEN 'High' WHEN h >= 1500 THEN 'Moderate' ELSE 'Healthy' END AS hhi_status, (SELECT count(*) FROM trends WHERE spend_trend = 'Increasing') AS increasing,
  (SELECT count(*) FROM trends WHERE spend_trend = 'Stable') AS stable, (SELECT count(*) FROM trends WHERE spend_trend = 'Decreasing') AS decreasing FROM p"""))
def spend_report(spark, d):
    """B6."""
    s, c = _spend(spark, d), C.contracts(spark, d)
    return S.spend_report(S.under_management(s, c), S.maverick(s, c), S.concentration_summary(s), S.quarter_trend(C.transactions(spark, d)))


@query(sql(*ST, "p AS (SELECT *, total_spend / CAST(sum(CAST(total_spend AS DECIMAL(18,2))) OVER () AS DOUBLE) AS share FROM spend)",
           select="""SELECT a.vendor_id AS from_id, b.vendor_id AS to_id, CAST(25 AS INT) AS pct, round(a.total_spend * 25 / 100, 4) AS moved, round(a.total_spend - a.total_spend * 25 / 100, 4) AS from_after, round(b.total_spend + a.total_spend * 25 / 100, 4) AS to_after,
  round((a.share - a.share * 25 / 100) * 100, 4) AS from_share_pct, round((b.share + a.share * 25 / 100) * 100, 4) AS to_share_pct FROM p a JOIN p b ON b.vendor_id = a.vendor_id + 1"""))
def whatif_shift(spark, d):
    s = _spend(spark, d)
    return S.shift_spend(s, s.select(F.col("vendor_id").alias("from_id"), (F.col("vendor_id") + 1).alias("to_id"), F.lit(25).alias("pct")))


@query(sql(*ST, SHARE, select="SELECT vendor_id, round(pct, 4) AS exposure_pct, CASE WHEN pct >= 10 THEN 'Critical' WHEN pct >= 5 THEN 'High' WHEN pct >= 1 THEN 'Moderate' ELSE 'Low' END AS impact FROM shares"))
def whatif_loss(spark, d):
    return S.loss_impact(_spend(spark, d))


@query(sql(*ST, VENDORS, SHARE, select="""SELECT vendor_id, supplier_name, total_spend, round(pct, 4) AS share_pct,
  CASE WHEN total_spend >= 1e9 THEN printf('$%.1fB', total_spend / 1e9) WHEN total_spend >= 1e6 THEN printf('$%.1fM', total_spend / 1e6) WHEN total_spend >= 1e3 THEN printf('$%.1fK', total_spend / 1e3) ELSE printf('$%.0f', total_spend) END AS shown
  FROM shares JOIN vendors USING (vendor_id) ORDER BY total_spend DESC, vendor_id LIMIT 10"""))
def top10_vendors(spark, d):
    """R39, T3, X24."""
    rows = S.share_of_total(_spend(spark, d)).join(C.vendors(spark, d), "vendor_id")
    rows = rows.select("vendor_id", "supplier_name", "total_spend", F.round(F.col("share") * 100, 4).alias("share_pct"), shown_money("total_spend").alias("shown"))
    return rows.orderBy(F.desc("total_spend"), "vendor_id").limit(10)


@query(sql(*T, VENDORS, select="SELECT vendor_id, supplier_name FROM vendors WHERE vendor_id NOT IN (SELECT vendor_id FROM transactions WHERE po_date >= (SELECT max(po_date) FROM transactions) - 3)"))
def idle_vendors(spark, d):
    """Vendors without spend in the last days that there are orders of."""
    t = C.transactions(spark, d).select("vendor_id", "po_date")
    last = C.read(spark, d, "orders").agg(F.max(F.to_date("o_orderdate")).alias("last"))
    recent = t.join(F.broadcast(last), F.col("po_date") >= F.date_sub("last", 3)).select("vendor_id")
    return C.vendors(spark, d).join(recent, "vendor_id", "left_anti").select("vendor_id", "supplier_name")


@query(sql(*ST, VENDORS, select="SELECT vendor_id, supplier_name FROM vendors WHERE vendor_id NOT IN (SELECT vendor_id FROM spend)"))
def zero_spend_vendors(spark, d):
    """R23, J8."""
    return C.vendors(spark, d).join(_spend(spark, d, more=False), "vendor_id", "left_anti").select("vendor_id", "supplier_name")
