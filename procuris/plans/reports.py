"""Served reports and the taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from procuris.functions.columns import total
from procuris.operators import taxonomy as X
from procuris.operators.relational import top_n
from procuris.plans.registry import query
from procuris.plans.tables import CONTRACTS, DELIVERIES, NEWS, SPEND, TRANSACTIONS, VENDORS, sql
from procuris.sources import curate as C

#: Words of product types that stand for keywords of segments here.
KEYWORDS = {"31": ["steel", "copper", "tin"], "13": ["brass", "plated"], "44": ["nickel", "polished"]}
GROUPS = {"80": ["ECONOMY", "PROMO"], "26": ["STANDARD", "SMALL"]}


@query(sql(TRANSACTIONS, SPEND, VENDORS, select="SELECT vendor_id, supplier_name, country, total_spend FROM vendors LEFT JOIN spend USING (vendor_id)"))
def all_vendors(spark, d):
    """R2, T1."""
    rows = C.vendors(spark, d).join(C.spend(C.transactions(spark, d)), "vendor_id", "left")
    return rows.select("vendor_id", "supplier_name", "country", "total_spend").orderBy(F.desc_nulls_last("total_spend"), "vendor_id")


@query(sql(TRANSACTIONS, SPEND, VENDORS, DELIVERIES, CONTRACTS, NEWS, """o AS (SELECT vendor_id, round(sum(otif) / count(*), 6) AS otif_rate FROM deliveries GROUP BY 1)""",
           "n AS (SELECT vendor_id, string_agg(url, ',' ORDER BY published_at DESC, article_id) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY published_at DESC, article_id) AS k FROM news) WHERE k <= 5 GROUP BY 1)",
           select="SELECT vendor_id, supplier_name, total_spend, otif_rate, contract_number, latest FROM vendors LEFT JOIN spend USING (vendor_id) LEFT JOIN o USING (vendor_id) LEFT JOIN contracts USING (vendor_id) LEFT JOIN n USING (vendor_id)"))
def vendor_profiles(spark, d):
    """Every vendor's profile: spend, delivery, contract and its five latest articles."""
    otif = C.deliveries(spark, d).groupBy("vendor_id").agg(F.round(F.sum("otif") / F.count("*"), 6).alias("otif_rate"))
    five = top_n(C.news(spark, d), ["vendor_id"], [F.desc("published_at"), F.asc("article_id")], 5, rank="_k")
    latest = five.groupBy("vendor_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "url"))), lambda x: x["url"]), ",").alias("latest"))
    rows = C.vendors(spark, d).select("vendor_id", "supplier_name")
    for part in (C.spend(C.transactions(spark, d)).select("vendor_id", "total_spend"), otif, C.contracts(spark, d).select("vendor_id", "contract_number"), latest):
        rows = rows.join(part, "vendor_id", "left")
    return rows


@query(sql(TRANSACTIONS, SPEND, VENDORS, "p AS (SELECT a.vendor_id AS a_id, b.vendor_id AS b_id, a.total_spend AS a_spend, b.total_spend AS b_spend, a.tx_count AS a_lines, b.tx_count AS b_lines FROM spend a JOIN spend b ON b.vendor_id = a.vendor_id + 1)",
           select="SELECT a_id, b_id, 'spend' AS metric, a_spend AS a, b_spend AS b, CASE WHEN a_spend >= b_spend THEN a_id ELSE b_id END AS larger FROM p UNION ALL SELECT a_id, b_id, 'lines', a_lines, b_lines, CASE WHEN a_lines >= b_lines THEN a_id ELSE b_id END FROM p"))
def vendor_comparison(spark, d):
    """Neighbouring vendors side by side, a row for each metric."""
    s = C.spend(C.transactions(spark, d)).select("vendor_id", F.col("total_spend").alias("spend"), F.col("tx_count").cast("double").alias("lines"))
    long = s.unpivot("vendor_id", ["spend", "lines"], "metric", "v")
    a, b = (long.select(F.col("vendor_id").alias(f"{x}_id"), "metric", F.col("v").alias(x)) for x in ("a", "b"))
    rows = a.withColumn("b_id", F.col("a_id") + 1).join(b, ["b_id", "metric"])
    return rows.select("a_id", "b_id", "metric", "a", "b", F.when(F.col("a") >= F.col("b"), F.col("a_id")).otherwise(F.col("b_id")).alias("larger"))


@query(sql(NEWS, select="SELECT count(*) AS articles, count(CASE WHEN disruption_flag THEN 1 END) AS disruptions, count(DISTINCT vendor_id) AS vendors, round(CAST(sum(CAST(sentiment_score AS DECIMAL(18,4))) AS DOUBLE) / count(*), 4) AS mean_sentiment FROM news"))
def news_kpis(spark, d):
    """R18."""
    return C.news(spark, d).agg(F.count("*").alias("articles"), F.count_if("disruption_flag").alias("disruptions"), F.countDistinct("vendor_id").alias("vendors"), F.round(F.sum(F.col("sentiment_score").cast("decimal(18,4)")).cast("double") / F.count("*"), 4).alias("mean_sentiment"))


def _classified(spark, d):
    parts = C.read(spark, d, "part").select("p_partkey", F.split("p_type", " ")[0].alias("material_group"), F.concat_ws(" ", "p_type", "p_name").alias("description"))
    # products are classified once, then their lines follow
    found = X.classify(parts, KEYWORDS, GROUPS).select("p_partkey", "segment", "method")
    lines = C.read(spark, d, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("amount"))
    return lines.join(found, F.col("l_partkey") == F.col("p_partkey"))


def _hits(words):
    return " + ".join(f"CAST(contains(lower(p_type || ' ' || p_name), '{w}') AS INT)" for w in words)


TAXONOMY = f"""k AS (SELECT p_partkey, CASE upper(trim(string_split(p_type, ' ')[1])) WHEN 'ECONOMY' THEN '80' WHEN 'PROMO' THEN '80' WHEN 'STANDARD' THEN '26' WHEN 'SMALL' THEN '26' END AS one, {_hits(KEYWORDS['31'])} AS a, {_hits(KEYWORDS['13'])} AS b, {_hits(KEYWORDS['44'])} AS c FROM part),
  t AS (SELECT p_partkey, one, CASE WHEN a + b + c = 0 THEN NULL WHEN a >= b AND a >= c THEN '31' WHEN b >= c THEN '13' ELSE '44' END AS two FROM k),
  classified AS (SELECT l_extendedprice AS amount, coalesce(one, two, 'Unclassified') AS segment, CASE WHEN one IS NOT NULL THEN 'lookup' WHEN two IS NOT NULL THEN 'keyword' ELSE 'none' END AS method FROM lineitem JOIN t ON l_partkey = p_partkey)"""


@query(sql(TAXONOMY, "s AS (SELECT segment, method, count(*) AS lines, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM classified GROUP BY 1, 2)",
           select="SELECT *, round(spend / CAST(sum(CAST(spend AS DECIMAL(18,2))) OVER () AS DOUBLE) * 100, 4) AS spend_pct FROM s"))
def taxonomy_summary(spark, d):
    """C21, C22, R30."""
    return X.summary(_classified(spark, d))


@query(sql(TAXONOMY, select="SELECT method, count(*) AS rows FROM classified GROUP BY 1"))
def taxonomy_coverage(spark, d):
    """C23."""
    return X.coverage(_classified(spark, d))


@query("SELECT s_nationkey AS nation, count(*) AS parties, CAST(sum(CAST(b AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM (SELECT s_nationkey, s_acctbal AS b FROM supplier UNION ALL SELECT c_nationkey, c_acctbal FROM customer) GROUP BY 1")
def parties_by_nation(spark, d):
    """U1, U7."""
    s = C.read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("b"))
    c = C.read(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("b"))
    return s.unionByName(c).groupBy("nation").agg(F.count("*").alias("parties"), total("b").alias("balance"))
