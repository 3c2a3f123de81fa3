"""Reports that readers ask for by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procuris.functions.columns import tokens, total
from procuris.operators.automaton import occurrences
from procuris.operators.relational import top_n, with_totals


def find_names(names: DataFrame, asked: DataFrame, order: str = "id") -> DataFrame:
    """(question, id): for each asked part of a name (question, part) the first of names (id, name) by `order` that holds it, case aside.

    Any number of parts is found, by an automaton. An empty part is held by every name that is not null.
    """
    ranked = names.filter("name IS NOT NULL").select("id", "name", F.col(order).alias("place"))
    hits = occurrences(ranked.select(F.struct("id", "place").alias("text_id"), F.col("name").alias("text")), asked.select(F.col("question").alias("pattern_id"), F.col("part").alias("pattern")))
    first = F.min_by("text_id.id", "text_id.place").alias("id")
    found = hits.groupBy(F.col("pattern_id").alias("question")).agg(first)
    whole = ranked.agg(F.min_by("id", "place").alias("id")).filter("id IS NOT NULL")
    return found.union(asked.filter("part = ''").select("question").distinct().crossJoin(F.broadcast(whole)))


def similar_names(names: DataFrame, asked: DataFrame, least: int = 3, most: int = 4) -> DataFrame:
    """(question, id, place): names (id, name) that share a word of more than `least` letters with an asked name (question, part); the first `most` by id."""
    word = lambda df, c: F.explode(F.filter(tokens(F.lower(c)), lambda w: F.length(w) > least))
    rows = names.select("id", word(names, "name").alias("word")).join(asked.select("question", word(asked, "part").alias("word")), "word").select("question", "id").distinct()
    return top_n(rows, ["question"], [F.asc("id")], most, rank="place")


def segments_with_attributes(segments: DataFrame, vendors: DataFrame) -> DataFrame:
    """Segments (vendor_id first) with country and industry of the vendor."""
    return segments.join(vendors.select("vendor_id", "supplier_name", "country_code", "industry_category"), "vendor_id", "left")


def anomalies_by_category(transactions: DataFrame, flags: DataFrame, most: int = 20) -> DataFrame:
    """Material groups with anomalous vendors: vendors, anomalous ones, their spend and rate in percent; the `most` with most of them.

    flags: (vendor_id, is_anomalous). Amounts are summed by group and vendor before the flags join.
    """
    group = F.coalesce(F.nullif(F.trim("material_group"), F.lit("")), F.lit("Unclassified")).alias("material_group")
    rows = transactions.filter("transaction_amount > 0").groupBy(group, "vendor_id").agg(F.sum(F.col("transaction_amount").cast("decimal(18,2)")).alias("s")).join(flags, "vendor_id")
    odd = F.col("is_anomalous")
    out = rows.groupBy("material_group").agg(F.count("*").alias("total_vendors"), F.count_if(odd).alias("anomalous_vendors"), F.sum("s").cast("double").alias("total_spend"),
                                             F.coalesce(F.sum(F.when(odd, F.col("s"))).cast("double"), F.lit(0.0)).alias("anomalous_spend"))
    out = out.filter("anomalous_vendors > 0").withColumn("anomaly_rate", F.round(F.col("anomalous_vendors") / F.col("total_vendors") * 100, 4))
    return out.orderBy(F.desc("anomalous_vendors"), "material_group").limit(most)


def esg(vendors: DataFrame, n: int = 5) -> DataFrame:
    """(kind, place, vendor_id, esg_score, covered, mean_score): the n best and n worst of vendors with a score above 0; ties by id."""
    rows = with_totals(vendors.filter("esg_score > 0").select("vendor_id", "esg_score"), covered=F.count("*"), mean_score=F.round(F.avg(F.col("esg_score").cast("decimal(18,6)")).cast("double"), 4))
    best, worst = (rows.orderBy(order, "vendor_id").limit(n).withColumn("kind", F.lit(kind)) for order, kind in ((F.desc("esg_score"), "top"), (F.asc("esg_score"), "bottom")))
    both = best.union(worst)  # 2 n rows, ranked anew
    key = F.when(F.col("kind") == "top", -F.col("esg_score")).otherwise(F.col("esg_score"))
    return top_n(both.withColumn("_o", key), ["kind"], [F.asc("_o"), F.asc("vendor_id")], n, rank="place").select("kind", "place", "vendor_id", "esg_score", "covered", "mean_score")


def risk_drivers(vendors: DataFrame, drivers: DataFrame, industries: int = 3) -> DataFrame:
    """(kind, name, value): mean size of each feature's contribution, vendors in countries of high risk, and the industries of most high-risk vendors.

    vendors: geo_risk, risk_label, industry_category; drivers: (vendor_id, feature, contribution).
    """
    features = drivers.groupBy(F.col("feature").alias("name")).agg(F.round(F.avg(F.abs("contribution").cast("decimal(28,12)")).cast("double"), 6).alias("value")).withColumn("kind", F.lit("feature"))
    places = vendors.agg(F.count_if(F.col("geo_risk") == "High").cast("double").alias("value")).select(F.lit("vendors in high-risk countries").alias("name"), "value", F.lit("geography").alias("kind"))
    common = vendors.filter(F.col("risk_label") == "High").groupBy(F.col("industry_category").alias("name")).agg(F.count("*").cast("double").alias("value"))
    common = common.orderBy(F.desc("value"), "name").limit(industries).withColumn("kind", F.lit("industry"))
    return features.unionByName(places).unionByName(common).select("kind", "name", "value")


def whole_profile(vendors: DataFrame, *parts: DataFrame) -> DataFrame:
    """Vendors with the columns of every part that knows them (vendor_id, ...), each a row a vendor."""
    for part in parts:
        vendors = vendors.join(part, "vendor_id", "left")
    return vendors


def spend_of_regions(spend: DataFrame, vendors: DataFrame) -> DataFrame:
    """(region, vendors, spend) by the region that a vendor's country code is listed in; others have none."""
    from procuris.functions.columns import region_of

    return spend.join(vendors.select("vendor_id", region_of("country_code").alias("region")), "vendor_id").groupBy("region").agg(F.count("*").alias("vendors"), total("total_spend").alias("spend"))
