"""Curated tables: from raw ERP extracts (C1 to C4), and from the star-schema tables at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procuris.functions import params as P
from procuris.functions.columns import binned, country_tier, decoded, money, normal_id, total, year_quarter
from procuris.operators.relational import keep_first

AS_OF = "2001-08-02"
NEWS_AS_OF = "2024-01-31"

#: Lines of a task that joins lines with their orders, about, however many there are.
PART_ROWS = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usable(c: str | Column) -> Column:
    """not null and no stand-in for it."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.trim(c).isin("", "nan", "NaN", "None")


# --- from raw extracts; all their columns are text

def build_vendors(lfa1: DataFrame, industries: dict[str, tuple[str, str]]) -> DataFrame:
    """Vendors not marked deleted and with a name of two signs or more, one for each id (the first by name)."""
    rows = lfa1.filter(F.coalesce(F.trim("LOEVM"), F.lit("")) != "X")
    code, known = F.trim("BRSCH"), decoded("BRSCH", industries)
    rows = rows.select(
        normal_id("LIFNR").alias("vendor_id"), F.trim("NAME1").alias("supplier_name"), F.upper(F.trim("LAND1")).alias("country_code"),
        F.trim("ORT01").alias("city"), code.alias("industry_code"), known["label"].alias("industry"), known["category"].alias("industry_category"), country_tier("LAND1").alias("geo_risk"))
    rows = rows.filter(usable("vendor_id") & usable("supplier_name") & (F.length("supplier_name") > 1))
    return keep_first(rows, ["vendor_id"], [F.asc("supplier_name"), F.asc_nulls_last("city")])


def build_transactions(ekko: DataFrame, ekpo: DataFrame, vendors: DataFrame) -> DataFrame:
    """Purchase order lines of a positive amount with a date and a vendor; amount is price times quantity, else net value."""
    header = keep_first(ekko.filter(F.col("BSTYP") == "F"), ["EBELN"], [F.asc_nulls_last("BEDAT"), F.asc_nulls_last("LIFNR")])
    price, quantity, net = (F.expr(f"try_cast({c} AS DOUBLE)") for c in ("NETPR", "MENGE", "NETWR"))
    rows = ekpo.join(header.select("EBELN", "LIFNR", "BEDAT", "EKORG", "BUKRS", "WAERS"), "EBELN", "left").select(
        F.col("EBELN").alias("po_number"), F.col("EBELP").alias("po_line"), normal_id("LIFNR").alias("vendor_id"), F.try_to_date("BEDAT", "yyyyMMdd").alias("po_date"),
        F.col("MATNR").alias("material_number"), F.col("MATKL").alias("material_group"), quantity.alias("quantity"), price.alias("unit_price"),
        F.coalesce(price * quantity, net).alias("transaction_amount"), F.col("WAERS").alias("currency"), F.col("EKORG").alias("purchasing_org"), F.col("BUKRS").alias("company_code"))
    rows = rows.filter((F.col("transaction_amount") > 0) & F.col("po_date").isNotNull() & usable("vendor_id"))
    rows = rows.join(vendors.select("vendor_id", "supplier_name"), "vendor_id", "left")
    return rows.withColumns({"year": F.year("po_date"), "quarter": F.quarter("po_date"), "month": F.month("po_date"), "year_quarter": year_quarter("po_date")})


def delivery_rows(promised: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Promised and actual delivery of a line, in a full outer join, with delay, on_time, in_full and otif.

    A line without both dates counts as no delay. No actual quantity counts as 0, which is in full only where nothing
    was promised.
    """
    rows = promised.join(actual, keys, "full")
    delay = F.coalesce(F.datediff("actual_date", "promised_date"), F.lit(0))
    want, got = F.coalesce("promised_qty", F.lit(0.0)), F.coalesce("actual_qty", F.lit(0.0))
    rows = rows.withColumns({"delay_days": delay, "on_time": (delay <= 0).cast("int"), "in_full": (got >= want * P.IN_FULL).cast("int")})
    return rows.withColumn("otif", F.col("on_time") * F.col("in_full"))


def build_delivery_events(eket: DataFrame, ekbe: DataFrame, ekko: DataFrame) -> DataFrame:
    """C3 from schedule lines and goods receipts (history of category 1), for orders with a vendor."""
    keys = ["po_number", "po_line"]
    name = [F.col("EBELN").alias("po_number"), F.col("EBELP").alias("po_line")]
    amount = F.coalesce(F.sum(F.expr("try_cast(MENGE AS DOUBLE)")), F.lit(0.0))
    promised = eket.groupBy(*name).agg(F.max(F.try_to_date("EINDT", "yyyyMMdd")).alias("promised_date"), amount.alias("promised_qty"))
    actual = ekbe.filter(F.substring("VGABE", 1, 1) == "1").groupBy(*name).agg(F.max(F.try_to_date("BUDAT", "yyyyMMdd")).alias("actual_date"), amount.alias("actual_qty"))
    header = keep_first(ekko, ["EBELN"], [F.asc_nulls_last("LIFNR")]).select(F.col("EBELN").alias("po_number"), normal_id("LIFNR").alias("vendor_id"))
    return delivery_rows(promised, actual, keys).join(header, "po_number", "left").filter(usable("vendor_id"))


def contract_status(end: str | Column, as_of: Column) -> Column:
    """Status bands of the days to the end; an open end is Expired."""
    days = F.coalesce(F.datediff(end, as_of), F.lit(-999))
    return binned(days, [-1, 30, 60, 90], ["Expired", "Expires <30d", "Expires <60d", "Expires <90d", "Active"])


def build_contracts(ekko: DataFrame, as_of: Column, kinds: tuple[str, ...] = ("K", "L")) -> DataFrame:
    """Outline agreements, or if there are none all that are no purchase orders; the latest end for each number."""
    chosen = ekko.filter(F.col("BSTYP").isin(*kinds))
    if chosen.isEmpty():
        chosen = ekko.filter(F.col("BSTYP") != "F")
    end = F.try_to_date("KDATE", "yyyyMMdd")
    rows = chosen.select(F.col("EBELN").alias("contract_number"), normal_id("LIFNR").alias("vendor_id"), F.try_to_date("KDATB", "yyyyMMdd").alias("contract_start"),
                         end.alias("contract_end"), F.coalesce(F.datediff(end, as_of), F.lit(-999)).alias("days_to_expiry"), contract_status(end, as_of).alias("contract_status"))
    return keep_first(rows.filter(usable("vendor_id")), ["contract_number"], [F.desc_nulls_last("contract_end"), F.asc("vendor_id")])


# --- from the star schema

def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    rows = read(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(
        F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("supplier_name"), F.col("n_name").alias("country"),
        F.array(*map(F.lit, P.NATION_CODES))[F.col("n_nationkey") % len(P.NATION_CODES)].alias("country_code"), F.col("r_name").alias("region"),
        F.array(*map(F.lit, P.INDUSTRIES))[(F.col("s_suppkey") % len(P.INDUSTRIES)).cast("int")].alias("industry_category"), F.col("s_acctbal").alias("balance"), F.lit(True).alias("is_active"))


def transactions(spark: SparkSession, sf_dir: str, with_group: bool = False) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("po_date"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    parts = -(-lines.count() // PART_ROWS)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):  # else the engine's own parts are no larger
        lines, orders = lines.repartition(parts, "l_orderkey"), orders.repartition(parts, "o_orderkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if with_group:
        rows = rows.join(read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("material_group")), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("l_orderkey").alias("po_number"), F.col("l_linenumber").alias("po_line"), F.col("l_suppkey").alias("vendor_id"), "po_date",
        F.year("po_date").alias("year"), F.quarter("po_date").alias("quarter"), F.month("po_date").alias("month"), year_quarter("po_date").alias("year_quarter"),
        F.col("l_partkey").alias("material_number"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("transaction_amount"),
        F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"), *(["material_group"] if with_group else []))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("po_number"), F.col("l_linenumber").alias("po_line"), F.col("l_suppkey").alias("vendor_id"), F.to_date("l_shipdate").alias("ship"), "l_partkey",
        F.col("l_quantity").alias("q"))
    keys = ["po_number", "po_line", "vendor_id"]
    late = F.pmod(F.col("l_partkey") * 7 + F.col("vendor_id") * 3 + F.col("po_line"), F.lit(15)) - 5
    rows = lines.withColumns({"actual": F.date_add("ship", late.cast("int")), "got": F.when(F.col("l_partkey") % 10 == 0, F.col("q") * 0.9).otherwise(F.col("q"))})
    both = rows.groupBy(*keys).agg(F.max("ship").alias("promised_date"), F.coalesce(F.sum(money("q")).cast("double"), F.lit(0.0)).alias("promised_qty"),
                                   F.max("actual").alias("actual_date"), F.coalesce(F.sum(money("got")).cast("double"), F.lit(0.0)).alias("actual_qty"))
    # promised and actual come from one table here, so one aggregation gives both sides of the join
    delay = F.datediff("actual_date", "promised_date")
    both = both.withColumns({"delay_days": delay, "on_time": (delay <= 0).cast("int"), "in_full": (F.col("actual_qty") >= F.col("promised_qty") * P.IN_FULL).cast("int")})
    return both.withColumn("otif", F.col("on_time") * F.col("in_full"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").filter("s_acctbal > 0")
    end = F.date_add(F.lit("2001-06-01").cast("date"), (F.col("s_suppkey") * 37 % 400 - 100).cast("int"))
    as_of = F.lit(AS_OF).cast("date")
    return rows.select(F.concat(F.lit("K"), F.col("s_suppkey")).alias("contract_number"), F.col("s_suppkey").alias("vendor_id"), end.alias("contract_end"),
                       F.datediff(end, as_of).alias("days_to_expiry"), contract_status(end, as_of).alias("contract_status"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    kind = F.col("event_type")
    mood = F.when(kind == "error", -0.8).when(kind == "signup", 0.5).when(kind == "purchase", 0.9).when(kind == "click", 0.1).otherwise(0.0)
    return read(spark, sf_dir, "events").crossJoin(F.broadcast(n)).select(
        (F.col("user_id") % F.col("n") + 1).alias("vendor_id"), F.col("event_id").alias("article_id"), F.col("event_id").cast("string").alias("url"),
        F.col("ts").cast("timestamp").alias("published_at"), (kind == "error").alias("disruption_flag"), kind.alias("disruption_type"), mood.alias("sentiment_score"),
        kind.alias("source_name"))


def spend(transactions: DataFrame) -> DataFrame:
    """Spend, lines and mean amount of each vendor."""
    return transactions.groupBy("vendor_id").agg(total("transaction_amount").alias("total_spend"), F.count("*").alias("tx_count"))
