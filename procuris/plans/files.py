"""Queries over files that are written from the given tables: readers, sinks, stores and logs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procuris.operators import quality as Q
from procuris.operators import relational as R
from procuris.plans.registry import query
from procuris.plans.tables import TRANSACTIONS, sql
from procuris.sources import curate as C
from procuris.sources import io, store
from procuris.sources.shared import at_exit, shared_dir


def _folder(spark) -> str:
    path = f"{shared_dir(spark)}/procuris/files-{uuid.uuid4().hex}"
    at_exit(spark, path)
    return path


@query("SELECT c_custkey AS custkey, replace(c_name, '#', 'é') AS name, c_acctbal AS acctbal FROM customer")
def latin_extract(spark, d):
    """A CSV extract in Latin-1 with blanks about its header, read by trying encodings."""
    path = f"{_folder(spark)}/LFA1"
    rows = C.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias(" custkey "), F.replace("c_name", F.lit("#"), F.lit("é")).alias("name"), F.col("c_acctbal").cast("string").alias("acctbal"))
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    found = io.read_extract(spark, path, ["CUSTKEY", "NAME", "ACCTBAL", "NOT THERE"])
    return found.select(F.col("CUSTKEY").cast("bigint").alias("custkey"), F.col("NAME").alias("name"), F.col("ACCTBAL").cast("double").alias("acctbal"))


@query("SELECT 'CUSTOMER' AS name, 'csv' AS kind, true AS filled, count(*) AS rows FROM customer UNION ALL SELECT 'NATION', 'json', true, count(*) FROM nation UNION ALL SELECT 'ORDERS', 'parquet', true, count(*) FROM orders")
def scanned_files(spark, d):
    """Files of three kinds, written as reports in folders of their own, found again and counted."""
    top = _folder(spark)
    for name, kind in (("customer", "csv"), ("nation", "json"), ("orders", "parquet")):
        io.report(C.read(spark, d, name), f"{top}/deep/{name}.{kind}", kind)
    files = io.scan_files(spark, top).withColumn("table", F.upper(F.regexp_extract("path", r"deep/([a-z]+)\.", 1))).withColumn("kind", F.regexp_extract("path", r"\.([a-z]+)$", 1))
    found = files.groupBy(F.col("table").alias("name"), "kind").agg((F.sum("length") > 0).alias("filled"))
    read = {"CUSTOMER": spark.read.option("header", True).csv(f"{top}/deep/customer.csv"), "NATION": spark.read.json(f"{top}/deep/nation.json"), "ORDERS": spark.read.parquet(f"{top}/deep/orders.parquet")}
    counts = None
    for name, rows in read.items():
        one = io.count_rows(rows).agg(F.sum("rows").alias("rows")).select(F.lit(name).alias("name"), "rows")
        counts = one if counts is None else counts.union(one)
    return found.join(F.broadcast(counts), "name").select("name", "kind", "filled", "rows")


@query("""SELECT 'customer.csv' AS file, 'KNA1' AS "table", 2 AS score, count(*) AS rows FROM customer UNION ALL SELECT 'orders.csv', 'EKKO', 3, count(*) FROM orders UNION ALL SELECT 'lineitem.csv', 'EKPO', 2, count(*) FROM lineitem""")
def matched_extracts(spark, d):
    """Which known table each of the given ones is, by their columns, and its rows."""
    tables = {f"{n}.csv": C.read(spark, d, n) for n in ("customer", "orders", "lineitem", "region")}
    found = spark.createDataFrame([(n, df.columns) for n, df in tables.items()], "file string, columns array<string>")
    known = {"KNA1": ["c_custkey", "C_NAME", "kunnr"], "EKKO": ["O_ORDERKEY", "o_custkey", "o_orderdate"], "EKPO": ["l_orderkey", "l_linenumber", "ebelp"], "T001": ["r_regionkey", "bukrs"]}
    counts = reduce(DataFrame.union, (io.count_rows(df).agg(F.sum("rows").alias("rows")).select(F.lit(n).alias("file"), "rows") for n, df in tables.items()))
    return Q.match_table(found, known).join(counts, "file").select("file", "table", "score", "rows")


@query("SELECT area, found, needed FROM (VALUES ('delivery', 'lineitem,orders', 2), ('news', 'events', 2), ('payment', '', 1), ('spend', 'lineitem,orders', 3)) t(area, found, needed) WHERE (SELECT count(*) FROM lineitem) > 0")
def covered_areas(spark, d):
    """Which analytic areas the tables at hand unlock."""
    tables = None
    for name in ("lineitem", "orders", "events", "customer"):
        one = io.count_rows(C.read(spark, d, name)).agg(F.sum("rows").alias("rows")).filter("rows > 0").select(F.lit(name).alias("table"))
        tables = one if tables is None else tables.union(one)
    needs = {"spend": ["orders", "lineitem", "contracts"], "delivery": ["orders", "lineitem"], "news": ["events", "articles"], "payment": ["invoices"]}
    return Q.gap_coverage(tables, needs).select("area", F.array_join("found", ",").alias("found"), F.col("needed").cast("int").alias("needed"))


@query("SELECT count(*) AS rows, true AS one_file_one_hash, true AS hashed, true AS stamped FROM orders")
def lineage(spark, d):
    """Every row with the file it comes from, the file's checksum and the time."""
    path = f"{_folder(spark)}/orders"
    C.read(spark, d, "orders").select("o_orderkey", "o_totalprice").repartition(3).write.option("header", True).csv(path)
    rows = io.with_lineage(spark, spark.read.option("header", True).csv(path), [path])
    files = rows.groupBy("source_file").agg(F.count("*").alias("n"), F.countDistinct("file_hash").alias("hashes"), F.min(F.length("file_hash")).alias("width"), F.count("ingested_at").alias("stamped"))
    return files.agg(F.sum("n").alias("rows"), F.bool_and(F.col("hashes") == 1).alias("one_file_one_hash"), F.bool_and(F.col("width") == 32).alias("hashed"), F.bool_and(F.col("stamped") == F.col("n")).alias("stamped"))


@query("SELECT r_regionkey, r_name FROM region")
def first_source(spark, d):
    """The first of several places that is there."""
    path = f"{_folder(spark)}/region.csv"
    io.report(C.read(spark, d, "region"), path)
    found = io.first_existing(spark, [f"{path}.parquet", f"{d}/no_region.parquet", path, f"{d}/region.parquet"])
    return found.select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"), "r_name")


@query("SELECT n_name AS nation, count(*) AS vendors, sum(CAST(s_acctbal AS DECIMAL(18,2)))::DOUBLE AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 GROUP BY 1")
def sql_over_tables(spark, d):
    """A query as text over named tables."""
    text = "SELECT n_name AS nation, count(*) AS vendors, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM {v} JOIN {n} ON s_nationkey = n_nationkey WHERE s_acctbal > 0 GROUP BY 1"
    return io.read_table(spark, text, v=C.read(spark, d, "supplier"), n=C.read(spark, d, "nation"))


@query("SELECT c_mktsegment AS segment, count(*) AS rows FROM (SELECT c_mktsegment FROM customer UNION ALL SELECT c_mktsegment FROM customer WHERE c_acctbal < 0) GROUP BY 1")
def bulk_written(spark, d):
    """A table replaced, then appended to."""
    path, rows = f"{_folder(spark)}/customer", C.read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    io.append(rows, path)
    io.replace(rows, path)
    io.append(rows.filter("c_acctbal < 0"), path)
    return spark.read.schema(rows.schema).parquet(path).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("rows"))


@query("SELECT s_suppkey, s_name, CAST(NULL AS DOUBLE) AS esg_score, CAST(NULL AS VARCHAR) AS segment FROM supplier")
def ensured_columns(spark, d):
    """Those of the wanted columns that there are, and the others as nulls."""
    rows = R.available(C.read(spark, d, "supplier"), ["s_suppkey", "s_name", "esg_score"])
    return R.ensure_columns(rows, {"s_name": "string", "esg_score": "double", "segment": "string"})


@query("SELECT CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'High' WHEN o_orderpriority LIKE '3%' THEN 'Medium' ELSE 'Low' END AS label, count(*) AS orders FROM orders GROUP BY 1")
def label_synonyms(spark, d):
    """a label for each of its spellings, else the default."""
    spelled = Q.synonyms("o_orderpriority", {"High": ["1-urgent", "2-high", "h", "3"], "Medium": ["3-medium", "m", "2"]}, "Low")
    return C.read(spark, d, "orders").groupBy(spelled.alias("label")).agg(F.count("*").alias("orders"))


@query("SELECT vec_id AS id, len(embedding) AS width, 'label ' || label AS text FROM embeddings WHERE embedding IS NOT NULL")
def stored_vectors(spark, d):
    """Vectors and their texts, written twice, of which the second time only new ids come in."""
    path = f"{_folder(spark)}/vectors"
    rows = C.read(spark, d, "embeddings").filter("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.concat(F.lit("label "), F.col("label")).alias("text"))
    io.store_vectors(rows.filter("id % 3 = 0"), path, reset=True)
    io.store_vectors(rows, path)
    return spark.read.schema(rows.schema).parquet(path).select("id", F.size("v").cast("bigint").alias("width"), "text")


@query(sql(TRANSACTIONS, select="SELECT 'transactions' AS \"table\", count(*) AS rows, round(sum(CAST(transaction_amount AS DECIMAL(18,2)))::DOUBLE, 2) AS total, 'ready' AS state FROM transactions UNION ALL SELECT 'nothing', 0, NULL, 'incomplete'"))
def run_log(spark, d):
    """Tables written and logged in one pass: counts and sums are observed while the rows go out."""
    path = _folder(spark)
    rows = C.transactions(spark, d).select("po_number", "po_line", "vendor_id", "transaction_amount")
    amount = F.sum(F.col("transaction_amount").cast("decimal(18,2)")).cast("double")
    for name, part in (("transactions", rows), ("nothing", rows.filter("vendor_id < 0"))):
        io.logged_write(part, f"{path}/{name}", f"{path}/log", name, total=amount)
    log = spark.read.parquet(f"{path}/log")
    return log.select(F.col("run_id").alias("table"), F.col("counts")["rows"].alias("rows"), F.round(F.col("figures")["total"], 2).alias("total"), "state")


CHANGED = "changed AS (SELECT c_custkey, c_acctbal + 1000 AS c_acctbal, 'new' AS c_mktsegment FROM customer WHERE c_custkey % 50 = 0 UNION ALL SELECT c_custkey + 10000000, 0.5, 'added' FROM customer WHERE c_custkey % 100 = 0)"


@query(sql(CHANGED, "first AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM changed) UNION ALL SELECT * FROM changed)",
           select="SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 70 = 0 THEN 'moved' ELSE c_mktsegment END AS c_mktsegment FROM first"))
def keyed_store(spark, d):
    """A store in buckets, upserted (one batch of it twice, as after a failure) and updated."""
    path, rows = f"{_folder(spark)}/store", C.read(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    store.upsert(path, rows, ["c_custkey"], 0)
    old = rows.filter("c_custkey % 50 = 0").select("c_custkey", (F.col("c_acctbal") + 1000).alias("c_acctbal"), F.lit("new").alias("c_mktsegment"))
    new = rows.filter("c_custkey % 100 = 0").select((F.col("c_custkey") + 10000000).alias("c_custkey"), F.lit(0.5).alias("c_acctbal"), F.lit("added").alias("c_mktsegment"))
    for _ in range(2):
        store.upsert(path, old.union(new), ["c_custkey"], 1)
    moved = rows.select("c_custkey").union(new.select("c_custkey")).filter("c_custkey % 70 = 0").withColumn("c_mktsegment", F.lit("moved"))
    store.update(path, moved, ["c_custkey"], ["c_mktsegment"], rows.schema, 2)
    return store.stored(spark, path, rows.schema)
