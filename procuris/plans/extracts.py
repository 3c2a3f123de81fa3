"""Raw extracts, feeds and name lists, made as text from the given tables, through curation and quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from procuris.functions import params as P
from procuris.operators import matching as M
from procuris.operators import news as N
from procuris.operators import quality as Q
from procuris.operators import relational as R
from procuris.operators.automaton import mentions
from procuris.plans.delivery import risk_case
from procuris.plans.registry import query
from procuris.plans.tables import listed, sql
from procuris.sources import curate as C
from procuris.sources import io

# --- vendors: numbers with leading zeros, a blank and a stand-in name, deleted ones, codes with and without a meaning

LFA1 = f"""lfa1 AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS "LIFNR", CASE WHEN s_suppkey % 17 = 3 THEN ' ' WHEN s_suppkey % 17 = 5 THEN 'nan' ELSE ' ' || s_name END AS "NAME1",
    lower(({listed(P.NATION_CODES)})[s_nationkey % {len(P.NATION_CODES)} + 1]) AS "LAND1", CAST(s_nationkey AS VARCHAR) AS "ORT01", CASE s_suppkey % 4 WHEN 0 THEN 'AUTO' WHEN 1 THEN 'CHEM' WHEN 2 THEN ' PHRM' ELSE '??' END AS "BRSCH",
    CASE WHEN s_acctbal < -500 THEN 'X' END AS "LOEVM" FROM supplier)"""
INDUSTRY_CODES = {"AUTO": ("Vehicles", "Automotive"), "CHEM": ("Chemistry", "Chemicals"), "PHRM": ("Medicine", "Pharma & Life Sciences")}


def _lfa1(spark, d):
    key = F.col("s_suppkey")
    return C.read(spark, d, "supplier").select(
        F.lpad(key.cast("string"), 10, "0").alias("LIFNR"), F.when(key % 17 == 3, " ").when(key % 17 == 5, "nan").otherwise(F.concat(F.lit(" "), "s_name")).alias("NAME1"),
        F.lower(F.array(*map(F.lit, P.NATION_CODES))[F.col("s_nationkey") % len(P.NATION_CODES)]).alias("LAND1"), F.col("s_nationkey").cast("string").alias("ORT01"),
        F.when(key % 4 == 0, "AUTO").when(key % 4 == 1, "CHEM").when(key % 4 == 2, " PHRM").otherwise("??").alias("BRSCH"), F.when(F.col("s_acctbal") < -500, "X").alias("LOEVM"))


RAW_VENDORS = f"""raw_vendors AS (SELECT ltrim(trim("LIFNR"), '0') AS vendor_id, trim("NAME1") AS supplier_name, upper(trim("LAND1")) AS country_code, trim("ORT01") AS city, trim("BRSCH") AS industry_code,
    CASE trim("BRSCH") {' '.join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in INDUSTRY_CODES.items())} ELSE 'Other' END AS industry, CASE trim("BRSCH") {' '.join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in INDUSTRY_CODES.items())} ELSE 'Other' END AS industry_category,
    CASE WHEN {risk_case('upper(trim("LAND1"))')} >= 0.65 THEN 'High' WHEN {risk_case('upper(trim("LAND1"))')} >= 0.4 THEN 'Medium' ELSE 'Low' END AS geo_risk
  FROM lfa1 WHERE coalesce(trim("LOEVM"), '') <> 'X' AND ltrim(trim("LIFNR"), '0') <> '' AND trim("NAME1") NOT IN ('', 'nan', 'NaN', 'None') AND length(trim("NAME1")) > 1)"""


@query(sql(LFA1, RAW_VENDORS, select="SELECT * FROM raw_vendors"))
def raw_vendors(spark, d):
    """C1, F5, F6, F13, F20, X1, X33."""
    return C.build_vendors(_lfa1(spark, d), INDUSTRY_CODES)


# --- purchase orders: headers twice, lines without a price, without a date and of no amount

EKKO = """ekko AS (SELECT CAST(o_orderkey AS VARCHAR) AS "EBELN", CASE WHEN o_orderkey % 9 = 0 THEN 'K' ELSE 'F' END AS "BSTYP", lpad(CAST(o_custkey % 50 AS VARCHAR), 8, '0') AS "LIFNR",
    CASE WHEN o_orderkey % 13 = 0 THEN '00000000' ELSE strftime(CAST(o_orderdate AS DATE), '%Y%m%d') END AS "BEDAT", '1000' AS "EKORG", 'C1' AS "BUKRS", 'EUR' AS "WAERS",
    strftime(CAST(o_orderdate AS DATE), '%Y%m%d') AS "KDATB", CASE WHEN o_orderkey % 2 = 0 THEN strftime(CAST(o_orderdate AS DATE) + 700, '%Y%m%d') END AS "KDATE" FROM orders)"""
EKPO = """ekpo AS (SELECT CAST(l_orderkey AS VARCHAR) AS "EBELN", CAST(l_linenumber AS VARCHAR) AS "EBELP", CAST(l_partkey AS VARCHAR) AS "MATNR", CASE WHEN l_partkey % 2 = 0 THEN 'M1' ELSE 'M2' END AS "MATKL",
    CASE WHEN l_partkey % 7 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS "MENGE", CAST(l_partkey % 90 AS VARCHAR) AS "NETPR", CAST(l_partkey % 50 * 10 AS VARCHAR) AS "NETWR" FROM lineitem)"""


def _ekko(spark, d):
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return C.read(spark, d, "orders").select(
        key.cast("string").alias("EBELN"), F.when(key % 9 == 0, "K").otherwise("F").alias("BSTYP"), F.lpad((F.col("o_custkey") % 50).cast("string"), 8, "0").alias("LIFNR"),
        F.when(key % 13 == 0, "00000000").otherwise(day).alias("BEDAT"), F.lit("1000").alias("EKORG"), F.lit("C1").alias("BUKRS"), F.lit("EUR").alias("WAERS"), day.alias("KDATB"),
        F.when(key % 2 == 0, F.date_format(F.date_add(F.to_date("o_orderdate"), 700), "yyyyMMdd")).alias("KDATE"))


def _ekpo(spark, d):
    part = F.col("l_partkey")
    return C.read(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("EBELN"), F.col("l_linenumber").cast("string").alias("EBELP"), part.cast("string").alias("MATNR"), F.when(part % 2 == 0, "M1").otherwise("M2").alias("MATKL"),
        F.when(part % 7 == 0, "n/a").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("MENGE"), (part % 90).cast("string").alias("NETPR"), (part % 50 * 10).cast("string").alias("NETWR"))


HEADER = """header AS (SELECT * FROM ekko WHERE "BSTYP" = 'F')"""


@query(sql(LFA1, RAW_VENDORS, EKKO, EKPO, HEADER, """lines AS (SELECT p."EBELN" AS po_number, "EBELP" AS po_line, ltrim(trim("LIFNR"), '0') AS vendor_id, CAST(try_strptime("BEDAT", '%Y%m%d') AS DATE) AS po_date, "MATNR" AS material_number, "MATKL" AS material_group,
    try_cast("MENGE" AS DOUBLE) AS quantity, try_cast("NETPR" AS DOUBLE) AS unit_price, coalesce(try_cast("NETPR" AS DOUBLE) * try_cast("MENGE" AS DOUBLE), try_cast("NETWR" AS DOUBLE)) AS transaction_amount, "WAERS" AS currency FROM ekpo p LEFT JOIN header h ON p."EBELN" = h."EBELN")""",
           select="""SELECT l.*, v.supplier_name, CAST(year(po_date) AS INT) AS year, CAST(quarter(po_date) AS INT) AS quarter, CAST(year(po_date) AS VARCHAR) || '-Q' || CAST(quarter(po_date) AS VARCHAR) AS year_quarter
  FROM lines l LEFT JOIN raw_vendors v ON l.vendor_id = v.vendor_id WHERE transaction_amount > 0 AND po_date IS NOT NULL AND l.vendor_id <> ''"""))
def raw_transactions(spark, d):
    """Lines under their headers; a line without a quantity counts with its net value."""
    rows = C.build_transactions(_ekko(spark, d), _ekpo(spark, d), C.build_vendors(_lfa1(spark, d), INDUSTRY_CODES))
    return rows.drop("purchasing_org", "company_code", "month")


@query(sql(EKKO, """c AS (SELECT "EBELN" AS contract_number, ltrim(trim("LIFNR"), '0') AS vendor_id, CAST(try_strptime("KDATB", '%Y%m%d') AS DATE) AS contract_start, CAST(try_strptime("KDATE", '%Y%m%d') AS DATE) AS contract_end FROM ekko WHERE "BSTYP" IN ('K', 'L'))""",
           "e AS (SELECT *, CAST(coalesce(contract_end - DATE '1998-01-01', -999) AS INT) AS days_to_expiry FROM c WHERE vendor_id <> '')",
           select="SELECT *, CASE WHEN days_to_expiry <= -1 THEN 'Expired' WHEN days_to_expiry <= 30 THEN 'Expires <30d' WHEN days_to_expiry <= 60 THEN 'Expires <60d' WHEN days_to_expiry <= 90 THEN 'Expires <90d' ELSE 'Active' END AS contract_status FROM e"))
def raw_contracts(spark, d):
    """C4, F2, F3, J16."""
    return C.build_contracts(_ekko(spark, d), F.lit("1998-01-01").cast("date"))


EKET = """eket AS (SELECT CAST(l_orderkey AS VARCHAR) AS "EBELN", CAST(l_linenumber AS VARCHAR) AS "EBELP", strftime(CAST(l_shipdate AS DATE), '%Y%m%d') AS "EINDT", CAST(CAST(l_quantity AS INT) AS VARCHAR) AS "MENGE" FROM lineitem WHERE l_partkey % 11 <> 0),
  ekbe AS (SELECT CAST(l_orderkey AS VARCHAR) AS "EBELN", CAST(l_linenumber AS VARCHAR) AS "EBELP", CASE WHEN l_partkey % 10 = 0 THEN '2' ELSE '1 ' END AS "VGABE", strftime(CAST(l_shipdate AS DATE) + CAST(l_partkey % 9 - 4 AS INT), '%Y%m%d') AS "BUDAT",
    CAST(CAST(l_quantity AS INT) - l_partkey % 3 AS VARCHAR) AS "MENGE" FROM lineitem)"""


@query(sql(EKKO, EKET, """p AS (SELECT "EBELN" AS po_number, "EBELP" AS po_line, max(CAST(try_strptime("EINDT", '%Y%m%d') AS DATE)) AS promised_date, coalesce(sum(try_cast("MENGE" AS DOUBLE)), 0) AS promised_qty FROM eket GROUP BY 1, 2)""",
           """a AS (SELECT "EBELN" AS po_number, "EBELP" AS po_line, max(CAST(try_strptime("BUDAT", '%Y%m%d') AS DATE)) AS actual_date, coalesce(sum(try_cast("MENGE" AS DOUBLE)), 0) AS actual_qty FROM ekbe WHERE substr("VGABE", 1, 1) = '1' GROUP BY 1, 2)""",
           "b AS (SELECT po_number, po_line, promised_date, promised_qty, actual_date, actual_qty, CAST(coalesce(actual_date - promised_date, 0) AS INT) AS delay_days, CAST(coalesce(actual_qty, 0) >= coalesce(promised_qty, 0) * 0.98::DOUBLE AS INT) AS in_full FROM p FULL JOIN a USING (po_number, po_line))",
           select="""SELECT b.*, CAST(delay_days <= 0 AS INT) AS on_time, CAST(delay_days <= 0 AS INT) * in_full AS otif, ltrim(trim(k."LIFNR"), '0') AS vendor_id FROM b JOIN ekko k ON b.po_number = k."EBELN" WHERE ltrim(trim(k."LIFNR"), '0') <> ''"""))
def raw_deliveries(spark, d):
    """Schedule lines and goods receipts in a full outer join; some lines have only one of them."""
    rows = C.read(spark, d, "lineitem")
    part, q = F.col("l_partkey"), F.col("l_quantity").cast("int")
    key = [F.col("l_orderkey").cast("string").alias("EBELN"), F.col("l_linenumber").cast("string").alias("EBELP")]
    eket = rows.filter(part % 11 != 0).select(*key, F.date_format("l_shipdate", "yyyyMMdd").alias("EINDT"), q.cast("string").alias("MENGE"))
    ekbe = rows.select(*key, F.when(part % 10 == 0, "2").otherwise("1 ").alias("VGABE"), F.date_format(F.date_add(F.to_date("l_shipdate"), (part % 9 - 4).cast("int")), "yyyyMMdd").alias("BUDAT"), (q - part % 3).cast("string").alias("MENGE"))
    return C.build_delivery_events(eket, ekbe, _ekko(spark, d))


@query(sql("r AS (SELECT CAST(o_orderkey % 5000 AS VARCHAR) AS k, CASE WHEN o_orderkey % 19 = 0 THEN 'none' ELSE CAST(o_totalprice AS VARCHAR) END AS t, o_orderstatus AS s, CAST(o_orderkey AS VARCHAR) AS n FROM orders)",
           "v AS (SELECT try_cast(k AS BIGINT) AS order_id, try_cast(t AS DOUBLE) AS amount, s AS status, n FROM r)",
           "o AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY CAST(order_id AS VARCHAR) NULLS LAST, CAST(amount AS DECIMAL(18,2)) NULLS LAST, status NULLS LAST) AS i FROM v)",
           select="SELECT count(*) AS rows, count(DISTINCT order_id) AS orders, count(CASE WHEN row_status = 'error' THEN 1 END) > 0 AS any_error, max(source_file) AS source_file FROM (SELECT *, CASE WHEN amount > 200000 THEN 'error' WHEN amount IS NULL THEN 'null_found' ELSE 'ok' END AS row_status, 'orders' AS source_file FROM o WHERE i = 1)"))
def ingested_orders(spark, d):
    """Standards, types, ranges and one row a key."""
    key = F.col("o_orderkey")
    raw = C.read(spark, d, "orders").select((key % 5000).cast("string").alias("Order No"), F.when(key % 19 == 0, "none").otherwise(F.col("o_totalprice").cast("string")).alias("TOTAL"), F.col("o_orderstatus").alias("state"))
    rows = Q.ingest(raw, {"order_id": ["order no"], "amount": ["total"], "status": ["state"]}, {"order_id": "bigint", "amount": "double"}, {"amount": (None, 200000)}, ["order_id", "amount"], ["order_id"], "orders")
    return rows.agg(F.count("*").alias("rows"), F.countDistinct("order_id").alias("orders"), (F.count_if(F.col("row_status") == "error") > 0).alias("any_error"), F.max("source_file").alias("source_file"))


@query("SELECT 'lineitem' AS \"table\", count(*) AS rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def table_rows(spark, d):
    """Rows of files, by the file's name."""
    names = [C.read(spark, d, n) for n in ("lineitem", "orders", "events")]
    counts = [io.count_rows(df).select(F.regexp_extract("path", r"/([a-z]+)\.parquet[^/]*(/[^/]*)?$", 1).alias("table"), "rows") for df in names]
    return counts[0].union(counts[1]).union(counts[2]).groupBy("table").agg(F.sum("rows").alias("rows"))


@query("SELECT 'c_acctbal' AS \"column\", 'amount' AS role, count(c_acctbal) AS filled FROM customer UNION ALL SELECT 'c_custkey', 'id', count(c_custkey) FROM customer UNION ALL SELECT 'c_name', 'name', count(c_name) FROM customer UNION ALL SELECT 'c_mktsegment', 'other', count(c_mktsegment) FROM customer UNION ALL SELECT 'c_nationkey', 'id', count(c_nationkey) FROM customer")
def column_profile(spark, d):
    """S5."""
    return Q.profile_columns(C.read(spark, d, "customer"), {"amount": ["acctbal", "price"], "name": ["name"], "id": ["key"]}).select("column", "role", "filled")


# --- feeds of three shapes

ARTICLES = """a AS (SELECT 'a' AS kind, doc_id, substr(text, 1, 80) AS title, text AS description, 'http://a/' || doc_id % 300 AS url, 'a.example' AS source_name, TIMESTAMP '2024-01-01' + CAST(doc_id % 30 AS INT) * INTERVAL 1 DAY AS published_at FROM documents WHERE text IS NOT NULL),
  b AS (SELECT 'b' AS kind, page_id AS doc_id, substr(html, 1, 700) AS title, html AS description, url, 'b.example' AS source_name, TIMESTAMP '2024-01-05 10:00:00' AS published_at FROM pages WHERE html IS NOT NULL),
  c AS (SELECT 'c' AS kind, item_id AS doc_id, text AS title, text AS description, 'http://c/' || item_id AS url, 'c' AS source_name, TIMESTAMP '2024-01-07' AS published_at FROM benchmark WHERE text IS NOT NULL),
  articles AS (SELECT substr(md5(kind || '|' || url), 1, 16) AS article_id, substr(title, 1, 500) AS title, substr(description, 1, 1000) AS description, url, source_name, published_at FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c))"""


def _articles(spark, d):
    docs, pages, items = (C.read(spark, d, n) for n in ("documents", "pages", "benchmark"))
    a = docs.filter("text IS NOT NULL").select(F.substring("text", 1, 80).alias("title"), F.col("text").alias("seendescription"), F.concat(F.lit("http://a/"), F.col("doc_id") % 300).alias("url"), F.lit("a.example").alias("domain"),
                                               F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")), "yyyyMMdd'T000000Z'").alias("seendate"))
    b = pages.filter("html IS NOT NULL").select(F.substring("html", 1, 700).alias("title"), F.col("html").alias("description"), "url", F.struct(F.lit("b.example").alias("name")).alias("source"), F.lit("2024-01-05T10:00:00Z").alias("publishedAt"))
    c = items.filter("text IS NOT NULL").select(F.struct(F.col("text").alias("headline"), F.col("text").alias("trailText")).alias("fields"), F.lit("?").alias("webTitle"), F.concat(F.lit("http://c/"), "item_id").alias("webUrl"), F.lit("2024-01-07").alias("webPublicationDate"))
    return io.articles(a, "a").unionByName(io.articles(b, "b")).unionByName(io.articles(c, "c"))


@query(sql(ARTICLES, select="SELECT article_id, md5(title) AS title, md5(description) AS description, url, source_name, CAST(published_at AS DATE) AS published FROM articles"))
def feed_articles(spark, d):
    """Feeds of three shapes in one schema, titles and descriptions cut to length."""
    return _articles(spark, d).select("article_id", F.md5("title").alias("title"), F.md5("description").alias("description"), "url", "source_name", F.to_date("published_at").alias("published"))


@query(sql(ARTICLES, select="SELECT url, min(published_at)::DATE AS published FROM articles GROUP BY url"))
def feed_by_url(spark, d):
    """One article for each url, the earliest."""
    return N.dedup_feed(_articles(spark, d)).select("url", F.to_date("published_at").alias("published"))


def case_of(text: str, categories: dict[str, list[str]]) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in categories.items())
    return f"CASE {whens} END"


SEVERITY = "CASE disruption_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.SEVERITY.items()) + " ELSE 'Low' END"


@query(sql(ARTICLES, f"t AS (SELECT *, {case_of("lower(coalesce(title, '') || ' ' || coalesce(description, ''))", P.DISRUPTIONS)} AS disruption_type FROM articles)",
           select=f"SELECT substr(sha256(title || '|' || source_name), 1, 24) AS event_id, article_id, disruption_type, {SEVERITY} AS severity FROM t WHERE disruption_type IS NOT NULL"))
def disruption_records(spark, d):
    """C19, S19, X11, X29."""
    return N.disruption_events(_articles(spark, d)).drop("title")


@query(sql("found AS (SELECT w AS company FROM documents, (VALUES ('Engin'), ('Thering'), ('Oulare'), ('Ander'), ('Supplier#000000001'), ('Tionale')) t(w) WHERE contains(lower(text), lower(w)))",
           select="SELECT company, count(*) AS mentions, least(0.95::DOUBLE, 0.5::DOUBLE + length(company) / 50.0::DOUBLE) AS confidence FROM found WHERE lower(company) NOT IN (SELECT lower(s_name) FROM supplier) GROUP BY 1"))
def company_discovery(spark, d):
    """C18, X13."""
    texts = C.read(spark, d, "documents").select("text")
    return N.new_companies(texts, C.vendors(spark, d), ["Engin", "Thering", "Oulare", "Ander", "Supplier#000000001", "Tionale"])


@query("SELECT doc_id AS text_id, n_nationkey AS name_id FROM documents, nation WHERE contains(lower(text), lower(substr(n_name, 1, 3))) OR contains(lower(substr(n_name, 1, 3)), lower(text))")
def substring_join(spark, d):
    """Texts that hold a nation's first three letters, or are held by them."""
    names = C.read(spark, d, "nation").select(F.col("n_nationkey").alias("name_id"), F.substring("n_name", 1, 3).alias("name"))
    return N.contains_pairs(C.read(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"), names)


# --- names

@query(sql("k AS (SELECT s_suppkey AS id, s_nationkey + 7 AS master, s_name, s_acctbal FROM supplier)", select="SELECT master, count(*) AS variant_count, min_by(s_name, id) AS master_name, round(avg(s_acctbal), 4) AS mean_balance FROM k GROUP BY 1"))
def merged_vendors(spark, d):
    """C14: one row for each master, here a nation's vendors."""
    s = C.read(spark, d, "supplier")
    rows = s.select(F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("supplier_name"), F.col("s_acctbal").alias("balance"))
    return M.merged(rows, s.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") + 7).alias("master")))


@query(sql("n AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 300000)", select="SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT id FROM n)"))
def unmatched_customers(spark, d):
    """U4: names that nothing matched."""
    left = C.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return M.unmatched(left, C.read(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("left_id")).distinct())


@query()
def sequence_similarity(spark, d):
    """The sequence matcher's ratio of products' names and types, once for each two texts."""
    rows = C.read(spark, d, "part").select(F.lower("p_name").alias("a"), F.lower("p_type").alias("b")).distinct()
    return rows.select("a", "b", F.round(M.sequence_ratio("a", "b"), 6).alias("ratio"))


@query(sql("f AS (SELECT s_suppkey AS vendor_id, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END AS spend FROM supplier)", "g AS (SELECT l_suppkey AS vendor_id, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM lineitem GROUP BY 1)",
           select="SELECT f.vendor_id, coalesce(f.spend, g.spend) AS spend FROM f LEFT JOIN g USING (vendor_id)"))
def combined_spend(spark, d):
    """A value that is there wins over the joined one."""
    own = C.read(spark, d, "supplier").select(F.col("s_suppkey").alias("vendor_id"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal")).alias("spend"))
    other = C.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("vendor_id")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("spend"))
    return R.combine_first(own, other, "vendor_id", ["spend"])


KEYS = "keys AS (SELECT min(doc_id) AS name_id, regexp_extract(text, '[A-Za-z]{6,}') AS name FROM documents WHERE length(regexp_extract(text, '[A-Za-z]{6,}')) >= 6 GROUP BY 2)"


def _keys(docs):
    """Names to look for: the first long word of each text, under its least document."""
    word = F.regexp_extract("text", "[A-Za-z]{6,}", 0)
    return docs.select("doc_id", word.alias("name")).filter(F.length("name") >= 6).groupBy("name").agg(F.min("doc_id").alias("name_id"))


@query(sql(KEYS, select="SELECT name_id, count(DISTINCT doc_id) AS texts FROM documents JOIN keys ON contains(lower(text), lower(name)) GROUP BY 1"))
def name_occurrences(spark, d):
    """How many whole texts hold each of the names, wherever in a word."""
    docs = C.read(spark, d, "documents").select("doc_id", "text")
    hits = mentions(docs.withColumnRenamed("doc_id", "text_id"), _keys(docs).select(F.col("name_id").alias("pattern_id"), F.col("name").alias("pattern")))
    return hits.select(F.col("pattern_id").alias("name_id"), "texts")


@query(sql(KEYS, """known AS (SELECT CASE WHEN name_id % 2 = 0 THEN name ELSE name || 's' END AS name FROM keys WHERE name_id % 3 = 0)""",
           "found AS (SELECT name AS company, count(DISTINCT doc_id) AS mentions FROM documents JOIN keys ON contains(lower(text), lower(name)) GROUP BY 1)",
           """fresh AS (SELECT * FROM found WHERE NOT EXISTS (SELECT 1 FROM known k WHERE round((1 - levenshtein(lower(company), lower(k.name)) / greatest(length(company), length(k.name))::DOUBLE) * 100, 2) >= 85))""",
           select="SELECT company, mentions, least(0.95::DOUBLE, 0.5::DOUBLE + length(company) / 50.0::DOUBLE) AS confidence FROM fresh"))
def unknown_companies(spark, d):
    """Names in whole texts, of which those go that a known one nearly equals; of the names a third are known, half of them with a letter more."""
    docs = C.read(spark, d, "documents").select("doc_id", "text")
    names = _keys(docs)
    known = names.filter("name_id % 3 = 0").select(F.when(F.col("name_id") % 2 == 0, F.col("name")).otherwise(F.concat("name", F.lit("s"))).alias("supplier_name"))
    return N.new_companies(docs.select("text"), known, names.select(F.col("name").alias("company")))
