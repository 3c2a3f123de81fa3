"""News, keyed-update and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from procuris.functions import params as P
from procuris.functions.columns import article_id, best_category, first_category, sentiment
from procuris.operators import news as N
from procuris.operators import quality as Q
from procuris.operators import relational as R
from procuris.plans.registry import query
from procuris.plans.tables import DELIVERIES, NEWS, VENDORS, listed, sql
from procuris.sources import curate as C

MEAN = "round(CAST(sum(CAST(sentiment_score AS DECIMAL(18,4))) AS DOUBLE) / count(*), 4)"
RECENT = "recent AS (SELECT * FROM news WHERE published_at >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY)"


def as_of():
    return F.lit(C.NEWS_AS_OF).cast("timestamp")


@query(sql(NEWS, RECENT, select=f"SELECT vendor_id, {MEAN} AS news_sentiment, count(CASE WHEN disruption_flag THEN 1 END) AS disruptions, count(*) AS articles, max(published_at) AS last_at, arg_max(disruption_type, (published_at, article_id)) AS last_type FROM recent GROUP BY 1"))
def news_signals(spark, d):
    return N.signals(C.news(spark, d), as_of()).withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))


@query(sql(NEWS, select=f"SELECT source_name, count(*) AS articles, count(CASE WHEN disruption_flag THEN 1 END) AS disruptions, {MEAN} AS mean_sentiment FROM news GROUP BY 1"))
def news_by_source(spark, d):
    return N.by_source(C.news(spark, d))


@query(sql(NEWS, DELIVERIES, f"bad AS (SELECT vendor_id FROM news GROUP BY 1 HAVING CAST(sum(CAST(sentiment_score AS DECIMAL(18,4))) AS DOUBLE) / count(*) < 0.1::DOUBLE)",
           select="SELECT b.vendor_id IS NOT NULL AS bad_news, count(*) AS deliveries, round(sum(delay_days) / count(*), 4) AS mean_delay FROM deliveries d LEFT JOIN bad b USING (vendor_id) GROUP BY 1"))
def news_delay_gap(spark, d):
    return N.delay_gap(C.news(spark, d), C.deliveries(spark, d), edge=0.1)


@query(sql(NEWS, select=f"SELECT vendor_id, {MEAN} AS mean_sentiment, count(*) AS articles FROM news GROUP BY 1 ORDER BY 2, 1 LIMIT 10"))
def negative_vendors(spark, d):
    """R19."""
    rows = C.news(spark, d).groupBy("vendor_id").agg(F.round(F.sum(F.col("sentiment_score").cast("decimal(18,4)")).cast("double") / F.count("*"), 4).alias("mean_sentiment"), F.count("*").alias("articles"))
    return rows.orderBy("mean_sentiment", "vendor_id").limit(10)


@query(sql(NEWS, RECENT, VENDORS, select="SELECT article_id, vendor_id, supplier_name, disruption_type FROM recent LEFT JOIN vendors USING (vendor_id) WHERE disruption_flag ORDER BY published_at DESC, article_id LIMIT 50"))
def recent_news(spark, d):
    """R7, T2."""
    rows = C.news(spark, d).filter((F.col("published_at") >= as_of() - F.expr("interval 30 days")) & F.col("disruption_flag"))
    rows = rows.orderBy(F.desc("published_at"), "article_id").limit(50)
    return rows.join(C.vendors(spark, d).select("vendor_id", "supplier_name"), "vendor_id", "left").select("article_id", "vendor_id", "supplier_name", "disruption_type")


@query(sql(NEWS, "ranked AS (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY published_at DESC, article_id) AS k FROM news)",
           select="SELECT vendor_id, article_id, CASE WHEN sentiment_score > 0.1::DOUBLE THEN 'Positive' WHEN sentiment_score < -0.1::DOUBLE THEN 'Negative' ELSE 'Neutral' END AS mood FROM ranked WHERE k <= 5"))
def latest_vendor_news(spark, d):
    """R41, C20."""
    return N.capped(C.news(spark, d), 5).select("vendor_id", "article_id", N.mood_band("sentiment_score").alias("mood"))


@query(sql(NEWS, VENDORS, select=f"SELECT region, count(*) AS articles, count(CASE WHEN disruption_flag THEN 1 END) AS disruptions, {MEAN} AS mean_sentiment FROM news JOIN vendors USING (vendor_id) GROUP BY 1"))
def region_news(spark, d):
    """R17."""
    rows = C.news(spark, d).join(C.vendors(spark, d), "vendor_id").groupBy("region")
    return rows.agg(F.count("*").alias("articles"), F.count_if("disruption_flag").alias("disruptions"), F.round(F.sum(F.col("sentiment_score").cast("decimal(18,4)")).cast("double") / F.count("*"), 4).alias("mean_sentiment"))


@query(sql(NEWS, "m AS (SELECT vendor_id, CAST(sum(CAST(sentiment_score AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS s, count(*) AS n FROM news GROUP BY 1)",
           select="SELECT CASE WHEN s > 0.1::DOUBLE THEN 'Positive' WHEN s < -0.1::DOUBLE THEN 'Negative' ELSE 'Neutral' END AS mood, count(*) AS vendors, CAST(sum(n) AS BIGINT) AS articles FROM m GROUP BY 1"))
def feed_summary(spark, d):
    """R44."""
    rows = C.news(spark, d).groupBy("vendor_id").agg((F.sum(F.col("sentiment_score").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("s"), F.count("*").alias("n"))
    return rows.groupBy(N.mood_band("s").alias("mood")).agg(F.count("*").alias("vendors"), F.sum("n").alias("articles"))


@query(f"""WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z\\s]', '', 'g'), '\\s+'), lambda x: x <> '')) AS w FROM documents),
c AS (SELECT doc_id, len(list_intersect(w, {listed(P.PROSE_POSITIVE)})) AS p, len(list_intersect(w, {listed(P.PROSE_NEGATIVE)})) AS n FROM w)
SELECT doc_id, coalesce(CASE WHEN p + n > 0 THEN round((p - n) / (p + n), 3) END, 0)::DOUBLE AS sentiment FROM c""")
def lexicon_sentiment(spark, d):
    """X10 over whole texts, with words of their prose."""
    return C.read(spark, d, "documents").select("doc_id", sentiment("text", P.PROSE_POSITIVE, P.PROSE_NEGATIVE).alias("sentiment"))


def _first_sql(categories: dict) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{k}')" for k in ks) + f" THEN '{c}'" for c, ks in categories.items()) + " END"


@query(f"SELECT doc_id, {_first_sql(P.DISRUPTIONS | P.PROSE_TYPES)} AS disruption_type FROM documents")
def disruption_type(spark, d):
    """X11."""
    return C.read(spark, d, "documents").select("doc_id", first_category("text", P.DISRUPTIONS | P.PROSE_TYPES).alias("disruption_type"))


def _best_sql(categories: dict) -> str:
    scores = [f"struct_pack(n := {' + '.join(f'CAST(contains(lower(text), {k!r}) AS INT)' for k in ks)}, i := {-i}, c := '{c}')" for i, (c, ks) in enumerate(categories.items())]
    return "list_max([" + ", ".join(scores) + "])"


@query(f"WITH b AS (SELECT doc_id, {_best_sql(P.PROSE_TYPES)} AS b FROM documents) SELECT doc_id, CASE WHEN b.n > 0 THEN b.c END AS category FROM b")
def keyword_category(spark, d):
    """X12."""
    return C.read(spark, d, "documents").select("doc_id", best_category("text", P.PROSE_TYPES).alias("category"))


@query(f"SELECT event_type, count(*) AS events, count(DISTINCT json_extract_string(props, '$.k')) AS kinds FROM events GROUP BY 1")
def json_props(spark, d):
    """X31."""
    rows = C.read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("events"), F.countDistinct("k").alias("kinds"))


@query(sql(NEWS, select="SELECT vendor_id, article_id AS event_id, substr(md5(CAST(vendor_id AS VARCHAR) || '|' || url), 1, 16) AS article_id FROM news"))
def article_ids(spark, d):
    """X26."""
    return C.news(spark, d).select("vendor_id", F.col("article_id").alias("event_id"), article_id("vendor_id", "url").alias("article_id"))


ALIASES = f"""names AS (SELECT s_suppkey AS vendor_id, lower(trim(s_name || ' ' || n_name)) AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  words AS (SELECT *, list_filter(string_split_regex(name, '\\s+'), lambda x: length(x) >= 5 AND NOT list_contains({listed(P.ALIAS_STOP)}, x)) AS w FROM names),
  aliases AS (SELECT DISTINCT vendor_id, key FROM (SELECT vendor_id, unnest(list_filter([name, w[1]], lambda x: x IS NOT NULL AND length(x) >= 4)) AS key FROM words))"""


def _aliases(spark, d):
    rows = C.vendors(spark, d).select("vendor_id", F.concat_ws(" ", "supplier_name", "country").alias("supplier_name"))
    return N.alias_index(rows)


@query(sql(ALIASES, select="SELECT * FROM aliases"))
def alias_index(spark, d):
    return _aliases(spark, d)


@query(sql("""keys AS (SELECT DISTINCT lower(regexp_extract(text, '[A-Za-z]{6,}')) AS key, doc_id % 50 AS vendor_id FROM documents WHERE length(regexp_extract(text, '[A-Za-z]{6,}')) >= 6)""",
           "w AS (SELECT DISTINCT doc_id AS article_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}&#]+')) AS key FROM documents)",
           select="SELECT DISTINCT article_id, vendor_id FROM w JOIN keys USING (key) WHERE key <> ''"))
def article_vendor_match(spark, d):
    """Whole texts against keys, here words that texts begin with."""
    docs = C.read(spark, d, "documents")
    word = F.lower(F.regexp_extract("text", "[A-Za-z]{6,}", 0))
    keys = docs.select(word.alias("key"), (F.col("doc_id") % 50).alias("vendor_id")).filter(F.length("key") >= 6).distinct()
    articles = docs.select(F.col("doc_id").alias("article_id"), F.col("text").alias("title"), F.lit(None).cast("string").alias("description"))
    return N.match_articles(articles, keys)


# --- keyed operators

@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_customer(spark, d):
    """W1."""
    rows = C.read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return R.latest_per_key(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


NEW = "fresh AS (SELECT s_suppkey + 50 AS s_suppkey, 'new ' || s_name AS s_name FROM supplier)"


def _fresh(spark, d):
    s = C.read(spark, d, "supplier").select("s_suppkey", "s_name")
    return s, s.select((F.col("s_suppkey") + 50).alias("s_suppkey"), F.concat(F.lit("new "), F.col("s_name")).alias("s_name"))


@query(sql(NEW, select="SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM fresh) UNION ALL SELECT * FROM fresh"))
def upsert_vendors(spark, d):
    """S11."""
    old, new = _fresh(spark, d)
    return R.upsert(old, new, "s_suppkey")


@query(sql(NEW, select="SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT * FROM fresh WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier)"))
def insert_ignore(spark, d):
    """S12."""
    old, new = _fresh(spark, d)
    return R.insert_ignore(old, new, ["s_suppkey"], [F.asc("s_name")])


@query(sql(NEW, select="SELECT s.s_suppkey, CASE WHEN f.s_suppkey IS NOT NULL THEN f.s_name ELSE s.s_name END AS s_name FROM supplier s LEFT JOIN fresh f USING (s_suppkey)"))
def update_from(spark, d):
    """S13."""
    old, new = _fresh(spark, d)
    return R.update_from(old, new, "s_suppkey", ["s_name"])


@query("""SELECT count(CASE WHEN c.k IS NOT NULL AND o.k IS NOT NULL THEN 1 END) AS matched, count(CASE WHEN o.k IS NULL THEN 1 END) AS only_left, count(CASE WHEN c.k IS NULL THEN 1 END) AS only_right
FROM (SELECT DISTINCT c_custkey AS k FROM customer) c FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c.k = o.k""")
def id_overlap(spark, d):
    """J18."""
    return R.id_overlap(C.read(spark, d, "customer").select(F.col("c_custkey").alias("k")), C.read(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT c_mktsegment, count(*) AS customers FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1")
def customers_without_orders(spark, d):
    """J8, U3."""
    rows = C.read(spark, d, "customer").join(C.read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


@query("SELECT c_mktsegment, count(*) AS customers FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1")
def customers_without_urgent_orders(spark, d):
    """J7, J8, U3."""
    urgent = C.read(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return C.read(spark, d, "customer").join(urgent, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


@query("SELECT DISTINCT c_mktsegment FROM customer")
def filter_values(spark, d):
    """F18."""
    return C.read(spark, d, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 0 AND 5000 AND c_name ILIKE '%9%'")
def dynamic_filter(spark, d):
    """Optional conditions, of which one is "all"."""
    rows = R.all_of(C.read(spark, d, "customer"), [F.col("c_mktsegment") == "BUILDING", None, F.col("c_acctbal").between(0, 5000), F.col("c_name").ilike("%9%")])
    return rows.select("c_custkey", "c_name")


# --- quality

DIRTY = """dirty AS (SELECT CAST(l_orderkey AS VARCHAR) AS "Order No", CASE WHEN l_linenumber % 5 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity - 20 AS INT) AS VARCHAR) END AS qty, CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_returnflag END AS flag FROM lineitem)"""
CLEAN = "clean AS (SELECT \"Order No\" AS order_no, try_cast(qty AS INT) AS quantity, flag FROM dirty)"


def _validated(spark, d):
    rows = C.read(spark, d, "lineitem")
    dirty = rows.select(F.col("l_orderkey").cast("string").alias("Order No"), F.when(F.col("l_linenumber") % 5 == 0, "n/a").otherwise((F.col("l_quantity") - 20).cast("int").cast("string")).alias("qty"),
                        F.when(F.col("l_linenumber") % 7 != 0, F.col("l_returnflag")).alias("flag"), F.lit(1).alias("extra"))
    plain = Q.standardize(dirty, {"order_no": ["Order No"], "quantity": ["QTY", "amount"], "flag": []}, ("order_no",))
    return Q.validate(Q.coerce(plain, {"quantity": "int"}), {"quantity": (0, None)}, ["order_no", "quantity", "flag"])


@query(sql(DIRTY, CLEAN, select="""SELECT CASE WHEN quantity < 0 THEN 'error' WHEN quantity IS NULL OR flag IS NULL THEN 'null_found' ELSE 'ok' END AS row_status, count(*) AS rows FROM clean GROUP BY 1"""))
def standardize_validate(spark, d):
    """F14 to F16."""
    return _validated(spark, d).groupBy("row_status").agg(F.count("*").alias("rows"))


@query(sql(DIRTY, CLEAN, select="""SELECT 'lineitem' AS "table", c AS "column", i AS issue, count(*) AS rows FROM (SELECT 'quantity' AS c, CASE WHEN quantity < 0 THEN 'out_of_range' WHEN quantity IS NULL THEN 'null' END AS i FROM clean
  UNION ALL SELECT 'flag', CASE WHEN flag IS NULL THEN 'null' END FROM clean) WHERE i IS NOT NULL GROUP BY 1, 2, 3"""))
def dq_summary(spark, d):
    """F17."""
    return Q.quality_summary(_validated(spark, d), "lineitem")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1")
def dedupe_first(spark, d):
    """W11."""
    rows = C.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return R.keep_first(rows, ["l_orderkey", "l_linenumber"], [F.asc("l_partkey"), F.asc("l_suppkey")])
