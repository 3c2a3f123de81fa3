"""Matching, anomaly, recommendation and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F


from procuris.functions.columns import normal_name, rounded
from procuris.operators import anomaly as A
from procuris.operators import matching as M
from procuris.operators import retrieve as V
from procuris.operators import vectorindex as VI
from procuris.plans.features import FEATURES, matrix
from procuris.plans.registry import query
from procuris.plans.tables import sql
from procuris.sources import curate as C


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_name || ' Ltd.')), '[.,''\"]', '', 'g'), '\\s+ltd$', '')) AS norm FROM part")
def name_normalise(spark, d):
    """X6."""
    return C.read(spark, d, "part").select("p_partkey", normal_name(F.concat("p_name", F.lit(" Ltd."))).alias("norm"))


LEFT = "l AS (SELECT s_suppkey AS id, lower(s_name) || ' ' || lower(n_name) AS norm FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
RIGHT = "r AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'trader-' || s_suppkey ELSE lower(replace(s_name, '00000', '0')) || ' ' || lower(n_name) END AS norm FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
SCORED = """toks AS (SELECT l.id AS left_id, r.id AS right_id, l.norm AS ln, r.norm AS rn, list_distinct(string_split(l.norm, ' ')) AS a, list_distinct(string_split(r.norm, ' ')) AS b FROM l, r WHERE list_has_any(string_split(l.norm, ' '), string_split(r.norm, ' '))),
  parts AS (SELECT *, len(list_intersect(a, b)) AS i, len(list_distinct(a || b)) AS u FROM toks),
  scored AS (SELECT left_id, right_id, round(CASE WHEN ln = rn THEN 100.0::DOUBLE ELSE 0.6::DOUBLE * least(100, (i / u + CASE WHEN i = len(a) OR i = len(b) THEN 0.2 ELSE 0 END::DOUBLE) * 100) + 0.4::DOUBLE * ((1 - levenshtein(ln, rn) / greatest(length(ln), length(rn))) * 100) END, 2) AS score FROM parts),
  best AS (SELECT * FROM scored WHERE score >= 50 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) = 1)"""


def _names(spark, d):
    rows = C.read(spark, d, "supplier").join(F.broadcast(C.read(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    left = rows.select(F.col("s_suppkey").alias("id"), F.concat_ws(" ", "s_name", "n_name").alias("name"))
    other = F.concat(F.lit("Trader-"), F.col("s_suppkey"))
    right = rows.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, other).otherwise(F.concat_ws(" ", F.replace("s_name", F.lit("00000"), F.lit("0")), F.col("n_name"))).alias("name"))
    return left, right


@query(sql(LEFT, RIGHT, SCORED, select="SELECT left_id, right_id, score, CASE WHEN score >= 100 THEN 'Exact' WHEN score >= 85 THEN 'High' WHEN score >= 70 THEN 'Medium' ELSE 'Low' END AS confidence FROM best"))
def fuzzy_match(spark, d):
    """C12, J13."""
    return M.fuzzy_match(*_names(spark, d), threshold=50.0)


@query(sql(LEFT, RIGHT, SCORED, select="SELECT (SELECT count(*) FROM l) AS left_names, (SELECT count(*) FROM r) AS right_names, count(*) AS matched, count(DISTINCT right_id) AS right_matched, round(count(*) / (SELECT count(*) FROM l) * 100, 4) AS coverage_pct FROM best"))
def match_summary(spark, d):
    left, right = _names(spark, d)
    return M.match_summary(left, right, M.fuzzy_match(left, right, 50.0))


VARIANTS = """nm AS (SELECT p_partkey AS id, p_brand || ' ' || p_name || ' ' || p_size AS norm FROM part UNION ALL SELECT p_partkey + 1000000000, replace(p_brand || ' ' || p_name || ' ' || p_size, 'e', '') FROM part),
  names AS (SELECT id, lower(norm) AS norm FROM nm)"""


def _variants(spark, d):
    """Names of products by brand, name and size, and each once more with letters lost, under ids of their own."""
    name = F.concat_ws(" ", "p_brand", "p_name", F.col("p_size").cast("string"))
    rows = C.read(spark, d, "part")
    return rows.select(F.col("p_partkey").alias("id"), name.alias("name")).union(rows.select((F.col("p_partkey") + 1_000_000_000).alias("id"), F.replace(name, F.lit("e"), F.lit("")).alias("name")))


@query(sql(VARIANTS, "forms AS (SELECT norm, min(id) AS id FROM names GROUP BY 1)",
           "pairs AS (SELECT x.id AS a, y.id AS b, round((1 - levenshtein(x.norm, y.norm) / greatest(length(x.norm), length(y.norm))::DOUBLE) * 100, 2) AS similarity FROM forms x JOIN forms y ON x.id < y.id AND abs(length(x.norm) - length(y.norm)) <= 0.15 * greatest(length(x.norm), length(y.norm)))",
           select="SELECT a, b, similarity FROM pairs WHERE similarity >= 85 UNION ALL SELECT f.id, n.id, 100 FROM names n JOIN forms f USING (norm) WHERE n.id <> f.id"))
def duplicate_names(spark, d):
    """Pairs of like names among all."""
    return M.duplicate_pairs(_variants(spark, d))


@query()
def consolidate_duplicates(spark, d):
    """Groups of like names, each under its least id."""
    names = _variants(spark, d)
    return M.groups(M.duplicate_pairs(names), names)


ZSQL = ", ".join(f"abs((coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM risk)) - a_{c}) / nullif(s_{c}, 0)) AS z_{c}" for c in A.ANOMALY_FEATURES)


@query(sql(*FEATURES, "st AS (SELECT " + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in A.ANOMALY_FEATURES) + " FROM risk)", f"z AS (SELECT vendor_id, {ZSQL} FROM risk, st)",
           "b AS (SELECT vendor_id, list_max([" + ", ".join(f"struct_pack(z := round(round(coalesce(z_{c}, 0), 4), 3), i := {-i}, c := '{c}')" for i, c in enumerate(A.ANOMALY_FEATURES)) + "]) AS b FROM z)",
           select="SELECT vendor_id, b.z AS max_zscore, b.z > 3.5 AS anomaly_zscore_flag FROM b"))
def zscore_anomaly(spark, d):
    """M14."""
    rows = A.zscores(matrix(spark, d), A.ANOMALY_FEATURES)
    return rows.select("vendor_id", rounded("max_zscore", 3).alias("max_zscore"), "anomaly_zscore_flag")


RULES = """w AS (SELECT quantile_cont(composite_risk_score, 0.75) AS r75, quantile_cont(spend_share, 0.9) AS s90, quantile_cont(financial_stability, 0.1) AS f10, quantile_cont(delivery_performance, 0.95) AS d95, sum(disruption_count_30d) AS total FROM risk),
  reasons AS (SELECT vendor_id, concat_ws('; ', CASE WHEN composite_risk_score >= r75 AND spend_share >= s90 THEN 'High risk + top-10% spend concentration' END,
    CASE WHEN total > 0 AND disruption_count_30d > 2 AND composite_risk_score < r75 THEN 'Active news disruptions (' || disruption_count_30d || ') but low risk score' END,
    CASE WHEN financial_stability <= f10 AND financial_stability < 40 THEN 'Financial stability critically low (' || round(financial_stability) || '/100)' END,
    CASE WHEN delivery_performance >= d95 AND composite_risk_score >= r75 THEN 'Top delivery performance inconsistent with high risk score' END,
    CASE WHEN otif_rate = 0 AND composite_risk_score >= r75 THEN 'No OTIF data for high-risk vendor (monitoring gap)' END) AS r FROM risk, w)"""


@query(sql(*FEATURES, RULES, select="SELECT vendor_id, r <> '' AS rule_based_flag, r AS rule_based_reason FROM reasons"))
def rule_anomaly(spark, d):
    """M15."""
    return A.rules(matrix(spark, d))


@query()
def isolation_forest(spark, d):
    """M13."""
    rows = C.read(spark, d, "orders").select(F.col("o_orderkey").alias("vendor_id"), "o_totalprice", F.month("o_orderdate").alias("m"))
    return A.isolation_forest(rows, ["o_totalprice", "m"])


ALT = [c for c in A.SIMILARITY_FEATURES]
ALT_SQL = ("st AS (SELECT " + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in ALT) + " FROM risk)",
           "z AS (SELECT risk.*, [" + ", ".join(f"CASE WHEN s_{c} > 1e-12 THEN ({c} - a_{c}) / s_{c} ELSE 0 END" for c in ALT) + "]::DOUBLE[] AS v FROM risk, st)",
           """p AS (SELECT s.vendor_id, a.vendor_id AS alt_vendor_id, round(list_cosine_similarity(s.v, a.v), 6) AS similarity, a.composite_risk_score < s.composite_risk_score AS lower, a.country_code <> s.country_code AS abroad
      , s.industry_category = a.industry_category AS alike FROM z s JOIN z a ON s.vendor_id <> a.vendor_id WHERE s.composite_risk_score >= 0.25)""",
           "q AS (SELECT *, round(similarity * CASE WHEN alike THEN 1.2 ELSE 0.8 END::DOUBLE * CASE WHEN abroad THEN 1.1 ELSE 1 END::DOUBLE * CASE WHEN lower THEN 1.15 ELSE 1 END::DOUBLE, 6) AS adjusted FROM p)",
           "t AS (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY adjusted DESC, alt_vendor_id) AS alternative_rank FROM q WHERE adjusted > 0)")


@query(sql(*FEATURES, *ALT_SQL, select="SELECT vendor_id, alt_vendor_id, alternative_rank, round(similarity, 4) AS similarity FROM t WHERE alternative_rank <= 3"))
def alternatives_top3(spark, d):
    """M11."""
    rows = A.alternatives(matrix(spark, d), ALT)
    return rows.select("vendor_id", "alt_vendor_id", F.col("alternative_rank").cast("long").alias("alternative_rank"), F.round("similarity", 4).alias("similarity"))


@query(sql(*FEATURES, *ALT_SQL, select="SELECT vendor_id, alt_vendor_id FROM t WHERE alternative_rank = 1"))
def best_alternative(spark, d):
    """R15, J10."""
    return A.alternatives(matrix(spark, d), ALT, n=1).select("vendor_id", "alt_vendor_id")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
p AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS similarity FROM embeddings, q)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 10""")
def vector_topk(spark, d):
    """The ten nearest of all vectors to each query vector, which are those of ids divisible by 100."""
    e = C.read(spark, d, "embeddings")
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    out = V.top_k(e.select("vec_id", F.col("embedding").alias("v")), queries, 10)
    return out.withColumn("rank", F.col("rank").cast("long"))


def _searched(spark, d):
    e = C.read(spark, d, "embeddings")
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    index = VI.build(e)
    return e, queries, VI.search(index, queries, 10, max(1, round(PROBED * len(index.cells))))


#: The share of cells that a query goes through: vectors here have no clusters, so many cells lie nearly as near (see the README).
PROBED = 0.75


@query()
def vector_index_topk(spark, d):
    """The ten nearest vectors by an index of cells, with their texts and labels; queries are ids divisible by 100."""
    e, _, found = _searched(spark, d)
    texts = e.select("vec_id", F.concat(F.lit("vector "), F.col("vec_id"), F.coalesce(F.concat(F.lit(" of label "), F.col("label")), F.lit(""))).alias("text"), "label")
    return VI.with_texts(found, texts)


@query("SELECT count(*) AS queries, true AS recalled FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL")
def vector_index_recall(spark, d):
    """Whether the index finds nine tenths of what the exact search does."""
    e, queries, found = _searched(spark, d)
    exact = V.top_k(e.select("vec_id", F.col("embedding").alias("v")), queries, 10)
    return VI.recall(found, exact).select("queries", (F.col("recall") >= 0.9).alias("recalled"))


@query("""WITH r AS (SELECT source AS query_id, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents),
c AS (SELECT query_id, doc_id, rank, sum(length(text) * 0.25::DOUBLE) OVER (PARTITION BY query_id ORDER BY rank) AS cost FROM r) SELECT query_id, doc_id, cost FROM c WHERE cost <= 3000""")
def context_pack(spark, d):
    """M26."""
    docs = C.read(spark, d, "documents").select(F.col("source").alias("query_id"), "doc_id", "text")
    return V.pack_in_order(docs, 3000).select("query_id", "doc_id", "cost")


@query()
def vendor_embeddings(spark, d):
    """Texts of vendors as hashed TF-IDF vectors."""
    rows = C.vendors(spark, d).join(C.spend(C.transactions(spark, d)), "vendor_id", "left")
    return V.embed(V.vendor_text(rows).select(F.col("vendor_id").alias("id"), "text"))


