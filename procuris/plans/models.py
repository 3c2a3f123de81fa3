"""Model and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from procuris.operators import explain as E
from procuris.operators import models as M
from procuris.operators import shapley as S
from procuris.plans.features import FEATURES, matrix
from procuris.plans.registry import query
from procuris.plans.tables import sql
from procuris.sources import curate as C
from procuris.sources.shared import at_exit, saved, shared_dir
from procuris.streaming import feeds

LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark, d):
    """A row for each line, with a key and a label to learn."""
    rows = C.read(spark, d, "lineitem")
    return rows.select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("vendor_id"), *LINES, F.when(F.col("l_extendedprice") > 60000, "High").when(F.col("l_extendedprice") > 20000, "Medium").otherwise("Low").alias("risk_label_3class"))


#: The figures that the risk models see.
RISK_FEATURES = ["financial_stability", "delivery_performance", "profit_impact_score", "total_spend", "tx_count", "spend_share", "geo_risk_numeric", "industry_risk_numeric", "news_sentiment_30d", "disruption_count_30d", "otif_rate", "avg_delay_days",
                 "performance_composite", "delivery_risk_numeric", "spend_concentration_flag", "news_risk_flag", "historical_risk_numeric", "active_quarters", "spend_trend_numeric", "disruption_freq_norm", "sanctioned_country", "significant_delay_flag"]


@query()
def risk_model(spark, d):
    """M1 to M4: risk classes of all vendors by a forest of 200 trees on 22 figures, with its held-out measures over five folds."""
    rows = matrix(spark, d)
    folds = M.cross_validated(rows, RISK_FEATURES, "risk_label_3class").agg(F.round(F.avg("accuracy"), 4).alias("accuracy"), F.round(F.avg("f1"), 4).alias("f1"))
    filled = M.spread(M.balanced(M.imputed(rows, RISK_FEATURES), "risk_label_3class"), rows.count())
    model = M.classifier("forest", RISK_FEATURES, "risk_label_3class").fit(filled)
    told = M.predictions(model, rows, RISK_FEATURES, "vendor_id", "run-1").groupBy("predicted").agg(F.count("*").alias("rows"))
    return told.crossJoin(F.broadcast(folds))


@query()
def line_model(spark, d):
    """M1 to M4: the better of two models of lines' price classes, without the price, over all lines: 200 trees, and 200 rounds for each class."""
    rows, features = _lines(spark, d), ["l_quantity", "l_discount", "l_tax"]
    model, _ = M.best_model(rows, features, "risk_label_3class")
    return M.predictions(model, rows, features, "vendor_id", "run-1").groupBy("predicted").agg(F.count("*").alias("rows"))


#: A model that SQL can tell as well: classes of lines by their quantity.
TOLD = "told AS (SELECT CASE WHEN l_extendedprice > 60000 THEN 'High' WHEN l_extendedprice > 20000 THEN 'Medium' ELSE 'Low' END AS label, CASE WHEN l_quantity > 40 THEN 'High' WHEN l_quantity > 12 THEN 'Medium' ELSE 'Low' END AS predicted, l_quantity / 50::DOUBLE AS high, 1 - l_quantity / 50::DOUBLE AS low, 1 - abs(l_quantity - 25) / 25::DOUBLE AS medium FROM lineitem)"


def _told(spark, d):
    q = F.col("l_quantity")
    predicted = F.when(q > 40, "High").when(q > 12, "Medium").otherwise("Low")
    return C.read(spark, d, "lineitem").select(F.when(F.col("l_extendedprice") > 60000, "High").when(F.col("l_extendedprice") > 20000, "Medium").otherwise("Low").alias("label"), predicted.alias("predicted"),
                                               (q / 50).alias("high"), (1 - q / 50).alias("low"), (1 - F.abs(q - 25) / 25).alias("medium"))


@query(f"""WITH {TOLD}, s AS (SELECT x AS label, count(CASE WHEN label = x AND predicted = x THEN 1 END) AS hit, count(CASE WHEN label = x THEN 1 END) AS support, count(CASE WHEN predicted = x THEN 1 END) AS told FROM told, (VALUES ('High'), ('Medium'), ('Low')) t(x) GROUP BY 1),
r AS (SELECT label, hit / told AS precision, hit / support AS recall, 2 * hit / (told + support) AS f1, support, hit FROM s)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hit) / sum(support), 6), sum(support)::BIGINT FROM r UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM r
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM r""")
def class_report(spark, d):
    """M3: precision, recall and F1 of each class."""
    rows = M.class_report(_told(spark, d), "label", "predicted")
    return rows.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""WITH {TOLD}, x AS (SELECT 'High' AS of, high AS s, label = 'High' AS hit FROM told UNION ALL SELECT 'Low', low, label = 'Low' FROM told UNION ALL SELECT 'Medium', medium, label = 'Medium' FROM told),
r AS (SELECT of, hit, rank() OVER (PARTITION BY of ORDER BY s) + (count(*) OVER (PARTITION BY of, s) - 1) / 2 AS rk FROM x),
n AS (SELECT of, sum(CASE WHEN hit THEN rk END) AS ranks, count(CASE WHEN hit THEN 1 END) AS p, count(CASE WHEN NOT hit THEN 1 END) AS q FROM r GROUP BY 1) SELECT of AS label, round((ranks - p * (p + 1) / 2) / (p * q), 6) AS auc, p AS positives FROM n""")
def multiclass_auc(spark, d):
    """M3: each class against the rest by ranks."""
    return M.rank_auc(_told(spark, d), "label", {"High": "high", "Low": "low", "Medium": "medium"}).withColumn("auc", F.round("auc", 6))


@query()
def feature_importance(spark, d):
    """M5."""
    rows = M.condensed(M.binned(M.imputed(_lines(spark, d), LINES), LINES), LINES, "risk_label_3class")
    rows = M.balanced(rows, "risk_label_3class", "rows")
    return M.importances(M.classifier("forest", LINES, "risk_label_3class", trees=200).fit(rows), LINES, spark)


def _line_forest(rows):
    """A forest of 20 trees of lines' price classes, fitted to all lines."""
    alike = M.condensed(M.imputed(rows, LINES), LINES, "risk_label_3class")
    return M.classifier("forest", LINES, "risk_label_3class", trees=20).fit(M.balanced(alike, "risk_label_3class", "rows"))


def _alike(rows):
    """(lines, the figures): lines alike in all figures as one, over all cores, as each has the same contributions."""
    alike = saved(rows.groupBy(*LINES).agg(F.count("*").alias("lines")))
    return M.spread(alike, alike.count())


@query("SELECT count(*) AS rows, count(*) AS additive, count(*) AS as_predicted FROM lineitem")
def forest_shapley(spark, d):
    """M17 for a fitted forest: lines whose contributions add up to their chance less the mean, and whose chance is the model's own."""
    rows = M.binned(_lines(spark, d), LINES)
    model, alike = _line_forest(rows), _alike(rows).withColumn("vendor_id", F.monotonically_increasing_id())
    alike = saved(alike)
    told = model.transform(alike).select("vendor_id", "lines", F.array_max(vector_to_array("probability")).alias("chance"))
    total = F.aggregate("contributions", F.lit(0.0), lambda s, x: s + x)
    explained = S.forest_shapley(model.stages[-1], alike, LINES).select("vendor_id", "prediction", (F.abs(total + F.col("expected") - F.col("prediction")) < 1e-9).alias("additive"))
    lines = lambda which: F.coalesce(F.sum(F.when(which, F.col("lines"))), F.lit(0)).cast("long")
    return explained.join(told, "vendor_id").agg(lines(F.lit(True)).alias("rows"), lines(F.col("additive")).alias("additive"), lines(F.abs(F.col("chance") - F.col("prediction")) < 1e-9).alias("as_predicted"))


@query()
def shapley_drivers(spark, d):
    """Mean size of each feature's contribution to the chance of a high price, and of how many lines it is the first driver."""
    rows = M.binned(_lines(spark, d), LINES)
    explained = S.forest_shapley(_line_forest(rows).stages[-1], _alike(rows), LINES, key="lines", of=0)  # the number of lines goes along
    long = S.contributions_long(explained, LINES, key="lines")
    return long.groupBy("feature").agg((F.sum(F.abs("contribution") * F.col("lines")) / F.sum("lines")).alias("mean_size"), F.coalesce(F.sum(F.when(F.col("driver") == 1, F.col("lines"))), F.lit(0)).cast("long").alias("first_of"))


@query()
def text_classifier(spark, d):
    """M6: languages of documents from words and pairs of words, learned from four fifths of them and told of the rest."""
    rows = C.read(spark, d, "documents").filter("lang is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    train, test = M.stratified_split(rows, "doc_id", "lang")
    train = M.balanced(train, "lang")
    model = M.text_classifier(train, "text", "lang")
    return model.transform(test).groupBy("lang").agg(F.count("*").alias("rows"), F.count_if(F.col("label") == F.col("prediction")).alias("right"))


@query()
def kmeans_segments(spark, d):
    """M7, M10, A23."""
    out, _ = M.kmeans(matrix(spark, d), ["composite_risk_score", "total_spend", "otif_rate", "profit_impact_score"])
    return M.cluster_profile(out, more=["disruption_count_30d"])


@query(sql(*FEATURES, "m AS (SELECT median(composite_risk_score) AS r, median(total_spend) AS s, median(performance_composite) AS p FROM risk)",
           "c AS (SELECT vendor_id % 7 AS cluster_id, count(*) AS vendors, avg(composite_risk_score) AS mr, avg(total_spend) AS ms, avg(performance_composite) AS mp FROM risk GROUP BY 1)",
           "l AS (SELECT cluster_id, vendors, CASE WHEN mr > r AND ms > s THEN 'Critical High-Spend' WHEN mr > r THEN 'Vulnerable Low-Spend' WHEN ms > s THEN 'Stable Strategic' WHEN mp > p THEN 'Reliable Tactical' ELSE 'Underperforming Tail' END AS cluster_label FROM c, m)",
           select="SELECT *, CASE cluster_label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.CLUSTER_ACTIONS.items()) + " END AS cluster_action FROM l"))
def cluster_labels(spark, d):
    """Names and actions of groups of vendors, here by their numbers, against the medians of all."""
    rows = matrix(spark, d).withColumn("cluster_id", F.col("vendor_id") % 7)
    return M.cluster_profile(rows).select("cluster_id", "vendors", "cluster_label", "cluster_action")


@query()
def cluster_search(spark, d):
    """M8."""
    return M.best_k(matrix(spark, d), ["composite_risk_score", "total_spend", "otif_rate"], range(2, 9))


@query()
def pca2(spark, d):
    """M9."""
    return M.pca2(_lines(spark, d), LINES)


def _predict(df):
    """A model to explain: the price of a line from its other figures, as a plain formula."""
    return df.withColumn("prediction", F.col("l_quantity") * 2.0 + F.col("l_discount") * F.col("l_quantity") - F.col("l_tax"))


@query()
def sampled_shapley(spark, d):
    """M17 for a model that is no sum."""
    return E.sampled_shapley(_lines(spark, d), "vendor_id", ["l_quantity", "l_discount", "l_tax"], _predict)


@query()
def permutation_importance(spark, d):
    """The fall of the correlation with the price when a figure is shuffled."""
    return E.permutation_importance(_lines(spark, d), "vendor_id", ["l_quantity", "l_discount"], lambda df: _predict(df).agg(F.corr("prediction", "l_extendedprice")).first()[0], repeats=20)


@query()
def local_surrogate(spark, d):
    """M20, for orders as rows."""
    rows = C.read(spark, d, "orders").select(F.col("o_orderkey").alias("vendor_id"), F.col("o_totalprice").alias("p"), F.month("o_orderdate").cast("double").alias("m")).groupBy("vendor_id").agg(F.max("p").alias("p"), F.max("m").alias("m"))
    return E.local_surrogate(rows, "vendor_id", ["p", "m"], lambda df: df.withColumn("prediction", F.col("p") / 1000 + F.col("m") ** 2))


# --- streams

def _folder(spark) -> str:
    path = f"{shared_dir(spark)}/procuris/stream-{uuid.uuid4().hex}"
    at_exit(spark, path)
    return path


def _feed(spark, d):
    like = C.read(spark, d, "events")
    rows = feeds.as_stream(spark, d, "events*.parquet", like)
    return rows.select("ts", (F.col("user_id") % 100).alias("vendor_id"), (F.col("event_type") == "error").alias("disruption_flag"), F.col("event_id").cast("string").alias("url"))


EVENTS = "f AS (SELECT ts, user_id % 100 AS vendor_id, event_type = 'error' AS disruption_flag, CAST(event_id AS VARCHAR) AS url FROM events)"


@query(f"WITH {EVENTS} SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS disruptions FROM f WHERE disruption_flag GROUP BY 1")
def stream_daily(spark, d):
    """E3, with the open windows too."""
    return feeds.drained(feeds.daily_counts(_feed(spark, d)), _folder(spark), "complete").withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(f"WITH {EVENTS}, w AS (SELECT *, date_trunc('day', ts) + INTERVAL (k) DAY AS window_end FROM f, range(1, 31) t(k)) SELECT CAST(window_end AS TIMESTAMP) AS window_end, vendor_id, count(*) AS articles, count(CASE WHEN disruption_flag THEN 1 END) AS disruptions FROM w GROUP BY 1, 2")
def stream_rolling_signals(spark, d):
    """E2."""
    rows = feeds.kept(feeds.rolling_panes(_feed(spark, d)), _folder(spark), ["window_end", "vendor_id"], ["articles"])
    return rows.withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@query(f"WITH {EVENTS}, w AS (SELECT *, date_trunc('day', ts) + INTERVAL (k) DAY AS window_end FROM f, range(1, 31) t(k)), s AS (SELECT window_end, vendor_id, count(*) AS articles, count(CASE WHEN disruption_flag THEN 1 END) AS disruptions FROM w GROUP BY 1, 2) SELECT CAST(max(window_end) AS TIMESTAMP) AS window_end, vendor_id, max_by(disruptions, window_end) AS disruptions FROM s WHERE disruptions >= 2 GROUP BY vendor_id")
def stream_alerts(spark, d):
    """E5: of each vendor the latest window with two disruptions or more, upserted batch by batch."""
    rows = feeds.kept(feeds.alerts(feeds.rolling_panes(_feed(spark, d)), 2), _folder(spark), ["vendor_id"], ["window_end", "disruptions"])
    return rows.select(F.col("window_end").cast("timestamp_ntz").alias("window_end"), "vendor_id", "disruptions")


@query(f"WITH {EVENTS} SELECT DISTINCT vendor_id, url FROM f")
def stream_dedup(spark, d):
    """E1."""
    return feeds.drained(feeds.dedup(_feed(spark, d), ["vendor_id", "url"], "60 days"), _folder(spark)).select("vendor_id", "url")


@query(f"""WITH {EVENTS}, o AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS n FROM f WHERE disruption_flag WINDOW w AS (PARTITION BY vendor_id ORDER BY ts)),
g AS (SELECT *, sum(n) OVER (PARTITION BY vendor_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT vendor_id, CAST(min(ts) AS TIMESTAMP) AS begins, CAST(max(ts) + INTERVAL 6 HOUR AS TIMESTAMP) AS ends, count(*) AS articles FROM g GROUP BY vendor_id, s""")
def stream_sessions(spark, d):
    """E4."""
    rows = feeds.drained(feeds.episodes(_feed(spark, d)), _folder(spark), "complete")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("begins", "ends")})


#: The feed in three deliveries, of which the last ones bring events of all days once more.
PARTS = 3


def _delivered(spark, d, take):
    """Run take(feed, folder) after each of the deliveries, which a folder gathers, and return what the last run gives."""
    like, folder, out = C.read(spark, d, "events"), _folder(spark), None
    for n in range(PARTS):
        like.filter(F.pmod("event_id", F.lit(PARTS)) == n).write.mode("append").parquet(f"{folder}/in")
        rows = feeds.as_stream(spark, f"{folder}/in", "*.parquet", like, None)
        out = take(rows.select("ts", (F.col("user_id") % 100).alias("vendor_id"), (F.col("event_type") == "error").alias("disruption_flag"), F.col("event_id").cast("string").alias("url")), folder)
    return out


DELIVERIES_IN = f"e AS (SELECT ts, event_id % {PARTS} AS batch, event_type = 'error' AS disruption_flag FROM events), marks AS (SELECT batch, count(*) AS rows, max(ts) AS latest FROM e GROUP BY 1), w AS (SELECT batch, rows, max(latest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS watermark FROM marks)"


@query(f"WITH {DELIVERIES_IN} SELECT CAST(w.batch AS BIGINT) AS batch, any_value(w.rows) AS rows, count(CASE WHEN date_trunc('day', ts) + INTERVAL 1 DAY <= watermark THEN 1 END) AS late_rows, CAST(any_value(watermark) AS TIMESTAMP) AS watermark FROM w JOIN e ON e.batch = w.batch GROUP BY 1")
def stream_late_rows(spark, d):
    """Rows behind the watermark in each of three deliveries of the feed, counted across runs that go on from one checkpoint."""
    return _delivered(spark, d, feeds.late_account).withColumn("watermark", F.col("watermark").cast("timestamp_ntz"))


@query(f"WITH {DELIVERIES_IN}, day AS (SELECT date_trunc('day', ts) AS day, count(*) AS disruptions FROM e JOIN w USING (batch) WHERE disruption_flag AND (watermark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > watermark) GROUP BY 1) SELECT CAST(day AS TIMESTAMP) AS day, disruptions FROM day WHERE day + INTERVAL 1 DAY <= (SELECT max(latest) - INTERVAL 1 DAY FROM marks)")
def stream_closed_days(spark, d):
    """Disruptions of days that the watermark has closed, each put out once; late rows are left out and closed days leave the state."""
    rows = _delivered(spark, d, lambda feed, folder: feeds.drained(feeds.daily_counts(feed), folder))
    return rows.withColumn("day", F.col("day").cast("timestamp_ntz"))
