"""The vendor feature matrix, composite risk, quadrants and forecasts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procuris.functions import params as P
from procuris.functions.columns import binned, country_risk, country_tier, mapped, poisson_any, rounded, total
from procuris.operators.relational import with_totals


def held(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def filled_spend() -> Column:
    return F.coalesce("total_spend", F.lit(float(P.DEFAULT_SPEND)))


def spend_risk() -> Column:
    """The spend part of B16: off contract, little under contract, concentration."""
    return rounded(F.coalesce("is_maverick", F.lit(False)).cast("double") * 0.5 + F.when(F.coalesce("sum_percentage", F.lit(100.0)) < 60, 0.3).otherwise(0.0)
                   + mapped("concentration_risk", {"HIGH": 0.8, "MEDIUM": 0.4, "LOW": 0.1}, 0.1) * 0.2, 6)


#: Aggregates of the whole table that the steps below divide by or fill with. All are of columns the table has from the
#: start, so `matrix` takes them in one pass; a step that is called alone takes its own.
TOTALS = {
    "_f": lambda: F.percentile("financial_stability", 0.5), "_d": lambda: F.percentile("delivery_performance", 0.5),
    "_all": lambda: F.sum(filled_spend().cast("decimal(18,2)")).cast("double"), "_most": lambda: F.max("disruption_count_30d"), "_worst": lambda: F.max(spend_risk()),
}


def performance(rows: DataFrame) -> DataFrame:
    """Medians where stability or delivery is missing, risk label as a number, their weighted mean and its tier."""
    rows = with_totals(rows, _f=TOTALS["_f"](), _d=TOTALS["_d"]())
    stability, delivery = F.coalesce("financial_stability", "_f", F.lit(60.0)), F.coalesce("delivery_performance", "_d", F.lit(60.0))
    history = mapped(F.lower(F.trim("risk_label")), {"high": 0.9, "medium": 0.5, "low": 0.1}, 0.5)
    score = (stability * 0.35 + delivery * 0.40 + (1 - history) * 100 * 0.25) / 100
    rows = rows.withColumns({"financial_stability": stability, "delivery_performance": delivery, "historical_risk_numeric": history})
    rows = rows.withColumn("performance_composite", rounded(score, 6))
    return rows.withColumn("performance_tier", binned("performance_composite", [0.4, 0.7], ["Poor", "Adequate", "Strong"])).drop("_f", "_d")


def spend_features(rows: DataFrame, threshold: float = P.TOP1_MAX) -> DataFrame:
    """Defaults for missing spend, share, concentration flag, active-quarter trend, and profit impact: log spend
    between the least and the most of the vendor's industry, a half where they are equal."""
    rows = with_totals(rows, _all=TOTALS["_all"]())
    rows = rows.withColumns({"total_spend": filled_spend(), "tx_count": F.coalesce("tx_count", F.lit(P.DEFAULT_COUNT))})
    share = F.try_divide("total_spend", "_all")
    level = F.log1p(F.greatest("total_spend", F.lit(0.0)))
    group = Window.partitionBy("industry_category")
    low, high = F.min(level).over(group), F.max(level).over(group)
    return rows.withColumns({
        "spend_share": F.coalesce(share, F.lit(0.0)), "spend_concentration_flag": (share > threshold).cast("int"), "spend_trend_numeric": held(F.coalesce("active_quarters", F.lit(1)) / 4),
        "profit_impact_score": rounded(F.when(high > low, (level - low) / (high - low)).otherwise(0.5), 6)}).drop("_all")


def news_features(rows: DataFrame) -> DataFrame:
    """No news is neutral; a flag for bad mood or disruptions; their number by the most there is."""
    rows = rows.withColumns({"news_sentiment_30d": F.coalesce("news_sentiment_30d", F.lit(0.0)), "disruption_count_30d": F.coalesce("disruption_count_30d", F.lit(0))})
    rows = with_totals(rows, _most=TOTALS["_most"]())
    flag = (F.col("news_sentiment_30d") < -0.2) | (F.col("disruption_count_30d") > 0)
    return rows.withColumns({"news_risk_flag": flag.cast("int"), "disruption_freq_norm": F.coalesce(F.try_divide("disruption_count_30d", "_most"), F.lit(0.0))}).drop("_most")


def place_features(rows: DataFrame) -> DataFrame:
    """Risk of country and industry, the tier, and a flag for sanctions."""
    return rows.withColumns({"geo_risk_numeric": country_risk("country_code"), "geo_risk_tier": country_tier("country_code"),
                             "sanctioned_country": F.coalesce(F.upper(F.trim("country_code")).isin(*P.SANCTIONED), F.lit(False)).cast("int"),
                             "industry_risk_numeric": mapped("industry_category", P.INDUSTRY_RISK, P.INDUSTRY_RISK_DEFAULT)})


def delivery_features(rows: DataFrame) -> DataFrame:
    """B15."""
    rows = rows.withColumns({"otif_rate": F.coalesce("otif_rate", F.lit(0.75)), "avg_delay_days": F.coalesce("avg_delay_days", F.lit(0.0))})
    return rows.withColumns({"delivery_risk_numeric": held(1 - F.col("otif_rate")), "significant_delay_flag": (F.col("avg_delay_days") > P.SIGNIFICANT_DELAY).cast("int")})


def composite_risk(rows: DataFrame, high: float = P.RISK_HIGH, medium: float = P.RISK_MEDIUM) -> DataFrame:
    """The weighted base, then 15 % news, then 10 % spend risk by its most; held to 0..1 and rounded at each step."""
    w = P.RISK_WEIGHTS
    base = rounded(held(F.col("geo_risk_numeric") * w["geo_risk"] + F.col("industry_risk_numeric") * w["industry_risk"] + F.col("delivery_risk_numeric") * w["delivery_risk"]
                        + F.col("spend_concentration_flag") * w["concentration_risk"]), 4)
    rows = rows.withColumn("_base", base).withColumn("_news", rounded(held(F.col("_base") * 0.85 + F.col("disruption_freq_norm") * 0.15), 4))
    rows = with_totals(rows, _worst=TOTALS["_worst"]())
    score = rounded(held(F.col("_news") * 0.90 + F.coalesce(F.try_divide(spend_risk(), F.col("_worst")), F.lit(0.0)) * 0.10), 4)
    rows = rows.withColumn("composite_risk_score", score)
    return rows.withColumn("risk_label_3class", binned("composite_risk_score", [medium, high], ["Low", "Medium", "High"])).drop("_base", "_news", "_worst")


def matrix(rows: DataFrame) -> DataFrame:
    """B11 to B16 in turn, over one pass for all totals. rows should be saved, as they are read twice."""
    rows = with_totals(rows, **{n: f() for n, f in TOTALS.items()})
    for step in (performance, spend_features, news_features, place_features, delivery_features, composite_risk):
        rows = step(rows)
    return rows


def kraljic(rows: DataFrame) -> DataFrame:
    """Quadrants by the medians of risk and profit impact, with the action."""
    rows = with_totals(rows, _r=F.percentile("composite_risk_score", 0.5), _p=F.percentile("profit_impact_score", 0.5))
    risk, profit = F.col("composite_risk_score") >= F.col("_r"), F.col("profit_impact_score") >= F.col("_p")
    segment = F.when(risk & profit, "Strategic").when(~risk & profit, "Leverage").when(risk & ~profit, "Bottleneck").otherwise("Tactical")
    rows = rows.withColumn("kraljic_segment", segment).drop("_r", "_p")
    actions = {"Strategic": "Build partnership", "Leverage": "Negotiate volume", "Bottleneck": "Secure supply", "Tactical": "Automate purchasing"}
    return rows.withColumn("strategic_action", mapped("kraljic_segment", actions))


def risk_spend_quadrant(rows: DataFrame) -> DataFrame:
    """B26."""
    rows = with_totals(rows, _r=F.percentile("composite_risk_score", 0.5), _s=F.percentile("total_spend", 0.5))
    risk, spend = F.col("composite_risk_score") >= F.col("_r"), F.col("total_spend") >= F.col("_s")
    return rows.withColumn("risk_spend_quadrant", F.when(risk & spend, "High Risk / High Spend").when(risk, "High Risk / Low Spend").when(spend, "Low Risk / High Spend").otherwise("Low Risk / Low Spend")).drop("_r", "_s")


def scaled(rows: DataFrame, columns: list[str], percent: bool = False) -> DataFrame:
    """Medians where values are missing, then between least and most as 0 to 1 (or to 100); equal values are a half."""
    one = rows.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))), *(F.percentile(c, 0.5).alias(f"_mid_{c}") for c in columns))
    rows = rows.crossJoin(F.broadcast(one))
    top = 100.0 if percent else 1.0

    def of(c: str) -> Column:
        low, high = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        return rounded(F.when(high > low, (F.coalesce(c, f"_mid_{c}") - low) / (high - low) * top).otherwise(top / 2), 6)

    return rows.withColumns({f"{c}_scaled": of(c) for c in columns}).drop(*one.columns)


def feature_summary(rows: DataFrame) -> DataFrame:
    """Vendors, mean risk and how many of each label."""
    return rows.agg(F.count("*").alias("vendors"), rounded(F.avg(F.col("composite_risk_score").cast("decimal(18,8)")).cast("double"), 4).alias("mean_risk"),
                    *(F.count_if(F.col("risk_label_3class") == x).alias(x.lower()) for x in ("High", "Medium", "Low")))


def monthly_slope(transactions: DataFrame) -> DataFrame:
    """Slope of a vendor's monthly spend by its mean; under three months, or within 5 %, it is stable."""
    months = transactions.groupBy("vendor_id", (F.col("year") * 12 + F.col("month")).alias("m")).agg(total("transaction_amount").alias("s"))
    rows = months.groupBy("vendor_id").agg(F.count("*").alias("months"), F.regr_slope("s", "m").alias("_slope"), F.avg("s").alias("_mean"))
    slope = rounded(F.try_divide("_slope", "_mean"), 6)
    return rows.select("vendor_id", "months", slope.alias("slope"), F.when(F.col("months") < 3, "stable").when(slope > 0.05, "increasing").when(slope < -0.05, "decreasing").otherwise("stable").alias("trend"))


def disruption_features(events: DataFrame, as_of: Column) -> DataFrame:
    """Number, days since the last, commonest type (ties to the least), yearly frequency by 3, recency risk of 90 and 365 days."""
    days = F.datediff(as_of, F.max(F.to_date("published_at")))
    rows = events.groupBy("vendor_id").agg(F.count("*").alias("disruptions"), days.alias("days_since"), F.mode("disruption_type", True).alias("main_type"))
    return rows.withColumns({"frequency": rounded(F.col("disruptions") / 3, 6), "recency_risk": F.when(F.col("days_since") <= 90, 1.0).when(F.col("days_since") <= 365, 0.5).otherwise(0.1)})


def strategic_features(rows: DataFrame) -> DataFrame:
    """Criticality, quadrant score, labels of two and three classes."""
    quad = mapped("kraljic_segment", {"Strategic": 1.0, "Bottleneck": 0.75, "Leverage": 0.5, "Tactical": 0.25}, 0.25)
    risk = F.col("composite_risk_score")
    return rows.select("vendor_id", quad.alias("quadrant_score"), rounded(0.6 * risk + 0.4 * F.col("profit_impact_score"), 6).alias("criticality_index"), (risk >= 0.5).cast("int").alias("label_binary"),
                       binned(risk, [0.33, 0.66], ["Low", "Medium", "High"]).alias("label_3class"))


def disruption_forecast(rows: DataFrame) -> DataFrame:
    """Chances of a disruption in 30, 60 and 90 days by a Poisson rate raised by risk; rows: vendor_id, disruption_frequency (a year), composite_risk_score."""
    rate = F.coalesce("disruption_frequency", F.lit(0.5)) / 365.0 * (1 + F.coalesce("composite_risk_score", F.lit(0.5)))
    rows = rows.withColumn("_rate", rate)
    rows = rows.withColumns({f"disruption_prob_{h}d": rounded(poisson_any(F.col("_rate"), h), 4) for h in P.HORIZONS})
    rows = rows.withColumns({
        "forecast_risk_30d": binned("disruption_prob_30d", [0.20, 0.50], ["Low", "Medium", "High"]),
        "expected_days_to_disruption": F.round(F.least(F.lit(3650.0), 1 / F.greatest("_rate", F.lit(1e-6)))).cast("int"), "early_warning_flag": (F.col("disruption_prob_30d") >= P.ALERT).cast("int")})
    return rows.drop("_rate")


def portfolio_forecast(events: DataFrame, horizon: int = 3) -> DataFrame:
    """Counts by period (rows: period as a whole number) and a linear forecast with a band of two standard errors of the slope, from 0 up."""
    history = events.groupBy("period").agg(F.count("*").cast("double").alias("value"))
    n, sxx, syy, sxy = F.count("*"), F.regr_sxx("value", "period"), F.regr_syy("value", "period"), F.regr_sxy("value", "period")
    one = history.agg(n.alias("n"), F.max("period").alias("last"), F.regr_slope("value", "period").alias("slope"), F.regr_intercept("value", "period").alias("intercept"), sxx.alias("sxx"), syy.alias("syy"), sxy.alias("sxy"))
    error = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), (F.col("n") - 2) * F.col("sxx"))))
    future = one.withColumn("_e", error).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("period", F.col("last") + F.col("k"))
    guess = F.col("intercept") + F.col("slope") * F.col("period")
    future = future.select("period", rounded(F.greatest(F.lit(0.0), guess), 4).alias("value"), rounded(F.greatest(F.lit(0.0), guess - 2 * F.col("_e")), 4).alias("low"), rounded(guess + 2 * F.col("_e"), 4).alias("high"), F.lit("forecast").alias("kind"))
    return history.select("period", "value", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit("history").alias("kind")).unionByName(future)


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every two columns, pairwise complete, in one pass."""
    pairs = list(combinations(columns, 2))
    one = rows.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    long = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    return long.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), rounded("r", 4).alias("r"))


def histogram(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts of equal-width bins from the least to the most, which is in the last one."""
    rows = with_totals(rows.select(column).filter(F.col(column).isNotNull()), _lo=F.min(column), _hi=F.max(column))
    width = (F.col("_hi") - F.col("_lo")) / bins
    n = F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("_lo")) / width)))
    return rows.groupBy(n.cast("int").alias("bin")).agg(F.count("*").alias("count"))
