"""Column functions: names, text scores, bins, formats, dates and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from procuris.functions import params as P


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normal_id(c: str | Column) -> Column:
    """Trimmed, without leading zeros."""
    return F.regexp_replace(F.trim(col(c)), "^0+", "")


def or_unclassified(c: str | Column, default: str = "Unclassified") -> Column:
    """Blank and null become the default."""
    return F.coalesce(F.nullif(F.trim(col(c)), F.lit("")), F.lit(default))


def year_quarter(c: str | Column) -> Column:
    """2024-Q1."""
    return F.concat(F.year(col(c)), F.lit("-Q"), F.quarter(col(c)))


def money(c: str | Column) -> Column:
    """Cents-exact amounts, for sums that do not depend on the order."""
    return col(c).cast("decimal(18,2)")


def rounded(c: str | Column, places: int) -> Column:
    """Rounded to so many places by the nearest whole number of units, half away from zero, as SQL engines round doubles.

    F.round goes by the decimal form, so that a number just under a half, such as 0.39465 as a double, has another last place.
    """
    return F.round(col(c) * 10.0**places) / 10.0**places


def total(c: str | Column) -> Column:
    """Sum of an amount, exact, as a double."""
    return F.sum(money(c)).cast("double")


def normal_name(c: str | Column, anywhere: bool = False, suffixes: list[str] = P.SUFFIXES) -> Column:
    """A company name in small letters without legal suffixes and punctuation.

    anywhere cuts the suffixes wherever they stand, in list order; else words count at the end of the name only.
    """
    name = F.lower(F.trim(col(c)))
    if anywhere:
        name = reduce(lambda n, s: F.replace(n, F.lit(s), F.lit("")), suffixes, name)
    else:
        words = [s.strip().rstrip(".").replace(".", "").replace("& ", "") for s in suffixes if s.strip(" .,'\"")]
        name = F.regexp_replace(F.regexp_replace(name, r"[.,'\"]", ""), rf"(\s+(&\s+)?({'|'.join(dict.fromkeys(words))}))+$", "")
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def tokens(c: str | Column) -> Column:
    return F.array_distinct(F.filter(F.split(col(c), " "), lambda w: w != ""))


def token_score(a: str | Column, b: str | Column) -> Column:
    """Jaccard of the words, plus 0.2 if one set holds the other, times 100, at most 100."""
    x, y = tokens(a), tokens(b)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    held = F.when((both == F.size(x)) | (both == F.size(y)), 0.2).otherwise(0.0)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.least(F.lit(100.0), (both / either + held) * 100))


def edit_ratio(a: str | Column, b: str | Column) -> Column:
    """100 times one less the edit distance's share of the longer length; two empty names are equal."""
    longest = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.when(longest == 0, 100.0).otherwise((1 - F.levenshtein(col(a), col(b)) / longest) * 100)


def word_set(c: str | Column) -> Column:
    """Distinct words of a text in small letters, other signs dropped."""
    plain = F.regexp_replace(F.lower(col(c)), r"[^a-z\s]", "")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: w != ""))


def sentiment(c: str | Column, positive: list[str] = P.POSITIVE, negative: list[str] = P.NEGATIVE) -> Column:
    """(positive - negative) / both over distinct words, three places; 0 without either and for null."""
    words = word_set(c)
    up = F.size(F.array_intersect(words, F.array(*map(F.lit, positive))))
    down = F.size(F.array_intersect(words, F.array(*map(F.lit, negative))))
    return F.coalesce(F.when(up + down > 0, F.round((up - down) / (up + down), 3)), F.lit(0.0))


def has_any(c: Column, keywords: list[str], whole_words: bool = False) -> Column:
    if whole_words:
        return c.rlike(r"\b(" + "|".join(k.lower() for k in keywords) + r")\b")
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(k.lower())) for k in keywords))


def first_category(c: str | Column, categories: dict[str, list[str]] = P.DISRUPTIONS, whole_words: bool = False) -> Column:
    """X11: the first category with a keyword in the text; null without."""
    text = F.lower(col(c))
    return F.coalesce(*(F.when(has_any(text, words, whole_words), F.lit(name)) for name, words in categories.items()))


def best_category(c: str | Column, categories: dict[str, list[str]]) -> Column:
    """The category with most of its keywords in the text, ties to the first; null without any."""
    text = F.lower(col(c))
    scored = [F.struct(reduce(lambda a, b: a + b, (F.contains(text, F.lit(k.lower())).cast("int") for k in words)).alias("n"),
                       F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, words) in enumerate(categories.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["name"])


def parsed_time(c: str | Column, formats: list[str]) -> Column:
    """The first format that parses, else null."""
    return F.coalesce(*(F.try_to_timestamp(col(c), F.lit(f)) for f in formats))


def binned(c: str | Column, upper: list[float], labels: list[str]) -> Column:
    """Labels of right-closed bins; upper bounds rise, the last label is above all of them. Null stays null."""
    out = F.when(col(c) <= upper[0], labels[0])
    for bound, name in zip(upper[1:], labels[1:]):
        out = out.when(col(c) <= bound, name)
    return F.when(col(c).isNotNull(), out.otherwise(labels[-1]))


def literal(x) -> str:
    """A value as a SQL literal."""
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{x!r}D" if isinstance(x, float) else str(x)


def mapped(c: str | Column, table: dict, default=None) -> Column:
    """A small dictionary's value, else the default."""
    pairs = F.expr("map(" + ", ".join(literal(x) for kv in table.items() for x in kv) + ")")
    found = F.try_element_at(pairs, col(c))
    return found if default is None else F.coalesce(found, F.lit(default))


def country_risk(c: str | Column) -> Column:
    """Supply risk of a country code; sanctioned ones have a floor, unknown ones the default."""
    code = F.upper(F.trim(col(c)))
    known = mapped(code, P.COUNTRY_RISK)
    return F.when(code.isin(*P.SANCTIONED), F.greatest(F.coalesce(known, F.lit(P.SANCTION_DEFAULT)), F.lit(P.SANCTION_FLOOR))).otherwise(
        F.coalesce(known, F.lit(P.COUNTRY_RISK_DEFAULT)))


def country_tier(c: str | Column) -> Column:
    risk = country_risk(c)
    return F.when(risk >= 0.65, "High").when(risk >= 0.40, "Medium").otherwise("Low")


def months_later(c: str | Column, n: int | Column) -> Column:
    """The same day so many months later, or the month's last."""
    return F.add_months(col(c), n)


def decoded(c: str | Column, codes: dict[str, tuple[str, str]], default: str = "Other") -> Column:
    """A code's label and category as a struct; unknown and blank codes have the default for both."""
    code = F.trim(col(c))
    return F.struct(mapped(code, {k: v[0] for k, v in codes.items()}, default).alias("label"), mapped(code, {k: v[1] for k, v in codes.items()}, default).alias("category"))


def guessed_industry(c: str | Column, words: dict[str, list[str]] = P.INDUSTRY_WORDS, default: str = "Other") -> Column:
    """The first industry with a word in the company's name, case aside."""
    return F.coalesce(first_category(c, words), F.lit(default))


def region_of(country: str | Column, regions: dict[str, list[str]] = P.REGIONS) -> Column:
    """The region whose list has the country code; null without one."""
    return mapped(F.upper(F.trim(col(country))), {code: region for region, codes in regions.items() for code in codes})


def shown_feature(name: str | Column, value: str | Column) -> Column:
    """A feature's value as a reader sees it, by the feature's name; three decimals for names without a form of their own."""
    n, v = col(name), col(value)
    whole = v.cast("long")
    return (F.when(v.isNull(), F.lit("n/a"))
            .when(n.isin("financial_stability", "delivery_performance"), F.format_string("%.1f/100", v))
            .when(n == "total_annual_spend", F.concat(F.lit("$"), F.format_number(v, 0)))
            .when(n == "spend_pct_of_portfolio", F.format_string("%.1f%%", v * 100))
            .when(n == "disruption_count", F.format_string("%d events", whole))
            .when(n == "days_since_last_disruption", F.format_string("%d days", whole))
            .when(n.isin("spend_concentration_flag", "geo_risk_flag", "high_disruption_flag"), F.when(v > 0.5, "Yes").otherwise("No"))
            .when(n == "historical_risk_numeric", F.when(v > 0.7, "High").when(v > 0.3, "Medium").otherwise("Low"))
            .when(n.isin("kraljic_quadrant", "quadrant_score"), F.when(v >= 0.9, "Strategic").when(v >= 0.7, "Bottleneck").when(v >= 0.4, "Leverage").otherwise("Tactical"))
            .otherwise(F.format_string("%.3f", v)))


def quarter_asked(c: str | Column) -> Column:
    """the quarter that a text names (q1 to q4), else null."""
    return F.nullif(F.regexp_extract(F.lower(col(c)), r"\bq([1-4])\b", 1), F.lit("")).cast("int")


def days_asked(c: str | Column) -> Column:
    """the number of days that a text names, else null."""
    return F.nullif(F.regexp_extract(F.lower(col(c)), r"(\d+)\s*day", 1), F.lit("")).cast("int")


def percent_asked(c: str | Column) -> Column:
    """the share that a text asks to shift, before the verb or else behind it; null without one."""
    verb = "(?:shift|move|transfer|reallocate)"
    found = [F.nullif(F.regexp_extract(F.lower(col(c)), p, 1), F.lit("")) for p in (rf"(\d+)%?\s*{verb}", rf"{verb}[^\d]*(\d+)%?")]
    return F.coalesce(*found).cast("int")


def shown_money(c: str | Column) -> Column:
    """$1.2M, $3.4K, $56; n/a for null."""
    v = col(c)
    return (F.when(v.isNull(), "n/a").when(F.abs(v) >= 1e9, F.format_string("$%.1fB", v / 1e9)).when(F.abs(v) >= 1e6, F.format_string("$%.1fM", v / 1e6))
            .when(F.abs(v) >= 1e3, F.format_string("$%.1fK", v / 1e3)).otherwise(F.format_string("$%.0f", v)))


def article_id(vendor: str | Column, url: str | Column) -> Column:
    """16 hex digits of md5(vendor|url)."""
    return F.substring(F.md5(F.concat_ws("|", col(vendor).cast("string"), col(url))), 1, 16)


def poisson_any(rate_per_day: Column, days: int) -> Column:
    """The chance of at least one event."""
    return 1 - F.exp(-rate_per_day * days)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Null if either is a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def alias_keys(c: str | Column, stop: list[str] = P.ALIAS_STOP) -> Column:
    """The name in small letters, and its first word of five letters or more that is no stop word; keys of four or more."""
    name = F.lower(F.trim(col(c)))
    long = F.filter(F.split(name, r"\s+"), lambda w: (F.length(w) >= 5) & ~w.isin(*stop))
    keys = F.array_distinct(F.array_compact(F.array(name, F.get(long, F.lit(0)))))
    return F.filter(keys, lambda k: F.length(k) >= 4)
