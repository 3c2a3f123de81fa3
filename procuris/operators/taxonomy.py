"""Classification of order lines into a taxonomy of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procuris.functions.columns import best_category, mapped, total
from procuris.operators.relational import with_totals

# Material groups by taxonomy segment.
GROUPS = {
    "43": ["001", "ELEC", "COMP", "IT", "HW", "SW", "SOFT", "TELE", "ELE", "EDV"], "12": ["002", "CHEM", "CHE"], "41": ["LAB"],
    "31": ["003", "METL", "IRON", "STEE", "ALUM", "PART"], "25": ["004", "AUTO", "VHCL"], "14": ["005", "PACK", "PAPER"],
    "78": ["006", "LOG", "TRAN", "SHIP"], "27": ["007", "MRO", "EQUIP"], "72": ["MANT", "REPR", "012", "CONS", "BLDG", "CNST"], "44": ["008", "OFF", "OFFI"],
    "50": ["009", "FOOD", "BEV"], "51": ["010", "PHAR", "DRUG"], "42": ["MED"], "80": ["011", "SERV", "PROF", "MGMT", "020", "WHL", "GEN"],
    "26": ["013", "ENRG"], "15": ["FUEL"], "83": ["UTIL"], "23": ["014", "MACH"], "10": ["015", "AGR", "FARM"], "84": ["016", "FIN", "INS"],
    "53": ["017", "TEXT", "APP"], "13": ["018", "PLAS", "RUBB"], "47": ["019", "CLEN"],
}
UNKNOWN = "Unclassified"


def lookup(group: str | Column, groups: dict[str, list[str]] = GROUPS) -> Column:
    """The segment of a material group as it is written, or without leading zeros; null for others."""
    code = F.upper(F.trim(F.col(group) if isinstance(group, str) else group))
    table = {g: s for s, gs in groups.items() for g in gs}
    return F.coalesce(mapped(code, table), mapped(F.regexp_replace(code, "^0+", ""), table))


def classify(rows: DataFrame, keywords: dict[str, list[str]], groups: dict[str, list[str]] = GROUPS, model: Column | None = None, least: float = 0.30) -> DataFrame:
    """Rows (material_group, description) with segment and method: the lookup, else most keywords of the
    description, else a text model's (struct of segment and score) if it is sure enough, else unclassified."""
    one, two = lookup("material_group", groups), best_category(F.coalesce("description", F.lit("")), keywords)
    three = F.when(model["score"] >= least, model["segment"]) if model is not None else F.lit(None).cast("string")
    method = F.when(one.isNotNull(), "lookup").when(two.isNotNull(), "keyword").when(three.isNotNull(), "ml").otherwise("none")
    return rows.withColumns({"segment": F.coalesce(one, two, three, F.lit(UNKNOWN)), "method": method})


def summary(rows: DataFrame) -> DataFrame:
    """Lines, spend and share of each segment and method; rows with amount."""
    out = rows.groupBy("segment", "method").agg(F.count("*").alias("lines"), total("amount").alias("spend"))
    return with_totals(out, _all=total("spend")).select("segment", "method", "lines", "spend", F.round(F.col("spend") / F.col("_all") * 100, 4).alias("spend_pct"))


def coverage(rows: DataFrame) -> DataFrame:
    """Rows by method."""
    return rows.groupBy("method").agg(F.count("*").alias("rows"))
