"""Parameters of the operators. Values under "Fixed values" have to equal those that established reports use."""

# Thresholds and weights of the composite risk score.
RISK_HIGH, RISK_MEDIUM = 0.45, 0.25
RISK_WEIGHTS = {"geo_risk": 0.30, "industry_risk": 0.25, "delivery_risk": 0.25, "concentration_risk": 0.20}
LOADER_HIGH, LOADER_MEDIUM = 0.65, 0.35

# Spend analysis.
ABC_A, ABC_B = 0.70, 0.90
HHI_HEALTHY, HHI_MODERATE = 1500, 2500
TOP1_MAX, TOP5_MAX, TOP10_MAX = 0.10, 0.40, 0.65
CONCENTRATION_HIGH, CONCENTRATION_MEDIUM = 10.0, 6.7
SUM_TARGET = 80.0
ADDRESSABLE = 0.40
SAVINGS_RATE = {"Off-Contract (High Value)": 0.20, "Off-Contract (Regular)": 0.15, "Emergency / One-Off": 0.25, "Contracted": 0.0}
CATEGORY_SAVINGS_RATE = 0.18
DEFAULT_SPEND, DEFAULT_COUNT, DEFAULT_AVERAGE = 500_000, 10, 50_000

# Delivery and forecast.
IN_FULL, SIGNIFICANT_DELAY = 0.98, 5
HORIZONS, ALERT = (30, 60, 90), 0.50

# Supply risk of countries, 0 to 1.
COUNTRY_RISK = {
    "DE": 0.12, "NL": 0.12, "SG": 0.12, "CH": 0.15, "AT": 0.15, "SE": 0.15, "DK": 0.15, "FI": 0.15, "NO": 0.15, "BE": 0.15,
    "JP": 0.20, "CA": 0.20, "AU": 0.20, "GB": 0.22, "FR": 0.22, "US": 0.25,
    "KR": 0.25, "TW": 0.30, "PL": 0.28, "CZ": 0.28, "HU": 0.30, "ES": 0.28, "IT": 0.32, "PT": 0.30, "CN": 0.35, "MY": 0.32,
    "IL": 0.30, "IN": 0.38, "TH": 0.38, "MX": 0.40, "RO": 0.35, "TR": 0.42, "ZA": 0.45,
    "BR": 0.48, "VN": 0.42, "ID": 0.50, "EG": 0.52, "PH": 0.55, "NG": 0.60, "BD": 0.55, "KZ": 0.50, "GH": 0.50,
    "PK": 0.68, "UA": 0.80, "ET": 0.65, "KE": 0.58, "TZ": 0.60, "AR": 0.65, "VE": 0.85,
    "RU": 0.95, "IR": 0.95, "KP": 0.99, "BY": 0.90, "SY": 0.95,
}
SANCTIONED = ("RU", "IR", "KP", "BY", "SY")
COUNTRY_RISK_DEFAULT, SANCTION_FLOOR, SANCTION_DEFAULT = 0.45, 0.90, 0.95

# Risk of industries, 0 to 1; others have the default.
INDUSTRY_RISK = {
    "Electronics & Semiconductors": 0.85, "Chemicals": 0.75, "Automotive": 0.70, "Pharma & Life Sciences": 0.65,
    "Energy & Utilities": 0.60, "Metals": 0.60,
}
INDUSTRY_RISK_DEFAULT = 0.50
INDUSTRIES = ["Electronics & Semiconductors", "Chemicals", "Automotive", "Pharma & Life Sciences", "Energy & Utilities", "Metals",
              "Packaging", "Logistics", "Consulting", "Construction", "Machinery", "Agriculture", "Textiles", "Other"]

# Sentiment words and disruption categories (the first category with a keyword in the text wins).
POSITIVE = ["growth", "expansion", "profit", "award", "partnership", "contract", "strong", "increase", "record", "invest", "innovative",
            "sustainable", "reliable", "approved", "upgrade", "acquisition", "deal", "surplus", "outperform", "recovery"]
NEGATIVE = ["delay", "disruption", "shortage", "recall", "lawsuit", "fraud", "bankruptcy", "fine", "penalty", "loss", "shutdown", "strike",
            "sanction", "risk", "default", "decline", "breach", "contamination", "accident", "halt", "suspend", "warning", "downgrade",
            "investigation", "violation", "outage", "failure", "defect", "crash"]
DISRUPTIONS = {
    "shortage": ["shortage", "scarce", "depleted", "supply gap"],
    "delay": ["delay", "late", "behind schedule", "backlog", "slow delivery"],
    "financial": ["bankruptcy", "default", "insolvency", "loss", "receivership"],
    "geopolitical": ["sanction", "tariff", "trade war", "embargo", "geopolitical"],
    "natural": ["earthquake", "flood", "hurricane", "typhoon", "disaster", "fire"],
    "labour": ["strike", "walkout", "labour dispute", "worker", "union"],
    "quality": ["recall", "defect", "contamination", "quality issue", "rejection"],
    "cyber": ["cyberattack", "data breach", "hack", "ransomware", "phishing"],
    "regulatory": ["fine", "penalty", "investigation", "violation", "lawsuit", "ban"],
}
SEVERITY = {"financial": "High", "geopolitical": "High", "natural": "High", "cyber": "High", "shortage": "Medium", "labour": "Medium",
            "quality": "Medium", "delay": "Low", "regulatory": "Medium"}

# Legal suffixes in the order in which they are cut from names, and words that make no alias.
SUFFIXES = [" inc", " ltd", " llc", " plc", " gmbh", " co.", " corp", " corporation", " limited", " group", " holding", " holdings",
            " & co", " ag", " sa", " bv", " nv", " s.a", " s.l", ".", ",", "'", '"']
ALIAS_STOP = ["group", "international", "limited", "company", "corporation", "services", "solutions", "global", "holdings", "industries", "technology"]

# Words of company names that tell an industry, and country codes of regions.
INDUSTRY_WORDS = {
    "Electronics & Semiconductors": ["apple", "microsoft", "google", "amazon", "intel", "nvidia", "amd", "cisco"],
    "Electronics & Vehicles": ["toyota", "volkswagen", "bmw", "ford", "gm", "tesla"],
    "Pharmaceuticals": ["pfizer", "merck", "johnson", "astrazeneca", "novartis", "roche"],
    "Energy & Oil": ["shell", "exxon", "chevron", "bp", "valero"],
}
REGIONS = {
    "asia": ["CN", "JP", "KR", "TW", "IN", "VN", "TH", "SG", "MY", "ID", "PH"],
    "europe": ["DE", "FR", "GB", "IT", "ES", "NL", "PL", "SE", "AT", "CH", "BE"],
    "americas": ["US", "CA", "MX", "BR", "AR"],
    "middle east": ["SA", "AE", "TR", "IL", "EG"],
    "africa": ["ZA", "NG", "KE", "GH", "ET"],
}

# Parameters of the mapping from the given tables: words of the made-up prose that stand for a lexicon, country codes by nation.
PROSE_POSITIVE, PROSE_NEGATIVE = ["the", "of", "and", "der", "de", "la"], ["thon", "idiot", "trash", "ing", "ou", "ti", "en"]
PROSE_TYPES = {"quality": ["defect", "ingre"], "labour": ["strike", "thonin"], "delay": ["late", "andre"], "natural": ["fire", "oure"]}
NATION_CODES = ["DE", "BR", "CA", "EG", "ET", "FR", "US", "IN", "ID", "IR", "IT", "JP", "KR", "KE", "MX", "NL", "PK", "CN", "RO", "SG", "VN", "RU", "GB", "TR", "UA"]
