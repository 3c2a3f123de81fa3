"""The curated tables as SQL, for the queries' SQL forms."""

from procuris.functions import params as P


def listed(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


VENDORS = f"""vendors AS (
  SELECT s_suppkey AS vendor_id, s_name AS supplier_name, n_name AS country, ({listed(P.NATION_CODES)})[n_nationkey % {len(P.NATION_CODES)} + 1] AS country_code,
    r_name AS region, ({listed(P.INDUSTRIES)})[CAST(s_suppkey % {len(P.INDUSTRIES)} AS INT) + 1] AS industry_category, s_acctbal AS balance
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

TRANSACTIONS = """transactions AS (
  SELECT l_orderkey AS po_number, l_linenumber AS po_line, l_suppkey AS vendor_id, CAST(o_orderdate AS DATE) AS po_date,
    CAST(year(o_orderdate) AS INT) AS year, CAST(quarter(o_orderdate) AS INT) AS quarter, CAST(month(o_orderdate) AS INT) AS month,
    CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS year_quarter, l_partkey AS material_number,
    l_quantity AS quantity, l_extendedprice AS transaction_amount, CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS unit_price, p_type AS material_group
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

SPEND = """spend AS (
  SELECT vendor_id, CAST(sum(CAST(transaction_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_spend, count(*) AS tx_count FROM transactions GROUP BY vendor_id)"""

DELIVERIES = """deliveries AS (
  SELECT *, on_time * in_full AS otif FROM (
    SELECT *, CAST(actual_date - promised_date AS INT) AS delay_days, CAST(actual_date <= promised_date AS INT) AS on_time, CAST(actual_qty >= promised_qty * 0.98::DOUBLE AS INT) AS in_full
    FROM (SELECT l_orderkey AS po_number, l_linenumber AS po_line, l_suppkey AS vendor_id, max(CAST(l_shipdate AS DATE)) AS promised_date,
        max(CAST(l_shipdate AS DATE) + CAST((l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 15 - 5 AS INT)) AS actual_date,
        CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS promised_qty,
        CAST(sum(CAST(CASE WHEN l_partkey % 10 = 0 THEN l_quantity * 0.9::DOUBLE ELSE l_quantity END AS DECIMAL(18,2))) AS DOUBLE) AS actual_qty
      FROM lineitem GROUP BY 1, 2, 3)))"""

CONTRACTS = """contracts AS (
  SELECT *, CASE WHEN days_to_expiry <= -1 THEN 'Expired' WHEN days_to_expiry <= 30 THEN 'Expires <30d' WHEN days_to_expiry <= 60 THEN 'Expires <60d'
      WHEN days_to_expiry <= 90 THEN 'Expires <90d' ELSE 'Active' END AS contract_status
  FROM (SELECT *, CAST(contract_end - DATE '2001-08-02' AS INT) AS days_to_expiry
    FROM (SELECT 'K' || s_suppkey AS contract_number, s_suppkey AS vendor_id, DATE '2001-06-01' + CAST(s_suppkey * 37 % 400 - 100 AS INT) AS contract_end FROM supplier WHERE s_acctbal > 0)))"""

ACTIVE = "active AS (SELECT DISTINCT vendor_id FROM contracts WHERE contract_status <> 'Expired')"

NEWS = """news AS (
  SELECT user_id % (SELECT count(*) FROM supplier) + 1 AS vendor_id, event_id AS article_id, CAST(event_id AS VARCHAR) AS url, ts AS published_at,
    event_type = 'error' AS disruption_flag, event_type AS disruption_type, event_type AS source_name,
    CASE event_type WHEN 'error' THEN -0.8 WHEN 'signup' THEN 0.5 WHEN 'purchase' THEN 0.9 WHEN 'click' THEN 0.1 ELSE 0.0 END::DOUBLE AS sentiment_score
  FROM events)"""


def sql(*ctes: str, select: str) -> str:
    """A query over curated tables."""
    return "WITH " + ",\n".join(ctes) + "\n" + select
