"""Expected results of the registered queries, as SQL over the raw test tables.

The SQL is written from the definitions, with global window functions, plain
joins and self-joins, not from the Spark plans.
"""

from __future__ import annotations

YEAR = 1996
CATEGORIES = "'ECONOMY', 'LARGE'"
MONTHLY_TARGET = 35000000.0
RETENTION_TARGET = 70.0

_DIMS = """
dim_customer AS (
  SELECT row_number() OVER (ORDER BY c_custkey) AS customer_key, c_custkey AS customer_id,
         c_name AS company_name, c_mktsegment AS contact_title, n_name AS country, c_acctbal
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
),
dim_product AS (
  SELECT row_number() OVER (ORDER BY p_partkey) AS product_key, p_partkey AS product_id,
         p_name AS product_name, p_type AS category_name
  FROM part
),
dim_shipper AS (
  SELECT row_number() OVER (ORDER BY s_suppkey) AS shipper_key, s_suppkey AS shipper_id,
         s_name AS company_name, s_acctbal
  FROM supplier
),
dim_employee AS (
  SELECT row_number() OVER (ORDER BY employee_id) AS employee_key, *
  FROM (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS employee_id,
               split_part(o_orderpriority, '-', 2) AS last_name,
               CAST(min(o_orderdate) AS DATE) AS first_day,
               CAST(max(o_orderdate) AS DATE) AS last_day,
               max(o_totalprice) AS salary
        FROM orders GROUP BY o_orderpriority)
),
dim_date AS (
  SELECT full_date,
         CAST(strftime(full_date, '%Y%m%d') AS INTEGER) AS date_key,
         CAST(year(full_date) AS INTEGER) AS year,
         CAST(quarter(full_date) AS INTEGER) AS quarter,
         CAST(month(full_date) AS INTEGER) AS month,
         monthname(full_date) AS month_name,
         CAST(day(full_date) AS INTEGER) AS day,
         CAST(isodow(full_date) AS INTEGER) AS day_of_week,
         dayname(full_date) AS day_name,
         CAST(week(full_date) AS INTEGER) AS week_of_year,
         isodow(full_date) IN (6, 7) AS is_weekend,
         FALSE AS is_holiday
  FROM (SELECT DISTINCT CAST(d AS DATE) AS full_date
        FROM (SELECT o_orderdate AS d FROM orders
              UNION ALL SELECT l_shipdate FROM lineitem)
        WHERE d IS NOT NULL)
),
joined_lines AS (
  SELECT o_orderkey AS order_id, customer_key, product_key, d.date_key, employee_key,
         shipper_key, c.c_acctbal, s.s_acctbal,
         l_extendedprice / l_quantity AS unit_price, CAST(l_quantity AS INTEGER) AS quantity,
         l_discount AS discount,
         CAST(round_even(l_quantity * (l_extendedprice / l_quantity)
                         * (1 - l_discount) * 100, 0) / 100 AS DECIMAL(18,2)) AS revenue,
         o_totalprice AS freight
  FROM orders
  JOIN lineitem ON o_orderkey = l_orderkey
  LEFT JOIN dim_customer c ON o_custkey = c.customer_id
  LEFT JOIN dim_product p ON l_partkey = p.product_id
  LEFT JOIN dim_employee e ON CAST(substr(o_orderpriority, 1, 1) AS INTEGER) = e.employee_id
  LEFT JOIN dim_shipper s ON l_suppkey = s.shipper_id
  LEFT JOIN dim_date d ON CAST(o_orderdate AS DATE) = d.full_date
),
fact_sales AS (
  SELECT * FROM joined_lines
  WHERE customer_key IS NOT NULL AND product_key IS NOT NULL AND date_key IS NOT NULL
    AND employee_key IS NOT NULL AND shipper_key IS NOT NULL
),
sales AS (
  SELECT f.order_id, f.customer_key, f.quantity, f.revenue, dc.company_name, dc.country,
         dp.product_name, dp.category_name, dd.full_date, dd.year, dd.quarter, dd.month,
         dd.month_name
  FROM fact_sales f
  JOIN dim_customer dc ON f.customer_key = dc.customer_key
  JOIN dim_product dp ON f.product_key = dp.product_key
  JOIN dim_date dd ON f.date_key = dd.date_key
)
"""


_EXTRACTED = """SELECT 'extract', 'orders', count(*) FROM orders
  UNION ALL SELECT 'extract', 'order_details', count(*) FROM lineitem
  UNION ALL SELECT 'extract', 'products', count(*) FROM part
  UNION ALL SELECT 'extract', 'categories', count(DISTINCT p_type) FROM part
  UNION ALL SELECT 'extract', 'customers', count(*) FROM customer
  UNION ALL SELECT 'extract', 'employees', count(DISTINCT o_orderpriority) FROM orders
  UNION ALL SELECT 'extract', 'shippers', count(*) FROM supplier
  UNION ALL SELECT 'extract', 'suppliers', count(*) FROM supplier"""


def _in_categories(use: bool) -> str:
    return f"AND category_name IN ({CATEGORIES})" if use else ""


def _trend(year: int = YEAR, by_category: bool = False) -> str:
    return f"""
  SELECT year, month, month_name, CAST(sum(revenue) AS DOUBLE) AS total_revenue,
         count(DISTINCT order_id) AS total_orders
  FROM sales WHERE year = {year} {_in_categories(by_category)}
  GROUP BY year, month, month_name
"""


def _percent(part: str) -> str:
    """Exact integer form of round(100 * part / start, 2), half away from zero."""
    return (f"CASE WHEN start_customers > 0 THEN sign({part}) * CAST((20000 * abs({part})"
            f" + start_customers) // (2 * start_customers) AS DOUBLE) / 100 END")


def _retention_ctes(year: int = YEAR, tag: str = "", by_category: bool = False) -> str:
    return f"""
window_sales{tag} AS (
  SELECT customer_key, full_date, date_trunc('month', full_date) AS month_start
  FROM sales WHERE year BETWEEN {year} - 1 AND {year} {_in_categories(by_category)}
),
active{tag} AS (
  SELECT *, month_start = min(month_start) OVER (PARTITION BY customer_key) AS is_first
  FROM (SELECT DISTINCT customer_key, month_start FROM window_sales{tag})
),
monthly{tag} AS (
  SELECT CAST(year(month_start) AS INTEGER) AS year, CAST(month(month_start) AS INTEGER) AS month,
         count(*) AS end_customers, count(*) FILTER (is_first) AS new_customers
  FROM active{tag} GROUP BY month_start
),
lagged{tag} AS (
  SELECT *, lag(end_customers) OVER (ORDER BY year, month) AS start_customers
  FROM monthly{tag}
),
retention{tag} AS (
  SELECT year, month, start_customers, end_customers, new_customers,
         {_percent("(end_customers - new_customers)")} AS retention_rate,
         {_percent("(end_customers - start_customers)")} AS growth_rate,
         {_percent("(start_customers - end_customers + new_customers)")} AS churn_rate
  FROM lagged{tag} WHERE year = {year}
)"""


def _clv(year: int = YEAR, by_category: bool = False) -> str:
    return f"""
  SELECT company_name, count(DISTINCT order_id) AS frequency,
         CAST(sum(revenue) AS DOUBLE) AS monetary_value,
         CAST(sum(revenue) AS DOUBLE) * CAST(1.2 AS DOUBLE) AS predicted_clv
  FROM sales WHERE year = {year} {_in_categories(by_category)} GROUP BY company_name
"""


def _products(rows: int, year: int = YEAR, by_category: bool = False) -> str:
    return f"""
  SELECT product_name, category_name, CAST(sum(revenue) AS DOUBLE) AS total_revenue,
         CAST(sum(quantity) AS BIGINT) AS total_sold
  FROM sales WHERE year = {year} {_in_categories(by_category)}
  GROUP BY product_name, category_name
  ORDER BY total_revenue DESC NULLS FIRST, product_name, category_name LIMIT {rows}
"""


def _category_revenue(by_category: bool = False) -> str:
    return f"""
  SELECT category_name, CAST(sum(revenue) AS DOUBLE) AS total_revenue
  FROM sales WHERE year = {YEAR} {_in_categories(by_category)} GROUP BY category_name
"""


def _geo(by_category: bool = False) -> str:
    return f"""
  SELECT country, CAST(sum(revenue) AS DOUBLE) AS total_revenue,
         count(DISTINCT order_id) AS total_orders
  FROM sales WHERE year = {YEAR} {_in_categories(by_category)} GROUP BY country
"""


def _rfm_ctes(by_category: bool = False) -> str:
    return f"""
rfm_raw AS (
  SELECT company_name AS customer_name, max(full_date) AS last_order_date,
         count(DISTINCT order_id) AS frequency, CAST(sum(revenue) AS DOUBLE) AS monetary
  FROM sales WHERE year = {YEAR} {_in_categories(by_category)} GROUP BY company_name
),
rfm_recency AS (
  SELECT *, CAST(date_diff('day', last_order_date, DATE '{YEAR}-12-31') AS INTEGER) AS recency
  FROM rfm_raw
),
rfm_ranked AS (
  SELECT *, row_number() OVER (ORDER BY recency, customer_name) AS r_rank,
         row_number() OVER (ORDER BY frequency, customer_name) AS f_rank,
         count(*) OVER () AS n
  FROM rfm_recency
),
rfm_scores AS (
  SELECT customer_name, last_order_date, frequency, monetary, recency,
         CAST(6 - greatest(1, (5 * (r_rank - 1) + n - 2) // (n - 1)) AS INTEGER) AS r_score,
         CAST(greatest(1, (5 * (f_rank - 1) + n - 2) // (n - 1)) AS INTEGER) AS f_score
  FROM rfm_ranked
),
rfm_segments AS (
  SELECT *, CASE
      WHEN r_score IN (1, 2) AND f_score IN (1, 2) THEN 'Lost'
      WHEN r_score IN (1, 2) AND f_score IN (3, 4, 5) THEN 'At Risk'
      WHEN r_score IN (3, 4, 5) AND f_score = 1 THEN 'New Customers'
      WHEN r_score IN (3, 4) AND f_score IN (2, 3) THEN 'Potential'
      WHEN r_score IN (3, 4) AND f_score IN (4, 5) THEN 'Loyal Customers'
      WHEN r_score = 5 AND f_score IN (2, 3) THEN 'Loyal Customers'
      WHEN r_score = 5 AND f_score IN (4, 5) THEN 'Champions'
      ELSE 'Potential' END AS segment
  FROM rfm_scores
)"""


def _mean(column: str) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(28,2))) AS DOUBLE) / nullif(count({column}), 0)"


def _with(*parts: str) -> str:
    *ctes, body = parts
    return "WITH " + ",\n".join(c.strip() for c in (_DIMS, *ctes)) + "\n" + body.strip()


def _iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d')"


_MONEY = "'$' || format('{{:,.0f}}', {})"
_PERCENT = "format('{{:.1f}}', {}) || '%'"


def _shorten(text: str, longer_than: int, keep: int) -> str:
    return (f"CASE WHEN length({text}) > {longer_than} "
            f"THEN substr({text}, 1, {keep}) || '...' ELSE {text} END")


_LABEL = "(c_name || ' ' || c_mktsegment)"

_ACHIEVEMENT = f"round_even(total_revenue / {MONTHLY_TARGET} * 100 * 10, 0) / 10"

ORACLES: dict[str, str] = {
    "clean_null_tokens": """
SELECT c_custkey, c_name,
       CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE', 'MACHINERY') THEN NULL
            ELSE c_mktsegment END AS region
FROM customer""",
    "normalize_columns": "SELECT * FROM supplier",
    "add_missing_columns": """
SELECT s_suppkey AS shipperid, s_name AS companyname, CAST(NULL AS VARCHAR) AS phone,
       CAST(NULL AS VARCHAR) AS fax
FROM supplier""",
    "fill_defaults": """
SELECT p_partkey AS supplierid, p_name AS productname,
       coalesce(s_name, 'Unknown') AS supplier_name, coalesce(s_acctbal, 0.0) AS balance
FROM part LEFT JOIN supplier ON p_partkey = s_suppkey""",
    "lenient_parse": """
SELECT o_orderkey,
       strftime(coalesce(try_strptime(day_text, '%m/%d/%Y %H:%M'),
                         try_strptime(day_text, '%Y-%m-%d')), '%Y-%m-%d') AS parsed_day,
       try_cast(amount_text AS DOUBLE) AS parsed_amount
FROM (SELECT o_orderkey,
             CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%m/%d/%Y %H:%M')
                                WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%d')
                                ELSE 'not a date' END AS day_text,
             CASE o_orderstatus WHEN 'P' THEN 'n.a.'
                                ELSE CAST(o_totalprice AS VARCHAR) END AS amount_text
      FROM orders)""",
    "lenient_dates": """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 10 <> 9 THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed_day
FROM orders""",
    "lenient_numbers": """
SELECT CAST(l_orderkey AS BIGINT) AS orderid, CAST(l_linenumber AS BIGINT) AS line,
       l_quantity + 0.5 AS quantity, CAST(l_orderkey AS BIGINT) * 10000000000 AS wide,
       CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey AS DOUBLE) END AS code
FROM lineitem""",
    "lines_with_nan": """
SELECT l_orderkey AS orderid, l_linenumber AS line,
       CASE WHEN l_linenumber % 3 = 2 THEN
         round_even(l_quantity * (l_extendedprice / l_quantity) * (1 - l_discount) * 100, 0) / 100
       END AS total_sales
FROM lineitem""",
    "etl_append": _with("""
SELECT f.order_id, c.customer_id, p.product_id, e.employee_id, s.shipper_id,
       strftime(d.full_date, '%Y-%m-%d') AS full_date, f.quantity,
       CAST(f.revenue AS DOUBLE) AS total_sales
FROM fact_sales f JOIN dim_customer c USING (customer_key) JOIN dim_product p USING (product_key)
JOIN dim_employee e USING (employee_key) JOIN dim_shipper s USING (shipper_key)
JOIN dim_date d USING (date_key)"""),
    "etl_append_twice": _with("""
SELECT CAST(date_key // 10000 AS INTEGER) AS order_year, count(*) AS line_count,
       CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(revenue) AS DOUBLE) AS total_sales
FROM fact_sales GROUP BY date_key // 10000"""),
    "load_ledger": _with(f"""
parts AS (
  SELECT CASE WHEN year(o_orderdate) < {YEAR} THEN 'older' ELSE 'newer' END AS load_id, o_orderkey
  FROM orders WHERE o_orderdate IS NOT NULL
)""", """
SELECT load_id, 'transform' AS phase, 'order_lines' AS name, count(*) AS row_count
FROM joined_lines JOIN parts ON order_id = o_orderkey GROUP BY load_id
UNION ALL SELECT load_id, 'transform', 'fact_sales', count(*)
FROM fact_sales JOIN parts ON order_id = o_orderkey GROUP BY load_id"""),
    "load_audit": _with(f"""
counts(phase, name, row_count) AS (
  {_EXTRACTED}
  UNION ALL SELECT 'transform', 'dim_shipper', count(*) FROM dim_shipper
  UNION ALL SELECT 'transform', 'dim_customer', count(*) FROM dim_customer
  UNION ALL SELECT 'transform', 'dim_employee', count(*) FROM dim_employee
  UNION ALL SELECT 'transform', 'dim_product', count(*) FROM dim_product
  UNION ALL SELECT 'transform', 'dim_date', count(*) FROM dim_date
  UNION ALL SELECT 'transform', 'order_lines', count(*) FROM joined_lines
  UNION ALL SELECT 'transform', 'fact_sales', count(*) FROM fact_sales
  UNION ALL SELECT 'orphans', 'customer_key', count(*) - count(customer_key) FROM joined_lines
  UNION ALL SELECT 'orphans', 'product_key', count(*) - count(product_key) FROM joined_lines
  UNION ALL SELECT 'orphans', 'date_key', count(*) - count(date_key) FROM joined_lines
  UNION ALL SELECT 'orphans', 'employee_key', count(*) - count(employee_key) FROM joined_lines
  UNION ALL SELECT 'orphans', 'shipper_key', count(*) - count(shipper_key) FROM joined_lines
)""", "SELECT 'all' AS load_id, phase, name, row_count FROM counts"),
    "full_name": """
SELECT c_custkey,
       CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END || ' ' || c_name AS full_name
FROM customer""",
    "truncate_labels": f"""
SELECT c_custkey, {_shorten(_LABEL, 15, 12)} AS report_label,
       {_shorten(_LABEL, 15, 15)} AS scorecard_label,
       {_shorten(_LABEL, 25, 25)} AS insight_label,
       {_shorten(_LABEL, 25, 22)} AS table_label
FROM customer""",
    "line_revenue": """
SELECT l_orderkey AS orderid, l_partkey AS productid, CAST(l_quantity AS INTEGER) AS quantity,
       round_even(l_quantity * (l_extendedprice / l_quantity) * (1 - l_discount) * 100, 0)
       / 100 AS total_sales
FROM lineitem""",
    "surrogate_keys": """
SELECT c_custkey AS customerid, row_number() OVER (ORDER BY c_custkey) AS customer_key
FROM customer""",
    "hierarchy_lookup": """
WITH people AS (
  SELECT c_custkey AS id, nullif(CAST(c_nationkey AS BIGINT), 0) AS parent_id, c_name AS name
  FROM customer
)
SELECT p.id, CAST(p.parent_id AS DOUBLE) AS parent_id, p.name,
       coalesce(q.name, 'N/A') AS parent_name
FROM people p LEFT JOIN people q ON p.parent_id = q.id""",
    "key_lookup_left": _with("""
SELECT l_suppkey AS shipvia, l_orderkey AS orderid, l_partkey AS productid,
       CAST(shipper_key AS DOUBLE) AS shipper_key
FROM lineitem LEFT JOIN (SELECT * FROM dim_shipper WHERE s_acctbal >= 0)
  ON l_suppkey = shipper_id"""),
    "orphan_audit": _with("""
checked AS (
  SELECT CASE WHEN c_acctbal >= 0 THEN customer_key END AS customer_key, product_key, date_key,
         employee_key, CASE WHEN s_acctbal >= 0 THEN shipper_key END AS shipper_key
  FROM joined_lines
),
totals AS (
  SELECT count(*) AS joined_rows,
         count(customer_key + product_key + date_key + employee_key + shipper_key) AS kept_rows
  FROM checked
)""", """
SELECT key_name, orphan_rows, joined_rows, kept_rows FROM totals, (
  SELECT 'customer_key' AS key_name, count(*) - count(customer_key) AS orphan_rows FROM checked
  UNION ALL SELECT 'product_key', count(*) - count(product_key) FROM checked
  UNION ALL SELECT 'date_key', count(*) - count(date_key) FROM checked
  UNION ALL SELECT 'employee_key', count(*) - count(employee_key) FROM checked
  UNION ALL SELECT 'shipper_key', count(*) - count(shipper_key) FROM checked)"""),
    "orphan_filter": _with("""
SELECT order_id, customer_key, product_key, shipper_key, CAST(revenue AS DOUBLE) AS total_sales
FROM fact_sales WHERE c_acctbal >= 0 AND s_acctbal >= 0"""),
    "order_lines": """
SELECT o_orderstatus, count(*) AS line_count,
       sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus""",
    "date_spine": _with(f"SELECT {_iso('full_date')} AS full_date FROM dim_date"),
    "dim_shipper": _with("""
SELECT shipper_key, shipper_id, company_name, CAST(NULL AS VARCHAR) AS phone FROM dim_shipper"""),
    "dim_customer": _with("""
SELECT customer_key, customer_id, company_name, CAST(NULL AS VARCHAR) AS contact_name,
       contact_title, CAST(NULL AS VARCHAR) AS address, CAST(NULL AS VARCHAR) AS city,
       'Unknown' AS region, 'Unknown' AS postal_code, country,
       CAST(NULL AS VARCHAR) AS phone, CAST(NULL AS VARCHAR) AS fax
FROM dim_customer"""),
    "dim_employee": _with(f"""
SELECT e.employee_key, e.employee_id, e.last_name, 'Clerk' AS first_name,
       'Clerk ' || e.last_name AS full_name, CAST(NULL AS VARCHAR) AS title,
       CAST(NULL AS VARCHAR) AS title_of_courtesy, {_iso('e.first_day')} AS birth_date,
       {_iso('e.last_day')} AS hire_date, CAST(NULL AS VARCHAR) AS address,
       CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS region,
       CAST(NULL AS VARCHAR) AS country, CAST(NULL AS VARCHAR) AS home_phone,
       e.employee_id - 1 AS reports_to, coalesce('Clerk ' || b.last_name, 'N/A')
       AS reports_to_name, e.salary
FROM dim_employee e LEFT JOIN dim_employee b ON e.employee_id - 1 = b.employee_id"""),
    "dim_product": """
SELECT row_number() OVER (ORDER BY p_partkey) AS product_key, p_partkey AS product_id,
       p_name AS product_name, p_type AS category_id, p_type AS category_name,
       lower(p_type) AS category_description, CAST(p_size AS BIGINT) AS supplier_id,
       coalesce(s_name, 'Unknown') AS supplier_name, 'Unknown' AS supplier_contact_name,
       coalesce(n_name, 'Unknown') AS supplier_country, 'Unknown' AS supplier_phone,
       p_brand AS quantity_per_unit, p_retailprice AS unit_price, 0 AS units_in_stock,
       CAST(NULL AS DOUBLE) AS units_on_order, p_size AS reorder_level,
       FALSE AS discontinued
FROM part LEFT JOIN supplier ON p_size = s_suppkey
LEFT JOIN nation ON s_nationkey = n_nationkey""",
    "dim_date": _with(f"""
SELECT {_iso('full_date')} AS full_date, date_key, year, quarter, month, month_name, day,
       day_of_week, day_name, week_of_year, is_weekend, is_holiday
FROM dim_date"""),
    "fact_sales": _with("""
SELECT order_id, customer_key, product_key, date_key, employee_key, shipper_key, unit_price,
       quantity, discount, CAST(revenue AS DOUBLE) AS total_sales,
       CAST(revenue AS DOUBLE) AS revenue, freight
FROM fact_sales"""),
    "etl_row_counts": _with("""
SELECT 'dim_shipper' AS table_name, count(*) AS row_count FROM dim_shipper
UNION ALL SELECT 'dim_customer', count(*) FROM dim_customer
UNION ALL SELECT 'dim_employee', count(*) FROM dim_employee
UNION ALL SELECT 'dim_product', count(*) FROM dim_product
UNION ALL SELECT 'dim_date', count(*) FROM dim_date
UNION ALL SELECT 'fact_sales', count(*) FROM fact_sales"""),
    "extract_row_counts": """
SELECT 'orders' AS table_name, count(*) AS row_count FROM orders
UNION ALL SELECT 'order_details', count(*) FROM lineitem
UNION ALL SELECT 'products', count(*) FROM part
UNION ALL SELECT 'categories', count(DISTINCT p_type) FROM part
UNION ALL SELECT 'customers', count(*) FROM customer
UNION ALL SELECT 'employees', count(DISTINCT o_orderpriority) FROM orders
UNION ALL SELECT 'shippers', count(*) FROM supplier
UNION ALL SELECT 'suppliers', count(*) FROM supplier""",
    "distinct_years": _with("SELECT DISTINCT year FROM dim_date"),
    "distinct_categories": "SELECT DISTINCT p_type AS category_name FROM part",
    "financial_trend": _with(_trend()),
    "financial_trend_by_category": _with(_trend(by_category=True)),
    "customer_first_purchase": _with(_retention_ctes(), f"""
SELECT customer_key, {_iso('min(full_date)')} AS global_first_purchase
FROM window_sales GROUP BY customer_key"""),
    "monthly_customers": _with(_retention_ctes(), "SELECT * FROM monthly"),
    "retention_rate": _with(_retention_ctes(), "SELECT * FROM retention"),
    "retention_rate_by_category": _with(
        _retention_ctes(by_category=True), "SELECT * FROM retention"),
    "retention_yoy_delta": _with(
        _retention_ctes(YEAR + 1), _retention_ctes(YEAR, "_before"), f"""
SELECT CAST({YEAR + 1} AS INTEGER) AS year, a AS avg_retention, b AS prev_avg_retention,
       a - b AS retention_delta
FROM (SELECT {_mean('retention_rate')} AS a FROM retention),
     (SELECT {_mean('retention_rate')} AS b FROM retention_before)"""),
    "retention_vs_target": _with(_retention_ctes(), f"""
SELECT month, retention_rate, CAST({RETENTION_TARGET} AS DOUBLE) AS target,
       retention_rate - CAST({RETENTION_TARGET} AS DOUBLE) AS gap
FROM retention"""),
    "retention_summary": _with(_retention_ctes(), f"""
SELECT count(*) FILTER (retention_rate >= {RETENTION_TARGET}) AS months_on_target,
       CAST(12 AS INTEGER) AS months_in_year,
       {_mean('retention_rate')} - CAST({RETENTION_TARGET} AS DOUBLE) AS avg_gap,
       (SELECT month FROM retention WHERE retention_rate IS NOT NULL
        ORDER BY retention_rate DESC, month LIMIT 1) AS best_month
FROM retention"""),
    "customer_clv": _with(_clv()),
    "customer_clv_by_category": _with(_clv(by_category=True)),
    "top5_customers": _with(f"""
SELECT company_name, frequency, {_MONEY.format('monetary_value')} AS total_spent
FROM ({_clv()} ORDER BY monetary_value DESC, company_name LIMIT 5)"""),
    "product_performance": _with(_products(20)),
    "product_performance_by_category": _with(_products(20, by_category=True)),
    "top10_products": _with(_products(10)),
    "top15_products": _with(_products(15)),
    "category_performance": _with(_category_revenue()),
    "category_performance_by_category": _with(_category_revenue(by_category=True)),
    "category_share": _with(f"""
SELECT category_name, total_revenue,
       round(total_revenue / CAST((SELECT sum(revenue) FROM sales WHERE year = {YEAR})
                                  AS DOUBLE), 6) AS share
FROM ({_category_revenue()})"""),
    "geo_performance": _with(_geo()),
    "geo_performance_by_category": _with(_geo(by_category=True)),
    "rfm_raw": _with(_rfm_ctes(), f"""
SELECT customer_name, {_iso('last_order_date')} AS last_order_date, frequency, monetary
FROM rfm_raw"""),
    "rfm_recency": _with(_rfm_ctes(), f"""
SELECT customer_name, {_iso('last_order_date')} AS last_order_date, frequency, monetary, recency
FROM rfm_recency"""),
    "rfm_scores": _with(_rfm_ctes(), f"""
SELECT customer_name, {_iso('last_order_date')} AS last_order_date, frequency, monetary,
       recency, r_score, f_score
FROM rfm_scores"""),
    "rfm_segments": _with(_rfm_ctes(), f"""
SELECT customer_name, {_iso('last_order_date')} AS last_order_date, frequency, monetary,
       recency, r_score, f_score, segment
FROM rfm_segments"""),
    "rfm_segments_by_category": _with(_rfm_ctes(by_category=True), f"""
SELECT customer_name, {_iso('last_order_date')} AS last_order_date, frequency, monetary,
       recency, r_score, f_score, segment
FROM rfm_segments"""),
    "rfm_segment_counts": _with(_rfm_ctes(), """
SELECT segment, count(*) AS customer_count FROM rfm_segments GROUP BY segment"""),
    "rfm_customer_table": _with(_rfm_ctes(), """
SELECT customer_name, segment, recency, frequency, monetary FROM rfm_segments"""),
    "revenue_vs_target": _with(f"""
SELECT month, month_name, total_revenue, CAST({MONTHLY_TARGET} AS DOUBLE) AS target,
       {_ACHIEVEMENT} AS achievement_pct
FROM ({_trend()})"""),
    "formatted_targets": _with(f"""
SELECT month, month_name, {_MONEY.format('total_revenue')} AS actual,
       {_MONEY.format(MONTHLY_TARGET)} AS target,
       {_PERCENT.format(f'total_revenue / {MONTHLY_TARGET} * 100')} AS achievement
FROM ({_trend()})"""),
    "formatted_retention": _with(_retention_ctes(), f"""
SELECT month, coalesce({_PERCENT.format('retention_rate')}, 'nan%') AS actual_rate,
       '70%' AS target_rate,
       coalesce(format('{{:+.1f}}', retention_rate - CAST({RETENTION_TARGET} AS DOUBLE)), 'nan')
       || '%' AS gap
FROM retention"""),
    "revenue_peak_low": _with(f"""
SELECT CAST(sum(CAST(total_revenue AS DECIMAL(28,2))) AS DOUBLE) AS total_revenue,
       arg_max(month_name, (total_revenue, -month)) AS peak_month,
       arg_min(month_name, (total_revenue, month)) AS low_month
FROM ({_trend()})"""),
    "kpi_scorecard": _with(
        _retention_ctes(YEAR + 1), _retention_ctes(YEAR, "_before"),
        f"top AS ({_products(1, YEAR + 1)})", f"""
SELECT y.total_revenue, CAST({12 * MONTHLY_TARGET} AS DOUBLE) AS annual_target,
       round_even(y.total_revenue / {12 * MONTHLY_TARGET} * 100 * 10, 0) / 10
       AS revenue_achievement_pct,
       a AS avg_retention, a - b AS retention_delta, active_customers, product_name AS top_product,
       {_shorten('product_name', 15, 15)} AS top_product_label
FROM (SELECT CAST(sum(revenue) AS DOUBLE) AS total_revenue,
             count(DISTINCT company_name) AS active_customers
      FROM sales WHERE year = {YEAR + 1}) y,
     (SELECT {_mean('retention_rate')} AS a FROM retention),
     (SELECT {_mean('retention_rate')} AS b FROM retention_before), top"""),
    "insights": _with(
        _retention_ctes(), f"trend AS ({_trend()})", f"top AS ({_products(1)})", f"""
SELECT 'finance' AS kind, 'Kinerja Keuangan' AS title,
       {_MONEY.format('CAST(sum(CAST(total_revenue AS DECIMAL(28,2))) AS DOUBLE)')} AS value,
       'Puncak: **' || arg_max(month_name, (total_revenue, -month)) || '** | Terendah: **'
       || arg_min(month_name, (total_revenue, month)) || '**' AS detail, 'info' AS status
FROM trend
UNION ALL
SELECT 'customer', 'Kesehatan Pelanggan', {_PERCENT.format('r')},
       CASE WHEN r > 70 AND g > 0 THEN 'Retention Kuat (' WHEN r > 50 THEN 'Retention Sedang ('
            ELSE 'Retention Rendah (' END || {_PERCENT.format('r')} || ')',
       CASE WHEN r > 70 AND g > 0 THEN 'success' WHEN r > 50 THEN 'info' ELSE 'error' END
FROM (SELECT {_mean('retention_rate')} AS r, {_mean('growth_rate')} AS g FROM retention)
UNION ALL
SELECT 'product', 'Produk Unggulan', product_name,
       'Rev: **' || {_MONEY.format('total_revenue')} || '** | Kat: **' || category_name || '**',
       'success'
FROM top"""),
    "report_headline": _with(
        _retention_ctes(), f"trend AS ({_trend()})", f"top AS ({_products(1)})", f"""
SELECT {_MONEY.format('total')} AS total_revenue, {_PERCENT.format('r')} AS avg_retention,
       {_shorten('product_name', 15, 12)} AS top_product, active_months
FROM (SELECT CAST(sum(CAST(total_revenue AS DECIMAL(28,2))) AS DOUBLE) AS total,
             count(*) AS active_months FROM trend),
     (SELECT {_mean('retention_rate')} AS r FROM retention), top"""),
    "customer_purchase_value": _with("""
SELECT company_name, CAST(sum(revenue) AS DOUBLE) AS total_purchase_value
FROM sales GROUP BY company_name"""),
    "quarterly_customer_orders": _with("""
SELECT year, quarter, company_name, count(DISTINCT order_id) AS order_count,
       CAST(sum(revenue) AS DOUBLE) AS quarter_revenue
FROM sales GROUP BY year, quarter, company_name
ORDER BY year, quarter, order_count DESC, company_name LIMIT 20"""),
}
