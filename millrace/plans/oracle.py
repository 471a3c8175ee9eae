"""The same queries as plain SQL for an independent engine over the same tables."""

from __future__ import annotations

ROLES = """
raw_customers AS (
  SELECT 'C' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS customer_id, 'U' || lpad(CAST((c_custkey * 9) // 10 AS VARCHAR), 10, '0') AS customer_unique_id,
    CAST(c_nationkey * 1000 + c_custkey % 1000 AS BIGINT) AS customer_zip_code_prefix, c_mktsegment AS customer_city, n_name AS customer_state
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), raw_products AS (
  SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS product_id, nullif(p_type, 'ECONOMY') AS product_category_name,
    p_size * 10 AS product_weight_g, p_size AS product_length_cm, p_size + 1 AS product_height_cm, p_size + 2 AS product_width_cm, p_size % 5 AS product_photos_qty
  FROM part WHERE p_size <> 50
), raw_sellers AS (
  SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS seller_id, s_nationkey * 1000 AS seller_zip_code_prefix, lower(n_name) AS seller_city, n_name AS seller_state
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0
), raw_orders AS (
  SELECT 'O' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS order_id, 'C' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS customer_id,
    CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'P' THEN 'canceled' ELSE 'shipped' END AS order_status, o_orderdate AS order_purchase_timestamp,
    CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) END AS order_delivered_customer_date
  FROM orders
), raw_order_items AS (
  SELECT 'O' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS order_id, l_linenumber AS order_item_id, 'P' || lpad(CAST(l_partkey AS VARCHAR), 10, '0') AS product_id,
    'S' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS seller_id, l_extendedprice AS price, l_extendedprice * l_tax AS freight_value
  FROM lineitem
)"""

STAR = f"""WITH {ROLES}, dim_date AS (
  SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS full_date, year(d) AS "year", quarter(d) AS "quarter", month(d) AS "month", strftime(d, '%B') AS month_name,
    day(d) AS day_of_month, dayofweek(d) AS day_of_week, strftime(d, '%A') AS day_name, dayofweek(d) IN (0, 6) AS is_weekend
  FROM (SELECT CAST(unnest(generate_series(CAST(lo AS DATE), CAST(hi AS DATE), INTERVAL 1 DAY)) AS DATE) AS d
    FROM (SELECT min(order_purchase_timestamp) AS lo, max(order_purchase_timestamp) AS hi FROM raw_orders))
), dim_customer AS (
  SELECT row_number() OVER (ORDER BY customer_id) AS customer_key, customer_id AS customer_natural_key, customer_unique_id, customer_zip_code_prefix, customer_city, customer_state FROM raw_customers
), dim_product AS (
  SELECT row_number() OVER (ORDER BY product_id) AS product_key, product_id AS product_natural_key, coalesce(product_category_name, 'unknown') AS product_category,
    product_weight_g, product_length_cm, product_height_cm, product_width_cm, product_photos_qty FROM raw_products
  UNION ALL SELECT -1, 'UNKNOWN', 'unknown', NULL, NULL, NULL, NULL, NULL
), dim_seller AS (
  SELECT row_number() OVER (ORDER BY seller_id) AS seller_key, seller_id AS seller_natural_key, seller_zip_code_prefix, seller_city, seller_state FROM raw_sellers
  UNION ALL SELECT -1, 'UNKNOWN', NULL, NULL, NULL
), fact AS (
  SELECT i.order_id, i.order_item_id, coalesce(c.customer_key, -1) AS customer_key, coalesce(p.product_key, -1) AS product_key, coalesce(s.seller_key, -1) AS seller_key,
    CAST(strftime(o.order_purchase_timestamp, '%Y%m%d') AS INTEGER) AS order_date_key, o.order_status, i.price, i.freight_value, i.price + i.freight_value AS total_item_value,
    date_diff('day', CAST(o.order_purchase_timestamp AS DATE), o.order_delivered_customer_date) AS delivery_days
  FROM raw_order_items i JOIN raw_orders o ON i.order_id = o.order_id LEFT JOIN dim_customer c ON o.customer_id = c.customer_natural_key
  LEFT JOIN dim_product p ON i.product_id = p.product_natural_key LEFT JOIN dim_seller s ON i.seller_id = s.seller_natural_key
), dated AS (SELECT * FROM fact JOIN dim_date ON order_date_key = date_key)
"""

STAR_SQL = {
    "revenue_by_state": "SELECT customer_state, round(CAST(sum(CAST(price AS DECIMAL(20, 6))) AS DOUBLE), 2) AS revenue, count(DISTINCT order_id) AS orders FROM fact JOIN dim_customer USING (customer_key) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "freight_ratio_by_category": "SELECT product_category, round(CAST(sum(CAST(freight_value AS DECIMAL(20, 6))) AS DOUBLE) / CAST(sum(CAST(price AS DECIMAL(20, 6))) AS DOUBLE), 3) AS freight_ratio, count(*) AS items FROM fact JOIN dim_product USING (product_key) GROUP BY 1 HAVING count(*) >= 20 ORDER BY 2 DESC, 1 LIMIT 10",
    "monthly_revenue": 'SELECT "year", "month", round(CAST(sum(CAST(price AS DECIMAL(20, 6))) AS DOUBLE), 2) AS revenue FROM dated GROUP BY 1, 2',
    "weekend_vs_weekday": "SELECT is_weekend, count(DISTINCT order_id) AS orders, round(CAST(sum(CAST(total_item_value AS DECIMAL(20, 6))) AS DOUBLE) / count(total_item_value), 2) AS avg_item_value FROM dated GROUP BY 1",
    "top_categories": "SELECT product_category, round(CAST(sum(CAST(price AS DECIMAL(20, 6))) AS DOUBLE), 2) AS revenue FROM fact JOIN dim_product USING (product_key) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "delivery_days_by_state": "SELECT customer_state, round(avg(delivery_days), 1) AS avg_delivery_days, count(delivery_days) AS delivered_items FROM fact JOIN dim_customer USING (customer_key) GROUP BY 1",
    "seller_state_revenue": "SELECT seller_state, round(CAST(sum(CAST(price AS DECIMAL(20, 6))) AS DOUBLE), 2) AS revenue, count(DISTINCT seller_natural_key) AS active_sellers FROM fact JOIN dim_seller USING (seller_key) WHERE seller_key <> -1 GROUP BY 1",
    "order_size_distribution": "SELECT items_in_order, count(*) AS orders, round(CAST(sum(CAST(r AS DECIMAL(20, 6))) AS DOUBLE), 2) AS revenue FROM (SELECT order_id, count(*) AS items_in_order, CAST(sum(CAST(price AS DECIMAL(20, 6))) AS DOUBLE) AS r FROM fact GROUP BY 1) GROUP BY 1",
    "qoq_growth": 'SELECT "year", "quarter", round(r, 2) AS revenue, round(100.0 * (r - lag(r) OVER w) / lag(r) OVER w, 1) AS qoq_growth_pct FROM (SELECT "year", "quarter", CAST(sum(CAST(price AS DECIMAL(20, 6))) AS DOUBLE) AS r FROM dated GROUP BY 1, 2) WINDOW w AS (ORDER BY "year", "quarter")',
    "cancelled_value_by_month": "SELECT \"year\", \"month\", round(CAST(sum(CAST(total_item_value AS DECIMAL(20, 6))) AS DOUBLE), 2) AS cancelled_value, count(DISTINCT order_id) AS cancelled_orders FROM dated WHERE order_status = 'canceled' GROUP BY 1, 2",
    "mom_growth": 'SELECT "year", "month", round(r, 2) AS revenue, round(100.0 * (r - lag(r) OVER w) / lag(r) OVER w, 1) AS mom_growth_pct FROM (SELECT "year", "month", CAST(sum(CAST(price AS DECIMAL(20, 6))) AS DOUBLE) AS r FROM dated GROUP BY 1, 2) WINDOW w AS (ORDER BY "year", "month")',
    "yoy_growth": 'SELECT "year", "quarter", round(r, 2) AS revenue, round(100.0 * (r - lag(r, 4) OVER w) / lag(r, 4) OVER w, 1) AS yoy_growth_pct FROM (SELECT "year", "quarter", CAST(sum(CAST(price AS DECIMAL(20, 6))) AS DOUBLE) AS r FROM dated GROUP BY 1, 2) WINDOW w AS (ORDER BY "year", "quarter")',
    "basket_value": "SELECT is_weekend, count(*) AS orders, round(CAST(sum(CAST(v AS DECIMAL(20, 6))) AS DOUBLE) / count(v), 2) AS avg_basket_value FROM (SELECT order_id, any_value(is_weekend) AS is_weekend, CAST(sum(CAST(total_item_value AS DECIMAL(20, 6))) AS DOUBLE) AS v FROM dated GROUP BY 1) GROUP BY 1",
    "dim_date": "SELECT * FROM dim_date",
    "dim_customer": "SELECT * FROM dim_customer",
    "dim_product": "SELECT * FROM dim_product",
    "dim_seller": "SELECT * FROM dim_seller",
    "fact_order_items": "SELECT * FROM fact",
    "validate_star": """SELECT 'fact_rows' AS measure, (SELECT count(*) FROM fact) AS n UNION ALL SELECT 'raw_rows', (SELECT count(*) FROM lineitem)
      UNION ALL SELECT 'orphans_product', (SELECT count(*) FROM fact WHERE product_key NOT IN (SELECT product_key FROM dim_product)) UNION ALL SELECT 'orphans_seller', (SELECT count(*) FROM fact WHERE seller_key NOT IN (SELECT seller_key FROM dim_seller))
      UNION ALL SELECT 'unknown_product', (SELECT count(*) FROM fact WHERE product_key = -1) UNION ALL SELECT 'unknown_seller', (SELECT count(*) FROM fact WHERE seller_key = -1)""",
    "profile_duplicate_keys": "SELECT count(*) - count(DISTINCT order_id) AS duplicates FROM raw_orders",
    "profile_status_counts": "SELECT order_status AS value, count(*) AS n FROM raw_orders GROUP BY 1",
    "profile_null_category": "SELECT count(*) FILTER (WHERE product_category_name IS NULL) AS nulls, count(*) AS n FROM raw_products",
    "profile_items_per_order": "SELECT rows_per_key, count(*) AS keys FROM (SELECT order_id, count(*) AS rows_per_key FROM raw_order_items GROUP BY 1) GROUP BY 1",
    "fiscal_quarters": "SELECT date_key, quarter(CAST(full_date - INTERVAL 3 MONTH AS DATE)) AS fiscal_quarter FROM dim_date",
    "orders_at_two_grains": "SELECT count(*) AS orders, round(CAST(sum(CAST(p AS DECIMAL(20, 6))) AS DOUBLE), 2) AS item_value, round(CAST(sum(CAST(o_totalprice AS DECIMAL(20, 6))) AS DOUBLE), 2) AS header_value FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(20, 6))) AS DOUBLE) AS p FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey",
    "part_name_bridge": "SELECT word, count(DISTINCT p_partkey) AS parts FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1",
}

PLAYERS = r"""WITH base AS (
  SELECT c_custkey AS player_id, c_name AS short_name, CAST(16 + c_custkey % 25 AS INTEGER) AS age,
    upper(left(n_name, 1)) || lower(substr(n_name, 2)) AS plain_nation,
    CASE c_custkey % 3 WHEN 0 THEN '  ' || upper(n_name) || chr(9) WHEN 1 THEN lower(n_name) ELSE n_name END AS nationality,
    CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 'Club ' || c_nationkey END AS club, c_mktsegment AS position,
    CAST(60 + c_custkey % 30 + CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 5 WHEN c_custkey % 7 = 0 THEN -2 ELSE 0 END AS INTEGER) AS overall,
    CAST(65 + c_custkey % 30 AS INTEGER) AS potential,
    CASE WHEN c_custkey % 33 = 1 THEN NULL WHEN c_custkey % 50 = 7 THEN 'n/a' WHEN c_acctbal >= 5000 THEN 'M' WHEN c_acctbal >= 0 THEN 'K' ELSE '0' END AS kind,
    c_acctbal, CAST((1 + c_custkey % 300) * 1000 AS DOUBLE) AS wage_eur, DATE '2010-01-01' + CAST(c_custkey % 4000 AS INTEGER) AS joined_date,
    CAST(160 + c_custkey % 40 AS INTEGER) AS height_cm, CAST(55 + c_custkey % 40 AS INTEGER) AS weight_kg, c_custkey AS ord
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), valued AS (
  SELECT *, CASE kind WHEN 'M' THEN (floor(c_acctbal / 100) + 0.5) * 1e6 WHEN 'K' THEN floor(c_acctbal) * 1e3 WHEN '0' THEN 0.0 END AS value_eur FROM base
), players AS (
  SELECT * FROM valued UNION ALL SELECT * REPLACE (ord + 1000000000000 AS ord) FROM valued WHERE position = 'BUILDING' AND club = 'Club 3'
), titled AS (
  SELECT player_id, ord, list_aggregate(list_transform(regexp_extract_all(lower(trim(nationality, ' ' || chr(9))), '[a-z]+|[^a-z]+'), lambda w: upper(left(w, 1)) || substr(w, 2)), 'string_agg', '') AS nationality FROM players
), kept AS (SELECT * FROM players QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY ord) = 1
), imputed AS (
  SELECT k.*, coalesce(value_eur, m, (SELECT median(value_eur) FROM kept)) AS filled, value_eur IS NULL AS value_eur_imputed
  FROM kept k LEFT JOIN (SELECT position AS g, median(value_eur) AS m FROM kept GROUP BY 1) ON position = g
), clean AS (
  SELECT i.player_id, short_name, age, t.nationality, coalesce(club, 'Free Agent') AS club, position, overall, potential, filled AS value_eur, wage_eur, joined_date, height_cm, weight_kg, value_eur_imputed
  FROM imputed i JOIN titled t ON i.player_id = t.player_id AND i.ord = t.ord
)
"""

PLAYER_SQL = {
    "clean_normalize_text": "SELECT player_id, ord, nationality FROM titled",
    "clean_parse_currency": "SELECT player_id, ord, value_eur, wage_eur FROM players",
    "clean_parse_rating": "SELECT player_id, ord, overall, potential FROM players",
    "clean_parse_dates": "SELECT player_id, ord, joined_date FROM players",
    "clean_dedupe": "SELECT player_id, ord, short_name FROM kept",
    "clean_handle_nulls": "SELECT player_id, ord, coalesce(club, 'Free Agent') AS club, coalesce(value_eur, m, (SELECT median(value_eur) FROM players)) AS value_eur, value_eur IS NULL AS value_eur_imputed FROM players LEFT JOIN (SELECT position AS g, median(value_eur) AS m FROM players GROUP BY 1) ON position = g",
    "clean_full": "SELECT * FROM clean",
    "clean_report": """SELECT * FROM (VALUES
      ('normalize_text(nationality)', 'consistency', (SELECT count(*) FROM players p JOIN titled t ON p.player_id = t.player_id AND p.ord = t.ord WHERE p.nationality <> t.nationality)),
      ('parse_currency(value_eur)', 'validity', (SELECT count(kind) FROM players)), ('parse_currency(wage_eur)', 'validity', (SELECT count(*) FROM players)),
      ('parse_rating(overall)', 'validity', (SELECT count(*) FROM players)), ('parse_rating(potential)', 'validity', (SELECT count(*) FROM players)),
      ('parse_dates(joined_date)', 'validity', (SELECT count(*) FROM players)), ('dedupe(player_id)', 'uniqueness', (SELECT count(*) - count(DISTINCT player_id) FROM players)),
      ('handle_nulls', 'completeness', (SELECT count(*) FILTER (WHERE club IS NULL) + count(*) FILTER (WHERE value_eur IS NULL) FROM kept)), ('validate', 'accuracy', (SELECT count(*) FROM kept))
    ) AS r(step, quality_dimension, rows_affected)""",
    "best_player_by_position": "SELECT position, player_id, overall FROM clean QUALIFY row_number() OVER (PARTITION BY position ORDER BY overall DESC, player_id) = 1",
}

VERSIONS = """WITH loads AS (
  SELECT p_partkey AS product_id, DATE '1995-01-01' AS load_date, p_name AS product_name, p_type AS department, p_brand AS aisle, p_retailprice AS unit_price FROM part WHERE p_size <> 49
  UNION ALL SELECT p_partkey, DATE '1997-01-01', CASE WHEN p_size % 10 = 7 THEN p_name || ' No.' || p_partkey ELSE p_name END, p_type, p_brand, CASE WHEN p_size % 12 = 0 THEN p_retailprice * CAST(1.1 AS DOUBLE) ELSE p_retailprice END FROM part
  UNION ALL SELECT p_partkey, DATE '1999-01-01', CASE WHEN p_size % 10 = 7 THEN p_name || ' No.' || p_partkey ELSE p_name END, CASE WHEN p_size % 20 = 3 THEN 'MOVED' ELSE p_type END, p_brand,
    CASE WHEN p_size % 24 = 0 THEN p_retailprice * CAST(1.1 AS DOUBLE) * CAST(1.1 AS DOUBLE) WHEN p_size % 12 = 0 THEN p_retailprice * CAST(1.1 AS DOUBLE) ELSE p_retailprice END FROM part
), marked AS (
  SELECT *, lag(load_date) OVER w IS NULL AS is_first, (aisle, department, unit_price) IS DISTINCT FROM lag((aisle, department, unit_price)) OVER w AS differs,
    last_value(product_name IGNORE NULLS) OVER (PARTITION BY product_id ORDER BY load_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS newest
  FROM loads WINDOW w AS (PARTITION BY product_id ORDER BY load_date)
), versions AS (
  SELECT row_number() OVER (ORDER BY load_date, is_first, product_id) AS product_key, product_id, CASE WHEN product_name IS NOT NULL THEN newest END AS product_name, aisle, department, unit_price,
    load_date AS effective_start_date, coalesce(CAST(lead(load_date) OVER w - INTERVAL 1 DAY AS DATE), DATE '9999-12-31') AS effective_end_date, lead(load_date) OVER w IS NULL AS is_current, NOT is_first AS changed
  FROM marked WHERE is_first OR differs WINDOW w AS (PARTITION BY product_id ORDER BY load_date)
), runs AS (
  SELECT *, lag(department) OVER (PARTITION BY product_id ORDER BY load_date) AS previous_department FROM (
    SELECT *, is_first OR department IS DISTINCT FROM lag(department) OVER (PARTITION BY product_id ORDER BY load_date) AS opens FROM marked) WHERE opens
), type3 AS (
  SELECT product_id, product_name, department AS current_department, previous_department FROM runs QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY load_date DESC) = 1
), product_orders AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, l_quantity AS quantity, CAST(o_orderdate AS DATE) AS order_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size <> 49
), facts AS (
  SELECT order_id, order_date, quantity, product_key, quantity * unit_price AS line_revenue FROM product_orders o JOIN versions v ON o.product_id = v.product_id AND order_date BETWEEN effective_start_date AND effective_end_date
), changed_key AS (SELECT product_id FROM versions GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 1
), repriced_key AS (SELECT product_id FROM versions GROUP BY 1 HAVING count(DISTINCT unit_price) > 1 ORDER BY 1 LIMIT 1)
"""

_TYPE2 = "SELECT product_key, product_id, product_name, aisle, department, unit_price, effective_start_date, effective_end_date, is_current FROM versions"
_TYPE1 = "SELECT product_id, product_name, department, aisle, unit_price FROM loads WHERE load_date = DATE '1999-01-01'"
VERSION_SQL = {
    "scd1": _TYPE1,
    "scd1_merged": _TYPE1,
    "scd2": _TYPE2,
    "scd2_merged": _TYPE2,
    "scd2_stats": "SELECT count(*) AS total, count(*) FILTER (WHERE is_current) AS current, count(*) FILTER (WHERE changed) AS changed FROM versions",
    "scd3": "SELECT * FROM type3",
    "scd3_merged": "SELECT * FROM type3",
    "fact_orders_pit": "SELECT * FROM facts",
    "scd_first_changed_key": "SELECT * FROM changed_key",
    "scd_first_repriced_key": "SELECT * FROM repriced_key",
    "scd_current": "SELECT product_id, product_name, department, unit_price, effective_start_date, effective_end_date FROM versions WHERE is_current",
    "scd_as_of": "SELECT product_id, department, unit_price, effective_start_date, effective_end_date FROM versions WHERE DATE '1998-01-15' BETWEEN effective_start_date AND effective_end_date",
    "scd_history": "SELECT product_key, department, unit_price, effective_start_date, effective_end_date, is_current FROM versions WHERE product_id IN (SELECT product_id FROM changed_key)",
    "scd_price_vs_current": """SELECT order_id, order_date, v.unit_price AS price_at_order_time, c.unit_price AS current_price, round(c.unit_price - v.unit_price, 2) AS difference_if_naive_join
      FROM facts JOIN versions v USING (product_key) JOIN (SELECT * FROM versions WHERE is_current) c ON c.product_id = v.product_id WHERE v.product_id IN (SELECT product_id FROM repriced_key) ORDER BY order_date, order_id, price_at_order_time LIMIT 10""",
    "scd3_changed": "SELECT product_id, current_department, previous_department FROM type3 WHERE previous_department IS NOT NULL ORDER BY 1 LIMIT 5",
    "naive_vs_pit_revenue": """SELECT v.department, round(CAST(sum(CAST(quantity * v.unit_price AS DECIMAL(20, 6))) AS DOUBLE), 2) AS revenue, round(CAST(sum(CAST(quantity * c.unit_price AS DECIMAL(20, 6))) AS DOUBLE), 2) AS naive_revenue, round(CAST(sum(CAST(quantity * c.unit_price AS DECIMAL(20, 6))) AS DOUBLE) - CAST(sum(CAST(quantity * v.unit_price AS DECIMAL(20, 6))) AS DOUBLE), 2) AS difference
      FROM facts JOIN versions v USING (product_key) JOIN (SELECT * FROM versions WHERE is_current) c ON c.product_id = v.product_id GROUP BY 1""",
    "scd_moves": "SELECT b AS from_department, department AS to_department, count(*) AS products FROM (SELECT *, lag(department) OVER (PARTITION BY product_id ORDER BY effective_start_date) AS b FROM versions) WHERE b <> department GROUP BY 1, 2",
    "scd_products_by_month": """SELECT m AS month_start, count(v.product_id) AS products FROM (SELECT CAST(unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)) AS DATE) AS m FROM orders)
      LEFT JOIN versions v ON m BETWEEN effective_start_date AND effective_end_date GROUP BY 1""",
}


def oracle_sql() -> dict[str, str]:
    return {**{k: STAR + v for k, v in STAR_SQL.items()}, **{k: PLAYERS + v for k, v in PLAYER_SQL.items()}, **{k: VERSIONS + v for k, v in VERSION_SQL.items()}}
