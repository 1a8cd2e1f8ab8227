"""DuckDB text of every SQL-checkable query (the correctness oracle).

Each query starts with the adapter written as CTEs over the driver's
pre-registered views (``orders``, ``lineitem``, ``part``), so the oracle
derives the basket tables independently of the Spark code.  Column names
and types match the Spark results: integer sums are cast to BIGINT, order
numbers to INTEGER, and doubles that come from sums of doubles are rounded
to 6 digits on both sides.
"""

from __future__ import annotations

from ..functions.columns import hash_fraction_sql


# the power of ten above the number of types
_PLACES = "(SELECT CAST(pow(10, length(CAST(count(*) AS VARCHAR))) AS BIGINT) FROM ic_types)"


def _product_sql(grain: str) -> tuple[str, str]:
    """(FROM clause of lines with product_id, select of product id)."""
    if grain == "item":
        return "lineitem", "l_partkey"
    brand = "CAST(substr(p.p_brand, 7, 10) AS BIGINT)"
    if grain == "brand":
        return "lineitem JOIN part p ON l_partkey = p.p_partkey", brand
    return ("lineitem JOIN part p ON l_partkey = p.p_partkey "
            "JOIN ic_types t ON p.p_type = t.department",
            f"{brand} * {_PLACES} + t.department_id")


def adapter(grain: str = "item") -> str:
    """CTEs ic_orders, ic_lines, ic_prior, ic_train, ic_products, ic_aisles, ic_departments."""
    src, pid = _product_sql(grain)
    dept = "t.department_id" if grain != "brand" else "CAST(NULL AS INTEGER)"
    if grain == "item":
        prod = ("SELECT p.p_partkey AS product_id, p.p_name AS product_name, "
                "CAST(substr(p.p_brand, 7, 10) AS INTEGER) AS aisle_id, t.department_id AS department_id "
                "FROM part p JOIN ic_types t ON p.p_type = t.department")
    elif grain == "category":
        prod = (f"SELECT DISTINCT CAST(substr(p.p_brand, 7, 10) AS BIGINT) * {_PLACES} + t.department_id AS product_id, "
                "p.p_brand || ' ' || p.p_type AS product_name, "
                "CAST(substr(p.p_brand, 7, 10) AS INTEGER) AS aisle_id, t.department_id AS department_id "
                "FROM part p JOIN ic_types t ON p.p_type = t.department")
    else:
        prod = ("SELECT DISTINCT CAST(substr(p.p_brand, 7, 10) AS BIGINT) AS product_id, p.p_brand AS product_name, "
                f"CAST(substr(p.p_brand, 7, 10) AS INTEGER) AS aisle_id, {dept} AS department_id "
                "FROM part p")
    return f"""ic_types AS (
  SELECT CAST(dense_rank() OVER (ORDER BY department) AS INTEGER) AS department_id, department
  FROM (SELECT DISTINCT p_type AS department FROM part)),
ic_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id,
    CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
         THEN CASE WHEN o_custkey % 3 = 0 THEN 'test' ELSE 'train' END ELSE 'prior' END AS eval_set,
    CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS order_number
  FROM orders),
ic_l AS (SELECT DISTINCT l_orderkey AS order_id, {pid} AS product_id FROM {src}),
ic_la AS (SELECT l.order_id, l.product_id, o.user_id, o.order_number, o.eval_set
          FROM ic_l l JOIN ic_orders o ON l.order_id = o.order_id),
ic_lines AS (
  SELECT order_id, product_id,
    CAST(order_number > min(order_number) OVER (PARTITION BY user_id, product_id) AS INTEGER) AS reordered,
    eval_set
  FROM ic_la),
ic_prior AS (SELECT order_id, product_id, reordered FROM ic_lines WHERE eval_set = 'prior'),
ic_train AS (SELECT order_id, product_id, reordered FROM ic_lines WHERE eval_set = 'train'),
ic_products AS ({prod}),
ic_aisles AS (SELECT DISTINCT CAST(substr(p_brand, 7, 10) AS INTEGER) AS aisle_id, p_brand AS aisle FROM part),
ic_departments AS (SELECT department_id, department FROM ic_types)"""


def with_adapter(body_ctes: str, select: str, grain: str = "item") -> str:
    """Full query: adapter CTEs, extra CTEs (may be empty), final SELECT."""
    extra = f",\n{body_ctes}" if body_ctes.strip() else ""
    return f"WITH {adapter(grain)}{extra}\n{select}"


def split_sql(*keys_sql: str, seed: int = 42) -> str:
    return hash_fraction_sql(*keys_sql, seed=seed)
