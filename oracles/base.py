"""Common table expressions that rebuild the canonical tables in SQL."""

from __future__ import annotations

import re

AS_OF = "DATE '2001-08-01'"

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


def query(body: str) -> str:
    """Prefix a statement with the expressions it (transitively) names."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    parts = [f"{name} AS (\n{CTES[name]}\n)" for name in CTES if name in needed]
    body = body.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def rnd(x: str, n: int) -> str:
    return f"CAST(ROUND(CAST(({x}) AS DECIMAL(38,10)), {n}) AS DOUBLE)"


def dbl(x: str) -> str:
    return f"CAST(({x}) AS DOUBLE)"


def lng(x: str) -> str:
    return f"CAST(({x}) AS BIGINT)"


def ratio(a: str, b: str) -> str:
    return f"(CAST(({a}) AS DOUBLE) / NULLIF(CAST(({b}) AS DOUBLE), 0))"


def sd(n: str, s: str, q: str) -> str:
    """Sample deviation from count, sum and sum of squares (doubles)."""
    n, s, q = dbl(n), dbl(s), dbl(q)
    return f"(CASE WHEN {n} >= 2 THEN SQRT(GREATEST({n}*{q} - {s}*{s}, 0.0::DOUBLE) / ({n}*({n} - 1.0::DOUBLE))) END)"


def rules(name: str, columns: str, rows: list[tuple]) -> None:
    """Fixed values as a table of a query; a NULL bound holds for every row."""
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    cte(name, f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS r({columns})")


def looked_up(result: str, table: str, match: str, rank: str, otherwise: str) -> str:
    """The result of the matching rule of lowest rank."""
    return f"COALESCE((SELECT arg_min({result}, {rank}) FROM {table} WHERE {match}), {otherwise})"


UD1 = """CASE {p} % 12 WHEN 0 THEN 'FLTHB' WHEN 1 THEN 'FLTF1' WHEN 2 THEN 'FLTF2' WHEN 3 THEN 'FLTF3'
  WHEN 4 THEN 'FLTMH' WHEN 5 THEN 'FLTSC' WHEN 6 THEN 'SPECIAL REQUEST' WHEN 7 THEN 'DISCONTINUED'
  WHEN 8 THEN NULL ELSE 'NA' END"""

cte("location", """SELECT 'L' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS location_id,
  'R' || CAST(n_regionkey AS VARCHAR) || ' - ' || n_name AS name, n_name AS address, 'Y' AS is_active,
  CASE WHEN n_nationkey < 15 THEN DATE '1995-01-01' WHEN n_nationkey < 20 THEN DATE '2000-01-01'
       WHEN n_nationkey < 23 THEN DATE '2001-02-15' ELSE DATE '2001-05-15' END AS open_date, n_nationkey
FROM nation""")
cte("category", "SELECT DISTINCT p_type AS category_id, 'Category ' || p_type AS description FROM part")
cte("brand", "SELECT DISTINCT p_brand AS brand_id, upper(p_brand) AS description FROM part")
cte("stock_master", f"""SELECT 'P' || CAST(p_partkey AS VARCHAR) AS stock_id,
  CASE WHEN rate = 12 THEN 'BOX' ELSE 'PCS' END AS uom_id, 'PCS' AS base_uom_id, CAST(rate AS DECIMAL(18,4)) AS uom_rate,
  upper(p_name) AS stock_name, 'AI-' || CAST(p_size AS VARCHAR) AS active_ingredient, 'B' || CAST(p_partkey AS VARCHAR) AS barcode,
  p_type AS category_id, p_brand AS brand_id, {UD1.format(p='p_partkey')} AS ud1_code,
  p_type || '-' || CAST(p_size % 10 AS VARCHAR) AS therapeutic_group,
  CAST(CAST(p_retailprice AS DECIMAL(12,2)) * (16 + p_partkey % 50) * rate * 0.05 AS DECIMAL(18,4)) AS cost,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) * (16 + p_partkey % 50) * rate * 0.05 AS DECIMAL(18,4)) ELSE 0 END AS reference_cost,
  CASE WHEN p_partkey % 20 = 19 THEN 'N' ELSE 'Y' END AS is_active, p_partkey
FROM part, (VALUES (1), (12)) r(rate) WHERE rate = 1 OR p_partkey % 3 = 0""")
cte("product", """SELECT m.*, c.description AS category, b.description AS brand FROM stock_master m
  LEFT JOIN category c USING (category_id) LEFT JOIN brand b USING (brand_id) WHERE m.uom_id = m.base_uom_id""")
cte("sales_line", """SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'INVOICE' ELSE 'CASH' END AS channel, o_orderkey AS doc_no, l_linenumber AS item_no,
  'P' || CAST(l_partkey AS VARCHAR) AS stock_id, CASE WHEN l_partkey % 3 = 0 AND l_linenumber % 4 = 0 THEN 'BOX' ELSE 'PCS' END AS uom_id,
  w.location_id, CAST(o_orderdate AS DATE) AS doc_date, CAST(l_quantity AS DECIMAL(18,4)) AS qty,
  CAST(CAST(l_extendedprice AS DECIMAL(13,2)) * (1 - CAST(l_discount AS DECIMAL(3,2))) AS DECIMAL(18,4)) AS amount,
  l_discount >= 0.075 AS has_promo
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN location w ON w.n_nationkey = c_nationkey WHERE CAST(o_orderdate AS DATE) >= w.open_date""")
cte("costed", """SELECT s.*, m.cost AS unit_cost, m.uom_rate, s.qty * COALESCE(m.uom_rate, 1) AS base_qty
FROM sales_line s LEFT JOIN stock_master m USING (stock_id, uom_id)""")
cte("cash", "SELECT * FROM costed WHERE channel = 'CASH'")
cte("stock_balance", """SELECT 'P' || CAST(p_partkey AS VARCHAR) AS stock_id, 'PCS' AS uom_id, location_id,
  CAST(CASE WHEN p_partkey % 4 = 1 THEN (p_partkey * 31 + n_nationkey * 17) % 7 - 1
            ELSE (p_partkey * 31 + n_nationkey * 17) % 60 - 2 END AS DECIMAL(18,4)) AS balance_qty
FROM part, location WHERE (p_partkey * 7 + n_nationkey * 13) % 4 = 0""")
cte("valued", """SELECT b.*, COALESCE(b.balance_qty, 0) * COALESCE(m.cost, 0) AS stock_value
FROM stock_balance b LEFT JOIN stock_master m USING (stock_id, uom_id)""")
cte("stock_held", "SELECT stock_id, SUM(balance_qty) AS balance_qty FROM stock_balance GROUP BY stock_id")
cte("stock_ledger", """SELECT stock_id, uom_id, location_id, CASE channel WHEN 'CASH' THEN 'CUS_CASH_SALES' ELSE 'CUS_INVOICE' END AS doc_type,
  doc_date, qty AS qty_out, qty * CASE uom_id WHEN 'BOX' THEN 12 ELSE 1 END AS root_uom_qty_out,
  CAST((CAST(amount * 10000 AS BIGINT) // CAST(qty AS BIGINT)) AS DECIMAL(18,0)) * 0.0001 AS unit_price
FROM sales_line""")
cte("batch_line", """SELECT CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'SUP_INVOICE' WHEN l_returnflag = 'N' THEN 'RECEIVE'
    WHEN l_returnflag = 'R' THEN 'TRANSFER' WHEN l_linestatus = 'O' THEN 'TRANSIT' ELSE 'SUP_CREDIT' END AS doc_type,
  l_orderkey AS doc_id, CAST(l_shipdate AS DATE) AS doc_date,
  CASE WHEN l_returnflag = 'R' THEN 'L' || lpad(CAST(l_orderkey % 25 AS VARCHAR), 2, '0') ELSE 'WAREHOUSE' END AS location_id,
  'P' || CAST(l_partkey AS VARCHAR) AS stock_id, l_suppkey,
  CASE WHEN l_partkey % 3 = 0 AND l_linenumber % 4 = 0 THEN 'BOX' ELSE 'PCS' END AS uom_id,
  CAST(CASE WHEN l_returnflag = 'A' THEN 1 ELSE l_quantity END AS DECIMAL(18,4)) AS qty,
  CASE WHEN l_linenumber = 7 THEN 'N/A'
       WHEN l_orderkey % 11 = 0 THEN substr(CAST(CAST(DATE '2021-08-01' + CAST((l_orderkey*37 + l_linenumber*11) % 500 - 100 AS INTEGER) AS DATE) AS VARCHAR), 1, 8) || '00 LOT' || CAST(l_suppkey AS VARCHAR)
       ELSE CAST(CAST(DATE '2021-08-01' + CAST((l_orderkey*37 + l_linenumber*11) % 500 - 100 AS INTEGER) AS DATE) AS VARCHAR) || ' LOT' || CAST(l_suppkey AS VARCHAR) END AS batch_remark
FROM lineitem""")
cte("supplier_invoice_line", """SELECT b.*, m.cost * CAST(1 + (l_suppkey % 5) * 0.01 AS DECIMAL(3,2)) AS unit_price
FROM batch_line b LEFT JOIN stock_master m USING (stock_id, uom_id) WHERE b.doc_type = 'SUP_INVOICE'""")
