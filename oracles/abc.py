from stockloom import config
from oracles.base import AS_OF, cte, dbl, lng, query, ratio, rnd, sd

cte("abc_month", f"""SELECT s.stock_id, date_trunc('month', doc_date) AS mon, SUM(qty) AS q, SUM(amount) AS r,
  SUM(qty * COALESCE(unit_cost, 0)) AS c FROM costed s WHERE doc_date >= {AS_OF} - 360 GROUP BY ALL""")
cte("abc_sku", f"""SELECT stock_id, SUM(q) AS tq, SUM(r) AS tr, SUM(c) AS tc, COUNT(*) AS n,
  {dbl('SUM(q)')} / COUNT(*) AS av, {sd('COUNT(*)', 'SUM(q)', 'SUM(q * q)')} AS dev FROM abc_month GROUP BY stock_id""")
cte("abc_rank", f"""SELECT *, SUM(tr) OVER () AS grand, SUM(tr) OVER (ORDER BY tr DESC) AS run, COUNT(*) OVER () AS total,
  ROW_NUMBER() OVER (ORDER BY tr DESC, substr(md5(stock_id), 1, 2), stock_id) AS rk,
  CASE WHEN av > 0 THEN dev / av END AS cvr FROM abc_sku WHERE tr > 0""")
cte("abc_base", f"""SELECT a.stock_id, p.stock_name, p.barcode, p.category, p.ud1_code, {dbl('tq')} AS total_qty, {rnd('tr', 2)} AS total_revenue,
  {rnd('tr - tc', 2)} AS gross_profit, {rnd(ratio('tr - tc', 'tr') + ' * 100', 1)} AS gp_margin_pct, {rnd('av', 1)} AS avg_monthly_qty,
  COALESCE({rnd('cvr', 2)}, 0.0) AS cv, {lng('n')} AS months_with_sales, {dbl('COALESCE(v.bal, 0)')} AS current_balance,
  {rnd('COALESCE(v.val, 0)', 2)} AS inventory_value,
  CASE WHEN av > 0 THEN {rnd(ratio(dbl('COALESCE(v.bal, 0)') + ' * 30', 'av'), 0)} ELSE 9999.0 END AS days_of_inventory,
  {rnd(ratio('run', 'grand') + ' * 100', 2)} AS cumulative_pct, {rnd(ratio('tr', 'grand') + ' * 100', 3)} AS revenue_contribution_pct,
  {lng('rk')} AS rank, {lng('total')} AS total_skus,
  CASE WHEN {ratio('run', 'grand')} <= 0.80::DOUBLE THEN 'A' WHEN {ratio('run', 'grand')} <= 0.95::DOUBLE THEN 'B' ELSE 'C' END AS abc_class,
  CASE WHEN cvr < 0.5 THEN 'X' WHEN cvr <= 1.0 THEN 'Y' ELSE 'Z' END AS xyz_class
FROM abc_rank a JOIN product p ON p.stock_id = a.stock_id
LEFT JOIN (SELECT stock_id, SUM(balance_qty) AS bal, SUM(stock_value) AS val FROM valued GROUP BY stock_id) v ON v.stock_id = a.stock_id""")
BRANDS = "'WIDGET|RING'"
cte("abc_scored", f"""SELECT *, 0.25::DOUBLE * sp + 0.20::DOUBLE * sv + 0.20::DOUBLE * sr + 0.15::DOUBLE * ss + 0.10::DOUBLE * sc + 0.10::DOUBLE * sg AS raw_score FROM (
  SELECT *, LEAST(gp_margin_pct / 60 * 100, 100.0::DOUBLE) AS sp,
    CASE WHEN mq > 0 THEN total_qty / mq * 100 ELSE 0 END AS sv, CASE WHEN mr > 0 THEN total_revenue / mr * 100 ELSE 0 END AS sr,
    GREATEST(0.0::DOUBLE, 100 - cv * 50) AS ss,
    CASE WHEN doi < 9999 THEN GREATEST(0.0::DOUBLE, 100 - doi / 180 * 100) ELSE 0 END AS sc,
    CASE WHEN is_protected THEN 100.0::DOUBLE ELSE 0 END AS sg
  FROM (SELECT *, MAX(total_qty) OVER () AS mq, MAX(total_revenue) OVER () AS mr,
          CASE WHEN days_of_inventory = 0 THEN 9999 ELSE days_of_inventory END AS doi,
          COALESCE(regexp_matches(stock_name, {BRANDS}), FALSE) AS is_branded,
          COALESCE(ud1_code IN ('FLTHB', 'FLTF1', 'FLTF2', 'FLTF3', 'FLTMH'), FALSE) OR COALESCE(regexp_matches(stock_name, {BRANDS}), FALSE) AS is_protected
        FROM abc_base) x) y""")

CELLS = "('AX','auto_replenish'),('AY','seasonal_planning'),('AZ','careful_forecast'),('BX','standard_reorder'),('BY','buffer_stock'),('BZ','reduce_variety'),('CX','min_order_qty'),('CY','negotiate_margins'),('CZ','delist_review')"
SQL = {
    "abc1_abc_xyz": query("SELECT * FROM abc_base"),
    "abc2_health_score": query(f"""SELECT stock_id, {rnd('sp', 1)} AS profitability_score, {rnd('sv', 1)} AS volume_score, {rnd('sr', 1)} AS revenue_score,
        {rnd('ss', 1)} AS stability_score, {rnd('sc', 1)} AS doi_score, sg AS strategic_score, {rnd('raw_score', 1)} AS health_score FROM abc_scored"""),
    "abc3_protection": query("SELECT stock_id, is_branded, is_protected FROM abc_scored"),
    "abc_report": query(f"""SELECT stock_id, stock_name, barcode, category, COALESCE(ud1_code, '') AS ud1_code, abc_class, xyz_class, abc_class || xyz_class AS abc_xyz,
        total_revenue, gross_profit, gp_margin_pct, {lng('trunc(total_qty)')} AS total_qty, cv, {lng('trunc(current_balance)')} AS current_balance,
        CASE WHEN doi < 9999 THEN {lng('doi')} END AS days_of_inventory, {rnd('raw_score', 1)} AS health_score, is_branded, is_protected
        FROM abc_scored ORDER BY total_revenue DESC, stock_id LIMIT 100"""),
    "abc4_distribution": query(f"""SELECT abc_class, {lng('COUNT(*)')} AS sku_count, {dbl('SUM(CAST(total_revenue AS DECIMAL(28,2)))')} AS revenue,
        {rnd(ratio('SUM(CAST(total_revenue AS DECIMAL(28,2)))', '(SELECT SUM(CAST(total_revenue AS DECIMAL(28,2))) FROM abc_base)') + ' * 100', 1)} AS revenue_pct
        FROM abc_base GROUP BY abc_class"""),
    "abc5_matrix": query(f"""SELECT k.cell AS abc_xyz, {lng('COUNT(b.stock_id)')} AS sku_count, k.action
        FROM (VALUES {CELLS}) k(cell, action) LEFT JOIN abc_base b ON b.abc_class || b.xyz_class = k.cell GROUP BY k.cell, k.action"""),
    "abc6_delist_candidates": query(f"""SELECT stock_id, stock_name, category, ud1_code, gp_margin_pct, cv, days_of_inventory, {rnd('raw_score', 1)} AS health_score
        FROM abc_scored WHERE abc_class = 'C' AND xyz_class = 'Z' AND NOT is_protected AND raw_score < 30
        ORDER BY health_score, stock_id LIMIT 50"""),
}

_fixed = ", ".join(f"('{b}')" for b in sorted({*config.PROTECTED_BRANDS, *config.MUST_HAVE_BRANDS}))
SQL["abc3_many_brands"] = query(f"""WITH patterns AS (SELECT DISTINCT substr(upper(p_name), 2, 7) AS pattern FROM part WHERE p_partkey % 40 = 0 UNION SELECT * FROM (VALUES {_fixed}))
    SELECT stock_id, EXISTS (SELECT 1 FROM patterns WHERE length(pattern) >= 3 AND contains(stock_name, pattern)) AS is_branded FROM product""")
