from oracles.base import AS_OF, cte, dbl, lng, query, ratio, rnd

cte("base_held", """SELECT b.stock_id, b.bal, m.cost FROM (SELECT stock_id, uom_id, SUM(balance_qty) AS bal FROM stock_balance GROUP BY 1, 2) b
  JOIN stock_master m ON m.stock_id = b.stock_id AND m.uom_id = b.uom_id WHERE m.uom_id = m.base_uom_id""")
cte("d_out", f"""SELECT {lng('COUNT(*) FILTER (bal <= 0)')} AS stockout_count, {lng('COUNT(*)')} AS total_skus, {rnd(ratio('COUNT(*) FILTER (bal <= 0)', 'COUNT(*)') + ' * 100', 2)} AS stockout_rate
  FROM (SELECT stock_id, uom_id, location_id, SUM(balance_qty) AS bal FROM stock_balance GROUP BY 1, 2, 3) b JOIN stock_master m USING (stock_id, uom_id) WHERE uom_id = m.base_uom_id""")
cte("d_inv", f"""SELECT {dbl('SUM(bal * cost)')} AS total_inventory_value, {dbl('SUM(bal)')} AS total_units,
  {rnd(ratio('SUM(sup)', 'COUNT(sup)'), 4)} AS avg_days_of_supply
  FROM (SELECT h.*, CAST(CASE WHEN s.sold > 0 THEN {ratio(dbl('bal') + ' * s.n', 's.sold')} END AS DECIMAL(28,10)) AS sup FROM base_held h
        LEFT JOIN (SELECT stock_id, SUM(q) AS sold, COUNT(*) AS n FROM (SELECT stock_id, doc_date, SUM(qty) AS q FROM sales_line WHERE channel = 'CASH' AND doc_date >= {AS_OF} - 90 GROUP BY 1, 2) GROUP BY 1) s ON s.stock_id = h.stock_id)""")
cte("d_turn", f"""SELECT {dbl('cogs')} AS cogs, {dbl('gp')} AS gross_profit, {dbl('inv')} AS avg_inventory, CASE WHEN inv > 0 THEN {rnd(ratio('cogs', 'inv'), 2)} ELSE 0 END AS turnover,
  CASE WHEN inv > 0 THEN {rnd(ratio('gp', 'inv'), 2)} ELSE 0 END AS gmroi
  FROM (SELECT SUM(qty * unit_cost) AS cogs, SUM(amount) - SUM(qty * unit_cost) AS gp FROM cash WHERE doc_date >= {AS_OF} - 365), (SELECT SUM(bal * cost) AS inv FROM base_held)""")
DEAD = f"bal > 0 AND stock_id NOT IN (SELECT stock_id FROM sales_line WHERE channel = 'CASH' AND doc_date >= {AS_OF} - 90)"
cte("d_dead", f"""SELECT {lng('SUM(CASE WHEN dead THEN 1 ELSE 0 END)')} AS dead_stock_count, {lng('COUNT(*) FILTER (bal > 0)')} AS active_stock_count,
  {rnd(ratio('SUM(CASE WHEN dead THEN 1 ELSE 0 END)', 'COUNT(*) FILTER (bal > 0)') + ' * 100', 2)} AS dead_stock_pct FROM (SELECT *, {DEAD} AS dead FROM base_held)""")
cte("d_short", f"""SELECT {lng('COUNT(*) FILTER (bal > 0 AND due > 0)')} AS short_dated_count, {lng('COUNT(*) FILTER (bal > 0)')} AS total_with_stock,
    COALESCE({rnd('SUM(worth) FILTER (bal > 0)', 2)}, 0) AS short_dated_value
  FROM (SELECT stock_id, SUM(bal) AS bal FROM base_held GROUP BY 1) h
  LEFT JOIN (SELECT stock_id, COUNT(*) AS due, SUM(q * cost) AS worth FROM batches WHERE days BETWEEN 0 AND 90 GROUP BY 1) d USING (stock_id)""")

MH = f"""SELECT q.stock_id, p.stock_name, p.barcode, p.category, p.ud1_code AS current_ud1, {lng('n')} AS months_sold, {rnd('tq', 0)} AS annual_qty, {rnd('tr', 2)} AS annual_revenue,
    {rnd('gp', 1)} AS gp_margin_pct, 'BRAND_MATCH' AS detection_reason
  FROM (SELECT stock_id, COUNT(DISTINCT date_trunc('month', doc_date)) AS n, SUM(qty) AS tq, SUM(amount) AS tr,
          CASE WHEN SUM(amount) > 0 THEN {ratio('SUM(amount) - SUM(qty * unit_cost)', 'SUM(amount)')} * 100 ELSE 0 END AS gp
        FROM cash WHERE doc_date >= {AS_OF} - 365 GROUP BY 1) q JOIN product p ON p.stock_id = q.stock_id
  WHERE n >= 3 AND gp < 40 AND (p.ud1_code IS NULL OR p.ud1_code NOT IN ('FLTHB', 'FLTF1', 'FLTF2', 'FLTF3', 'FLTSC'))
    AND (p.stock_name LIKE '%WIDGET%' OR p.stock_name LIKE '%RING%')"""
ACTIVE = """(SELECT p.*, COALESCE(b.bal, 0) AS bal FROM product p LEFT JOIN (SELECT stock_id, uom_id, SUM(balance_qty) AS bal FROM stock_balance GROUP BY 1, 2) b
     ON b.stock_id = p.stock_id AND b.uom_id = p.uom_id WHERE p.is_active = 'Y')"""
OK = "(ud1_code IS NULL OR ud1_code NOT IN ('SPECIAL REQUEST', 'DISCONTINUED'))"

SQL = {
    "dsh1_stockout_rate": query("SELECT * FROM d_out"),
    "dsh2_inventory_supply": query("SELECT * FROM d_inv"),
    "dsh3_turnover_gmroi": query("SELECT * FROM d_turn"),
    "dsh4_dead_stock": query("SELECT * FROM d_dead"),
    "dsh5_short_dated": query("SELECT * FROM d_short"),
    "dsh6_scorecard": query(f"""WITH v AS (SELECT o.stockout_rate AS so, i.avg_days_of_supply AS ds, COALESCE({ratio('s.short_dated_value', 'i.total_inventory_value')} * 100, 0) AS er,
          t.turnover AS tu, t.gmroi AS gm, d.dead_stock_pct AS de, COALESCE({ratio('s.short_dated_count', 's.total_with_stock')} * 100, 0) AS sd
        FROM d_out o, d_inv i, d_turn t, d_dead d, d_short s)
      SELECT 'tier_1_critical' AS tier, 'stock_out_rate' AS metric, {rnd('so', 2)} AS value, '< 2%' AS target, CASE WHEN so < 2 THEN 'good' WHEN so < 5 THEN 'warning' ELSE 'critical' END AS status FROM v
      UNION ALL SELECT 'tier_1_critical', 'days_of_supply', {rnd('ds', 0)}, '30-45 days', CASE WHEN ds BETWEEN 30 AND 45 THEN 'good' ELSE 'warning' END FROM v
      UNION ALL SELECT 'tier_1_critical', 'expiry_risk_value', {rnd('er', 2)}, '< 2%', CASE WHEN er < 2 THEN 'good' WHEN er < 5 THEN 'warning' ELSE 'critical' END FROM v
      UNION ALL SELECT 'tier_2_efficiency', 'inventory_turnover', {rnd('tu', 2)}, '8-12x/year', CASE WHEN tu BETWEEN 8 AND 12 THEN 'good' ELSE 'warning' END FROM v
      UNION ALL SELECT 'tier_2_efficiency', 'gmroi', {rnd('gm', 2)}, '> 3.0', CASE WHEN gm >= 3 THEN 'good' ELSE 'warning' END FROM v
      UNION ALL SELECT 'tier_2_efficiency', 'dead_stock_pct', {rnd('de', 2)}, '< 5%', CASE WHEN de < 5 THEN 'good' WHEN de < 10 THEN 'warning' ELSE 'critical' END FROM v
      UNION ALL SELECT 'tier_3_pharmacy_specific', 'short_dated_ratio', {rnd('sd', 2)}, '< 5%', CASE WHEN sd < 5 THEN 'good' ELSE 'warning' END FROM v"""),
    "mh1_must_have": query(f"{MH} ORDER BY annual_revenue DESC, q.stock_id LIMIT 500"),
    "mh2_must_have_confidence": query(f"SELECT *, CASE WHEN months_sold >= 10 THEN 'high' ELSE 'medium' END AS confidence FROM ({MH})"),
    "ud1_stock_type_distribution": query(f"""SELECT COALESCE(ud1_code, 'NULL/EMPTY') AS ud1_code, {lng('COUNT(DISTINCT stock_id)')} AS sku_count, {dbl('SUM(bal)')} AS total_balance,
        {rnd('SUM(bal * COALESCE(cost, 0))', 2)} AS inventory_value, {rnd(ratio('SUM(bal * COALESCE(cost, 0))', 'SUM(SUM(bal * COALESCE(cost, 0))) OVER ()') + ' * 100', 1)} AS value_pct
        FROM {ACTIVE} GROUP BY ud1_code"""),
    "ud2_true_stockout": query(f"""SELECT {lng('COUNT(*)')} AS total_active_skus, {lng(f'COUNT(*) FILTER ({OK})')} AS stockable_skus, {lng(f'COUNT(*) FILTER ({OK} AND bal <= 0)')} AS stockout_stockable,
        {lng("COUNT(*) FILTER (ud1_code = 'SPECIAL REQUEST')")} AS special_request_skus, {lng("COUNT(*) FILTER (ud1_code = 'DISCONTINUED')")} AS discontinued_skus,
        {rnd(ratio(f'COUNT(*) FILTER ({OK} AND bal <= 0)', f'COUNT(*) FILTER ({OK})') + ' * 100', 2)} AS true_stockout_rate FROM {ACTIVE}"""),
    "tg1_therapeutic_groups": query(f"""SELECT COALESCE(therapeutic_group, 'UNCLASSIFIED') AS therapeutic_group, {lng('COUNT(*)')} AS sku_count, {lng("COUNT(*) FILTER (ud1_code = 'FLTHB')")} AS house_brand_count,
        COUNT(*) FILTER (ud1_code = 'FLTHB') > 0 AS has_house_brand, {dbl('SUM(COALESCE(q, 0))')} AS total_sales_qty, {rnd('SUM(COALESCE(r, 0))', 2)} AS total_revenue
        FROM product p LEFT JOIN (SELECT stock_id, SUM(qty) AS q, SUM(amount) AS r FROM sales_line WHERE channel = 'CASH' AND doc_date >= {AS_OF} - 365 GROUP BY 1) s ON s.stock_id = p.stock_id
        WHERE p.is_active = 'Y' GROUP BY therapeutic_group HAVING COUNT(*) > 1 ORDER BY total_revenue DESC NULLS LAST, 1 LIMIT 100"""),
    "sr1_special_request": query(f"""SELECT p.stock_id, p.stock_name, p.barcode, p.ud1_code AS current_ud1, p.therapeutic_group, p.category, {dbl('h.balance_qty')} AS current_balance,
        {rnd('h.balance_qty * p.cost', 2)} AS inventory_value, s.d AS last_sale_date, {lng(f'{AS_OF} - s.d')} AS days_since_sale, {dbl('COALESCE(s.q, 0)')} AS annual_qty,
        {rnd(dbl('COALESCE(s.q, 0)') + ' / 12', 2)} AS avg_monthly_qty, {lng('COALESCE(s.n, 0)')} AS months_sold
        FROM product p JOIN stock_held h ON h.stock_id = p.stock_id
        LEFT JOIN (SELECT stock_id, MAX(doc_date) AS d, SUM(qty) AS q, COUNT(DISTINCT date_trunc('month', doc_date)) AS n FROM sales_line WHERE channel = 'CASH' AND doc_date >= {AS_OF} - 365 GROUP BY 1) s ON s.stock_id = p.stock_id
        WHERE p.is_active = 'Y' AND COALESCE(p.ud1_code, 'NA') NOT IN ('SPECIAL REQUEST', 'DISCONTINUED', 'STOCK CLEARANCE') AND h.balance_qty > 0
          AND (s.d IS NULL OR s.d < {AS_OF} - 180) AND {dbl('COALESCE(s.q, 0)')} / 12 < 5 ORDER BY inventory_value DESC, p.stock_id LIMIT 500"""),
}
