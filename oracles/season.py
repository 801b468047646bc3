from oracles.base import AS_OF, dbl, lng, query, ratio, rnd, sd

SEA1 = f"""
    SELECT s.stock_id, p.stock_name, p.barcode, p.category, {lng('s.n')} AS months_with_sales, {rnd('s.av', 2)} AS avg_monthly_qty,
      {rnd('s.dev', 2)} AS stddev_monthly, {rnd(ratio('s.dev', 's.av'), 3)} AS coefficient_of_variation,
      CASE WHEN {ratio('s.dev', 's.av')} > 0.5 THEN 'HIGH_VARIANCE' WHEN {ratio('s.dev', 's.av')} > 0.3 THEN 'MEDIUM_VARIANCE' ELSE 'LOW_VARIANCE' END AS seasonality_class,
      {dbl('s.lo')} AS min_monthly, {dbl('s.hi')} AS max_monthly, {rnd(ratio('s.hi', 's.lo'), 1)} AS peak_to_trough_ratio, t.top3 AS top_3_peak_months
    FROM (SELECT stock_id, COUNT(*) AS n, {dbl('SUM(q)')} / COUNT(*) AS av, {sd('COUNT(*)', 'SUM(q)', 'SUM(q * q)')} AS dev, MIN(q) AS lo, MAX(q) AS hi
          FROM mon24 GROUP BY stock_id HAVING COUNT(*) >= 6) s
    LEFT JOIN (SELECT stock_id, string_agg(CAST(m AS VARCHAR), ',' ORDER BY k) AS top3
               FROM (SELECT stock_id, month(mon) AS m, ROW_NUMBER() OVER (PARTITION BY stock_id ORDER BY {dbl('SUM(q)')} / COUNT(*) DESC, month(mon)) AS k
                     FROM mon24 GROUP BY stock_id, month(mon)) WHERE k <= 3 GROUP BY stock_id) t USING (stock_id)
    LEFT JOIN product p USING (stock_id)"""
MON24 = f"mon24 AS (SELECT stock_id, date_trunc('month', doc_date) AS mon, CAST(SUM(qty) AS DECIMAL(18,4)) AS q FROM sales_line WHERE doc_date >= {AS_OF} - 730 GROUP BY ALL)"
SEA1_TOP = f"{SEA1} ORDER BY coefficient_of_variation DESC NULLS LAST, s.stock_id LIMIT 500"

MONALL = f"""monall AS (SELECT stock_id, date_trunc('month', doc_date) AS mon, SUM(qty) AS q FROM sales_line GROUP BY ALL),
  ov AS (SELECT stock_id, {dbl('SUM(q)')} / COUNT(*) AS av FROM monall GROUP BY stock_id HAVING COUNT(*) >= 18),
  idx AS (SELECT stock_id, month(mon) AS m, CASE WHEN ANY_VALUE(av) > 0 THEN ({dbl('SUM(q)')} / COUNT(*)) / ANY_VALUE(av) ELSE 1 END AS i
          FROM monall JOIN ov USING (stock_id) GROUP BY stock_id, month(mon)),
  rng AS (SELECT stock_id, MAX(i) AS hi, MIN(i) AS lo, CASE WHEN MIN(i) > 0 THEN MAX(i) / MIN(i) ELSE MAX(i) END AS span,
          string_agg(CAST(m AS VARCHAR), ',' ORDER BY i DESC, m) FILTER (i > 1.3) AS peak_months,
          string_agg(CAST(m AS VARCHAR), ',' ORDER BY i, m) FILTER (i < 0.7) AS trough_months FROM idx GROUP BY stock_id)"""
SEA2 = f"""SELECT r.stock_id, p.stock_name, p.barcode, p.category, {rnd('hi', 2)} AS peak_index, {rnd('lo', 2)} AS trough_index, {rnd('span', 2)} AS seasonal_range,
    CASE WHEN span > 3.0 THEN 'HIGHLY_SEASONAL' WHEN span >= 1.5 THEN 'MODERATELY_SEASONAL' ELSE 'STABLE' END AS seasonality_type,
    COALESCE(peak_months, '') AS peak_months, COALESCE(trough_months, '') AS trough_months FROM rng r JOIN product p USING (stock_id)"""
SEA2_TOP = f"{SEA2} ORDER BY seasonal_range DESC, r.stock_id LIMIT 500"

SMART = f"""pm AS (SELECT stock_id, date_trunc('month', doc_date) AS mon, CAST(SUM(q) AS DECIMAL(18,4)) AS q, CAST(COALESCE(SUM(q) FILTER (NOT promo), 0) AS DECIMAL(18,4)) AS c, bool_or(promo) AS promo
    FROM (SELECT stock_id, doc_date, SUM(qty) AS q, bool_or(has_promo) AS promo FROM sales_line WHERE channel = 'CASH' AND doc_date >= {AS_OF} - 1080 GROUP BY ALL) GROUP BY ALL),
  st AS (SELECT stock_id, COUNT(*) AS n, {dbl('SUM(q)')} / COUNT(*) AS av,
      CASE WHEN SUM(q) > 0 THEN {sd('COUNT(*)', 'SUM(q)', 'SUM(q * q)')} / ({dbl('SUM(q)')} / COUNT(*)) END AS base,
      CASE WHEN SUM(c) > 0 THEN {sd('COUNT(*)', 'SUM(c)', 'SUM(c * c)')} / ({dbl('SUM(c)')} / COUNT(*)) END AS clean,
      COUNT(*) FILTER (promo) AS pmn, COALESCE({ratio('MAX(q)', 'MIN(q)')}, 1) AS swing FROM pm GROUP BY stock_id HAVING COUNT(*) >= 6)"""
SEA3 = f"""SELECT s.stock_id, p.stock_name, p.barcode, p.category, {rnd('av', 1)} AS avg_monthly_qty, COALESCE({rnd('base', 2)}, 0) AS base_cv, COALESCE({rnd('clean', 2)}, 0) AS clean_cv,
    {lng('n')} AS month_count, {lng('pmn')} AS promo_months, {rnd(ratio('pmn', 'n') + ' * 100', 0)} AS promo_frequency_pct, {rnd('swing', 1)} AS peak_trough_ratio,
    CASE WHEN base IS NULL THEN 'INSUFFICIENT_DATA' WHEN base > 0.7 AND clean < 0.5 THEN 'PROMO_DRIVEN' WHEN base > 0.7 AND swing > 3 THEN 'TRUE_SEASONAL'
         WHEN base > 1.0 THEN 'ERRATIC' WHEN base > 0.5 THEN 'MODERATE_VARIABILITY' ELSE 'STABLE' END AS demand_pattern,
    CASE WHEN base IS NULL THEN 'Gather more data' WHEN base > 0.7 AND clean < 0.5 THEN 'Manage via promotion calendar' WHEN base > 0.7 AND swing > 3 THEN 'Pre-stock for peak months'
         WHEN base > 1.0 THEN 'Maintain safety stock buffer' ELSE 'Standard replenishment' END AS recommendation
  FROM st s JOIN product p USING (stock_id)"""
SEA3_TOP = f"{SEA3} ORDER BY COALESCE({rnd('base', 9)}, 0) DESC, s.stock_id LIMIT 500"

CY, LY = "doc_date >= DATE '2001-07-01' AND doc_date < DATE '2001-08-01'", "doc_date >= DATE '2000-07-01' AND doc_date < DATE '2000-08-01'"
YOY = f"""SELECT q.stock_id, p.stock_name, p.barcode, p.category, {dbl('ly')} AS last_year_qty, {dbl('cy')} AS current_year_qty, {dbl('cy - ly')} AS qty_change,
    CASE WHEN ly > 0 THEN {rnd(ratio('cy - ly', 'ly') + ' * 100', 1)} WHEN cy > 0 THEN 999.0 ELSE 0.0 END AS yoy_change_pct,
    CASE WHEN ly > 0 AND cy < ly * 0.7 THEN 'UNDERPERFORMING' WHEN ly > 0 AND cy > ly * 1.3 THEN 'OUTPERFORMING' WHEN ly = 0 AND cy > 0 THEN 'NEW_THIS_YEAR'
         WHEN cy = 0 AND ly > 0 THEN 'NO_SALES_THIS_YEAR' ELSE 'NORMAL' END AS yoy_status
  FROM (SELECT COALESCE(a.stock_id, b.stock_id) AS stock_id, COALESCE(a.q, 0) AS cy, COALESCE(b.q, 0) AS ly
        FROM (SELECT stock_id, SUM(qty) AS q FROM sales_line WHERE {CY} GROUP BY 1) a FULL JOIN (SELECT stock_id, SUM(qty) AS q FROM sales_line WHERE {LY} GROUP BY 1) b ON a.stock_id = b.stock_id) q
  LEFT JOIN product p ON p.stock_id = q.stock_id"""
YOY_TOP = f"{YOY} ORDER BY ABS(qty_change) DESC, q.stock_id LIMIT 200"
OUT = f"""SELECT l.location_id, l.name AS location_name, f.d AS first_sale_date, {lng(f'{AS_OF} - f.d')} AS days_since_first_sale,
    CASE WHEN {AS_OF} - f.d < 90 THEN 'NEW' WHEN {AS_OF} - f.d < 180 THEN 'RAMPING' ELSE 'MATURE' END AS maturity_status, CASE WHEN {AS_OF} - f.d < 90 THEN FALSE ELSE TRUE END AS alerts_enabled
  FROM location l LEFT JOIN (SELECT location_id, MIN(doc_date) AS d FROM sales_line WHERE channel = 'CASH' GROUP BY 1) f ON f.location_id = l.location_id WHERE l.is_active = 'Y'"""
LFL = f"""SELECT (SELECT {dbl('COALESCE(SUM(r), 0)')} FROM c WHERE location_id IN (SELECT location_id FROM y)) AS lfl_cy_revenue,
    (SELECT {dbl('COALESCE(SUM(r), 0)')} FROM y WHERE location_id IN (SELECT location_id FROM c)) AS lfl_ly_revenue,
    (SELECT {lng('COUNT(*)')} FROM c WHERE location_id IN (SELECT location_id FROM y)) AS lfl_outlet_count,
    (SELECT {dbl('COALESCE(SUM(r), 0)')} FROM c) AS total_cy_revenue, (SELECT {dbl('COALESCE(SUM(r), 0)')} FROM y) AS total_ly_revenue,
    (SELECT {lng('COUNT(*)')} FROM c) AS cy_outlet_count, (SELECT {lng('COUNT(*)')} FROM y) AS ly_outlet_count,
    (SELECT {lng('COUNT(*)')} FROM c WHERE location_id NOT IN (SELECT location_id FROM y)) AS new_outlets_count,
    (SELECT {dbl('COALESCE(SUM(r), 0)')} FROM c WHERE location_id NOT IN (SELECT location_id FROM y)) AS new_outlets_revenue"""
LFL_CTE = f"""c AS (SELECT location_id, SUM(amount) AS r FROM sales_line WHERE {CY} GROUP BY 1), y AS (SELECT location_id, SUM(amount) AS r FROM sales_line WHERE {LY} GROUP BY 1)"""
grow = lambda a, b: f"COALESCE({rnd(ratio(f'{a} - {b}', b) + ' * 100', 1)}, 0)"

SQL = {
    "src1_cash_sales": query(f"""SELECT channel, {lng('doc_no')} AS doc_no, {lng('item_no')} AS item_no, stock_id, uom_id, location_id, doc_date, {dbl('qty')} AS qty, {dbl('amount')} AS amount, {dbl('unit_cost')} AS unit_cost, has_promo FROM cash"""),
    "src2_invoice_sales": query(f"""SELECT channel, {lng('doc_no')} AS doc_no, {lng('item_no')} AS item_no, stock_id, uom_id, location_id, doc_date, {dbl('qty')} AS qty, {dbl('amount')} AS amount, {dbl('COALESCE(unit_cost, 0)')} AS unit_cost, has_promo FROM costed WHERE channel = 'INVOICE'"""),
    "src3_combined_sales": query(f"""SELECT stock_id, location_id, {dbl('SUM(qty)')} AS qty, {dbl('SUM(amount)')} AS revenue FROM sales_line WHERE doc_date >= {AS_OF} - 365 GROUP BY 1, 2"""),
    "src4_daily_sales": query(f"SELECT stock_id, location_id, doc_date, {dbl('SUM(qty)')} AS qty FROM sales_line WHERE doc_date >= {AS_OF} - 90 GROUP BY 1, 2, 3"),
    "src5_monthly_sales": query(f"SELECT stock_id, CAST(date_trunc('month', doc_date) AS DATE) AS month, {dbl('SUM(qty)')} AS qty FROM sales_line GROUP BY 1, 2"),
    "src6_base_uom": query(f"SELECT stock_id, uom_id, {dbl('SUM(qty)')} AS qty, {dbl('SUM(base_qty)')} AS base_qty FROM costed GROUP BY 1, 2"),
    "src7_base_products": query(f"SELECT stock_id, stock_name, ud1_code, {dbl('cost')} AS cost FROM stock_master WHERE uom_id = base_uom_id AND is_active = 'Y'"),
    "src8_enrich": query(f"""SELECT s.stock_id, s.location_id, s.qty, p.stock_name, p.barcode, p.category, l.name AS location_name
        FROM (SELECT stock_id, location_id, {dbl('SUM(qty)')} AS qty FROM sales_line GROUP BY 1, 2) s LEFT JOIN product p ON p.stock_id = s.stock_id LEFT JOIN location l ON l.location_id = s.location_id"""),
    "sea1_seasonal_patterns": query(f"WITH {MON24} {SEA1_TOP}"),
    "sea1_seasonal_patterns_all": query(f"WITH {MON24} {SEA1}"),
    "sea1b_pattern_counts": query(f"WITH {MON24} SELECT seasonality_class, {lng('COUNT(*)')} AS sku_count FROM ({SEA1}) GROUP BY 1"),
    "sea2_seasonal_index": query(f"WITH {MONALL} {SEA2_TOP}"),
    "sea2_seasonal_index_all": query(f"WITH {MONALL} {SEA2}"),
    "sea2b_index_counts": query(f"WITH {MONALL} SELECT seasonality_type, {lng('COUNT(*)')} AS sku_count FROM ({SEA2}) GROUP BY 1"),
    "sea3_smart_cv": query(f"WITH {SMART} {SEA3_TOP}"),
    "sea3_smart_cv_all": query(f"WITH {SMART} {SEA3}"),
    "sea3b_smart_counts": query(f"WITH {SMART} SELECT demand_pattern, {lng('COUNT(*)')} AS sku_count FROM ({SEA3}) GROUP BY 1"),
    "yoy1_comparison": query(YOY_TOP),
    "yoy1_comparison_all": query(YOY),
    "yoy1b_status_counts": query(f"SELECT yoy_status, {lng('COUNT(*)')} AS sku_count FROM ({YOY}) GROUP BY 1"),
    "out1_outlet_maturity": query(OUT),
    "out1_maturity_counts": query(f"SELECT maturity_status, {lng('COUNT(*)')} AS outlet_count FROM ({OUT}) GROUP BY 1"),
    "lfl1_like_for_like": query(f"WITH {LFL_CTE} {LFL}"),
    "lfl2_growth_metrics": query(f"""WITH {LFL_CTE}, b AS ({LFL}) SELECT {grow('lfl_cy_revenue', 'lfl_ly_revenue')} AS lfl_growth_pct,
        {rnd(ratio('total_cy_revenue', 'cy_outlet_count'), 2)} AS cy_per_outlet, {rnd(ratio('total_ly_revenue', 'ly_outlet_count'), 2)} AS ly_per_outlet,
        {grow('(total_cy_revenue / cy_outlet_count)', '(total_ly_revenue / ly_outlet_count)')} AS per_outlet_growth_pct, {grow('total_cy_revenue', 'total_ly_revenue')} AS naive_growth_pct,
        new_outlets_count, {rnd('new_outlets_revenue', 2)} AS new_outlets_revenue, {rnd(ratio('new_outlets_revenue', 'total_cy_revenue') + ' * 100', 1)} AS expansion_contribution FROM b"""),
    "lfl3_cohorts": query(f"""SELECT {lng('y')} AS opening_year, {lng('COUNT(*)')} AS outlet_count, {dbl('COALESCE(SUM(cy), 0)')} AS cy_revenue, {dbl('COALESCE(SUM(ly), 0)')} AS ly_revenue,
        CASE WHEN SUM(ly) > 0 THEN {rnd(ratio('COALESCE(SUM(cy), 0) - SUM(ly)', 'SUM(ly)') + ' * 100', 1)} END AS yoy_growth_pct,
        CASE WHEN y >= 2001 THEN 'new' WHEN y >= 2000 THEN 'ramping' ELSE 'mature' END AS cohort_status
        FROM (SELECT location_id, year(MIN(doc_date)) AS y, SUM(amount) FILTER ({CY}) AS cy, SUM(amount) FILTER ({LY}) AS ly FROM sales_line WHERE channel = 'CASH' GROUP BY 1) GROUP BY y"""),
}

SQL["sea1_closed_months"] = SQL["sea1_seasonal_patterns_all"]
SQL["src5_closed_months"] = SQL["src5_monthly_sales"]
