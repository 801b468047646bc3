from oracles.base import AS_OF, dbl, lng, query, ratio, rnd

SQL = {
    "bal1_locations": query("SELECT location_id AS id, name, address FROM location WHERE is_active = 'Y'"),
    "bal2_balance_summary": query(f"""
        SELECT v.location_id, l.name AS location_name, {lng('COUNT(DISTINCT stock_id)')} AS sku_count,
               {dbl('SUM(balance_qty)')} AS total_qty, {dbl('SUM(stock_value)')} AS total_value
        FROM valued v LEFT JOIN location l USING (location_id) GROUP BY v.location_id, l.name"""),
    "bal3_balance_probe": query(f"""
        SELECT b.stock_id, b.location_id, {dbl('b.balance_qty')} AS balance_qty, m.stock_name, m.uom_id AS variant_uom, m.base_uom_id
        FROM stock_balance b JOIN stock_master m ON m.stock_id = b.stock_id WHERE b.stock_id LIKE 'P1%'"""),
    "bal3_balance_total": query(f"SELECT {dbl('SUM(balance_qty)')} AS total_balance FROM stock_balance WHERE stock_id = 'P12'"),
    "mov1_movement_analysis": query(f"""
        WITH sold AS (SELECT stock_id, SUM(qty) AS qty FROM sales_line
                      WHERE location_id = 'L03' AND doc_date >= {AS_OF} - 90 GROUP BY stock_id),
        held AS (SELECT stock_id, SUM(balance_qty) AS bal FROM stock_balance WHERE location_id = 'L03' GROUP BY stock_id)
        SELECT h.stock_id, p.stock_name, p.barcode, {dbl('h.bal')} AS balance_qty, {dbl('COALESCE(s.qty, 0)')} AS qty_sold_period,
               CASE WHEN s.qty > 0 THEN {rnd(ratio('h.bal * 90', 's.qty'), 1)} ELSE 999.0 END AS days_on_hand
        FROM held h LEFT JOIN sold s USING (stock_id) LEFT JOIN product p USING (stock_id)
        WHERE h.bal > 0 ORDER BY days_on_hand DESC, h.stock_id LIMIT 100"""),
    "mov2_stock_days_by_location": query(f"""
        WITH cogs AS (SELECT location_id, SUM(qty * unit_cost) AS cogs FROM cash WHERE doc_date >= {AS_OF} - 90 GROUP BY location_id),
        val AS (SELECT location_id, SUM(stock_value) AS v FROM valued GROUP BY location_id)
        SELECT val.location_id, l.name AS location_name, {rnd('v', 2)} AS stock_value, {rnd('COALESCE(cogs, 0)', 2)} AS cogs_period,
               CASE WHEN cogs > 0 THEN {rnd(ratio(dbl('v') + ' * 90', 'cogs'), 1)} ELSE 999.0 END AS stock_days
        FROM val LEFT JOIN cogs USING (location_id) LEFT JOIN location l ON l.location_id = val.location_id WHERE v > 0"""),
    "mov3_stock_days_company": query(f"""
        WITH cogs AS (SELECT SUM(qty * unit_cost) AS cogs FROM cash WHERE doc_date >= {AS_OF} - 90),
        val AS (SELECT SUM(stock_value) AS v FROM valued)
        SELECT {dbl('COALESCE(v, 0)')} AS total_stock_value, {dbl('COALESCE(cogs, 0)')} AS period_cogs,
               CASE WHEN cogs > 0 THEN {rnd(ratio(dbl('v') + ' * 90', 'cogs'), 1)} ELSE 0.0 END AS stock_days FROM val, cogs"""),
}

ALERTS = f"""
    SELECT a.alert_type, a.stock_id, p.stock_name, p.barcode, a.location_id, l.name AS location_name,
           {rnd('a.hist', 2)} AS historical_avg_daily, {rnd('a.rec', 2)} AS recent_avg_daily,
           {rnd(ratio('a.rec - a.hist', 'a.hist') + ' * 100', 1)} AS deviation_pct, {dbl('COALESCE(a.bal, 0)')} AS current_balance,
           CASE WHEN a.hist > 0 THEN {rnd(ratio('COALESCE(a.bal, 0)', 'a.hist'), 1)} ELSE 999.0 END AS days_on_hand, a.last_sale_date,
           CASE a.alert_type WHEN 'dead_stock' THEN 'Review for clearance, return to supplier, or writeoff'
             WHEN 'slow_moving' THEN 'Consider promotion or transfer to higher-traffic outlet'
             ELSE 'Consider reorder or transfer from other outlets' END AS recommended_action
    FROM (SELECT *, CASE WHEN last_sale_date < {AS_OF} - 30 AND bal > 0 THEN 'dead_stock' WHEN rec < hist * 0.7 THEN 'slow_moving'
                         WHEN rec > hist * 1.3 THEN 'fast_moving' END AS alert_type
          FROM (SELECT d.stock_id, d.location_id, {dbl('SUM(q)')} / COUNT(*) AS hist,
                       COALESCE({dbl(f"SUM(q) FILTER (doc_date >= {AS_OF} - 14)")} / NULLIF(COUNT(*) FILTER (doc_date >= {AS_OF} - 14), 0), 0) AS rec,
                       MAX(doc_date) AS last_sale_date, ANY_VALUE(b.bal) AS bal
                FROM (SELECT stock_id, location_id, doc_date, SUM(qty) AS q FROM sales_line WHERE doc_date >= {AS_OF} - 90 GROUP BY ALL) d
                LEFT JOIN (SELECT stock_id, location_id, SUM(balance_qty) AS bal FROM stock_balance GROUP BY ALL) b
                  ON b.stock_id = d.stock_id AND b.location_id = d.location_id
                GROUP BY d.stock_id, d.location_id) t) a
    LEFT JOIN product p ON p.stock_id = a.stock_id LEFT JOIN location l ON l.location_id = a.location_id
    WHERE a.alert_type IS NOT NULL"""
ALERT_ORDER = """ORDER BY CASE alert_type WHEN 'dead_stock' THEN 1 WHEN 'slow_moving' THEN 2 ELSE 3 END, current_balance DESC, stock_id, location_id"""

SQL |= {
    "sel1_sellout": query(f"""
        WITH d AS (SELECT stock_id, doc_date, SUM(qty) AS q FROM sales_line WHERE doc_date >= {AS_OF} - 90 GROUP BY ALL),
        s AS (SELECT stock_id, SUM(q) AS sold, COUNT(*) AS n, {dbl('SUM(q)')} / COUNT(*) AS avg_day,
                     {dbl(f"SUM(q) FILTER (doc_date >= {AS_OF} - 14)")} / NULLIF(COUNT(*) FILTER (doc_date >= {AS_OF} - 14), 0) AS recent
              FROM d GROUP BY stock_id HAVING SUM(q) > 0)
        SELECT s.stock_id, p.stock_name, p.barcode, {dbl('COALESCE(h.balance_qty, 0)')} AS current_balance, {dbl('sold')} AS total_sold_period,
               {lng('n')} AS active_days, {rnd('avg_day', 2)} AS avg_daily_sellout, {rnd('avg_day * 7', 2)} AS avg_weekly_sellout,
               {rnd('avg_day * 30', 2)} AS avg_monthly_sellout,
               CASE WHEN avg_day > 0 THEN {rnd(ratio('COALESCE(h.balance_qty, 0)', 'avg_day'), 1)} ELSE 999.0 END AS days_on_hand,
               CASE WHEN recent IS NULL THEN 'no_recent_sales' WHEN recent < avg_day * 0.7 THEN 'slow'
                    WHEN recent > avg_day * 1.3 THEN 'fast' ELSE 'normal' END AS trend_status,
               {rnd(ratio('COALESCE(recent, 0) - avg_day', 'avg_day') + ' * 100', 1)} AS trend_deviation_pct
        FROM s LEFT JOIN stock_held h USING (stock_id) LEFT JOIN product p USING (stock_id)
        ORDER BY days_on_hand DESC, s.stock_id LIMIT 100"""),
    "alr1_movement_alerts": query(f"{ALERTS} {ALERT_ORDER} LIMIT 200"),
    "alr1_movement_alerts_all": query(ALERTS),
    "alr2_alert_summary": query(f"SELECT alert_type, {lng('COUNT(*)')} AS alert_count FROM ({ALERTS}) GROUP BY alert_type"),
}
