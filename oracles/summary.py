from oracles.base import AS_OF, cte, dbl, lng, looked_up, query, ratio, rnd, rules, sd

WINDOWS = (7, 14, 30, 90, 365)


def rolled(qty: str) -> str:
    since = lambda n: f"doc_date >= {AS_OF} - {n}"
    cols = [f"COALESCE(SUM({qty}) FILTER ({since(n)}), 0) AS qty_{n}d" for n in WINDOWS]
    for n in (7, 30, 90, 365):
        cols.append(f"COALESCE(SUM(amount) FILTER ({since(n)}), 0) AS rev_{n}d")
        cols.append(f"COALESCE(SUM(amount - qty * unit_cost) FILTER ({since(n)}), 0) AS gp_{n}d")
    cols += [f"COUNT(DISTINCT doc_date) FILTER ({since(n)}) AS selling_days_{n}d" for n in (30, 90)]
    return f"SELECT stock_id, {', '.join(cols)}, MIN(doc_date) AS first_sale, MAX(doc_date) AS last_sale FROM cash WHERE doc_date >= {AS_OF} - 365 GROUP BY stock_id"


def variation(qty: str) -> str:
    return f"""SELECT stock_id, COUNT(*) AS months, CASE WHEN SUM(q) > 0 THEN {sd('COUNT(*)', 'SUM(q)', 'SUM(q * q)')} / ({dbl('SUM(q)')} / COUNT(*)) END AS cv
  FROM (SELECT stock_id, CAST(SUM({qty}) AS DECIMAL(18,4)) AS q FROM cash WHERE doc_date >= {AS_OF} - 365 GROUP BY stock_id, date_trunc('month', doc_date))
  GROUP BY stock_id HAVING COUNT(*) >= 3"""


cte("rolled", rolled("base_qty"))
cte("rolled_plain", rolled("qty"))
cte("vary", variation("base_qty"))
cte("vary_plain", variation("qty"))
cte("held_base", """SELECT b.stock_id, SUM(b.balance_qty * COALESCE(m.uom_rate, 1)) AS balance FROM stock_balance b
  JOIN stock_master m ON m.stock_id = b.stock_id AND m.uom_id = b.uom_id GROUP BY b.stock_id""")
cte("held_plain", "SELECT stock_id, SUM(balance_qty) AS balance FROM stock_balance GROUP BY stock_id")
cte("order_unit", """SELECT m.stock_id, w.uom_id AS order_uom, w.uom_rate AS order_uom_rate, w.stock_name AS order_uom_desc
FROM (SELECT stock_id FROM stock_master WHERE uom_id = base_uom_id AND is_active = 'Y') m
LEFT JOIN (SELECT stock_id, arg_min(uom_id, (-n, uom_id)) AS u FROM (SELECT stock_id, uom_id, COUNT(*) AS n FROM batch_line
      WHERE doc_type = 'SUP_INVOICE' AND doc_id % 2 = 0 GROUP BY ALL) GROUP BY stock_id) po ON po.stock_id = m.stock_id
LEFT JOIN (SELECT stock_id, arg_min(uom_id, (-n, uom_id)) AS u FROM (SELECT stock_id, uom_id, COUNT(*) AS n FROM batch_line
      WHERE doc_type = 'SUP_INVOICE' GROUP BY ALL) GROUP BY stock_id) inv ON inv.stock_id = m.stock_id
LEFT JOIN (SELECT stock_id, arg_min(uom_id, (-uom_rate, uom_id)) AS u FROM stock_master WHERE is_active = 'Y' GROUP BY stock_id) big ON big.stock_id = m.stock_id
LEFT JOIN stock_master w ON w.stock_id = m.stock_id AND w.uom_id = COALESCE(po.u, inv.u, big.u)""")


def abc_of(source: str) -> str:
    share = ratio("SUM(rev_365d) OVER (ORDER BY rev_365d DESC)", "SUM(rev_365d) OVER ()")
    return f"""SELECT stock_id, CASE WHEN share <= 0.80::DOUBLE THEN 'A' WHEN share <= 0.95::DOUBLE THEN 'B' ELSE 'C' END AS abc_class
  FROM (SELECT stock_id, {share} AS share FROM {source} WHERE rev_365d > 0)"""


cte("abc365", abc_of("rolled"))
cte("abc365_plain", abc_of("rolled_plain"))


def summary(r: str, v: str, held: str, abc: str, units: bool) -> str:
    unit = ("COALESCE(u.order_uom, p.base_uom_id) AS order_uom, COALESCE(u.order_uom_desc, p.stock_name) AS order_uom_desc, COALESCE(u.order_uom_rate, 1) AS rate"
            if units else "p.base_uom_id AS order_uom, p.stock_name AS order_uom_desc, CAST(1 AS DECIMAL(18,4)) AS rate")
    z = ", ".join(f"COALESCE(r.{c}, 0) AS {c}" for c in
                  [f"qty_{n}d" for n in WINDOWS] + [f"{k}_{n}d" for n in (30, 90, 365) for k in ("rev", "gp")] + ["selling_days_30d", "selling_days_90d"])
    score = lambda x: rnd(x, 1)
    return f"""SELECT stock_id, stock_name, barcode, category, brand, ud1_code, therapeutic_group, therapeutic_group AS product_family, active_ingredient,
  {dbl('cost')} AS unit_cost, {', '.join(f"{dbl(f'qty_{n}d')} AS qty_last_{n}d" for n in WINDOWS)},
  {', '.join(f"{rnd(ratio(f'qty_{n}d', str(n)), 2)} AS avg_daily_{n}d" for n in (7, 14, 30, 90))},
  {lng('selling_days_30d')} AS selling_days_30d, {lng('selling_days_90d')} AS selling_days_90d,
  {rnd(ratio(dbl('qty_7d * 30 - qty_30d * 7') + ' * 100', 'qty_30d * 7'), 1)} AS trend_7d_vs_30d,
  CASE WHEN qty_30d = 0 AND qty_90d = 0 THEN 'DEAD' WHEN qty_7d * 30 > qty_30d * 7 * 1.5 THEN 'SPIKE_UP' WHEN qty_7d * 30 > qty_30d * 7 * 1.2 THEN 'ACCELERATING'
       WHEN qty_7d * 30 < qty_30d * 7 * 0.5 THEN 'SPIKE_DOWN' WHEN qty_7d * 30 < qty_30d * 7 * 0.8 THEN 'DECELERATING' ELSE 'STABLE' END AS trend_status,
  abc_class, xyz_class, {rnd('cv', 2)} AS cv_value, COALESCE(abc_class, '') || xyz_class AS abc_xyz_class,
  {score('0.25::DOUBLE * sp + 0.20::DOUBLE * sv + 0.20::DOUBLE * sr + 0.15::DOUBLE * ss + 0.10::DOUBLE * sc + 0.10::DOUBLE * sg')} AS health_score,
  {score('sp')} AS profitability_score, {score('sv')} AS volume_score, {score('sr')} AS revenue_score, {score('ss')} AS stability_score,
  {score('sc')} AS doi_score, {dbl('sg')} AS strategic_score,
  {', '.join(f"{rnd(f'rev_{n}d', 2)} AS revenue_last_{n}d, {rnd(f'gp_{n}d', 2)} AS gp_last_{n}d" for n in (30, 90, 365))},
  {rnd('margin', 1)} AS gp_margin_pct, base_uom_id AS base_uom, stock_name AS base_uom_desc, order_uom, order_uom_desc, {dbl('rate')} AS order_uom_rate,
  {rnd(ratio('bal', 'rate'), 0)} AS balance_in_order_uom, {dbl('bal')} AS current_balance, {rnd('bal * COALESCE(cost, 0)', 2)} AS inventory_value,
  COALESCE({rnd('cover', 0)}, 9999.0) AS days_of_inventory,
  CASE WHEN bal <= 0 THEN 'STOCKOUT' WHEN qty_30d > 0 AND bal * 30 <= qty_30d * 7 THEN 'CRITICAL' WHEN qty_30d > 0 AND bal * 30 <= qty_30d * 14 THEN 'WARNING'
       WHEN qty_30d > 0 AND bal * 30 <= qty_30d * 45 THEN 'OK' WHEN qty_30d > 0 AND bal * 30 > qty_30d * 90 THEN 'OVERSTOCKED' ELSE 'UNKNOWN' END AS stockout_risk,
  {rnd(ratio(dbl('qty_30d * 21') + ' / 30', 'rate'), 0)} AS suggested_reorder_point, {rnd(ratio('qty_30d', 'rate'), 0)} AS suggested_reorder_qty,
  last_sale AS last_sale_date, first_sale AS first_sale_date, {AS_OF} AS last_updated
FROM (SELECT *, LEAST(margin / 60 * 100, 100.0::DOUBLE) AS sp, {ratio('qty_365d', 'max_qty')} * 100 AS sv, {ratio('rev_365d', 'max_rev')} * 100 AS sr,
        LEAST((1.0::DOUBLE - COALESCE(cv, 1.0::DOUBLE)) * 100, 100.0::DOUBLE) AS ss, GREATEST(100.0::DOUBLE - cover / 90 * 100, 0.0::DOUBLE) AS sc,
        CASE WHEN ud1_code IN ('FLTHB', 'FLTF1') THEN 100 WHEN ud1_code = 'FLTMH' THEN 80 WHEN ud1_code = 'FLTF2' THEN 70 WHEN ud1_code = 'FLTF3' THEN 60 ELSE 50 END AS sg
      FROM (SELECT *, CASE WHEN rev_365d > 0 THEN {ratio('gp_365d', 'rev_365d')} * 100 ELSE 0 END AS margin, {ratio(dbl('bal') + ' * 30', 'qty_30d')} AS cover
            FROM (SELECT p.*, {z}, COALESCE(h.balance, 0) AS bal, v.cv, a.abc_class, r.first_sale, r.last_sale,
                    CASE WHEN v.cv < 0.5 THEN 'X' WHEN v.cv <= 1.0 THEN 'Y' ELSE 'Z' END AS xyz_class, {unit},
                    (SELECT COALESCE(MAX(qty_365d), 1) FROM {r}) AS max_qty, (SELECT COALESCE(MAX(rev_365d), 1) FROM {r}) AS max_rev
                  FROM product p LEFT JOIN {r} r ON r.stock_id = p.stock_id LEFT JOIN {v} v ON v.stock_id = p.stock_id
                  LEFT JOIN {held} h ON h.stock_id = p.stock_id LEFT JOIN {abc} a ON a.stock_id = p.stock_id
                  {'LEFT JOIN order_unit u ON u.stock_id = p.stock_id' if units else ''}
                  WHERE p.is_active = 'Y') q1) q2) q3"""


cte("summary_table", summary("rolled", "vary", "held_base", "abc365", True))
cte("summary_plain", summary("rolled_plain", "vary_plain", "held_plain", "abc365_plain", False))

MON = [f"qty_m{i}" for i in range(1, 13)]
cte("pivot12", f"""SELECT stock_id, {', '.join(f"MAX(CASE WHEN mon = date_trunc('month', {AS_OF}) - INTERVAL '{i} months' THEN q ELSE 0 END) AS qty_m{i + 1}" for i in range(12))}
FROM (SELECT stock_id, date_trunc('month', doc_date) AS mon, SUM(root_uom_qty_out) AS q FROM stock_ledger
      WHERE doc_type IN ('CUS_CASH_SALES', 'CUS_INVOICE') AND doc_date >= date_trunc('month', {AS_OF}) - INTERVAL '12 months' GROUP BY ALL)
GROUP BY stock_id""")
low, high = f"LEAST({', '.join(MON)})", f"GREATEST({', '.join(MON)})"
# fixed values: the business's limits
rules("season_rule", "ord, cv_over, ratio_over, season", [(1, 0.8, 5.0, "HIGHLY_SEASONAL"), (2, 0.5, None, "MODERATELY_SEASONAL"), (3, None, 2.0, "MODERATELY_SEASONAL")])
rules("velocity_rule", "least, velocity", [(300, "FAST"), (30, "MEDIUM"), (0.01, "SLOW")])
rules("cover_rule", "ord, code, class, target", [(1, "FLTHB", None, 120), (2, "FLTF1", None, 100), (3, None, "A", 60), (4, None, "B", 75)])
rules("advice_rule", "ord, velocity, class, held_upto, points, targets, advice", [
    (1, None, None, 0, None, None, "STOCKOUT"), (2, "DEAD", "C", None, None, None, "DELIST_CANDIDATE"), (3, "DEAD", None, None, None, None, "REVIEW"),
    (4, None, None, None, 1.0, None, "ORDER_NOW"), (5, None, None, None, 1.5, None, "ORDER_SOON"),
    (6, None, None, None, None, 2, "STOP_ORDERING"), (7, None, None, None, None, 1, "REDUCE_ORDER"),
])
advice = looked_up("a.advice", "advice_rule a", f"""(a.velocity IS NULL OR a.velocity = velocity_category) AND (a.class IS NULL OR a.class = abc_class)
    AND (a.held_upto IS NULL OR current_balance <= a.held_upto) AND (a.points IS NULL OR current_balance < COALESCE(reorder_point, 0) * {dbl('a.points')})
    AND (a.targets IS NULL OR days_of_inventory > target_doi * a.targets)""", "a.ord", "'HOLD'")
season = looked_up("r.season", "season_rule r", "(r.cv_over IS NULL OR cv_value > r.cv_over) AND (r.ratio_over IS NULL OR seasonal_peak_trough_ratio > r.ratio_over)", "r.ord", "'STABLE'")
velocity = looked_up("v.velocity", "velocity_rule v", "ams_3m >= v.least", "-v.least", "'DEAD'")
target = looked_up("c.target", "cover_rule c", "(c.code IS NULL OR c.code = ud1_code) AND (c.class IS NULL OR c.class = abc_class)", "c.ord", "90")
cte("monthly_table", f"""SELECT *, {advice} AS reorder_recommendation
FROM (SELECT *, CASE WHEN COALESCE(ams_3m, 0) = 0 THEN 'DEAD' ELSE {season} END AS seasonality_type, {velocity} AS velocity_category,
      CASE WHEN ams_3m > 0 THEN {rnd('(lead_time_days + 7) * ams_3m / 30', 0)} END AS reorder_point,
      CASE WHEN ams_3m > 0 THEN {rnd(ratio('qty_last_7d * 30 - ams_3m * 7', 'ams_3m * 7') + ' * 100', 1)} END AS trend_7d_vs_ams
  FROM (SELECT s.* EXCLUDE (base_uom_desc), 'PCS OF 1' AS base_uom_desc, {', '.join(f"{dbl(f'COALESCE(p.{m}, 0)')} AS {m}" for m in MON)},
          {rnd(ratio('COALESCE(p.qty_m2, 0) + COALESCE(p.qty_m3, 0) + COALESCE(p.qty_m4, 0)', '3'), 2)} AS ams_3m,
          CASE WHEN {low} > 0 THEN {rnd(ratio(high, low), 2)} END AS seasonal_peak_trough_ratio,
          IF(house, 'LONG', 'STANDARD') AS lead_time_category, {lng("IF(house, 90, 14)")} AS lead_time_days, {lng(target)} AS target_doi
        FROM (SELECT *, COALESCE(ud1_code = 'FLTHB', FALSE) AS house FROM summary_table) s LEFT JOIN pivot12 p ON p.stock_id = s.stock_id) m1) m2""")
cte("monthly_table_shown", "SELECT * EXCLUDE (house) FROM monthly_table")

VIEW = ["stock_id", "stock_name", "barcode", "ud1_code", "abc_xyz_class", "qty_last_7d", "qty_last_30d", "avg_daily_30d", "trend_status", "trend_7d_vs_30d",
        "health_score", "gp_margin_pct", "base_uom", "base_uom_desc", "order_uom", "order_uom_desc", "order_uom_rate", "balance_in_order_uom", "current_balance",
        "days_of_inventory", "stockout_risk", "suggested_reorder_qty", "reorder_point", "target_doi", "revenue_last_30d", "therapeutic_group", "ams_3m",
        "velocity_category", "lead_time_category", "lead_time_days", "seasonality_type", "seasonal_peak_trough_ratio", "reorder_recommendation", *MON]
cte("last_buy", f"""SELECT stock_id, uom_id, {dbl('unit_price')} AS last_purchase_cost, doc_date AS last_purchase_date, CAST(doc_id AS VARCHAR) AS last_purchase_doc
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY stock_id, uom_id ORDER BY doc_date DESC, doc_id DESC, unit_price DESC) AS k
      FROM supplier_invoice_line WHERE unit_price > 0) WHERE k = 1""")
cnt = lambda c: lng(f"COUNT(*) FILTER ({c})")

SQL = {
    "smr1_rolling_sales": query(f"""SELECT stock_id, {', '.join(f"{dbl(f'qty_{n}d')} AS qty_{n}d" for n in WINDOWS)},
        {', '.join(f"{dbl(f'rev_{n}d')} AS rev_{n}d, {dbl(f'gp_{n}d')} AS gp_{n}d" for n in (7, 30, 90, 365))},
        {lng('selling_days_30d')} AS selling_days_30d, {lng('selling_days_90d')} AS selling_days_90d, first_sale, last_sale FROM rolled"""),
    "smr1b_rolling_sales_plain": query(f"""SELECT stock_id, {', '.join(f"{dbl(f'qty_{n}d')} AS qty_{n}d" for n in WINDOWS)},
        {', '.join(f"{dbl(f'rev_{n}d')} AS rev_{n}d, {dbl(f'gp_{n}d')} AS gp_{n}d" for n in (7, 30, 90, 365))},
        {lng('selling_days_30d')} AS selling_days_30d, {lng('selling_days_90d')} AS selling_days_90d, first_sale, last_sale FROM rolled_plain"""),
    "smr2_sku_cv": query(f"SELECT stock_id, {rnd('cv', 6)} AS cv FROM vary"),
    "smr3_max_values": query(f"SELECT {dbl('COALESCE(MAX(qty_365d), 1)')} AS max_qty, {dbl('COALESCE(MAX(rev_365d), 1)')} AS max_rev FROM rolled"),
    "smr4_company_balance": query(f"SELECT stock_id, {dbl('balance')} AS balance FROM held_base"),
    "smr5_purchase_uom": query(f"SELECT stock_id, order_uom, {dbl('COALESCE(order_uom_rate, 1)')} AS order_uom_rate, order_uom_desc FROM order_unit"),
    "smr6_abc_class": query("SELECT stock_id, abc_class FROM abc365"),
    "smr7_movement_summary": query("SELECT * FROM summary_table"),
    "smr7_movement_summary_plain": query("SELECT * FROM summary_plain"),
    "smr8_health_score": query("""SELECT stock_id, health_score, profitability_score, volume_score, revenue_score, stability_score, doi_score, strategic_score FROM summary_table"""),
    "smr9_summary_stats": query(f"""SELECT {lng('COUNT(*)')} AS total_skus, {cnt("trend_status = 'SPIKE_UP'")} AS spike_up, {cnt("trend_status = 'SPIKE_DOWN'")} AS spike_down,
        {cnt("stockout_risk = 'CRITICAL'")} AS stockout_critical, {cnt("stockout_risk = 'WARNING'")} AS stockout_warning FROM summary_table"""),
    "view1_summary": query(f"""SELECT {', '.join(VIEW)}, CAST(NULL AS VARCHAR) AS peak_months FROM monthly_table
        ORDER BY revenue_last_30d DESC NULLS LAST, stock_id LIMIT 50"""),
    "view1_summary_filtered": query(f"""SELECT {', '.join(VIEW)}, CAST(NULL AS VARCHAR) AS peak_months FROM monthly_table
        WHERE trend_status = 'SPIKE_DOWN' AND stockout_risk = 'OVERSTOCKED' AND abc_class = 'A' ORDER BY revenue_last_30d DESC NULLS LAST, stock_id LIMIT 50"""),
    "lpc1_last_purchase": query("SELECT * FROM last_buy"),
    "lpc2_unit_cost": query(f"""SELECT s.stock_id, s.order_uom, b.last_purchase_cost, b.last_purchase_date, b.last_purchase_doc,
        COALESCE(b.last_purchase_cost, {dbl('CASE WHEN m.reference_cost > 0 THEN m.reference_cost END')}, s.unit_cost) AS unit_cost
        FROM summary_table s LEFT JOIN last_buy b ON b.stock_id = s.stock_id AND b.uom_id = s.order_uom
        LEFT JOIN stock_master m ON m.stock_id = s.stock_id AND m.uom_id = s.order_uom"""),
    "mon1_monthly_pivot": query(f"SELECT stock_id, {', '.join(f'{dbl(m)} AS {m}' for m in MON)} FROM pivot12"),
    "mon2_to_mon10_monthly_analysis": query("SELECT * FROM monthly_table_shown"),
    "mon11_monthly_stats": query(f"""SELECT {', '.join(f"{cnt(f"seasonality_type = '{v}'")} AS {v.lower()}" for v in ('HIGHLY_SEASONAL', 'MODERATELY_SEASONAL', 'STABLE', 'DEAD'))},
        {', '.join(f"{cnt(f"velocity_category = '{v}'")} AS {v.lower()}" for v in ('FAST', 'MEDIUM', 'SLOW'))},
        {', '.join(f"{cnt(f"reorder_recommendation = '{v}'")} AS {v.lower()}" for v in ('ORDER_NOW', 'ORDER_SOON', 'STOP_ORDERING'))},
        {cnt("reorder_recommendation = 'DELIST_CANDIDATE'")} AS delist_candidates,
        {cnt('trend_7d_vs_ams > 50')} AS trend_spike, {cnt('trend_7d_vs_ams > 30 AND trend_7d_vs_ams <= 50')} AS trend_rising,
        {cnt('trend_7d_vs_ams BETWEEN -30 AND 30')} AS trend_stable, {cnt('trend_7d_vs_ams < -30 AND trend_7d_vs_ams >= -50')} AS trend_declining,
        {cnt('trend_7d_vs_ams < -50')} AS trend_dropping FROM monthly_table"""),
    "src9_v_monthly_sales": query(f"""SELECT stock_id, uom_id AS stock_uom_id, CAST(date_trunc('month', doc_date) AS DATE) AS sale_month, {dbl('SUM(qty_out)')} AS total_quantity,
        {dbl('SUM(qty_out * unit_price)')} AS total_revenue, {lng('COUNT(DISTINCT location_id)')} AS outlets_sold FROM stock_ledger
        WHERE doc_type IN ('CUS_CASH_SALES', 'CUS_INVOICE') AND doc_date >= {AS_OF} - INTERVAL '24 months' GROUP BY 1, 2, 3"""),
    "src10_v_sku_intelligence": query("""SELECT stock_id, stock_name, barcode, category, brand, ud1_code, abc_class, xyz_class, abc_xyz_class, cv_value, gp_margin_pct AS margin_pct,
        CASE WHEN gp_margin_pct < 15 THEN 'LOW_MARGIN' WHEN gp_margin_pct < 30 THEN 'MEDIUM_MARGIN' WHEN gp_margin_pct < 45 THEN 'GOOD_MARGIN' ELSE 'HIGH_MARGIN' END AS margin_category,
        revenue_last_365d AS l12m_revenue, qty_last_365d AS l12m_quantity, gp_last_365d AS l12m_gross_profit, revenue_last_90d AS l3m_revenue, qty_last_90d AS l3m_quantity,
        avg_daily_30d, current_balance AS current_stock_qty, days_of_inventory AS days_of_stock, stockout_risk AS stock_status, trend_status AS sales_trend,
        trend_7d_vs_30d AS trend_pct, ams_3m, seasonality_type, velocity_category, lead_time_category, reorder_recommendation AS recommended_action,
        COALESCE(ud1_code = 'FLTHB', FALSE) AS is_house_brand, last_updated FROM monthly_table"""),
}

# stored state must give what all lines give
SQL["smr7_refreshed_by_change"] = SQL["smr7_movement_summary"]
SQL["mon1_closed_months"] = SQL["mon1_monthly_pivot"]
SQL["src9_outlets_from_sets"] = SQL["src9_v_monthly_sales"]
SQL["smr1_selling_days_from_sets"] = query(f"SELECT stock_id, {lng('selling_days_30d')} AS selling_days_30d, {lng('selling_days_90d')} AS selling_days_90d FROM rolled")
