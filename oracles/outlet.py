import oracles.summary  # noqa: F401  (its expressions come first)
from oracles.base import AS_OF, UD1, cte, dbl, lng, looked_up, query, ratio, rnd, rules

PATTERNS = "['DEAD', 'NEW', 'DISC', 'SPORADIC', 'STRONG_DECLINE', 'DECLINE', 'STABLE', 'GROWTH', 'STRONG_GROWTH']"
P = "CAST(substr(stock_id, 2) AS BIGINT)"
MON = [f"qty_m{i}" for i in range(1, 13)]
total = " + ".join(MON)
h1, h2, r3 = " + ".join(MON[:6]), " + ".join(MON[6:]), " + ".join(MON[:3])

cte("sku_summary", f"""SELECT t.*, order_uom_desc AS order_uom_stock_name, p % 20 <> 18 AS is_active, ({PATTERNS})[p % 9 + 1] AS demand_pattern,
  'V' || CAST(p % 7 + 1 AS VARCHAR) AS variability_class, (['MONSOON', 'Q4_PEAK', 'Q1_PEAK', 'SCHOOL', 'NONE'])[p % 5 + 1] AS seasonal_type_new,
  (['TRUE_SEASONAL', 'MODERATE', 'VARIABLE', 'STABLE'])[p % 4 + 1] AS seasonal_intensity, cv_value * 100 AS cv_pct, 1.0::DOUBLE + {dbl('p % 10')} / 10 AS trend_index,
  (['GAINING', 'STEADY', 'LOSING'])[p % 3 + 1] AS momentum_status, 1.0::DOUBLE AS momentum_index, ams_3m / order_uom_rate AS ams_calculated, ams_3m AS ams_base_uom,
  ams_3m / 30 AS velocity_daily, ams_3m * 3 / order_uom_rate AS max_stock, ams_3m * 2 / order_uom_rate AS order_up_to_level, 1.5::DOUBLE AS safety_multiplier,
  {lng('14')} AS safety_days, 'OK' AS ams_status, (['A', 'B', 'C'])[p % 3 + 1] AS gp_abc_class, (['NEW_ITEM', 'AMS_CHECK', NULL])[p % 3 + 1] AS review_flag,
  CASE WHEN p % 12 = 0 THEN {AS_OF} END AS reviewed_at, CASE WHEN p % 12 = 0 THEN 'U1' END AS reviewed_by, {lng('p % 12')} AS active_months,
  CASE WHEN p % 11 <> 5 THEN 'S' || CAST(p % 10 AS VARCHAR) END AS po_supplier_id, CASE WHEN p % 5 = 0 THEN 'UNKNOWN' ELSE 'PO_HISTORY' END AS po_supplier_source,
  CASE WHEN p % 7 = 0 THEN '' ELSE barcode END AS po_barcode, CASE WHEN p % 7 = 0 THEN 'NONE' ELSE 'MASTER' END AS po_barcode_source,
  CASE WHEN p % 3 <> 0 THEN unit_cost * order_uom_rate END AS po_unit_price, (['NONE', 'INVOICE_UOM', 'INVOICE_ANY'])[p % 3 + 1] AS po_price_source,
  brand AS brand_description, {AS_OF} AS po_data_updated_at, CASE WHEN p % 6 = 0 THEN {AS_OF} - CAST(p % 40 AS INTEGER) END AS po_last_generated_at
FROM (SELECT *, {P} AS p FROM monthly_table) t""")

cte("outlet_sku", f"""SELECT *, CASE WHEN current_balance <= 0 THEN 'STOCKOUT' WHEN total_12m <= 0 THEN 'REVIEW' WHEN current_balance < outlet_ams * 0.7 THEN 'ORDER_NOW'
    WHEN current_balance < outlet_ams * 1.05 THEN 'ORDER_SOON' WHEN days_of_inventory > 180 THEN 'STOP_ORDERING' WHEN days_of_inventory > 90 THEN 'REDUCE_ORDER' ELSE 'OPTIMAL' END AS reorder_recommendation,
  CASE WHEN total_12m <= 0 THEN 'DEAD' WHEN h2 = 0 THEN 'NEW' WHEN h1 > 3 * h2 THEN 'STRONG_GROWTH' WHEN h1 > 1.2 * h2 THEN 'GROWTH'
       WHEN 3 * h1 < h2 THEN 'STRONG_DECLINE' WHEN 1.2 * h1 < h2 THEN 'DECLINE' ELSE 'STABLE' END AS outlet_demand_pattern,
  CASE WHEN 2 * r3 > h1 THEN 'GAINING' WHEN 2 * r3 < h1 THEN 'LOSING' ELSE 'STEADY' END AS outlet_momentum_status,
  CASE WHEN outlet_ams >= 5 THEN 'A' WHEN outlet_ams >= 2 THEN 'B' ELSE 'C' END AS outlet_abc_class,
  CAST(CASE WHEN h2 = 0 THEN 1 ELSE LEAST(2, GREATEST(0.5, {ratio('h1', 'h2')})) END AS DECIMAL(18,4)) AS outlet_trend_index,
  CAST(CASE WHEN p % 3 = 0 THEN 12 ELSE 1 END AS DECIMAL(18,4)) AS order_uom_rate, 'V' || CAST(p % 7 + 1 AS VARCHAR) AS outlet_variability_class,
  CASE WHEN p % 3 = 0 THEN 'BOX' ELSE 'PCS' END AS order_uom, {UD1.format(p='p')} AS ud1_code, ({PATTERNS})[p % 9 + 1] AS demand_pattern,
  (['A', 'B', 'C'])[p % 3 + 1] AS abc_class, (['A', 'B', 'C'])[p % 3 + 1] AS gp_abc_class, p % 20 <> 19 AS is_active, CAST((p % 10) * 0.15 AS DECIMAL(18,4)) AS outlet_cv,
  CAST(outlet_ams * 0.7 AS DECIMAL(18,4)) AS reorder_point, outlet_ams * 3 AS max_stock, outlet_ams * 2 AS order_up_to_level, CAST(outlet_ams / 30 AS DECIMAL(18,4)) AS velocity_daily
FROM (SELECT m.*, w.name AS location_name, pr.stock_name, m.p, CAST({dbl('total_12m')} / 12 AS DECIMAL(18,4)) AS outlet_ams,
        CAST(CASE WHEN total_12m > 0 THEN {dbl('current_balance')} * 360 / {dbl('total_12m')} ELSE 9999 END AS DECIMAL(18,4)) AS days_of_inventory
      FROM (SELECT *, {total} AS total_12m, {h1} AS h1, {h2} AS h2, {r3} AS r3, {P} AS p FROM (
              SELECT COALESCE(s.location_id, b.location_id) AS location_id, COALESCE(s.stock_id, b.stock_id) AS stock_id,
                COALESCE(b.balance_qty, 0) AS current_balance, {', '.join(f'COALESCE(s.{m}, 0) AS {m}' for m in MON)}
              FROM (SELECT location_id, stock_id, {', '.join(f"CAST(COALESCE(SUM(base_qty) FILTER (date_trunc('month', doc_date) = date_trunc('month', {AS_OF}) - INTERVAL '{i} months'), 0) AS DECIMAL(18,4)) AS qty_m{i + 1}" for i in range(12))}
                    FROM costed WHERE doc_date >= date_trunc('month', {AS_OF}) - INTERVAL '11 months' GROUP BY 1, 2) s
              FULL JOIN stock_balance b ON b.stock_id = s.stock_id AND b.location_id = s.location_id)) m
      LEFT JOIN location w ON w.location_id = m.location_id LEFT JOIN product pr ON pr.stock_id = m.stock_id) x""")

SHOWN = "CASE {c} WHEN 'DELIST_CANDIDATE' THEN 'DELIST' WHEN 'STOP_ORDERING' THEN 'OVERSTOCKED' WHEN 'REDUCE_ORDER' THEN 'REDUCE' WHEN 'REVIEW' THEN 'UNCERTAIN' WHEN 'UNKNOWN' THEN 'UNCERTAIN' ELSE {c} END"
show = lambda c: SHOWN.format(c=c)
SKU = f"""SELECT stock_id, stock_name, order_uom_stock_name, barcode, ud1_code, is_active, {', '.join(f"{rnd(ratio(m, 'order_uom_rate'), 1)} AS {m}" for m in MON[:4])},
  demand_pattern, variability_class, seasonal_type_new, seasonal_intensity, cv_pct, trend_index, momentum_status, momentum_index, ams_calculated, ams_base_uom, velocity_daily,
  ams_calculated AS ams_order_uom, current_balance, {rnd(ratio('current_balance', 'order_uom_rate'), 0)} AS balance_in_order_uom, days_of_inventory, reorder_point, max_stock, safety_multiplier,
  safety_days, order_up_to_level, ams_status, abc_class, gp_abc_class, {show('reorder_recommendation')} AS reorder_recommendation, CAST(NULL AS VARCHAR) AS ams_action, order_uom, order_uom_desc,
  order_uom_rate, base_uom, base_uom_desc, last_updated, CAST(NULL AS VARCHAR) AS peak_months, review_flag, CAST(NULL AS VARCHAR) AS review_reason, CAST(NULL AS INTEGER) AS review_priority,
  reviewed_at, reviewed_by, active_months, po_last_generated_at FROM sku_summary"""
SKU_ORDER = """ORDER BY COALESCE(list_position(['STRONG_GROWTH', 'GROWTH', 'STABLE', 'NEW', 'DECLINE', 'STRONG_DECLINE', 'SPORADIC', 'DISC', 'DEAD'], demand_pattern), 10), current_balance DESC NULLS LAST, stock_id"""
OPEN = "review_flag IN ('NEW_ITEM', 'AMS_CHECK') AND reviewed_at IS NULL"
LIST = f"""stock_id, stock_name, stock_name AS order_uom_stock_name, location_id, location_name, 'PCS' AS base_uom, order_uom, {dbl('order_uom_rate')} AS order_uom_rate, ud1_code,
  {', '.join(f"{rnd(ratio(m, 'order_uom_rate'), 1)} AS {m}" for m in MON)}, {rnd(ratio('total_12m', 'order_uom_rate'), 1)} AS total_12m, {rnd('outlet_ams', 2)} AS ams_12m,
  CAST(NULL AS DOUBLE) AS pct_of_total, {rnd('outlet_ams', 2)} AS ams_calculated, {dbl('velocity_daily')} AS velocity_daily, {lng('14')} AS safety_days,
  {rnd(ratio('reorder_point', 'order_uom_rate'), 1)} AS reorder_point, {rnd(ratio('max_stock', 'order_uom_rate'), 1)} AS max_stock, {dbl('outlet_cv')} AS outlet_cv, outlet_variability_class,
  {lng('7')} AS outlet_safety_days, {rnd(ratio('order_up_to_level', 'order_uom_rate'), 1)} AS order_up_to_level,
  GREATEST(0.0::DOUBLE, {rnd(ratio('order_up_to_level - current_balance', 'order_uom_rate'), 1)}) AS reorder_qty, {dbl('current_balance')} AS current_balance,
  {rnd(ratio('current_balance', 'order_uom_rate'), 0)} AS balance_in_order_uom, {dbl('days_of_inventory')} AS days_of_inventory, {show('reorder_recommendation')} AS reorder_recommendation,
  demand_pattern, outlet_variability_class AS variability_class, outlet_variability_class AS outlet_var_class, abc_class, {dbl('outlet_trend_index')} AS outlet_trend_index, outlet_demand_pattern, outlet_abc_class, gp_abc_class, is_active"""
BEST = "ORDER BY o.outlet_ams DESC NULLS LAST, o.current_balance DESC NULLS LAST, o.stock_id"
RECS = ["STOCKOUT", "ORDER_NOW", "ORDER_SOON", "OPTIMAL", "REDUCE", "OVERSTOCKED", "DELIST", "UNCERTAIN"]
PSEUDO = "('WAREHOUSE', 'QUARANTINE', 'RETURN', 'S-ISCS')"

# fixed values: points of a suggestion by the lowest measure that earns them, and by the demand pattern (with a gaining momentum)
rules("step_points", "measure, least, points", [
    ("outlets", 10, 25), ("outlets", 7, 22), ("outlets", 5, 20), ("outlets", 4, 17), ("outlets", 3, 14), ("outlets", 0, 10),
    ("demand", 50, 25), ("demand", 20, 20), ("demand", 10, 15), ("demand", 5, 10), ("demand", 1, 5), ("demand", 0, 2),
])
rules("pattern_points", "pattern, points, gaining", [
    ("EXTREME_GROWTH", 18, 20), ("STRONG_GROWTH", 18, 20), ("MODERATE_GROWTH", 14, 16), ("GROWTH", 14, 16), ("STABLE", 10, 10),
    ("STABLE_DECLINE", 5, 5), ("DECLINE", 5, 5), ("STRONG_DECLINE", 2, 2), ("EXTREME_DECLINE", 2, 2),
])
rules("gap_points", "share, points", [(0.5, 15), (0.75, 10), (1.0, 5)])
STEP = "(SELECT MAX(k.points) FROM step_points k WHERE k.measure = '{}' AND {} >= k.least)"
mode_of = lambda c: f"(SELECT stock_id, arg_min({c}, (-n, {c})) AS v FROM (SELECT stock_id, {c}, COUNT(*) AS n FROM sel WHERE {c} IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"
SUG = f"""WITH sel AS (SELECT * FROM outlet_sku WHERE location_id <> 'L23' AND location_id NOT IN {PSEUDO} AND outlet_ams >= 3),
  reg AS (SELECT stock_id, COUNT(DISTINCT location_id) AS n, string_agg(location_id, ',' ORDER BY location_id) AS outlets, {dbl('SUM(outlet_ams)')} / COUNT(*) AS av, MAX(outlet_ams) AS mx, SUM(total_12m) AS tt,
            {dbl('SUM(outlet_trend_index)')} / COUNT(*) AS tr FROM sel GROUP BY 1 HAVING COUNT(DISTINCT location_id) >= 2),
  pats AS {mode_of('outlet_demand_pattern')}, moms AS {mode_of('outlet_momentum_status')},
  cov AS (SELECT ud1_code, SUM(n) FILTER (location_id = 'L23') AS mine, {dbl('SUM(n)')} / COUNT(*) AS usual FROM (SELECT o.location_id, s.ud1_code, COUNT(*) AS n FROM outlet_sku o
            JOIN sku_summary s ON s.stock_id = o.stock_id WHERE o.outlet_ams > 0 GROUP BY 1, 2) GROUP BY 1),
  sc AS (SELECT r.*, s.stock_name, s.ud1_code, s.order_uom, s.order_uom_rate, s.abc_class AS company_abc, s.gp_abc_class, s.demand_pattern AS company_pattern, a.v AS pat, b.v AS mom,
      CAST(ROUND(CAST(r.av AS DECIMAL(38,10)), 2) AS DECIMAL(18,2)) AS m2,
      {STEP.format('outlets', 'r.n')} AS p1, {STEP.format('demand', 'r.av')} AS p2, CASE s.gp_abc_class WHEN 'A' THEN 15 WHEN 'B' THEN 10 ELSE 5 END AS p4,
      COALESCE(IF(b.v IN ('ACCELERATING', 'GAINING'), g.gaining, g.points), 8) AS p3,
      {looked_up('k.points', 'gap_points k', 'COALESCE(mine, 0) < COALESCE(usual, 0) * k.share', 'k.share', '0')} AS p5
    FROM reg r JOIN sku_summary s ON s.stock_id = r.stock_id LEFT JOIN pats a ON a.stock_id = r.stock_id LEFT JOIN moms b ON b.stock_id = r.stock_id LEFT JOIN cov c ON c.ud1_code = s.ud1_code LEFT JOIN pattern_points g ON g.pattern = a.v
    WHERE s.is_active AND r.av >= 3 AND r.stock_id NOT IN (SELECT stock_id FROM outlet_sku WHERE location_id = 'L23' AND outlet_ams >= 1)),
  sug AS (SELECT stock_id, stock_name, ud1_code, order_uom, company_abc, gp_abc_class, company_pattern, {lng('p1 + p2 + p3 + p4 + p5')} AS confidence_score, {lng('p1')} AS regional_success_score,
      {lng('p2')} AS demand_strength_score, {lng('p3')} AS growth_trajectory_score, {lng('p4')} AS profitability_score, {lng('p5')} AS category_gap_score, {lng('n')} AS selling_outlet_count, outlets AS selling_outlets,
      {dbl('m2')} AS avg_regional_ams, {rnd('mx', 2)} AS max_regional_ams, {rnd('tt', 0)} AS total_regional_sales, pat AS dominant_pattern, mom AS dominant_momentum, {rnd('tr', 3)} AS avg_trend_index,
      {rnd('m2 * 0.7', 1)} AS predicted_monthly_sales, {lng(f"CEIL({ratio('m2 * 0.7', 'order_uom_rate')})")} AS suggested_initial_qty,
      'Selling in ' || CAST(n AS VARCHAR) || ' outlets (avg ' || CAST(CAST(ROUND(m2, 1) AS DECIMAL(18,1)) AS VARCHAR) || '/month)' ||
        CASE WHEN pat IN ('EXTREME_GROWTH', 'STRONG_GROWTH', 'GROWTH') THEN ' • Growing demand' WHEN pat = 'STABLE' THEN ' • Stable demand' ELSE '' END ||
        CASE WHEN gp_abc_class = 'A' THEN ' • High margin' ELSE '' END || CASE WHEN p5 >= 10 THEN ' • Fills category gap' ELSE '' END AS why_suggested
    FROM sc WHERE p1 + p2 + p3 + p4 + p5 >= 50)"""

# --- rotation ---------------------------------------------------------------
# fixed values: months of sales kept, and days of cover above which a position gives (of the house brand: last column)
rules("keep_rule", "tier, cat, months_kept, doi_most, doi_house", [
    ("FAST", "DECLINING", 0.5, 15, 120), ("FAST", "STABLE", 0.5, 45, 120), ("FAST", "GROWING", 1.0, 75, 120), ("FAST", "SPORADIC", 4.0, 210, 210),
    ("MEDIUM", "DECLINING", 0.5, 45, 135), ("MEDIUM", "STABLE", 1.0, 75, 135), ("MEDIUM", "GROWING", 1.5, 105, 135), ("MEDIUM", "SPORADIC", 4.0, 210, 210),
    ("SLOW", "DECLINING", 1.5, 90, 180), ("SLOW", "STABLE", 2.0, 120, 180), ("SLOW", "GROWING", 2.5, 150, 180), ("SLOW", "SPORADIC", 4.0, 210, 210),
    ("VERY_SLOW", "DECLINING", 2.5, 150, 240), ("VERY_SLOW", "STABLE", 3.0, 180, 240), ("VERY_SLOW", "GROWING", 3.5, 210, 240), ("VERY_SLOW", "SPORADIC", 4.0, 210, 210),
])
rules("trend_rule", "pattern, cat", [
    ("EXTREME_DECLINE", "DECLINING"), ("STRONG_DECLINE", "DECLINING"), ("DECLINE", "DECLINING"), ("SPORADIC", "SPORADIC"), ("EXTREME_GROWTH", "GROWING"),
    ("STRONG_GROWTH", "GROWING"), ("MODERATE_GROWTH", "GROWING"), ("GROWTH", "GROWING"), ("EMERGING_GROWTH", "GROWING"),
])
rules("tier_rule", "least, tier", [(50, "FAST"), (10, "MEDIUM"), (1, "SLOW")])
cte("rot_pos", f"""SELECT o.stock_id, o.location_id, o.location_name, NULLIF(regexp_extract(o.location_name, '^R[0-9]+'), '') AS region, o.current_balance AS bal, o.outlet_ams AS ams, o.days_of_inventory AS doi,
    o.reorder_recommendation AS rec, o.order_uom_rate AS rate, s.order_uom_stock_name AS s_name, s.order_uom AS s_uom, s.ud1_code AS s_ud1, COALESCE(s.demand_pattern, 'STABLE') AS pat,
    {looked_up('t.tier', 'tier_rule t', f"{ratio('o.outlet_ams', 'o.order_uom_rate')} >= t.least", '-t.least', "'VERY_SLOW'")} AS tier,
    COALESCE(r.cat, 'STABLE') AS cat, COALESCE(s.ud1_code = 'FLTHB', FALSE) AS hb
  FROM outlet_sku o LEFT JOIN sku_summary s ON s.stock_id = o.stock_id LEFT JOIN trend_rule r ON r.pattern = s.demand_pattern WHERE o.outlet_ams > 0""")
cte("rot_have", """SELECT *, bal - keep AS exc FROM (SELECT p.*, IF(hb, r.doi_house, r.doi_most) AS doi_max, ams * r.months_kept AS keep
    FROM rot_pos p JOIN keep_rule r ON r.tier = p.tier AND r.cat = p.cat WHERE bal > 0)
  WHERE doi > doi_max AND (bal - keep > keep OR (tier = 'VERY_SLOW' AND bal - keep > 5)) AND bal - keep > 0""")
cte("rot_want", "SELECT *, ams * 2 - bal AS want FROM rot_pos WHERE rec IN ('STOCKOUT', 'ORDER_NOW', 'ORDER_SOON') AND ams * 2 - bal > 0")


def rot(out: bool) -> str:
    me, other = ("h", "w") if out else ("w", "h")
    order = "w.doi, w.want DESC, w.location_id" if out else "h.exc DESC, h.doi DESC, h.location_id"
    whole = lambda x: rnd(ratio(x, "rate"), 0)
    label = "me_ud1" if out else "COALESCE(me_ud1, '')"
    return f"""SELECT '{'OUT' if out else 'IN'}' AS direction, stock_id, s_name AS stock_name, s_uom AS order_uom, {label} AS ud1_code, pat AS demand_pattern, tier AS velocity_tier, cat AS pattern_category,
      {lng('doi_max')} AS doi_threshold, f AS from_outlet, fn AS from_outlet_name, t AS to_outlet, tn AS to_outlet_name, {rnd('fdoi', 0)} AS from_doi, {rnd('tdoi', 0)} AS to_doi,
      {whole('fbal')} AS from_balance_order_uom, {whole('tbal')} AS to_balance_order_uom, {whole('LEAST(exc, want)')} AS transfer_qty, {whole('exc')} AS excess_qty_order_uom,
      {whole('want')} AS need_qty_order_uom, CASE WHEN same THEN 'SAME_REGION' ELSE 'OTHER_REGION' END AS transfer_reason
    FROM (SELECT h.stock_id, {me}.s_name, {me}.s_uom, {me}.s_ud1 AS me_ud1, h.pat, h.tier, h.cat, h.doi_max, h.location_id AS f, h.location_name AS fn, w.location_id AS t, w.location_name AS tn, h.doi AS fdoi, w.doi AS tdoi,
            h.bal AS fbal, w.bal AS tbal, h.exc, w.want, {me}.rate, COALESCE(h.region = w.region, FALSE) AS same,
            ROW_NUMBER() OVER (PARTITION BY {me}.location_id, h.stock_id ORDER BY CASE WHEN h.region = w.region THEN 0 ELSE 1 END, {order}) AS k
          FROM rot_have h JOIN rot_want w ON w.stock_id = h.stock_id AND w.location_id <> h.location_id WHERE {other}.location_id NOT IN {PSEUDO}) z WHERE k = 1"""


# --- rebalancing ------------------------------------------------------------
# fixed values: days of cover below which a stock is short, by house brand or not
rules("short_rule", "house, below, tier, weight", [
    (True, 30, "CRITICAL", 3.0), (True, 60, "URGENT", 2.0), (True, 90, "MODERATE", 1.5), (False, 14, "CRITICAL", 3.0), (False, 30, "URGENT", 2.0), (False, 45, "MODERATE", 1.5),
])
rules("class_weight", "class, weight", [("A", 3), ("B", 2), ("C", 1)])
cte("rb_short", f"""SELECT x.stock_id, x.ud1_code, x.abc_class, {dbl('total_balance')} AS total_balance, {dbl('total_ams')} AS total_ams, company_doi, {lng('outlet_count')} AS outlet_count,
    {lng("IF(x.house, 60, 30)")} AS doi_threshold, u.tier AS urgency_tier, {dbl('COALESCE(w.weight, 1) * u.weight')} AS priority_score
  FROM (SELECT *, ud1_code = 'FLTHB' AS house
        FROM (SELECT o.stock_id, COALESCE(ANY_VALUE(s.ud1_code), 'OTHER') AS ud1_code, COALESCE(ANY_VALUE(s.abc_class), 'C') AS abc_class, SUM(o.current_balance) AS total_balance, SUM(o.outlet_ams) AS total_ams,
                {ratio(dbl('SUM(o.current_balance)') + ' * 30', 'SUM(o.outlet_ams)')} AS company_doi, COUNT(DISTINCT o.location_id) AS outlet_count
              FROM outlet_sku o LEFT JOIN sku_summary s ON s.stock_id = o.stock_id WHERE o.current_balance > 0 OR o.outlet_ams > 0 GROUP BY o.stock_id HAVING SUM(o.outlet_ams) > 0))
  x ASOF JOIN short_rule u ON u.house = x.house AND x.company_doi < u.below LEFT JOIN class_weight w ON w.class = x.abc_class WHERE outlet_count >= 2""")
cte("rb_share", f"""SELECT *, CASE WHEN dev > 0 AND doi > company_doi + 7 THEN 'DONOR' WHEN dev < 0 AND doi < company_doi - 7 THEN 'RECIPIENT' ELSE 'BALANCED' END AS cls,
    CASE WHEN dev > 0 AND doi > company_doi + 7 THEN dev * 0.8 ELSE 0 END AS give, CASE WHEN dev < 0 AND doi < company_doi - 7 THEN ABS(dev) ELSE 0 END AS want
  FROM (SELECT *, {dbl('bal')} - fair AS dev FROM (SELECT o.stock_id, o.location_id, o.location_name, o.current_balance AS bal, {dbl('o.days_of_inventory')} AS doi, o.order_uom_rate AS rate,
          c.* EXCLUDE (stock_id), {ratio('o.outlet_ams', 'c.total_ams')} * c.total_balance AS fair FROM outlet_sku o JOIN rb_short c ON c.stock_id = o.stock_id WHERE o.outlet_ams > 0))""")
w0 = lambda x: rnd(ratio(x, "m.rate"), 0)
RB = f"""SELECT m.direction, m.stock_id, s.order_uom_stock_name AS stock_name, s.order_uom, m.ud1_code, s.demand_pattern, m.abc_class, m.urgency_tier, m.priority_score, m.f AS from_outlet, m.fn AS from_outlet_name,
    m.t AS to_outlet, m.tn AS to_outlet_name, {rnd('m.fdoi', 0)} AS from_doi, {rnd('m.tdoi', 0)} AS to_doi, {rnd('m.company_doi', 0)} AS avg_doi, {rnd('m.company_doi', 0)} AS company_doi,
    {w0('m.fbal')} AS from_balance_order_uom, {w0('m.tbal')} AS to_balance_order_uom, {w0('m.ffair')} AS from_fair_share, {w0('m.tfair')} AS to_fair_share,
    {w0('LEAST(m.give, m.want)')} AS transfer_qty, 'REBALANCE' AS transfer_reason
  FROM (SELECT CASE WHEN d.location_id = 'L05' THEN 'DONATE' ELSE 'RECEIVE' END AS direction, d.stock_id, d.ud1_code, d.abc_class, d.urgency_tier, d.priority_score, d.company_doi, d.rate, d.location_id AS f, d.location_name AS fn,
          d.doi AS fdoi, d.bal AS fbal, d.fair AS ffair, d.give, r.location_id AS t, r.location_name AS tn, r.doi AS tdoi, r.bal AS tbal, r.fair AS tfair, r.want
        FROM rb_share d JOIN rb_share r ON r.stock_id = d.stock_id AND r.location_id <> d.location_id
        WHERE d.cls = 'DONOR' AND d.give > 0 AND r.cls = 'RECIPIENT' AND r.want > 0 AND (d.location_id = 'L05' OR r.location_id = 'L05')) m
  LEFT JOIN sku_summary s ON s.stock_id = m.stock_id"""

cte("staff", f"""SELECT 'U' || CAST(s_suppkey AS VARCHAR) AS staff_id, CASE s_suppkey % 6 WHEN 0 THEN 'admin' WHEN 2 THEN 'area_manager' ELSE 'staff' END AS role,
    (['ADMINISTRATORS', 'PURCHASER', 'AREA MANAGER', 'PIC OUTLET', 'CASHIER', NULL])[s_suppkey % 6 + 1] AS pos_user_group, s_suppkey % 10 <> 9 AS is_active,
    w.location_id AS primary_outlet, w.name AS primary_outlet_name, 'R' || CAST(n_regionkey AS VARCHAR) AS region, n_regionkey
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN location w ON w.n_nationkey = s_nationkey""")
cte("region_outlet", "SELECT n.n_regionkey, w.location_id, w.name FROM nation n JOIN location w ON w.n_nationkey = n.n_nationkey")
ACCESS = "CASE WHEN pos_user_group IN ('ADMINISTRATORS', 'COO', 'CMO', 'CEO', 'PURCHASER', 'WAREHOUSE MANAGER', 'ONLINE EXECUTIVE') THEN 'FULL' WHEN pos_user_group = 'AREA MANAGER' THEN 'REGION' WHEN pos_user_group = 'PIC OUTLET' THEN 'OUTLET' ELSE 'NONE' END"

# --- purchasing -------------------------------------------------------------
cte("po_line", f"""SELECT *, order_qty * COALESCE(po_unit_price, 0) AS raw_total, COALESCE(po_price_source, 'NONE') = 'NONE' AS w1, COALESCE(po_price_source = 'INVOICE_ANY', FALSE) AS w2, COALESCE(po_barcode, '') = '' AS w3,
    COALESCE(po_supplier_source, 'UNKNOWN') = 'UNKNOWN' AS w4
  FROM (SELECT *, {lng('CEIL(CAST(order_up_to_level - held AS DECIMAL(38,10)))')} AS order_qty FROM (SELECT *, {rnd(ratio('current_balance', 'order_uom_rate'), 1)} AS held FROM sku_summary
        WHERE reorder_recommendation IN ('ORDER_NOW', 'ORDER_SOON', 'STOCKOUT', 'OPTIMAL') AND is_active AND order_up_to_level > 0 AND order_uom_rate > 0)) WHERE order_qty > 0""")
SUPP = f"""SELECT COALESCE(po_supplier_id, 'UNKNOWN') AS supplier_id, {lng('COUNT(*)')} AS item_count, {dbl(f"SUM(CAST({rnd('raw_total', 2)} AS DECIMAL(28,2)))")} AS total_value, {lng('SUM(order_qty)')} AS total_qty,
    {lng('COUNT(*) FILTER (w1 OR w2 OR w3 OR w4)')} AS warning_count, MAX(po_last_generated_at) AS last_po_generated_at FROM po_line GROUP BY 1"""
LOG = lambda d: f"""SELECT supplier_id || '-' || strftime({d}, '%Y%m%d') AS po_id, supplier_id, {d} AS generated_at, 'U1' AS generated_by, item_count, total_value, total_qty, 'WAREHOUSE' AS location_id FROM ({SUPP})"""

# --- expiry -----------------------------------------------------------------
TODAY = "DATE '2021-08-01'"
VALID = "regexp_matches(batch_remark, '^20[2-9][0-9]-[01][0-9]-[0-3][0-9]')"
PARSED = "TRY_CAST(CASE WHEN e LIKE '%-00' THEN substr(e, 1, 8) || '28' ELSE e END AS DATE)"
cte("wh_batch", f"""SELECT 'WAREHOUSE' AS location_id, b.stock_id, b.e, b.q, p.stock_name, p.barcode, COALESCE(p.cost, 0) AS cost, {PARSED} AS exp_date
  FROM (SELECT stock_id, substr(batch_remark, 1, 10) AS e, SUM(CASE WHEN doc_type IN ('SUP_INVOICE', 'RECEIVE') THEN qty ELSE -qty END) AS q FROM batch_line
        WHERE {VALID} AND doc_type <> 'TRANSFER' GROUP BY 1, 2) b LEFT JOIN product p ON p.stock_id = b.stock_id WHERE b.q > 0""")
cte("out_batch", f"""SELECT b.location_id, b.stock_id, b.e, b.q, p.stock_name, p.barcode, COALESCE(p.cost, 0) AS cost, {PARSED} AS exp_date
  FROM (SELECT stock_id, location_id, substr(batch_remark, 1, 10) AS e, SUM(qty) AS q FROM batch_line WHERE {VALID} AND doc_type = 'TRANSFER' GROUP BY 1, 2, 3) b
  LEFT JOIN product p ON p.stock_id = b.stock_id WHERE b.q > 0""")
cte("batch_units", f"""SELECT location_id, stock_id, substr(batch_remark, 1, 10) AS expiry_str, doc_date, IF(doc_type IN ('TRANSIT', 'SUP_CREDIT'), -qty, qty) AS q
  FROM batch_line WHERE {VALID} AND (doc_type = 'TRANSFER') = (location_id <> 'WAREHOUSE')""")
cte("batch_lot", f"""SELECT *, SUM(i) OVER w AS i_end, SUM(o) OVER w AS o_end, SUM(i) OVER b AS i_all, SUM(o) OVER b AS o_all
  FROM (SELECT location_id, stock_id, expiry_str, doc_date, SUM(GREATEST(q, 0)) AS i, SUM(GREATEST(-q, 0)) AS o FROM batch_units WHERE doc_date <= {AS_OF} GROUP BY ALL)
  WINDOW b AS (PARTITION BY location_id, stock_id, expiry_str), w AS (PARTITION BY location_id, stock_id, expiry_str ORDER BY doc_date)""")
cte("lot_left", """SELECT location_id, stock_id, expiry_str, doc_date AS received_on, LEAST(i, i_end - o_all) AS units FROM batch_lot WHERE LEAST(i, i_end - o_all) > 0""")
cte("lot_drawn", f"""SELECT a.location_id, a.stock_id, a.expiry_str, a.doc_date AS received_on, b.doc_date AS sent_on, LEAST(a.i_end, b.o_end) - GREATEST(a.i_end - a.i, b.o_end - b.o) AS units
  FROM batch_lot a JOIN batch_lot b ON b.location_id = a.location_id AND b.stock_id = a.stock_id AND b.expiry_str = a.expiry_str
  WHERE LEAST(a.i_end, b.o_end) > GREATEST(a.i_end - a.i, b.o_end - b.o)""")
cte("batches", f"""SELECT *, exp_date - {TODAY} AS days FROM (SELECT * FROM wh_batch UNION ALL SELECT * FROM out_batch)""")
WIN = "CASE WHEN days < 0 THEN 'expired' WHEN days <= 30 THEN '0_30_days' WHEN days <= 60 THEN '31_60_days' WHEN days <= 90 THEN '61_90_days' WHEN days <= 180 THEN '91_180_days' ELSE 'over_180_days' END"


def scope(n, c):
    return (f"{lng(f'COUNT(w) FILTER ({c})')} AS {n}_batches, {lng(f'COALESCE(SUM(CAST(q AS BIGINT)) FILTER ({c}), 0)')} AS {n}_units, {rnd(f'COALESCE(SUM(q * cost) FILTER ({c}), 0)', 2)} AS {n}_value")


WINDOWS = f"""SELECT k.name AS expiry_window, {scope('warehouse', "location_id = 'WAREHOUSE'")}, {scope('outlet', "location_id <> 'WAREHOUSE'")}, {scope('total', 'w IS NOT NULL')}
  FROM (VALUES ('expired'), ('0_30_days'), ('31_60_days'), ('61_90_days'), ('91_180_days'), ('over_180_days')) k(name)
  LEFT JOIN (SELECT *, {WIN} AS w FROM batches WHERE days IS NOT NULL) b ON b.w = k.name GROUP BY 1"""


def bands(n, c):
    return f"{lng(f'COUNT(*) FILTER ({c})')} AS {n}_batches, {lng(f'COALESCE(SUM(u) FILTER ({c}), 0)')} AS {n}_units, {rnd(f'COALESCE(SUM(u * cost) FILTER ({c}), 0)', 2)} AS {n}_value"


ITEMS = f"""SELECT b.location_id, CASE WHEN b.location_id = 'WAREHOUSE' THEN 'WAREHOUSE' ELSE l.name END AS location_name, b.stock_id, b.stock_name, b.barcode, b.e AS expiry_date, {lng('b.q')} AS quantity,
    {dbl('b.cost')} AS unit_cost, {rnd('b.q * b.cost', 2)} AS total_value, {lng('b.days')} AS days_until_expiry FROM batches b LEFT JOIN location l ON l.location_id = b.location_id WHERE"""

JOINED = f"""SELECT o.stock_id, COALESCE(s.order_uom_stock_name, o.stock_name) AS stock_name, s.order_uom_stock_name, o.location_id, o.location_name, 'PCS' AS base_uom, COALESCE(s.order_uom, o.order_uom) AS order_uom,
        {dbl('COALESCE(s.order_uom_rate, o.order_uom_rate)')} AS order_uom_rate, COALESCE(s.ud1_code, o.ud1_code) AS ud1_code, {', '.join(f"{rnd(ratio(f'o.{m}', 'COALESCE(s.order_uom_rate, 1)'), 1)} AS {m}" for m in MON)},
        {rnd(ratio('o.total_12m', 'COALESCE(s.order_uom_rate, 1)'), 1)} AS total_12m, {rnd('o.outlet_ams', 2)} AS ams_12m, CAST(NULL AS DOUBLE) AS pct_of_total, {rnd('o.outlet_ams', 2)} AS ams_calculated, {dbl('o.velocity_daily')} AS velocity_daily, {lng('14')} AS safety_days, {rnd(ratio('o.reorder_point', 'COALESCE(s.order_uom_rate, 1)'), 1)} AS reorder_point, {rnd(ratio('o.max_stock', 'COALESCE(s.order_uom_rate, 1)'), 1)} AS max_stock, {dbl('o.outlet_cv')} AS outlet_cv,
        o.outlet_variability_class, o.outlet_variability_class AS outlet_var_class, {lng('7')} AS outlet_safety_days, {dbl('o.days_of_inventory')} AS days_of_inventory, s.trend_index, {AS_OF} AS last_updated,
        {rnd(ratio('o.order_up_to_level', 'COALESCE(s.order_uom_rate, 1)'), 1)} AS order_up_to_level,
        GREATEST(0.0::DOUBLE, {rnd(ratio('o.order_up_to_level - o.current_balance', 'COALESCE(s.order_uom_rate, 1)'), 1)}) AS reorder_qty, {dbl('o.current_balance')} AS current_balance,
        {rnd(ratio('o.current_balance', 'COALESCE(s.order_uom_rate, 1)'), 0)} AS balance_in_order_uom, {show('o.reorder_recommendation')} AS reorder_recommendation, s.demand_pattern, s.variability_class, s.abc_class
        FROM outlet_sku o LEFT JOIN sku_summary s ON s.stock_id = o.stock_id WHERE o.location_id = 'L03'"""

SQL = {
    "sku1_sku_intelligence": query(f"{SKU} {SKU_ORDER} LIMIT 100"),
    "sku1_sku_intelligence_filtered": query(f"""SELECT * FROM ({SKU} WHERE reorder_recommendation IN ('STOP_ORDERING') AND is_active AND (stock_id ILIKE '%ring%' OR stock_name ILIKE '%ring%' OR barcode ILIKE '%ring%')) {SKU_ORDER} LIMIT 50 OFFSET 10"""),
    "sku2_sku_counts": query(f"""SELECT 'total' AS section, 'ALL' AS key, {lng("COUNT(*) FILTER (reorder_recommendation IN ('STOP_ORDERING'))")} AS sku_count FROM sku_summary WHERE ud1_code = 'NA'
        UNION ALL SELECT 'recommendation', COALESCE({show('reorder_recommendation')}, 'UNCERTAIN'), COUNT(*) FROM sku_summary WHERE ud1_code = 'NA' GROUP BY 2
        UNION ALL SELECT 'review', review_flag, COUNT(*) FROM sku_summary WHERE ud1_code = 'NA' AND review_flag IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'review', 'NEEDS_REVIEW', COUNT(*) FILTER ({OPEN}) FROM sku_summary WHERE ud1_code = 'NA'"""),
    "sku3_display_recommendation": query(f"SELECT stock_id, reorder_recommendation, {show('reorder_recommendation')} AS display_name FROM sku_summary"),
    "rv1_apply_reviews": query(f"""SELECT s.stock_id, CASE WHEN a.act IN ('APPROVE', 'DISMISS') THEN {AS_OF} ELSE s.reviewed_at END AS reviewed_at, CASE WHEN a.act IN ('APPROVE', 'DISMISS') THEN 'U1' ELSE s.reviewed_by END AS reviewed_by,
        a.notes AS review_notes, {lng("CASE WHEN a.act = 'FLAG' THEN 1 END")} AS review_priority, CASE a.act WHEN 'APPROVE' THEN 'APPROVED' WHEN 'DISMISS' THEN 'DISMISSED' ELSE s.review_flag END AS review_flag
        FROM sku_summary s LEFT JOIN (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS stock_id, (['APPROVE', 'DISMISS', 'FLAG'])[p_partkey % 3 + 1] AS act,
          CASE WHEN p_partkey % 2 = 1 THEN 'note ' || CAST(p_partkey AS VARCHAR) END AS notes FROM part WHERE p_partkey % 17 = 0) a ON a.stock_id = s.stock_id"""),
    "acc1_access_level": query(f"SELECT staff_id, pos_user_group, region, {ACCESS} AS access, {ACCESS} <> 'NONE' AS may_log_in FROM staff WHERE is_active"),
    "acc1_manager_access": query("""SELECT staff_id, role IN ('admin', 'coo', 'cmo', 'director', 'area_manager') OR COALESCE(pos_user_group, '') IN ('ADMINISTRATORS', 'COO', 'CMO', 'CEO', 'PURCHASER', 'WAREHOUSE MANAGER', 'AREA MANAGER') AS manager_access FROM staff WHERE is_active"""),
    "acc2_accessible_outlets": query(f"""SELECT s.staff_id, {ACCESS} AS access, w.location_id, w.name AS location_name FROM staff s JOIN region_outlet w
        ON ({ACCESS} = 'FULL') OR ({ACCESS} = 'REGION' AND w.n_regionkey = s.n_regionkey) OR ({ACCESS} = 'OUTLET' AND w.location_id = s.primary_outlet) WHERE s.is_active"""),
    "osi1_outlet_intelligence": query(f"SELECT {LIST} FROM outlet_sku o WHERE location_id = 'L03' AND is_active {BEST} LIMIT 500"),
    "osi1_outlet_intelligence_all": query(f"SELECT {LIST} FROM outlet_sku WHERE is_active"),
    "osi1_outlet_intelligence_joined": query(f"{JOINED} {BEST} LIMIT 500"),
    "osi1_joined_brand_search": query(f"{JOINED} AND (o.stock_id ILIKE '%rand#1%' OR o.stock_name ILIKE '%rand#1%' OR s.brand ILIKE '%rand#1%') {BEST} LIMIT 500"),
    "osi2_pattern_group": query(f"SELECT {LIST} FROM outlet_sku o WHERE location_id = 'L03' AND is_active AND outlet_demand_pattern IN ('MODERATE_GROWTH', 'GROWTH', 'STABLE_GROWTH') {BEST} LIMIT 500"),
    "osi3_outlet_page": query(f"""SELECT location_id, stock_id, {dbl('outlet_ams')} AS outlet_ams, {dbl('current_balance')} AS current_balance, {lng('k')} AS row_num FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY location_id
        ORDER BY outlet_ams DESC NULLS LAST, current_balance DESC NULLS LAST, stock_id) AS k FROM outlet_sku) WHERE k > 100 AND k <= 300"""),
    "osi4_outlet_counts": query(f"""SELECT location_id, {lng('COUNT(*)')} AS total_skus, {', '.join(f"{lng(f"COUNT(*) FILTER ({show('reorder_recommendation')} = '{r}')")} AS {r.lower()}" for r in RECS)}
        FROM outlet_sku WHERE is_active GROUP BY 1"""),
    "osi5_outlet_review_counts": query(f"""WITH f AS (SELECT o.location_id, COALESCE(s.review_flag, 'NONE') AS review_flag FROM outlet_sku o LEFT JOIN sku_summary s ON s.stock_id = o.stock_id)
        SELECT location_id, review_flag, {lng('COUNT(*)')} AS sku_count FROM f GROUP BY 1, 2
        UNION ALL SELECT location_id, 'NEEDS_REVIEW', COUNT(*) FILTER (review_flag IN ('NEW_ITEM', 'AMS_CHECK')) FROM f GROUP BY 1"""),
    "sug1_suggestions": query(f"{SUG} SELECT * FROM sug ORDER BY confidence_score DESC, avg_regional_ams DESC, stock_id LIMIT 500"),
    "sug1a_category_gap": query(f"""SELECT s.ud1_code, {lng('COUNT(*) FILTER (o.location_id = \'L23\')')} AS target_sku_count, {dbl('COUNT(*)')} / COUNT(DISTINCT o.location_id) AS avg_sku_count
        FROM outlet_sku o JOIN sku_summary s ON s.stock_id = o.stock_id WHERE o.outlet_ams > 0 GROUP BY 1"""),
    "sug2_outlet_profile": query(f"""SELECT location_id, location_name, {dbl('SUM(total_12m)')} AS total_sales, {lng('COUNT(DISTINCT CASE WHEN outlet_ams > 0 THEN stock_id END)')} AS active_skus,
        {lng("COUNT(DISTINCT CASE WHEN outlet_abc_class = 'A' THEN stock_id END)")} AS class_a_count FROM outlet_sku GROUP BY 1, 2"""),
    "sug3_suggestion_summary": query(f"""{SUG} SELECT {lng('COUNT(*)')} AS total_suggestions, COALESCE({rnd(ratio('SUM(confidence_score)', 'COUNT(*)'), 1)}, 0) AS avg_confidence_score,
        {lng('COUNT(*) FILTER (confidence_score >= 70)')} AS high_confidence_count, {lng('COUNT(DISTINCT ud1_code)')} AS categories_represented FROM sug"""),
    "xr1_cross_recommend": query(f"""WITH peers AS (SELECT location_id FROM region_outlet WHERE location_id <> 'L23')
        SELECT r.stock_id, COALESCE(s.stock_name, r.o_name) AS stock_name, s.ud1_code, s.order_uom, s.order_uom_rate, r.ids AS selling_outlet_ids, r.names AS selling_outlet_names, {lng('r.n')} AS outlet_count,
          {rnd('r.av', 2)} AS regional_ams, {rnd('r.tt', 2)} AS regional_total, 0.0::DOUBLE AS your_ams, {rnd(f"{rnd('r.av', 2)} * 0.5::DOUBLE", 0)} AS suggested_initial_qty, s.demand_pattern, s.abc_class
        FROM (SELECT stock_id, string_agg(DISTINCT location_id, ',' ORDER BY location_id) AS ids, string_agg(DISTINCT location_name, ',' ORDER BY location_name) AS names, COUNT(DISTINCT location_id) AS n,
                {dbl('SUM(outlet_ams)')} / COUNT(*) AS av, SUM(total_12m) AS tt, MIN(stock_name) AS o_name FROM outlet_sku WHERE outlet_ams > 0 AND location_id IN (SELECT location_id FROM peers) GROUP BY 1) r
        LEFT JOIN sku_summary s ON s.stock_id = r.stock_id WHERE r.n >= 2 AND r.stock_id NOT IN (SELECT stock_id FROM outlet_sku WHERE location_id = 'L23' AND outlet_ams > 0)
        ORDER BY outlet_count DESC, regional_ams DESC, r.stock_id LIMIT 100"""),
    "xr2_peer_outlets": query("""SELECT w.location_id FROM staff s JOIN region_outlet w ON w.n_regionkey = s.n_regionkey WHERE s.staff_id = 'U2' AND s.is_active AND w.location_id <> s.primary_outlet"""),
    "rot4_transfers_out": query(rot(True)),
    "rot5_transfers_in": query(rot(False)),
    "rot4_rot5_one_outlet": query(f"""SELECT * FROM ({rot(True)}) WHERE from_outlet = 'L03' UNION ALL SELECT * FROM ({rot(False)}) WHERE to_outlet = 'L03'"""),
    "rot2_rot3_overstock": query(f"""SELECT stock_id, location_id, tier AS velocity_tier, cat AS pattern_category, {lng('doi_max')} AS doi_threshold, {dbl('exc')} AS excess_qty FROM rot_have"""),
    "rot1_rot6_tiers_and_region": query("SELECT stock_id, location_id, region, tier AS velocity_tier, cat AS pattern_category FROM rot_pos"),
    "rb1_supply_constrained": query("SELECT * FROM rb_short"),
    "rb2_fair_share": query(f"""SELECT stock_id, location_id, {rnd('fair', 4)} AS fair_share_qty, {rnd('dev', 4)} AS fair_share_deviation, cls AS classification, {rnd('give', 4)} AS can_donate_qty, {rnd('want', 4)} AS need_qty FROM rb_share"""),
    "rb3_rebalance": query(f"SELECT * FROM ({RB}) ORDER BY priority_score DESC, transfer_qty DESC, stock_id, from_outlet, to_outlet LIMIT 500"),
    "po1_po_lines": query(f"""SELECT stock_id, order_uom_stock_name AS stock_name, {show('reorder_recommendation')} AS reorder_recommendation, order_uom, order_uom_rate, base_uom, held AS balance_in_order_uom, order_up_to_level,
        order_qty, ams_calculated, days_of_inventory, ud1_code, demand_pattern, abc_class, po_supplier_id, po_supplier_source, po_barcode, po_barcode_source, COALESCE(po_unit_price, 0) AS po_unit_price, po_price_source,
        CAST(NULL AS VARCHAR) AS po_price_note, brand_description, po_data_updated_at, po_last_generated_at, {rnd('raw_total', 2)} AS line_total, w1 AS warning_no_price, w2 AS warning_uom_mismatch,
        w3 AS warning_no_barcode, w4 AS warning_unknown_supplier, (w1 OR w2 OR w3 OR w4) AS has_warning FROM po_line"""),
    "po2_po_suppliers": query(SUPP),
    "po3_po_log": query(LOG(AS_OF)),
    "po3_po_log_items": query(f"""SELECT COALESCE(po_supplier_id, 'UNKNOWN') || '-20010801' AS po_id, stock_id, order_qty, COALESCE(po_unit_price, 0) AS unit_price, {rnd('raw_total', 2)} AS line_total FROM po_line"""),
    "po3_stamp_ordered": query(f"SELECT stock_id, CASE WHEN stock_id IN (SELECT stock_id FROM po_line) THEN {AS_OF} ELSE po_last_generated_at END AS po_last_generated_at FROM sku_summary"),
    "po4_po_history": query(f"SELECT * FROM ({LOG(AS_OF)} UNION ALL {LOG(f'CAST({AS_OF} - 20 AS DATE)')} UNION ALL {LOG(f'CAST({AS_OF} - 45 AS DATE)')}) WHERE generated_at >= {AS_OF} - 30 ORDER BY generated_at DESC, po_id LIMIT 100"),
    "exp0_parse_batch": query(f"SELECT {lng('doc_id')} AS doc_id, stock_id, batch_remark, e AS expiry_str, {PARSED} AS expiry_date FROM (SELECT *, substr(batch_remark, 1, 10) AS e FROM batch_line WHERE {VALID})"),
    "exp1_warehouse_batches": query(f"SELECT stock_id, e AS expiry_str, {dbl('q')} AS remaining, stock_name, {dbl('cost')} AS unit_cost FROM wh_batch"),
    "exp1_balances_on_days": query(f"""SELECT location_id, stock_id, expiry_str, as_of, {dbl('SUM(q)')} AS units FROM batch_units
        JOIN (VALUES (DATE '1998-06-30'), (DATE '2000-12-31'), ({AS_OF})) d(as_of) ON doc_date <= as_of GROUP BY 1, 2, 3, 4 HAVING SUM(q) > 0"""),
    "exp1_warehouse_batches_by_log": query(f"SELECT stock_id, e AS expiry_str, {dbl('q')} AS remaining FROM wh_batch"),
    "exp1_draw_down": query(f"""SELECT location_id, stock_id, expiry_str, received_on, sent_on, {dbl('units')} AS units, FALSE AS unreceived, FALSE AS held FROM lot_drawn
        UNION ALL SELECT location_id, stock_id, expiry_str, received_on, NULL, {dbl('units')}, FALSE, TRUE FROM lot_left
        UNION ALL SELECT location_id, stock_id, expiry_str, NULL, doc_date, {dbl('LEAST(o, o_end - i_all)')}, TRUE, FALSE FROM batch_lot WHERE LEAST(o, o_end - i_all) > 0"""),
    "exp2_lots_left": query(f"SELECT location_id, stock_id, expiry_str, received_on, {dbl('units')} AS units, {lng(f'{AS_OF} - received_on')} AS age_days FROM lot_left"),
    "exp2_outlet_batches": query(f"SELECT stock_id, location_id, e AS expiry_str, {dbl('q')} AS qty, {dbl('cost')} AS unit_cost FROM out_batch"),
    "exp3_expiry_windows": query(WINDOWS),
    "exp4_at_risk": query(f"""SELECT {lng('SUM(total_batches)')} AS batches, {lng('SUM(total_units)')} AS units, {rnd('SUM(CAST(total_value AS DECIMAL(28,2)))', 2)} AS value FROM ({WINDOWS})
        WHERE expiry_window IN ('expired', '0_30_days', '31_60_days', '61_90_days')"""),
    "exp5_by_location": query(f"""SELECT b.location_id, CASE WHEN b.location_id = 'WAREHOUSE' THEN 'WAREHOUSE' ELSE l.name END AS location_name, {bands('expired', 'days < 0')}, {bands('at_risk', 'days BETWEEN 0 AND 90')}, {bands('safe', 'days > 90')}
        FROM (SELECT location_id, cost, CAST(q AS BIGINT) AS u, exp_date - {TODAY} AS days FROM wh_batch
              UNION ALL SELECT location_id, cost, CAST(SUM(q) AS BIGINT), exp_date - {TODAY} FROM out_batch GROUP BY location_id, e, exp_date, cost) b
        LEFT JOIN location l ON l.location_id = b.location_id GROUP BY 1, 2"""),
    "exp6_expiry_items": query(f"{ITEMS} days BETWEEN -365 AND 90 ORDER BY days_until_expiry, b.location_id, b.stock_id, expiry_date LIMIT 100"),
    "exp6_expiry_items_expired": query(f"{ITEMS} days < 0"),
    "exp6_expiry_items_outlet": query(f"{ITEMS} days BETWEEN 0 AND 60 AND b.location_id = 'L07' ORDER BY days_until_expiry, b.location_id, b.stock_id, expiry_date LIMIT 100"),
}

SQL["osi3_stored_page"] = SQL["osi3_outlet_page"]
for _name, _needle in (("sku1_indexed_search", "Ring"), ("sku1_indexed_search_short", "9")):
    SQL[_name] = query(f"SELECT stock_id, stock_name, barcode FROM product WHERE stock_id ILIKE '%{_needle}%' OR stock_name ILIKE '%{_needle}%' OR barcode ILIKE '%{_needle}%'")

# what a giver and a taker have in common when their quantities are laid end to end
_LAID = """SELECT stock_id, location_id, a, urgency_tier, priority_score, SUM(a) OVER (PARTITION BY stock_id ORDER BY {turn}, location_id ROWS UNBOUNDED PRECEDING) AS b
  FROM (SELECT *, CAST({amount} AS DECIMAL(28,4)) AS a FROM rb_share WHERE cls = '{side}') WHERE a > 0"""
SQL["rb3_allocation"] = query(f"""WITH g AS ({_LAID.format(turn='doi DESC', amount="ROUND(CAST(give AS DECIMAL(38,10)), 4)", side='DONOR')}),
    t AS ({_LAID.format(turn='doi', amount="ROUND(CAST(want AS DECIMAL(38,10)), 4)", side='RECIPIENT')})
    SELECT g.stock_id, g.location_id AS from_outlet, t.location_id AS to_outlet, {dbl('LEAST(g.b, t.b) - GREATEST(g.b - g.a, t.b - t.a)')} AS transfer_qty, g.urgency_tier, g.priority_score
    FROM g JOIN t ON t.stock_id = g.stock_id AND g.b - g.a < t.b AND t.b - t.a < g.b""")
# shared expressions once, so that neither side of a comparison waits for the other
SQL["rb2_fair_share"] = SQL["rb2_fair_share"].replace(" AS (\n", " AS MATERIALIZED (\n")


def _everywhere(text: str) -> str:
    """The suggestion statement with the outlet as a column: each outlet by each stock, the plain way."""
    text = text.replace("location_id <> 'L23' AND ", "")
    text = text.replace("SUM(n) FILTER (location_id = 'L23') AS mine, ", "")
    text = text.replace("SELECT r.*, s.stock_name", "SELECT w.location_id, r.*, s.stock_name")
    text = text.replace("FROM reg r JOIN sku_summary s ON s.stock_id = r.stock_id", "FROM (SELECT DISTINCT location_id FROM outlet_sku) w, reg r JOIN sku_summary s ON s.stock_id = r.stock_id")
    text = text.replace("COALESCE(mine, 0)", """COALESCE((SELECT COUNT(*) FROM outlet_sku oo JOIN sku_summary ss ON ss.stock_id = oo.stock_id
        WHERE oo.outlet_ams > 0 AND oo.location_id = w.location_id AND ss.ud1_code = s.ud1_code), 0)""")
    text = text.replace("r.stock_id NOT IN (SELECT stock_id FROM outlet_sku WHERE location_id = 'L23' AND outlet_ams >= 1)", "(w.location_id, r.stock_id) NOT IN (SELECT (location_id, stock_id) FROM outlet_sku WHERE outlet_ams >= 1)")
    return text.replace("sug AS (SELECT stock_id,", "sug AS (SELECT location_id, stock_id,")


SQL["sug1_all_outlets"] = query(f"""{_everywhere(SUG)} SELECT * EXCLUDE (k) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY location_id ORDER BY confidence_score DESC, avg_regional_ams DESC, stock_id) AS k FROM sug) WHERE k <= 20""")
