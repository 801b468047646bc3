"""Business constants. Every value here is data the results depend on."""

# --- Fixed values: stock-type (UD1) codes -----------------------------------
HOUSE_BRAND = "FLTHB"
PROTECTED_CODES = ["FLTHB", "FLTF1", "FLTF2", "FLTF3", "FLTMH"]
MUST_HAVE_EXCLUDED_CODES = ["FLTHB", "FLTF1", "FLTF2", "FLTF3", "FLTSC"]
NON_STOCKABLE_CODES = ["SPECIAL REQUEST", "DISCONTINUED"]
SPECIAL_REQUEST_EXCLUDED_CODES = ["SPECIAL REQUEST", "DISCONTINUED", "STOCK CLEARANCE"]

# strategic points in the summary health score; any other code scores 50
STRATEGIC_SCORES = {"FLTHB": 100, "FLTF1": 100, "FLTMH": 80, "FLTF2": 70, "FLTF3": 60}
STRATEGIC_DEFAULT = 50

# --- Fixed values: locations that are not shops -----------------------------
PSEUDO_LOCATIONS = ["WAREHOUSE", "QUARANTINE", "RETURN", "S-ISCS"]
WAREHOUSE = "WAREHOUSE"

# --- Fixed values: ledger document types that are sales ---------------------
SALES_DOC_TYPES = ["CUS_CASH_SALES", "CUS_INVOICE"]

# --- Fixed values: brand words for the protection flag ----------------------
PROTECTED_BRANDS = [
    "BLACKMORES", "CENTRUM", "PHARMATON", "SCOTTS", "OMEGA",
    "PANADOL", "NUROFEN", "VOLTAREN", "STREPSILS", "GAVISCON",
    "BEROCCA", "REDOXON", "CALTRATE", "OSTELIN", "SWISSE",
    "NATURE", "VITAMIN", "GLUCOSAMINE", "FISH OIL",
]

# --- Fixed values: brand words for must-have detection ----------------------
MUST_HAVE_BRANDS = [
    "BLACKMORES", "CENTRUM", "PHARMATON", "SCOTTS", "CALTRATE",
    "PANADOL", "NUROFEN", "VOLTAREN", "STREPSILS", "GAVISCON",
    "BEROCCA", "REDOXON", "OSTELIN", "SWISSE", "NATURE MADE",
    "NOW FOODS", "21ST CENTURY", "HOLLAND", "GNLD", "NUTRILITE",
    "AMWAY", "HERBALIFE", "HIMALAYA", "TIGER BALM", "AXEORIGINAL",
    "BIOMERIT", "ACTIFAST", "ZYRTEC", "CLARITYN", "TELFAST",
    "DIFFLAM", "BETADINE", "DETTOL", "LISTERINE", "COLGATE",
    "ORAL-B", "SENSODYNE", "PARODONTAX", "DUREX", "FEMI",
    "ANMUM", "SIMILAC", "ENFAGROW", "PEDIASURE", "ENSURE",
    "GLUCERNA", "PROTINEX", "SUSTAGEN", "MILO", "HORLICKS",
    "OMEGA-3", "FISH OIL", "COD LIVER", "EVENING PRIMROSE",
    "GLUCOSAMINE", "CHONDROITIN", "CALCIUM", "VITAMIN", "MULTIVITAMIN",
]

# --- Fixed values: action per ABC-XYZ cell ----------------------------------
ABC_XYZ_ACTIONS = {
    "AX": "auto_replenish",
    "AY": "seasonal_planning",
    "AZ": "careful_forecast",
    "BX": "standard_reorder",
    "BY": "buffer_stock",
    "BZ": "reduce_variety",
    "CX": "min_order_qty",
    "CY": "negotiate_margins",
    "CZ": "delist_review",
}

# --- Fixed values: movement alert texts, in report order --------------------
ALERT_ACTIONS = {
    "dead_stock": "Review for clearance, return to supplier, or writeoff",
    "slow_moving": "Consider promotion or transfer to higher-traffic outlet",
    "fast_moving": "Consider reorder or transfer from other outlets",
}

# --- Fixed values: recommendation names, stored -> displayed ----------------
RECOMMENDATION_DISPLAY = {
    "DELIST_CANDIDATE": "DELIST",
    "STOP_ORDERING": "OVERSTOCKED",
    "REDUCE_ORDER": "REDUCE",
    "REVIEW": "UNCERTAIN",
    "UNKNOWN": "UNCERTAIN",
}
RECOMMENDATION_STORED = {
    "DELIST": ["DELIST_CANDIDATE"],
    "OVERSTOCKED": ["STOP_ORDERING"],
    "REDUCE": ["REDUCE_ORDER"],
    "UNCERTAIN": ["REVIEW", "UNKNOWN"],
}
DISPLAY_RECOMMENDATIONS = [
    "STOCKOUT", "ORDER_NOW", "ORDER_SOON", "OPTIMAL",
    "REDUCE", "OVERSTOCKED", "DELIST", "UNCERTAIN",
]
UNDERSTOCKED = ["STOCKOUT", "ORDER_NOW", "ORDER_SOON"]
ORDERABLE = ["ORDER_NOW", "ORDER_SOON", "STOCKOUT", "OPTIMAL"]

# --- Fixed values: demand patterns in list order ----------------------------
DEMAND_PATTERN_ORDER = [
    "STRONG_GROWTH", "GROWTH", "STABLE", "NEW", "DECLINE",
    "STRONG_DECLINE", "SPORADIC", "DISC", "DEAD",
]

# --- Fixed values: outlet demand-pattern groups -----------------------------
OUTLET_PATTERN_GROUPS = {
    "STRONG_GROWTH": ["EXTREME_GROWTH", "STRONG_GROWTH"],
    "GROWTH": ["MODERATE_GROWTH", "GROWTH", "STABLE_GROWTH"],
    "STABLE": ["STABLE"],
    "DECLINE": ["STABLE_DECLINE", "DECLINE"],
    "STRONG_DECLINE": ["STRONG_DECLINE", "EXTREME_DECLINE"],
    "DEAD": ["DEAD", "NO_HISTORY"],
    "NEW": ["NEW"],
}

# --- Fixed values: demand patterns grouped for stock rotation ---------------
ROTATION_PATTERNS = {
    "DECLINING": ["EXTREME_DECLINE", "STRONG_DECLINE", "DECLINE"],
    "GROWING": ["EXTREME_GROWTH", "STRONG_GROWTH", "MODERATE_GROWTH", "GROWTH", "EMERGING_GROWTH"],
    "SPORADIC": ["SPORADIC"],
}

# --- Fixed values: rotation thresholds per velocity tier --------------------
# order units per month at or above which a tier applies, highest first
VELOCITY_TIERS = {"FAST": 50, "MEDIUM": 10, "SLOW": 1, "VERY_SLOW": None}
SPORADIC_DOI = 210
SPORADIC_EXCESS_MONTHS = 4.0
ROTATION_DOI = {
    "FAST": {"house_brand": 120, "DECLINING": 15, "GROWING": 75, "STABLE": 45},
    "MEDIUM": {"house_brand": 135, "DECLINING": 45, "GROWING": 105, "STABLE": 75},
    "SLOW": {"house_brand": 180, "DECLINING": 90, "GROWING": 150, "STABLE": 120},
    "VERY_SLOW": {"house_brand": 240, "DECLINING": 150, "GROWING": 210, "STABLE": 180},
}
ROTATION_EXCESS_MONTHS = {
    "FAST": {"DECLINING": 0.5, "GROWING": 1.0, "STABLE": 0.5},
    "MEDIUM": {"DECLINING": 0.5, "GROWING": 1.5, "STABLE": 1.0},
    "SLOW": {"DECLINING": 1.5, "GROWING": 2.5, "STABLE": 2.0},
    "VERY_SLOW": {"DECLINING": 2.5, "GROWING": 3.5, "STABLE": 3.0},
}
VERY_SLOW_EXCESS_UNITS = 5

# --- Fixed values: supply-constraint days (company DOI below) and weights ---
URGENCY_DAYS = {
    "house_brand": {"CRITICAL": 30, "URGENT": 60, "MODERATE": 90},
    "standard": {"CRITICAL": 14, "URGENT": 30, "MODERATE": 45},
}
URGENCY_WEIGHTS = {"CRITICAL": 3.0, "URGENT": 2.0, "MODERATE": 1.5, "LOW": 1.0}
ABC_WEIGHTS = {"A": 3.0, "B": 2.0, "C": 1.0}
CONSTRAINED_TRIGGER_DAYS = {"house_brand": 60, "standard": 30}

# --- Fixed values: product suggestion points --------------------------------
SUGGEST_OUTLET_POINTS = [(10, 25), (7, 22), (5, 20), (4, 17), (3, 14), (None, 10)]
SUGGEST_DEMAND_POINTS = [(50, 25), (20, 20), (10, 15), (5, 10), (1, 5), (None, 2)]
SUGGEST_MARGIN_POINTS = {"A": 15, "B": 10}
SUGGEST_MARGIN_DEFAULT = 5
# demand pattern -> points, points with a rising momentum; any other pattern has the default
SUGGEST_GROWTH_POINTS = {
    "EXTREME_GROWTH": (18, 20), "STRONG_GROWTH": (18, 20), "GROWTH": (14, 16), "MODERATE_GROWTH": (14, 16), "STABLE": (10, 10),
    "STABLE_DECLINE": (5, 5), "DECLINE": (5, 5), "STRONG_DECLINE": (2, 2), "EXTREME_DECLINE": (2, 2),
}
SUGGEST_GROWTH_DEFAULT = 8
RISING_MOMENTUM = ["ACCELERATING", "GAINING"]
SUGGEST_GAP_POINTS = [(0.5, 15), (0.75, 10), (1.0, 5), (None, 0)]

# --- Fixed values: kinds of variation and what they ask for -----------------
VARIED, ERRATIC, MODERATE, PROMO_FREE, PEAK_TO_TROUGH = 0.7, 1.0, 0.5, 0.5, 3
VARIATION_ADVICE = {
    "INSUFFICIENT_DATA": "Gather more data",
    "PROMO_DRIVEN": "Manage via promotion calendar",
    "TRUE_SEASONAL": "Pre-stock for peak months",
    "ERRATIC": "Maintain safety stock buffer",
}
VARIATION_DEFAULT_ADVICE = "Standard replenishment"

# --- Fixed values: staff groups and roles -----------------------------------
FULL_ACCESS_GROUPS = [
    "ADMINISTRATORS", "COO", "CMO", "CEO",
    "PURCHASER", "WAREHOUSE MANAGER",
    "ONLINE EXECUTIVE",
]
REGION_ACCESS_GROUPS = ["AREA MANAGER"]
OUTLET_ACCESS_GROUPS = ["PIC OUTLET"]
COMPANY_ROLES = ["admin", "coo", "cmo", "director"]

# --- Fixed values: margin category upper bounds, percent --------------------
MARGIN_CATEGORIES = [(15, "LOW_MARGIN"), (30, "MEDIUM_MARGIN"), (45, "GOOD_MARGIN"), (None, "HIGH_MARGIN")]

# --- Fixed values: scorecard targets ----------------------------------------
# metric -> (target text, tier, low, high, warning high)
# status is good inside [low, high] (high exclusive unless the range is two-sided)
SCORECARD_TARGETS = [
    ("stock_out_rate", "< 2%", "tier_1_critical", None, 2.0, 5.0),
    ("days_of_supply", "30-45 days", "tier_1_critical", 30.0, 45.0, None),
    ("expiry_risk_value", "< 2%", "tier_1_critical", None, 2.0, 5.0),
    ("inventory_turnover", "8-12x/year", "tier_2_efficiency", 8.0, 12.0, None),
    ("gmroi", "> 3.0", "tier_2_efficiency", 3.0, None, None),
    ("dead_stock_pct", "< 5%", "tier_2_efficiency", None, 5.0, 10.0),
    ("short_dated_ratio", "< 5%", "tier_3_pharmacy_specific", None, 5.0, None),
]

# --- Fixed values: expiry windows, in report order --------------------------
EXPIRY_WINDOWS = [
    "expired", "0_30_days", "31_60_days", "61_90_days", "91_180_days", "over_180_days",
]
AT_RISK_WINDOWS = EXPIRY_WINDOWS[:4]
BATCH_PATTERN = "^20[2-9][0-9]-[01][0-9]-[0-3][0-9]"
