"""Stock-level intelligence, review actions and staff access."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom import config
from stockloom.functions.expr import first_match, like_text, lng, lookup, ratio, rnd

NEEDS_REVIEW = ["NEW_ITEM", "AMS_CHECK"]


def display_recommendation(c="reorder_recommendation"):
    """SKU-3: stored recommendation under its display name."""
    col = F.col(c) if isinstance(c, str) else c
    return lookup(col, config.RECOMMENDATION_DISPLAY, col)


def stored_recommendations(name: str) -> list[str]:
    """SKU-3: display name back to the stored value(s)."""
    return config.RECOMMENDATION_STORED.get(name, [name])


def needs_review():
    return F.col("review_flag").isin(NEEDS_REVIEW) & F.col("reviewed_at").isNull()


def _filtered(s: DataFrame, demand_pattern=None, variability_class=None, seasonal_type=None, seasonal_intensity=None,
              recommendation=None, ud1=None, is_active=None, review_flag=None, search=None) -> DataFrame:
    equal = {
        "demand_pattern": demand_pattern, "variability_class": variability_class, "seasonal_type_new": seasonal_type,
        "seasonal_intensity": seasonal_intensity, "ud1_code": ud1,
    }
    for column, value in equal.items():
        if value:
            s = s.filter(F.col(column) == value)
    if recommendation:
        s = s.filter(F.col("reorder_recommendation").isin(stored_recommendations(recommendation)))
    if is_active:
        s = s.filter(F.col("is_active") == (is_active == "Y"))
    if review_flag == "NEEDS_REVIEW":
        s = s.filter(needs_review())
    elif review_flag:
        s = s.filter(F.col("review_flag") == review_flag)
    if search:
        s = s.filter(like_text(["stock_id", "stock_name", "barcode"], search))
    return s


def in_order_units(c, n: int):
    return rnd(ratio(F.coalesce(F.col(c), F.lit(0)), "order_uom_rate"), n)


def sku_intelligence(s: DataFrame, limit: int | None = 100, offset: int = 0, **filters) -> DataFrame:
    """SKU-1: filtered stock list, growing patterns first, then by balance."""
    order = {p: i for i, p in enumerate(config.DEMAND_PATTERN_ORDER)}
    rank = F.coalesce(lookup("demand_pattern", order, len(order)), F.lit(len(order)))
    rows = _filtered(s, **filters).orderBy(rank, F.desc_nulls_last("current_balance"), "stock_id")
    if offset:
        rows = rows.offset(offset)
    if limit is not None:
        rows = rows.limit(limit)
    return rows.select(
        "stock_id", "stock_name", "order_uom_stock_name", "barcode", "ud1_code", "is_active",
        *[in_order_units(f"qty_m{i}", 1).alias(f"qty_m{i}") for i in range(1, 5)],
        "demand_pattern", "variability_class", "seasonal_type_new", "seasonal_intensity", "cv_pct", "trend_index",
        "momentum_status", "momentum_index", "ams_calculated", "ams_base_uom", "velocity_daily",
        F.col("ams_calculated").alias("ams_order_uom"), "current_balance",
        in_order_units("current_balance", 0).alias("balance_in_order_uom"), "days_of_inventory", "reorder_point", "max_stock",
        "safety_multiplier", "safety_days", "order_up_to_level", "ams_status", "abc_class", "gp_abc_class",
        display_recommendation().alias("reorder_recommendation"), "ams_action", "order_uom", "order_uom_desc", "order_uom_rate",
        "base_uom", "base_uom_desc", "last_updated", "peak_months", "review_flag", "review_reason", "review_priority",
        "reviewed_at", "reviewed_by", "active_months", "po_last_generated_at",
    )


def sku_counts(s: DataFrame, **filters) -> DataFrame:
    """SKU-2: total, counts per recommendation and per review flag, as (section, key, sku_count).

    The total obeys every filter; the others ignore the recommendation filter,
    so one pass over the loosely filtered rows gives all of them.
    """
    wanted = filters.pop("recommendation", None)
    rows = _filtered(s, **filters)
    chosen = F.col("reorder_recommendation").isin(stored_recommendations(wanted)) if wanted else F.lit(True)
    entry = lambda section, key, counted: F.struct(
        F.lit(section).alias("section"), key.alias("key"), counted.cast("bigint").alias("n")
    )
    one = F.lit(1)
    entries = F.array(
        entry("total", F.lit("ALL"), F.when(chosen, 1).otherwise(0)),
        entry("recommendation", F.coalesce(display_recommendation(), F.lit(config.RECOMMENDATION_DISPLAY["UNKNOWN"])), one),
        entry("review", F.col("review_flag"), one),
        entry("review", F.lit("NEEDS_REVIEW"), F.when(needs_review(), 1).otherwise(0)),
    )
    counted = rows.select(F.inline(entries)).filter(F.col("key").isNotNull())
    return counted.groupBy("section", "key").agg(F.sum("n").alias("sku_count"))


def apply_reviews(s: DataFrame, actions: DataFrame) -> DataFrame:
    """RV-1: the summary after replaying review actions in time order.

    Approve and dismiss set flag, time and person and keep the old note unless
    they bring one; flag always replaces the note and raises the priority.
    """
    done = F.col("action").isin("APPROVE", "DISMISS")
    flag = F.col("action") == "FLAG"
    last_done = F.max(F.when(done, F.struct("at", "action", "staff_id")))
    last_note = F.max(F.when(flag | (done & F.col("notes").isNotNull()), F.struct("at", "action", "notes")))
    per = actions.groupBy("stock_id").agg(last_done.alias("d"), last_note.alias("n"), F.bool_or(flag).alias("flagged"))
    out = s.join(per, "stock_id", "left")
    return out.withColumns({
        "reviewed_at": F.coalesce("d.at", "reviewed_at"),
        "reviewed_by": F.when(F.col("d").isNotNull(), F.col("d.staff_id")).otherwise(F.col("reviewed_by")),
        "review_notes": F.when(F.col("n").isNotNull(), F.col("n.notes")).otherwise(F.col("review_notes")),
        "review_priority": F.when(F.col("flagged"), 1).otherwise(F.col("review_priority")),
        "review_flag": first_match(
            [(F.col("d.action") == "APPROVE", F.lit("APPROVED")), (F.col("d.action") == "DISMISS", F.lit("DISMISSED"))], F.col("review_flag")
        ),
    }).drop("d", "n", "flagged")


def _group():
    return F.trim(F.upper(F.coalesce("pos_user_group", F.lit(""))))


def access_label():
    g = _group()
    return first_match(
        [
            (g.isin(config.FULL_ACCESS_GROUPS), "FULL"), (g.isin(config.REGION_ACCESS_GROUPS), "REGION"),
            (g.isin(config.OUTLET_ACCESS_GROUPS), "OUTLET"),
        ],
        "NONE",
    )


def access_level(staff: DataFrame) -> DataFrame:
    """ACC-1: access of each active staff member; any other group may not log in."""
    return staff.filter("is_active").select(
        "staff_id", "pos_user_group", "region", access_label().alias("access"), (access_label() != "NONE").alias("may_log_in")
    )


def has_manager_access():
    """Who may see suggestions, rotation and rebalancing."""
    role = F.lower(F.coalesce("role", F.lit("")))
    groups = [g for g in config.FULL_ACCESS_GROUPS if g != "ONLINE EXECUTIVE"] + config.REGION_ACCESS_GROUPS
    return role.isin(config.COMPANY_ROLES + ["area_manager"]) | _group().isin(groups)


def manager_access(staff: DataFrame) -> DataFrame:
    """Active staff with the manager-report permission."""
    return staff.filter("is_active").select("staff_id", has_manager_access().alias("manager_access"))


def outlet_list(outlet_sku: DataFrame) -> DataFrame:
    """Every outlet once, with its name."""
    return outlet_sku.filter(F.col("location_id").isNotNull()).groupBy("location_id").agg(F.min("location_name").alias("location_name"))


def accessible_outlets(staff: DataFrame, outlet_sku: DataFrame) -> DataFrame:
    """ACC-2: the outlets each active staff member may see.

    The list of all outlets is as long as the chain has shops, so it travels as
    one array value.
    """
    shop = F.struct(F.col("location_id").alias("id"), F.col("location_name").alias("name"))
    every = outlet_list(outlet_sku).agg(F.sort_array(F.collect_list(shop)).alias("a")).scalar()
    n = F.least(F.size("allowed_outlets"), F.size("allowed_outlet_names"))
    zipped = F.transform(
        F.slice(F.arrays_zip("allowed_outlets", "allowed_outlet_names"), F.lit(1), F.greatest(n, F.lit(0))),
        lambda e: F.struct(e.allowed_outlets.alias("id"), e.allowed_outlet_names.alias("name")),
    )
    own = F.when(F.col("primary_outlet").isNotNull(), F.array(F.struct(F.col("primary_outlet").alias("id"), F.col("primary_outlet_name").alias("name"))))
    rows = staff.filter("is_active").withColumn("access", access_label()).withColumn("every", every)
    shops = first_match([(F.col("access") == "FULL", F.col("every")), (F.col("access") == "REGION", zipped), (F.col("access") == "OUTLET", own)])
    return rows.select("staff_id", "access", F.inline(shops)).select(
        "staff_id", "access", F.col("id").alias("location_id"), F.col("name").alias("location_name")
    )
