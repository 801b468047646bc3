"""Outlet-level lists, product suggestions and cross-outlet recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom import config
from stockloom.functions.expr import (
    count_if, dbl, first_match, like_text, lng, lookup, ratio, rnd, steps_at_least, top, total,
)
from stockloom.operators.pareto import number_rows
from stockloom.operators.sku import display_recommendation, in_order_units, outlet_list, stored_recommendations
from stockloom.session import cut_lineage

MONTHS = [f"qty_m{i}" for i in range(1, 13)]


def pattern_filter(pattern: str):
    """OSI-2: a grouped pattern name covers several stored values."""
    return F.col("outlet_demand_pattern").isin(config.OUTLET_PATTERN_GROUPS.get(pattern, [pattern]))


def _filtered(o, outlet=None, recommendation=None, ud1=None, is_active="Y", demand_pattern=None, abc=None, search=None):
    if outlet is not None:
        o = o.filter(F.col("location_id") == outlet)
    if recommendation:
        o = o.filter(F.col("reorder_recommendation").isin(stored_recommendations(recommendation)))
    if ud1:
        o = o.filter(F.col("ud1_code") == ud1)
    if is_active in ("Y", "N"):
        o = o.filter(F.col("is_active") == (is_active == "Y"))
    if demand_pattern:
        o = o.filter(pattern_filter(demand_pattern))
    if abc:
        o = o.filter(F.col("outlet_abc_class") == abc)
    if search:
        o = o.filter(like_text(["stock_id", "stock_name"], search))
    return o


def _sales_order():
    return [F.desc_nulls_last("outlet_ams"), F.desc_nulls_last("current_balance"), F.col("stock_id")]


def _listed(o: DataFrame) -> DataFrame:
    """The list columns, quantities in order units."""
    zero = F.lit(0)
    wanted = F.coalesce("order_up_to_level", zero) - F.coalesce("current_balance", zero)
    return o.select(
        "stock_id", "stock_name", F.col("stock_name").alias("order_uom_stock_name"), "location_id", "location_name", "base_uom",
        "order_uom", dbl("order_uom_rate").alias("order_uom_rate"), "ud1_code",
        *[in_order_units(m, 1).alias(m) for m in MONTHS],
        in_order_units("total_12m", 1).alias("total_12m"),
        rnd(F.coalesce("outlet_ams", zero), 2).alias("ams_12m"),
        dbl("pct_of_total").alias("pct_of_total"),
        rnd(F.coalesce("outlet_ams", zero), 2).alias("ams_calculated"),
        dbl(F.coalesce("velocity_daily", zero)).alias("velocity_daily"),
        lng(F.coalesce("safety_days", zero)).alias("safety_days"),
        in_order_units("reorder_point", 1).alias("reorder_point"),
        in_order_units("max_stock", 1).alias("max_stock"),
        dbl("outlet_cv").alias("outlet_cv"),
        "outlet_variability_class",
        lng(F.coalesce("outlet_safety_days", zero)).alias("outlet_safety_days"),
        in_order_units("order_up_to_level", 1).alias("order_up_to_level"),
        F.greatest(F.lit(0.0), rnd(ratio(wanted, "order_uom_rate"), 1)).alias("reorder_qty"),
        dbl(F.coalesce("current_balance", zero)).alias("current_balance"),
        in_order_units("current_balance", 0).alias("balance_in_order_uom"),
        dbl(F.coalesce("days_of_inventory", zero)).alias("days_of_inventory"),
        display_recommendation(F.coalesce("reorder_recommendation", F.lit("REVIEW"))).alias("reorder_recommendation"),
        "demand_pattern", "variability_class", F.col("outlet_variability_class").alias("outlet_var_class"), "abc_class",
        dbl("outlet_trend_index").alias("outlet_trend_index"), "outlet_demand_pattern", "outlet_abc_class", "gp_abc_class",
        F.coalesce("is_active", F.lit(True)).alias("is_active"),
    )


def outlet_intelligence(o: DataFrame, outlet=None, limit: int | None = 500, offset: int = 0, **filters) -> DataFrame:
    """OSI-1: stocks of an outlet, best sellers first.

    Without an outlet: the rows of all, whole and unordered; `limit` is a page of one
    outlet and does not apply, an offset is refused.
    """
    rows = _filtered(o, outlet, **filters)
    if outlet is None:
        if offset:
            raise ValueError("an offset needs an outlet")
        return _listed(rows)
    rows = rows.orderBy(*_sales_order())
    if offset:
        rows = rows.offset(offset)
    return _listed(rows if limit is None else rows.limit(limit))


def outlet_intelligence_joined(o: DataFrame, s: DataFrame, outlet, limit: int | None = 500, offset: int = 0, **filters) -> DataFrame:
    """OSI-1, joined: names, units and classes come from the summary where it knows the stock; a search looks at its brand too."""
    search = filters.pop("search", None)
    own = _filtered(o, outlet, is_active=filters.pop("is_active", None), **filters)
    known = s.select(
        "stock_id", F.coalesce("order_uom_stock_name", "stock_name").alias("s_name"), F.col("order_uom").alias("s_uom"),
        F.col("order_uom_rate").alias("s_rate"), F.col("ud1_code").alias("s_ud1"), F.col("demand_pattern").alias("s_pattern"),
        F.col("variability_class").alias("s_var"), F.col("abc_class").alias("s_abc"), F.col("trend_index").alias("s_trend"),
        F.col("order_uom_stock_name").alias("s_order_name"), F.col("brand").alias("s_brand"),
    )
    j = own.join(known, "stock_id", "left")
    if search:
        j = j.filter(like_text(["stock_id", "stock_name", "s_brand"], search))
    # quantities divide by the summary's rate only; the outlet's own is for display
    j = j.withColumn("shown_rate", F.coalesce("s_rate", "order_uom_rate", F.lit(1))).withColumns({
        "stock_name": F.coalesce("s_name", "stock_name"), "order_uom": F.coalesce("s_uom", "order_uom"), "ud1_code": F.coalesce("s_ud1", "ud1_code"),
        "order_uom_rate": F.coalesce("s_rate", F.lit(1.0)), "demand_pattern": F.col("s_pattern"), "variability_class": F.col("s_var"), "abc_class": F.col("s_abc"),
    })
    j = j.orderBy(*_sales_order())
    if offset:
        j = j.offset(offset)
    if limit is not None:
        j = j.limit(limit)
    zero = F.lit(0)
    wanted = F.coalesce("order_up_to_level", zero) - F.coalesce("current_balance", zero)
    return j.select(
        "stock_id", "stock_name", F.col("s_order_name").alias("order_uom_stock_name"), "location_id", "location_name", "base_uom", "order_uom", dbl("shown_rate").alias("order_uom_rate"), "ud1_code",
        *[in_order_units(m, 1).alias(m) for m in MONTHS], in_order_units("total_12m", 1).alias("total_12m"),
        rnd(F.coalesce("outlet_ams", zero), 2).alias("ams_12m"), dbl("pct_of_total").alias("pct_of_total"),
        rnd(F.coalesce("outlet_ams", zero), 2).alias("ams_calculated"), dbl(F.coalesce("velocity_daily", zero)).alias("velocity_daily"),
        lng(F.coalesce("safety_days", zero)).alias("safety_days"), in_order_units("reorder_point", 1).alias("reorder_point"),
        in_order_units("max_stock", 1).alias("max_stock"), dbl("outlet_cv").alias("outlet_cv"), "outlet_variability_class",
        lng(F.coalesce("outlet_safety_days", zero)).alias("outlet_safety_days"), in_order_units("order_up_to_level", 1).alias("order_up_to_level"),
        F.greatest(F.lit(0.0), rnd(ratio(wanted, "order_uom_rate"), 1)).alias("reorder_qty"),
        dbl(F.coalesce("current_balance", zero)).alias("current_balance"), in_order_units("current_balance", 0).alias("balance_in_order_uom"),
        dbl(F.coalesce("days_of_inventory", zero)).alias("days_of_inventory"),
        display_recommendation(F.coalesce("reorder_recommendation", F.lit("REVIEW"))).alias("reorder_recommendation"),
        "demand_pattern", "variability_class", F.col("outlet_variability_class").alias("outlet_var_class"), dbl("s_trend").alias("trend_index"), "abc_class", "last_updated",
    )


def outlet_page(o: DataFrame, after_row: int = 0, limit: int = 500) -> DataFrame:
    """OSI-3: the rows after a row number, for every outlet.

    The upper bound on the row number lets each task drop all but its best
    after_row + limit rows per outlet before the shuffle.
    """
    w = Window.partitionBy("location_id").orderBy(*_sales_order())
    numbered = o.select("location_id", "stock_id", "outlet_ams", "current_balance", F.row_number().over(w).alias("row_num"))
    page = numbered.filter((F.col("row_num") <= after_row + limit) & (F.col("row_num") > after_row))
    return page.select("location_id", "stock_id", dbl("outlet_ams").alias("outlet_ams"), dbl("current_balance").alias("current_balance"), lng("row_num").alias("row_num"))


def outlet_counts(o: DataFrame, is_active="Y") -> DataFrame:
    """OSI-4: stocks per outlet and displayed recommendation, zero where none."""
    shown = display_recommendation(F.coalesce("reorder_recommendation", F.lit("REVIEW")))
    rows = _filtered(o, is_active=is_active).withColumn("shown", shown)
    return rows.groupBy("location_id").agg(
        lng(F.count("stock_id")).alias("total_skus"),
        *[count_if(F.col("shown") == r).alias(r.lower()) for r in config.DISPLAY_RECOMMENDATIONS],
    )


def outlet_review_counts(o: DataFrame, s: DataFrame) -> DataFrame:
    """OSI-5: stocks per outlet and review flag; NEEDS_REVIEW adds the two open flags."""
    flags = s.select("stock_id", "review_flag")
    per = o.select("location_id", "stock_id").join(flags, "stock_id", "left").groupBy(
        "location_id", F.coalesce("review_flag", F.lit("NONE")).alias("flag")
    ).agg(F.count("stock_id").alias("n"))
    open_n = F.when(F.col("flag").isin("NEW_ITEM", "AMS_CHECK"), F.col("n")).otherwise(F.lit(0))
    both = F.array(F.struct(F.col("flag").alias("review_flag"), F.col("n")), F.struct(F.lit("NEEDS_REVIEW").alias("review_flag"), open_n.alias("n")))
    return per.select("location_id", F.inline(both)).groupBy("location_id", "review_flag").agg(lng(F.sum("n")).alias("sku_count"))


# --- product suggestions ----------------------------------------------------


def outlet_profile(o: DataFrame) -> DataFrame:
    """SUG-2: yearly sales, selling stocks and A-class stocks per outlet."""
    return o.groupBy("location_id", "location_name").agg(
        total("total_12m").alias("total_sales"), count_if(F.col("outlet_ams") > 0).alias("active_skus"),
        count_if(F.col("outlet_abc_class") == "A").alias("class_a_count"),
    )


def category_coverage(o: DataFrame, s: DataFrame, outlet: str) -> DataFrame:
    """SUG-1a: selling stocks per stock type at the outlet, and the mean over real outlets."""
    selling = o.filter(F.col("outlet_ams") > 0).select("location_id", "stock_id").join(s.select("stock_id", "ud1_code"), "stock_id")
    per = selling.groupBy("location_id", "ud1_code").agg(F.count("stock_id").alias("n"))
    real = ~F.col("location_id").isin(config.PSEUDO_LOCATIONS)
    return per.groupBy("ud1_code").agg(
        F.coalesce(F.sum(F.when(F.col("location_id") == outlet, F.col("n"))), F.lit(0)).cast("bigint").alias("target_sku_count"),
        ratio(F.sum(F.when(real, F.col("n"))), F.count_if(real)).alias("avg_sku_count"),
    )


def growth_points(pattern, momentum):
    steady, rising = ({k: v[i] for k, v in config.SUGGEST_GROWTH_POINTS.items()} for i in (0, 1))
    default = config.SUGGEST_GROWTH_DEFAULT
    return F.when(momentum.isin(config.RISING_MOMENTUM), lookup(pattern, rising, default)).otherwise(lookup(pattern, steady, default))


def gap_points(have, usual):
    usual = F.coalesce(usual, F.lit(0.0))
    have = F.coalesce(have, F.lit(0))
    *rules, (_, last) = config.SUGGEST_GAP_POINTS
    return first_match([(have < usual * share, points) for share, points in rules], last)


BASE_SCORES = ["regional_success_score", "demand_strength_score", "growth_trajectory_score", "profitability_score"]


def _regional(sellers: DataFrame) -> DataFrame:
    """Stocks that sell well in two or more of the outlets given, with what is known of their sales there.

    Lists of outlets are as long as the chain has shops.
    """
    return sellers.groupBy("stock_id").agg(
        F.sort_array(F.collect_set("location_id")).alias("selling_outlets"),
        ratio(F.sum("outlet_ams"), F.count("outlet_ams")).alias("avg_ams"),
        F.max("outlet_ams").alias("max_ams"),
        F.sum("total_12m").alias("total_12m"),
        F.mode("outlet_demand_pattern", True).alias("dominant_pattern"),
        F.mode("outlet_momentum_status", True).alias("dominant_momentum"),
        ratio(F.sum("outlet_trend_index"), F.count("outlet_trend_index")).alias("avg_trend"),
    ).withColumn("selling_outlet_count", lng(F.size("selling_outlets"))).filter((F.col("selling_outlet_count") >= 2) & (F.col("avg_ams") >= 3))


def _candidates(sellers: DataFrame, s: DataFrame, category) -> DataFrame:
    """Stocks to suggest with the scores that do not depend on the outlet."""
    products = s.filter("is_active").select(
        "stock_id", "stock_name", "ud1_code", "order_uom", F.coalesce("order_uom_rate", F.lit(1.0)).alias("order_uom_rate"),
        F.col("abc_class").alias("company_abc"), "gp_abc_class", F.col("demand_pattern").alias("company_pattern"),
    )
    if category:
        products = products.filter(F.col("ud1_code") == category)
    return _regional(sellers).join(products, "stock_id").withColumns({
        "mean2": F.round(F.col("avg_ams").cast("decimal(38,10)"), 2).cast("decimal(18,2)"),
        "regional_success_score": steps_at_least("selling_outlet_count", config.SUGGEST_OUTLET_POINTS),
        "demand_strength_score": steps_at_least("avg_ams", config.SUGGEST_DEMAND_POINTS),
        "growth_trajectory_score": growth_points(F.col("dominant_pattern"), F.col("dominant_momentum")),
        "profitability_score": lookup("gp_abc_class", config.SUGGEST_MARGIN_POINTS, config.SUGGEST_MARGIN_DEFAULT),
    })


def _base_score():
    score = F.col(BASE_SCORES[0])
    for c in BASE_SCORES[1:]:
        score = score + F.col(c)
    return score


def _suggested(rows: DataFrame, min_confidence: int, *keys: str) -> DataFrame:
    """The report columns of candidates with a category_gap_score, from a least confidence on."""
    predicted = F.col("mean2") * F.lit("0.7").cast("decimal(2,1)")
    mood = first_match(
        [
            (F.col("dominant_pattern").isin("EXTREME_GROWTH", "STRONG_GROWTH", "GROWTH"), " • Growing demand"),
            (F.col("dominant_pattern") == "STABLE", " • Stable demand"),
        ],
        "",
    )
    why = F.concat_ws(
        "", F.lit("Selling in "), F.col("selling_outlet_count").cast("string"), F.lit(" outlets (avg "),
        F.round("mean2", 1).cast("string"), F.lit("/month)"), mood,
        F.when(F.col("gp_abc_class") == "A", " • High margin").otherwise(""),
        F.when(F.col("category_gap_score") >= 10, " • Fills category gap").otherwise(""),
    )
    rows = rows.withColumn("confidence_score", _base_score() + F.col("category_gap_score"))
    return rows.filter(F.col("confidence_score") >= min_confidence).select(
        *keys, "stock_id", "stock_name", "ud1_code", "order_uom", "company_abc", "gp_abc_class", "company_pattern",
        lng("confidence_score").alias("confidence_score"), *[lng(p).alias(p) for p in [*BASE_SCORES, "category_gap_score"]],
        "selling_outlet_count", "selling_outlets", dbl("mean2").alias("avg_regional_ams"),
        rnd("max_ams", 2).alias("max_regional_ams"), rnd("total_12m", 0).alias("total_regional_sales"),
        "dominant_pattern", "dominant_momentum", rnd("avg_trend", 3).alias("avg_trend_index"),
        rnd(predicted, 1).alias("predicted_monthly_sales"),
        lng(F.ceil(ratio(predicted, "order_uom_rate"))).alias("suggested_initial_qty"), why.alias("why_suggested"),
    )


def _sellers(o: DataFrame) -> DataFrame:
    return o.filter(~F.col("location_id").isin(config.PSEUDO_LOCATIONS) & (F.col("outlet_ams") >= 3))


def suggest(o: DataFrame, s: DataFrame, outlet: str, category=None, min_confidence: int = 50, limit: int | None = 500) -> DataFrame:
    """SUG-1: stocks that sell well in two or more other outlets and hardly here, scored to 100."""
    here = o.filter((F.col("location_id") == outlet) & (F.col("outlet_ams") >= 1)).select("stock_id")
    rows = _candidates(_sellers(o).filter(F.col("location_id") != outlet), s, category).join(here, "stock_id", "left_anti")
    rows = rows.join(category_coverage(o, s, outlet), "ud1_code", "left")
    out = _suggested(rows.withColumn("category_gap_score", gap_points(F.col("target_sku_count"), F.col("avg_sku_count"))), min_confidence)
    return top(out, F.desc("confidence_score"), F.desc("avg_regional_ams"), "stock_id", limit=limit)


def suggest_all(o: DataFrame, s: DataFrame, category=None, min_confidence: int = 50, per_outlet: int = 50) -> DataFrame:
    """SUG-1 for every real outlet: the best `per_outlet` suggestions of each, as the query for that outlet gives them.

    A stock suggested to an outlet hardly sells there, so it is none of the stock's sellers and leaving it out
    changes nothing: scores are the stock's own, but for the points of the category gap, which all stocks of
    a type share. So the stocks of a type have one order for all outlets, and an outlet needs the first
    `per_outlet` of it, and as many more as it sells itself. These places are looked up by
    (type, place); neither outlets nor outlets and stocks are paired.
    """
    kind = F.coalesce("ud1_code", F.lit("\x00"))  # stocks without a type are one, too
    # numbering reads them three times, and what is numbered is read four times
    stocks = cut_lineage(_candidates(_sellers(o), s, category).withColumn("kind", kind).withColumn("base_score", _base_score()))
    order = F.struct("kind", (-F.col("base_score")).alias("b"), (-F.col("mean2")).alias("m"), "stock_id")
    ordered = cut_lineage(number_rows(stocks, "kind", order, "stock_id").drop("part").withColumnRenamed("row_num", "place"))

    real = o.filter(~F.col("location_id").isin(config.PSEUDO_LOCATIONS))
    outlets = real.select("location_id").distinct()
    selling = real.filter(F.col("outlet_ams") > 0).select("location_id", "stock_id").join(s.select("stock_id", kind.alias("kind")), "stock_id")
    counted = selling.groupBy("location_id", "kind").agg(F.count("stock_id").alias("have"))
    usual = counted.groupBy("kind").agg(ratio(F.sum("have"), F.count("location_id")).alias("usual"))
    known = real.filter(F.col("outlet_ams") >= 1).select("location_id", "stock_id")
    own = known.join(ordered.select("stock_id", "kind"), "stock_id").groupBy("location_id", "kind").agg(F.count("stock_id").alias("own"))
    kinds = ordered.groupBy("kind").agg(F.max("place").alias("places"))
    # one row for each outlet and type, as their gap is one: both are few
    every_kind = kinds.agg(F.collect_list(F.struct("kind", "places"))).scalar()
    needs = (
        outlets.withColumn("k", F.explode(every_kind)).select("location_id", "k.kind", "k.places").join(counted, ["location_id", "kind"], "left").join(usual, "kind", "left").join(own, ["location_id", "kind"], "left")
        .withColumn("category_gap_score", F.when(F.col("kind") == "\x00", F.lit(0)).otherwise(gap_points(F.col("have"), F.col("usual"))))
        .withColumn("needed", F.least(F.col("places"), F.coalesce("own", F.lit(0)) + per_outlet))
    )
    asked = needs.select("location_id", "kind", "category_gap_score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("needed"))).alias("place"))
    rows = asked.join(ordered, ["kind", "place"]).join(known, ["location_id", "stock_id"], "left_anti")
    out = _suggested(rows, min_confidence, "location_id")
    best = Window.partitionBy("location_id").orderBy(F.desc("confidence_score"), F.desc("avg_regional_ams"), "stock_id")
    return out.withColumn("row", F.row_number().over(best)).filter(F.col("row") <= per_outlet).drop("row")


def suggestion_summary(suggestions: DataFrame) -> DataFrame:
    """SUG-3: how many, how sure, how many sure ones, how many stock types."""
    per = suggestions.groupBy("ud1_code").agg(
        F.count("stock_id").alias("n"), F.sum("confidence_score").alias("c"), F.count_if(F.col("confidence_score") >= 70).alias("hi")
    )
    zero = F.lit(0)
    return per.agg(
        lng(F.coalesce(F.sum("n"), zero)).alias("total_suggestions"),
        F.coalesce(rnd(ratio(F.sum("c"), F.sum("n")), 1), F.lit(0.0)).alias("avg_confidence_score"),
        lng(F.coalesce(F.sum("hi"), zero)).alias("high_confidence_count"),
        count_if(F.col("ud1_code") != "").alias("categories_represented"),
    )


# --- cross-outlet recommendations -------------------------------------------


def peer_outlets(staff: DataFrame, o: DataFrame, staff_id: str, outlet: str | None = None) -> DataFrame:
    """XR-2: the outlets a staff member compares an outlet with, by role.

    Company roles get the list of the outlet's area manager, or all others when
    it has none; an area manager gets their own list; other roles get nothing.
    Without an outlet it is the one they are based at; an unknown person has no peers.
    """
    active = staff.filter("is_active")
    if outlet is None:
        outlet = staff.filter(F.col("staff_id") == staff_id).agg(F.min("primary_outlet")).scalar()
    manager = active.filter((F.col("primary_outlet") == outlet) & (F.col("role") == "area_manager")).agg(
        F.min_by(F.coalesce("allowed_outlets", F.array().cast("array<string>")), "staff_id").alias("a")
    ).scalar()
    others = outlet_list(o).filter(F.col("location_id") != outlet).agg(F.collect_list("location_id").alias("a")).scalar()
    me = active.filter(F.upper("staff_id") == staff_id.upper()).select(
        F.lower(F.coalesce("role", F.lit("staff"))).alias("role"), "allowed_outlets", manager.alias("managed"), others.alias("others")
    )
    peers = first_match(
        [
            (F.col("role").isin(config.COMPANY_ROLES), F.coalesce("managed", "others")),
            (F.col("role") == "area_manager", F.array_compact(F.array_remove("allowed_outlets", outlet))),
        ]
    )
    return me.select(F.explode(peers).alias("location_id")).distinct()


def cross_recommend(o: DataFrame, s: DataFrame, peers: DataFrame, outlet: str, limit: int | None = 100) -> DataFrame:
    """XR-1: stocks that sell in two or more peer outlets and not at all here."""
    sold = o.filter(F.col("outlet_ams") > 0).join(peers, "location_id", "left_semi")
    here = o.filter((F.col("location_id") == outlet) & (F.col("outlet_ams") != 0)).select("stock_id")
    region = sold.groupBy("stock_id").agg(
        F.sort_array(F.collect_set("location_id")).alias("selling_outlet_ids"),
        F.sort_array(F.collect_set("location_name")).alias("selling_outlet_names"),
        rnd(ratio(F.sum("outlet_ams"), F.count("outlet_ams")), 2).alias("regional_ams"),
        rnd(F.sum("total_12m"), 2).alias("regional_total"),
        F.min("stock_name").alias("o_name"),
    ).withColumn("outlet_count", lng(F.size("selling_outlet_ids"))).filter(F.col("outlet_count") >= 2)
    known = s.select("stock_id", "stock_name", "ud1_code", "order_uom", "order_uom_rate", "demand_pattern", "abc_class")
    out = region.join(here, "stock_id", "left_anti").join(known, "stock_id", "left").select(
        "stock_id", F.coalesce("stock_name", "o_name").alias("stock_name"), "ud1_code", "order_uom", "order_uom_rate",
        "selling_outlet_ids", "selling_outlet_names", "outlet_count", "regional_ams", "regional_total", F.lit(0.0).alias("your_ams"),
        rnd(F.col("regional_ams") * 0.5, 0).alias("suggested_initial_qty"), "demand_pattern", "abc_class",
    )
    return top(out, F.desc("outlet_count"), F.desc("regional_ams"), "stock_id", limit=limit)
