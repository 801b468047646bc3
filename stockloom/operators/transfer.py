"""Stock rotation between outlets and fair-share rebalancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom import config
from stockloom.functions.expr import dbl, first_match, lng, lookup, ratio, rnd, steps_below, top

# --- rotation columns -------------------------------------------------------


def velocity_tier(ams, rate):
    """ROT-1: speed in order units a month."""
    pace = ratio(ams, rate)
    *tiers, (slowest, _) = config.VELOCITY_TIERS.items()
    return first_match([(pace >= floor, tier) for tier, floor in tiers], slowest)


def pattern_category(pattern):
    """ROT-1: demand pattern as declining, growing, sporadic or stable; unknown counts as stable."""
    return first_match([(pattern.isin(names), group) for group, names in config.ROTATION_PATTERNS.items()], "STABLE")


def thresholds(spark) -> DataFrame:
    """ROT-2: days of inventory and spare months per (tier, category, house brand), 32 rows.

    A table and not a CASE, so filters on the thresholds are not expanded into
    nested conditions over the raw columns.
    """
    rows = []
    for tier, doi in config.ROTATION_DOI.items():
        for category in ("SPORADIC", "DECLINING", "GROWING", "STABLE"):
            for house in (True, False):
                days = config.SPORADIC_DOI if category == "SPORADIC" else doi["house_brand" if house else category]
                months = config.SPORADIC_EXCESS_MONTHS if category == "SPORADIC" else config.ROTATION_EXCESS_MONTHS[tier][category]
                rows.append(F.struct(
                    F.lit(tier).alias("velocity_tier"), F.lit(category).alias("pattern_category"), F.lit(house).alias("house"),
                    F.lit(days).alias("doi_threshold"), F.lit(str(months)).cast("decimal(2,1)").alias("excess_months"),
                ))
    return spark.range(1).select(F.inline(F.array(*rows)))


def region_of(name):
    """ROT-6: leading R and digits of the location name, NULL without them."""
    return F.regexp_substr(name, F.lit("^R[0-9]+"))


def _known(s: DataFrame) -> DataFrame:
    return s.select(
        "stock_id", F.coalesce("order_uom_stock_name", "stock_name").alias("s_name"), F.col("order_uom").alias("s_uom"),
        F.col("order_uom_rate").cast("decimal(18,4)").alias("s_rate"), F.col("ud1_code").alias("s_ud1"),
        F.col("demand_pattern").alias("s_pattern"), F.col("abc_class").alias("s_abc"),
    )


def _own(o: DataFrame) -> DataFrame:
    """Selling outlet rows under short names."""
    return o.select(
        "stock_id", "location_id", "location_name", region_of(F.col("location_name")).alias("region"),
        F.col("current_balance").alias("bal"), F.col("outlet_ams").alias("ams"), F.col("days_of_inventory").alias("doi"),
        "reorder_recommendation", "order_uom_rate",
    ).filter(F.col("ams") > 0)


def positions(o: DataFrame, s: DataFrame) -> DataFrame:
    """Selling outlet rows with unit, type and demand pattern from the summary."""
    j = _own(o).join(_known(s), "stock_id", "left")
    return j.withColumn("rate", F.coalesce("order_uom_rate", "s_rate", F.lit(1))).withColumn("pattern", F.coalesce("s_pattern", F.lit("STABLE")))


def excess(rows: DataFrame) -> DataFrame:
    """ROT-2, ROT-3: rows over their thresholds, with the excess quantity.

    The months kept are taken off once for the excess and compared again for
    the test, so a row must hold twice that many.
    """
    p = rows.filter(F.col("bal") > 0).withColumns({
        "velocity_tier": velocity_tier(F.col("ams"), F.col("rate")),
        "pattern_category": pattern_category(F.col("pattern")),
        "house": F.coalesce(F.col("s_ud1") == config.HOUSE_BRAND, F.lit(False)),
    })
    p = p.join(F.broadcast(thresholds(rows.sparkSession)), ["velocity_tier", "pattern_category", "house"])
    keep = F.col("ams") * F.col("excess_months")
    raw = F.col("bal") - keep
    over = (raw > keep) | ((F.col("velocity_tier") == "VERY_SLOW") & (raw > config.VERY_SLOW_EXCESS_UNITS))
    return p.filter((F.col("doi") > F.col("doi_threshold")) & over & (raw > 0)).withColumn("excess_qty", raw)


def need(rows: DataFrame) -> DataFrame:
    """Understocked rows and what two months of sales still need."""
    short = rows.filter(F.col("reorder_recommendation").isin(config.UNDERSTOCKED))
    return short.withColumn("need_qty", F.col("ams") * 2 - F.col("bal")).filter(F.col("need_qty") > 0)


def _best_partner(df: DataFrame, partners: DataFrame, keys, carry) -> DataFrame:
    """For each row the best partner outlet of its stock: own region first, then by the keys ascending.

    The order of partners does not depend on who asks, apart from the asking
    outlet itself. So the best two per (stock, region), and the best two of
    those per stock, are enough, and no pair of outlets is ever formed.
    """
    names = [f"k{i}" for i in range(len(keys))]
    ranked = partners.select(
        "stock_id", "region", *[k.alias(n) for k, n in zip(keys, names)], F.col("location_id").alias("loc"), *carry
    )
    w = Window.partitionBy("stock_id", "region").orderBy(*names, "loc")
    two = ranked.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 2)
    near = two.groupBy("stock_id", "region").agg(F.sort_array(F.collect_list(F.struct(*names, "loc", *carry))).alias("near"))
    # at most two entries a region
    far = near.groupBy("stock_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, 2).alias("far"))
    j = df.join(far, "stock_id").join(near, ["stock_id", "region"], "left")
    first_other = lambda c: F.try_element_at(F.filter(c, lambda e: e.loc != F.col("location_id")), F.lit(1))
    j = j.withColumn("n1", first_other("near")).withColumn("partner", F.coalesce("n1", first_other("far")))
    j = j.filter(F.col("partner").isNotNull())
    return j.withColumn("transfer_reason", F.when(F.col("n1").isNotNull(), "SAME_REGION").otherwise("OTHER_REGION")).drop("near", "far", "n1")


def _whole(x, rate="rate"):
    return rnd(ratio(x, rate), 0)


def _not_pseudo(df):
    return df.filter(~F.col("location_id").isin(config.PSEUDO_LOCATIONS))


def transfers_out(o: DataFrame, s: DataFrame, outlet=None, limit: int | None = 500) -> DataFrame:
    """ROT-4: for each overstocked row the best outlet to send to: same region, lowest cover, largest need.

    One outlet: its `limit` largest excesses in order. All outlets: every row, unordered; the limit does not apply.
    """
    sources = excess(positions(o, s))
    if outlet is not None:
        sources = sources.filter(F.col("location_id") == outlet)
    keys = [F.col("doi"), -F.col("need_qty")]
    j = _best_partner(sources, _not_pseudo(need(_own(o))), keys, ["location_name", "bal", "doi", "need_qty"])
    other = lambda c: F.col(f"partner.{c}")
    out = j.select(
        F.lit("OUT").alias("direction"), "stock_id", F.col("s_name").alias("stock_name"), F.col("s_uom").alias("order_uom"), F.col("s_ud1").alias("ud1_code"),
        F.col("pattern").alias("demand_pattern"), "velocity_tier", "pattern_category", lng("doi_threshold").alias("doi_threshold"),
        F.col("location_id").alias("from_outlet"), F.col("location_name").alias("from_outlet_name"),
        other("loc").alias("to_outlet"), other("location_name").alias("to_outlet_name"),
        rnd("doi", 0).alias("from_doi"), rnd(other("doi"), 0).alias("to_doi"),
        _whole("bal").alias("from_balance_order_uom"), _whole(other("bal")).alias("to_balance_order_uom"),
        _whole(F.least("excess_qty", other("need_qty"))).alias("transfer_qty"),
        _whole("excess_qty").alias("excess_qty_order_uom"), _whole(other("need_qty")).alias("need_qty_order_uom"), "transfer_reason",
        F.col("excess_qty").alias("_a"), (F.col("doi") - other("doi")).alias("_b"),
    )
    if outlet is None:
        return out.drop("_a", "_b")
    return top(out, F.desc("_a"), F.desc("_b"), "stock_id", limit=limit).drop("_a", "_b")


def transfers_in(o: DataFrame, s: DataFrame, outlet=None, limit: int | None = 500) -> DataFrame:
    """ROT-5: for each understocked row the best outlet to take from: same region, largest excess, longest cover.

    One outlet: its `limit` largest needs in order. All outlets: every row, unordered; the limit does not apply.
    """
    pos = positions(o, s)
    wanting = need(pos)
    if outlet is not None:
        wanting = wanting.filter(F.col("location_id") == outlet)
    carry = ["location_name", "bal", "doi", "excess_qty", "velocity_tier", "pattern_category", "doi_threshold", "pattern"]
    j = _best_partner(wanting, _not_pseudo(excess(pos)), [-F.col("excess_qty"), -F.col("doi")], carry)
    other = lambda c: F.col(f"partner.{c}")
    out = j.select(
        F.lit("IN").alias("direction"), "stock_id", F.col("s_name").alias("stock_name"), F.col("s_uom").alias("order_uom"), F.coalesce("s_ud1", F.lit("")).alias("ud1_code"),
        other("pattern").alias("demand_pattern"), other("velocity_tier").alias("velocity_tier"), other("pattern_category").alias("pattern_category"),
        lng(other("doi_threshold")).alias("doi_threshold"),
        other("loc").alias("from_outlet"), other("location_name").alias("from_outlet_name"),
        F.col("location_id").alias("to_outlet"), F.col("location_name").alias("to_outlet_name"),
        rnd(other("doi"), 0).alias("from_doi"), rnd("doi", 0).alias("to_doi"),
        _whole(other("bal")).alias("from_balance_order_uom"), _whole("bal").alias("to_balance_order_uom"),
        _whole(F.least("need_qty", other("excess_qty"))).alias("transfer_qty"),
        _whole(other("excess_qty")).alias("excess_qty_order_uom"), _whole("need_qty").alias("need_qty_order_uom"), "transfer_reason",
        F.col("need_qty").alias("_a"), other("excess_qty").alias("_b"),
    )
    if outlet is None:
        return out.drop("_a", "_b")
    return top(out, F.desc("_a"), F.desc("_b"), "stock_id", limit=limit).drop("_a", "_b")


def rotation(o: DataFrame, s: DataFrame, outlet=None, direction: str = "both", limit: int | None = 500) -> DataFrame:
    """ROT-4, ROT-5: transfers out of and into one outlet (each side up to `limit`), or whole lists of all outlets."""
    sides = {"out": transfers_out, "in": transfers_in}
    chosen = [f(o, s, outlet, limit) for d, f in sides.items() if direction in (d, "both")]
    return chosen[0] if len(chosen) == 1 else chosen[0].unionByName(chosen[1])


# --- fair-share rebalancing -------------------------------------------------


def _brand_kind():
    return F.coalesce(F.col("ud1_code") == config.HOUSE_BRAND, F.lit(False))


def urgency(doi, house):
    """RB-1: tier by company cover; the house brand has a longer lead."""
    def tiers(kind):
        steps = [(ceiling, name) for name, ceiling in config.URGENCY_DAYS[kind].items()]
        return steps_below(doi, steps + [(None, "LOW")])

    return F.when(house, tiers("house_brand")).otherwise(tiers("standard"))


def supply_constrained(o: DataFrame, s: DataFrame) -> DataFrame:
    """RB-1: stocks short across the company, held or sold at two outlets or more."""
    held = o.filter((F.col("current_balance") > 0) | (F.col("outlet_ams") > 0))
    per = held.groupBy("stock_id").agg(
        F.sum("current_balance").alias("total_balance"), F.sum("outlet_ams").alias("total_ams"), F.count("location_id").alias("outlet_count")
    ).filter((F.col("total_ams") > 0) & (F.col("outlet_count") >= 2))
    known = s.select("stock_id", "ud1_code", "abc_class", F.col("order_uom_rate").cast("decimal(18,4)").alias("summary_rate"))
    j = per.join(known, "stock_id", "left").withColumns({
        "ud1_code": F.coalesce("ud1_code", F.lit("OTHER")), "abc_class": F.coalesce("abc_class", F.lit("C")),
        "company_doi": ratio(dbl("total_balance") * 30, "total_ams"),
    })
    house, doi = _brand_kind(), F.col("company_doi")
    limit = lambda table: F.when(house, table["house_brand"]).otherwise(table["standard"])
    widest = {k: v["MODERATE"] for k, v in config.URGENCY_DAYS.items()}
    return j.filter(doi < limit(widest)).withColumns({
        "doi_threshold": limit(config.CONSTRAINED_TRIGGER_DAYS).cast("bigint"),
        "urgency_tier": urgency(doi, house),
        "outlet_count": lng("outlet_count"),
    }).withColumn(
        "priority_score",
        lookup("abc_class", config.ABC_WEIGHTS, 1.0) * lookup("urgency_tier", config.URGENCY_WEIGHTS, 1.0),
    )


def fair_share(o: DataFrame, constrained: DataFrame, min_doi_variance: int = 7) -> DataFrame:
    """RB-2: each selling outlet's share of the stock by its share of demand, and what it can give or needs."""
    own = o.filter(F.col("outlet_ams") > 0).select(
        "stock_id", "location_id", "location_name", "current_balance", "outlet_ams", "days_of_inventory", "order_uom_rate"
    )
    j = own.join(constrained, "stock_id")
    j = j.withColumn("order_uom_rate", F.coalesce("order_uom_rate", "summary_rate", F.lit(1))).drop("summary_rate")
    share = ratio("outlet_ams", "total_ams") * dbl("total_balance")
    j = j.withColumn("fair_share_qty", share).withColumn("fair_share_deviation", dbl("current_balance") - F.col("fair_share_qty"))
    dev, doi = F.col("fair_share_deviation"), dbl("days_of_inventory")
    donor = (dev > 0) & (doi > F.col("company_doi") + min_doi_variance)
    recipient = (dev < 0) & (doi < F.col("company_doi") - min_doi_variance)
    return j.withColumns({
        "classification": first_match([(donor, "DONOR"), (recipient, "RECIPIENT")], "BALANCED"),
        "can_donate_qty": F.when(donor, dev * 0.8).otherwise(0.0),
        "need_qty": F.when(recipient, F.abs(dev)).otherwise(0.0),
    })


def rebalance(fs: DataFrame, s: DataFrame, outlet: str, limit: int | None = 500) -> DataFrame:
    """RB-3: every partner an outlet can give to or take from, per stock.

    Nothing is allocated: each match shows what the pair could move. One
    outlet's rows meet the other outlets' rows, so the result grows with the
    outlets, not with their pairs.
    """
    movable = fs.filter((F.col("can_donate_qty") > 0) | (F.col("need_qty") > 0))
    cols = [
        "location_id", "location_name", "days_of_inventory", "current_balance", "fair_share_qty", "can_donate_qty", "need_qty", "classification",
    ]
    shared = ["order_uom_rate", "company_doi", "ud1_code", "abc_class", "urgency_tier", "priority_score"]
    side = lambda df, prefix: [F.col(c).alias(f"{prefix}_{c}") for c in cols]
    own = movable.filter(F.col("location_id") == outlet)
    far = movable.filter(F.col("location_id") != outlet)
    both = own.select("stock_id", *shared, *side(own, "own")).join(far.select("stock_id", *side(far, "far")), "stock_id")
    both = both.filter(F.col("own_classification") != F.col("far_classification"))
    gives = F.col("own_classification") == "DONOR"
    both = both.select(
        "stock_id", *shared, F.when(gives, "DONATE").otherwise("RECEIVE").alias("direction"),
        *[F.when(gives, F.col(f"own_{c}")).otherwise(F.col(f"far_{c}")).alias(f"from_{c}") for c in cols],
        *[F.when(gives, F.col(f"far_{c}")).otherwise(F.col(f"own_{c}")).alias(f"to_{c}") for c in cols],
    )
    known = s.select("stock_id", F.coalesce("order_uom_stock_name", "stock_name").alias("stock_name"), "order_uom", "demand_pattern")
    j = both.join(known, "stock_id", "left")
    rate = "order_uom_rate"
    out = j.select(
        "direction", "stock_id", "stock_name", "order_uom", "ud1_code", "demand_pattern", "abc_class", "urgency_tier", "priority_score",
        F.col("from_location_id").alias("from_outlet"), F.col("from_location_name").alias("from_outlet_name"),
        F.col("to_location_id").alias("to_outlet"), F.col("to_location_name").alias("to_outlet_name"),
        rnd("from_days_of_inventory", 0).alias("from_doi"), rnd("to_days_of_inventory", 0).alias("to_doi"),
        rnd("company_doi", 0).alias("avg_doi"), rnd("company_doi", 0).alias("company_doi"),
        _whole("from_current_balance", rate).alias("from_balance_order_uom"), _whole("to_current_balance", rate).alias("to_balance_order_uom"),
        _whole("from_fair_share_qty", rate).alias("from_fair_share"), _whole("to_fair_share_qty", rate).alias("to_fair_share"),
        _whole(F.least("from_can_donate_qty", "to_need_qty"), rate).alias("transfer_qty"), F.lit("REBALANCE").alias("transfer_reason"),
    )
    return top(out, F.desc("priority_score"), F.desc("transfer_qty"), "stock_id", "from_outlet", "to_outlet", limit=limit)


def allocate(fs: DataFrame) -> DataFrame:
    """RB-3 for all outlets: what each outlet gives to which, so that none gives or gets more than it can.

    Of a stock, outlets with the longest cover give first and those with the shortest get first. Givers
    and takers are laid side by side, each as long as its quantity; where they overlap, that much moves. Between
    two ends on either side there is one giver and one taker, so a stock has fewer rows than
    outlets, and no outlets are paired to find them.
    """
    exact = lambda c: F.col(c).cast("decimal(38,10)").cast("decimal(28,4)")
    give, want = exact("can_donate_qty"), exact("need_qty")
    sides = fs.select(
        "stock_id", "location_id", "urgency_tier", "priority_score", (give > 0).alias("gives"), F.when(give > 0, give).otherwise(want).alias("amount"),
        F.when(give > 0, -F.col("days_of_inventory")).otherwise(F.col("days_of_inventory")).alias("turn"),
    ).filter(F.col("amount") > 0)
    stock = Window.partitionBy("stock_id")
    side = Window.partitionBy("stock_id", "gives").orderBy(F.asc_nulls_last("turn"), "location_id").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda gives: F.coalesce(F.sum(F.when(F.col("gives") == gives, F.col("amount"))).over(stock), F.lit(0))
    laid = sides.withColumn("until", F.sum("amount").over(side)).withColumn("moved", F.least(total(True), total(False)))
    laid = laid.filter(F.col("until") - F.col("amount") < F.col("moved")).withColumn("until", F.least("until", "moved"))
    ends = Window.partitionBy("stock_id").orderBy("until", F.desc("gives"), "location_id")
    onward = ends.rowsBetween(0, Window.unboundedFollowing)
    next_one = lambda gives: F.first(F.when(F.col("gives") == gives, F.col("location_id")), ignorenulls=True).over(onward)
    pieces = laid.select(
        "stock_id", next_one(True).alias("from_outlet"), next_one(False).alias("to_outlet"),
        (F.col("until") - F.coalesce(F.lag("until").over(ends), F.lit(0))).alias("q"), "urgency_tier", "priority_score",
    )
    return pieces.filter(F.col("q") > 0).select("stock_id", "from_outlet", "to_outlet", dbl("q").alias("transfer_qty"), "urgency_tier", "priority_score")
