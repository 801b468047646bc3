"""Dashboard metrics and scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom import config
from stockloom.functions.expr import count_if, day, days_before, dbl, first_match, lng, ratio, rnd
from stockloom.operators import expiry, facts


def _base_balance(T, location=None, *by) -> DataFrame:
    """Balance of base-unit rows by key, with the master cost."""
    held = facts.period(T.stock_balance, location=location).groupBy("stock_id", "uom_id", *by).agg(
        F.sum(F.coalesce("balance_qty", F.lit(0))).alias("balance")
    )
    base = facts.base_products(T).select("stock_id", "uom_id", "cost")
    return held.join(base, ["stock_id", "uom_id"])


def stockout_rate(T, location=None) -> DataFrame:
    """DSH-1: (stock, location) rows at or below zero, and their percentage."""
    empty = F.col("balance") <= 0
    return _base_balance(T, location, "location_id").agg(
        count_if(empty).alias("stockout_count"),
        lng(F.count("stock_id")).alias("total_skus"),
        rnd(ratio(F.count_if(empty), F.count("stock_id")) * 100, 2).alias("stockout_rate"),
    )


def inventory_supply(T, as_of, location=None) -> DataFrame:
    """DSH-2: inventory value, units and mean days of supply over stocks that sold in 90 days."""
    cash = facts.period(facts.cash_sales(T, costed=False), days_before(as_of, 90), location=location)
    daily = cash.groupBy("stock_id", "doc_date").agg(F.sum("qty").alias("q"))
    pace = daily.groupBy("stock_id").agg(F.sum("q").alias("sold"), F.count("doc_date").alias("days"))
    rows = _base_balance(T, location).join(pace, "stock_id", "left")
    # each stock's days rounded to ten places, so the mean does not depend on row order
    supply = F.when(F.col("sold") > 0, ratio(dbl("balance") * F.col("days"), "sold")).cast("decimal(28,10)")
    return rows.agg(
        F.sum(F.col("balance") * F.col("cost")).cast("double").alias("total_inventory_value"),
        F.sum("balance").cast("double").alias("total_units"),
        rnd(ratio(F.sum(supply), F.count(supply)), 4).alias("avg_days_of_supply"),
    )


def turnover_gmroi(T, as_of, location=None) -> DataFrame:
    """DSH-3: yearly cost of sales and gross profit over today's inventory value."""
    cash = facts.period(facts.cash_sales(T), days_before(as_of, 365), location=location)
    cost = F.sum(F.col("qty") * F.col("unit_cost"))
    year = cash.agg(F.struct(cost.alias("cogs"), (F.sum("amount") - cost).alias("gp")).alias("y")).scalar()
    inv = _base_balance(T, location).agg(F.sum(F.col("balance") * F.col("cost")).alias("inv")).withColumn("y", year)
    over = lambda c: F.when(F.col("inv") > 0, rnd(ratio(c, "inv"), 2)).otherwise(0.0)
    return inv.select(
        dbl("y.cogs").alias("cogs"), dbl("y.gp").alias("gross_profit"), dbl("inv").alias("avg_inventory"),
        over("y.cogs").alias("turnover"), over("y.gp").alias("gmroi"),
    )


def dead_stock(T, as_of, location=None) -> DataFrame:
    """DSH-4: stocks held but not sold in 90 days."""
    sold = facts.period(facts.cash_sales(T, costed=False), days_before(as_of, 90), location=location)
    sold = sold.select("stock_id").distinct().withColumn("sold", F.lit(True))
    rows = _base_balance(T, location).join(sold, "stock_id", "left")
    held = F.col("balance") > 0
    dead = held & F.col("sold").isNull()
    return rows.agg(
        count_if(dead).alias("dead_stock_count"), count_if(held).alias("active_stock_count"),
        rnd(ratio(F.count_if(dead), F.count_if(held)) * 100, 2).alias("dead_stock_pct"),
    )


def short_dated(T, as_of, location=None, within: int = 90) -> DataFrame:
    """DSH-5: stocks held, those with a batch due within ninety days, and what such batches are worth at cost.

    `as_of` is a date of the batches. Expired batches are not short-dated.
    """
    batches = facts.period(expiry.all_batches(T), location=location)
    due = batches.filter(F.datediff("expiry_date", day(as_of)).between(0, within)).groupBy("stock_id").agg(
        F.sum(F.col("qty") * F.col("unit_cost")).alias("worth")
    )
    held = F.col("balance") > 0
    short = held & F.col("worth").isNotNull()
    return _base_balance(T, location).join(due, "stock_id", "left").agg(
        count_if(short).alias("short_dated_count"), count_if(held).alias("total_with_stock"),
        F.coalesce(rnd(F.sum(F.when(held, F.col("worth"))), 2), F.lit(0.0)).alias("short_dated_value"),
    )


def metrics(T, as_of, location=None, batch_as_of=None) -> DataFrame:
    """All headline numbers as one row; batch_as_of: today among the batches' dates, if they have another calendar."""
    row = lambda df: df.select(F.struct("*").alias("r")).scalar()
    out = stockout_rate(T, location).select(F.struct("*").alias("so"))
    out = out.withColumns({
        "inv": row(inventory_supply(T, as_of, location)), "turn": row(turnover_gmroi(T, as_of, location)),
        "dead": row(dead_stock(T, as_of, location)), "sd": row(short_dated(T, batch_as_of or as_of, location)),
    })
    zero = F.lit(0.0)
    return out.select(
        F.coalesce("so.stockout_rate", zero).alias("stock_out_rate"),
        F.coalesce("inv.avg_days_of_supply", zero).alias("days_of_supply"),
        F.coalesce(ratio("sd.short_dated_value", "inv.total_inventory_value") * 100, zero).alias("expiry_risk_value"),
        F.coalesce("turn.turnover", zero).alias("inventory_turnover"),
        F.coalesce("turn.gmroi", zero).alias("gmroi"),
        F.coalesce("dead.dead_stock_pct", zero).alias("dead_stock_pct"),
        F.coalesce(ratio("sd.short_dated_count", "sd.total_with_stock") * 100, zero).alias("short_dated_ratio"),
    )


def scorecard(metric_row: DataFrame, targets=None) -> DataFrame:
    """DSH-6: one row per metric with its target and status."""
    shown = {"days_of_supply": 0}
    cards = []
    for name, target, tier, low, high, warn in targets or config.SCORECARD_TARGETS:
        v = F.col(name)
        two_sided = low is not None and high is not None
        good = F.lit(True)
        if low is not None:
            good = good & (v >= low)
        if high is not None:
            good = good & ((v <= high) if two_sided else (v < high))
        rules = [(good, "good")]
        if warn is not None:
            rules.append((v < warn, "warning"))
        status = first_match(rules, "critical" if warn is not None else "warning")
        cards.append(F.struct(
            F.lit(tier).alias("tier"), F.lit(name).alias("metric"), rnd(v, shown.get(name, 2)).alias("value"),
            F.lit(target).alias("target"), status.alias("status"),
        ))
    return metric_row.select(F.inline(F.array(*cards)))
