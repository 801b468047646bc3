"""Sell-out speed and movement alerts. Averages are over days with sales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom import config
from stockloom.functions.expr import day, days_before, dbl, first_match, lng, lookup, ratio, rnd, top
from stockloom.operators import facts

RECENT_DAYS = 14
DEAD_DAYS = 30


def _day_stats(daily: DataFrame, as_of, *by) -> DataFrame:
    """Per key, over daily rows: totals and selling days, overall and for the recent days."""
    recent = F.col("doc_date") >= days_before(as_of, RECENT_DAYS)
    stats = daily.groupBy(*by).agg(
        F.sum("qty").alias("sold"),
        F.count("doc_date").alias("sold_days"),
        F.sum(F.when(recent, F.col("qty"))).alias("recent_sold"),
        F.count(F.when(recent, F.col("doc_date"))).alias("recent_days"),
        F.max("doc_date").alias("last_sale_date"),
    )
    return stats.withColumn("avg_day", ratio("sold", "sold_days")).withColumn("recent_avg", ratio("recent_sold", "recent_days"))


def sellout(T, as_of, location=None, stock=None, days: int = 90, limit: int | None = 100) -> DataFrame:
    """SEL-1: sell-out averages, days on hand and trend of the last two weeks."""
    daily = facts.daily_sales(T, days_before(as_of, days), location, stock, per_location=False)
    stats = _day_stats(daily, as_of, "stock_id").filter(F.col("sold") > 0)
    held = facts.balance_by_stock(T, location)
    avg, recent = F.col("avg_day"), F.col("recent_avg")
    bal = dbl(F.coalesce("balance_qty", F.lit(0)))
    out = facts.enrich(stats.join(held, "stock_id", "left"), T).select(
        "stock_id",
        "stock_name",
        "barcode",
        bal.alias("current_balance"),
        dbl("sold").alias("total_sold_period"),
        lng("sold_days").alias("active_days"),
        rnd(avg, 2).alias("avg_daily_sellout"),
        rnd(avg * 7, 2).alias("avg_weekly_sellout"),
        rnd(avg * 30, 2).alias("avg_monthly_sellout"),
        F.when(avg > 0, rnd(ratio(bal, avg), 1)).otherwise(999.0).alias("days_on_hand"),
        first_match(
            [(recent.isNull(), "no_recent_sales"), (recent < avg * 0.7, "slow"), (recent > avg * 1.3, "fast")], "normal"
        ).alias("trend_status"),
        rnd(ratio(F.coalesce(recent, F.lit(0.0)) - avg, avg) * 100, 1).alias("trend_deviation_pct"),
    )
    return top(out, F.desc("days_on_hand"), "stock_id", limit=limit)


def movement_alerts(T, as_of, location=None, threshold_pct: int = 30, days: int = 90, limit: int | None = 200) -> DataFrame:
    """ALR-1: dead, slow and fast movers per (stock, location), worst kind first.

    There is no grace period for new outlets and no minimum history.
    """
    daily = facts.daily_sales(T, days_before(as_of, days), location)
    stats = _day_stats(daily, as_of, "stock_id", "location_id")
    held = facts.period(T.stock_balance, location=location).groupBy("stock_id", "location_id").agg(F.sum("balance_qty").alias("bal"))
    s = stats.join(held, ["stock_id", "location_id"], "left")
    past, recent = F.col("avg_day"), F.coalesce("recent_avg", F.lit(0.0))
    low, high = (100 - threshold_pct) / 100, (100 + threshold_pct) / 100
    dead = (F.col("last_sale_date") < days_before(as_of, DEAD_DAYS)) & (F.col("bal") > 0)
    kind = first_match([(dead, "dead_stock"), (recent < past * low, "slow_moving"), (recent > past * high, "fast_moving")])
    bal = dbl(F.coalesce("bal", F.lit(0)))
    out = s.withColumn("alert_type", kind).filter(F.col("alert_type").isNotNull())
    out = facts.with_location_name(facts.enrich(out, T), T).select(
        "alert_type",
        "stock_id",
        "stock_name",
        "barcode",
        "location_id",
        "location_name",
        rnd(past, 2).alias("historical_avg_daily"),
        rnd(recent, 2).alias("recent_avg_daily"),
        rnd(ratio(recent - past, past) * 100, 1).alias("deviation_pct"),
        bal.alias("current_balance"),
        F.when(past > 0, rnd(ratio(bal, past), 1)).otherwise(999.0).alias("days_on_hand"),
        "last_sale_date",
        lookup("alert_type", config.ALERT_ACTIONS, F.lit(None).cast("string")).alias("recommended_action"),
    )
    order = lookup("alert_type", {k: i for i, k in enumerate(config.ALERT_ACTIONS)}, 9)
    return top(out, order, F.desc("current_balance"), "stock_id", "location_id", limit=limit)


def alert_summary(alerts: DataFrame) -> DataFrame:
    """ALR-2: number of alerts per type among the given alert rows."""
    return alerts.groupBy("alert_type").agg(lng(F.count("stock_id")).alias("alert_count"))
