"""Batch expiry: balances per expiry date, time windows, at-risk stock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom import config
from stockloom.functions.expr import count_if, day, dbl, lng, rnd, top
from stockloom.operators import facts

INBOUND = ["SUP_INVOICE", "RECEIVE"]
OUTBOUND = ["TRANSIT", "SUP_CREDIT"]
TRANSFER = "TRANSFER"


def union_documents(invoice, receipt, transit, credit, transfer) -> DataFrame:
    """One batch-line frame from the five document tables, each (doc_id, location_id, stock_id, qty, batch_remark)."""
    named = {"SUP_INVOICE": invoice, "RECEIVE": receipt, "TRANSIT": transit, "SUP_CREDIT": credit, TRANSFER: transfer}
    frames = [
        df.select(F.lit(kind).alias("doc_type"), "doc_id", "location_id", "stock_id", "qty", "batch_remark")
        for kind, df in named.items()
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def parse_batch(df: DataFrame, text="batch_remark") -> DataFrame:
    """EXP-0: rows whose batch text starts with a date, as expiry_str and expiry_date.

    Day 00 (month only) counts as the 28th; an impossible date gives NULL.
    """
    return df.filter(F.col(text).rlike(config.BATCH_PATTERN)).withColumn("expiry_str", F.substring(text, 1, 10)).withColumn(
        "expiry_date", expiry_date("expiry_str")
    )


def expiry_date(text):
    """Date of a ten-character batch date."""
    fixed = F.when(F.substring(text, 9, 2) == "00", F.concat(F.substring(text, 1, 8), F.lit("28"))).otherwise(F.col(text))
    return fixed.try_cast("date")


def _costed(df: DataFrame, T) -> DataFrame:
    cost = facts.base_products(T).select("stock_id", F.col("name").alias("stock_name"), "barcode", F.coalesce("cost", F.lit(0)).alias("unit_cost"))
    return df.join(cost, "stock_id", "left").withColumn("unit_cost", F.coalesce("unit_cost", F.lit(0)))


def _remaining(T, warehouse: bool, outlets: bool) -> DataFrame:
    """Positive quantity per (location, stock, expiry) in one pass over the batch lines.

    Receipts count up, dispatches and credits down, in one sum: several lines
    on either side cannot multiply each other.
    """
    kind, here = F.col("doc_type"), F.col("location_id") == config.WAREHOUSE
    wanted = F.lit(False)
    if warehouse:
        wanted = wanted | (here & kind.isin(INBOUND + OUTBOUND))
    if outlets:
        wanted = wanted | (~here & (kind == TRANSFER))
    lines = T.batch_line.filter(wanted & F.col("batch_remark").rlike(config.BATCH_PATTERN))
    qty = F.coalesce("qty", F.lit(0))
    left = lines.groupBy("location_id", "stock_id", F.substring("batch_remark", 1, 10).alias("expiry_str")).agg(
        F.sum(F.when(kind.isin(OUTBOUND), -qty).otherwise(qty)).alias("qty")
    )
    return _costed(left.filter(F.col("qty") > 0).withColumn("expiry_date", expiry_date("expiry_str")), T)


def warehouse_batches(T) -> DataFrame:
    """EXP-1: what is left in the warehouse per (stock, expiry): received less sent, when positive."""
    return _remaining(T, warehouse=True, outlets=False)


def outlet_batches(T) -> DataFrame:
    """EXP-2: batches that reached the outlets by transfer."""
    return _remaining(T, warehouse=False, outlets=True)


def all_batches(T) -> DataFrame:
    """Both, read once."""
    return _remaining(T, warehouse=True, outlets=True)


def expiry_windows(batches: DataFrame, as_of) -> DataFrame:
    """EXP-3: batches, units and value per time window for warehouse, outlets and together; empty windows as zero."""
    # sums per day first, then all windows in one row that is turned into six:
    # a join on a window label would push its long CASE down to every batch line
    per_day = batches.groupBy("expiry_date", "location_id").agg(
        F.count("stock_id").alias("batches"), F.sum(F.col("qty").cast("bigint")).alias("units"), F.sum(F.col("qty") * F.col("unit_cost")).alias("value")
    )
    b = per_day.select(F.datediff("expiry_date", day(as_of)).alias("days"), (F.col("location_id") == config.WAREHOUSE).alias("here"), "batches", "units", "value")
    days, here = F.col("days"), F.col("here")
    edges = [days < 0, days.between(0, 30), days.between(31, 60), days.between(61, 90), days.between(91, 180), days > 180]
    scopes = {"warehouse": here, "outlet": ~here, "total": F.lit(True)}
    measures = ("batches", "units", "value")
    sums = [
        F.coalesce(F.sum(F.when(edge & cond, F.col(m))), F.lit(0)).alias(f"w{i}_{n}_{m}")
        for i, edge in enumerate(edges) for n, cond in scopes.items() for m in measures
    ]
    shown = {"batches": lng, "units": lng, "value": lambda c: rnd(c, 2)}
    six = F.array(*[
        F.struct(F.lit(name).alias("expiry_window"), *[shown[m](f"w{i}_{n}_{m}").alias(f"{n}_{m}") for m in measures for n in scopes])
        for i, name in enumerate(config.EXPIRY_WINDOWS)
    ])
    return b.agg(*sums).select(F.inline(six))


def at_risk(windows: DataFrame) -> DataFrame:
    """EXP-4: expired or due within ninety days, together."""
    risky = windows.filter(F.col("expiry_window").isin(config.AT_RISK_WINDOWS))
    return risky.agg(
        lng(F.sum("total_batches")).alias("batches"), lng(F.sum("total_units")).alias("units"),
        rnd(F.sum(F.col("total_value").cast("decimal(28,2)")), 2).alias("value"),
    )


def expiry_by_location(T, as_of, days_threshold: int = 90) -> DataFrame:
    """EXP-5: expired, at-risk and safe batches per location, most value at risk first.

    Outlet batches of equal expiry and unit cost count as one batch, whichever
    the stock; warehouse batches count per stock.
    """
    w = warehouse_batches(T).select("location_id", "expiry_date", "qty", "unit_cost")
    o = outlet_batches(T).groupBy("location_id", "expiry_str", "expiry_date", "unit_cost").agg(F.sum("qty").alias("qty"))
    b = w.unionByName(o.select("location_id", "expiry_date", "qty", "unit_cost")).withColumn("units", F.col("qty").cast("bigint"))
    days = F.datediff("expiry_date", day(as_of))
    groups = {"expired": days < 0, "at_risk": (days >= 0) & (days <= days_threshold), "safe": days > days_threshold}
    sums = []
    for name, cond in groups.items():
        sums += [
            count_if(cond).alias(f"{name}_batches"),
            lng(F.sum(F.when(cond, F.col("units")).otherwise(F.lit(0)))).alias(f"{name}_units"),
            rnd(F.sum(F.when(cond, F.col("units") * F.col("unit_cost")).otherwise(F.lit(0))), 2).alias(f"{name}_value"),
        ]
    out = facts.with_location_name(b.groupBy("location_id").agg(*sums), T)
    name = F.when(F.col("location_id") == config.WAREHOUSE, F.lit(config.WAREHOUSE)).otherwise(F.col("location_name"))
    return out.withColumn("location_name", name).orderBy(F.desc("at_risk_value"), "location_id")


def _in_window(days, window: str):
    return {
        "expired": days < 0,
        "30_days": days.between(0, 30),
        "60_days": days.between(0, 60),
        "90_days": days.between(-365, 90),
        "at_risk": days.between(-365, 90),
    }.get(window, F.col("expiry_date") >= day("2020-01-01"))


def expiry_items(T, as_of, location=None, window: str = "at_risk", limit: int | None = 100) -> DataFrame:
    """EXP-6: batches in a time window, soonest first."""
    if location == config.WAREHOUSE:
        b = warehouse_batches(T)
    elif location is not None:
        b = outlet_batches(T).filter(F.col("location_id") == location)
    else:
        b = all_batches(T)
    days = F.datediff("expiry_date", day(as_of))
    out = facts.with_location_name(b.filter(_in_window(days, window)), T).select(
        "location_id",
        F.when(F.col("location_id") == config.WAREHOUSE, F.lit(config.WAREHOUSE)).otherwise(F.col("location_name")).alias("location_name"),
        "stock_id", "stock_name", "barcode", F.col("expiry_str").alias("expiry_date"), lng("qty").alias("quantity"),
        dbl("unit_cost").alias("unit_cost"), rnd(F.col("qty") * F.col("unit_cost"), 2).alias("total_value"), lng(days).alias("days_until_expiry"),
    )
    return top(out, "days_until_expiry", "location_id", "stock_id", "expiry_date", limit=limit)
