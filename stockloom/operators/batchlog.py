"""Batches over time: what a batch held on any day, and which receipts its dispatches used up.

A batch is what one location has of one stock with one expiry date. Its lines are
first summed by day, so a batch is at most one row for each day, however many
lines it has. Receipts of a batch are used up in order of their days. Laid end to
end, receipts and dispatches cut one line of units into intervals; a dispatch has used up
the receipts whose intervals it overlaps. The cuts of both are sorted
together, so no receipt is ever paired with all dispatches.

A line without a day counts as before all others; one without a quantity as nothing. Corrections of a negative
quantity count on the other side. What was dispatched beyond all receipts has
no day of receipt; what is left has no day of dispatch.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom import config
from stockloom.functions.expr import day
from stockloom.operators.expiry import INBOUND, OUTBOUND, TRANSFER
from stockloom.session import dealt

BATCH = ["location_id", "stock_id", "expiry_str"]
UNITS = "decimal(28,4)"
#: Parts of the lines of one batch and day that are summed on their own first.
SALTS = 32


def signed_lines(lines: DataFrame, *extra) -> DataFrame:
    """Lines that count for a batch, with units (and other columns): receipts and transfers up, dispatches and credits down."""
    kind, here = F.col("doc_type"), F.col("location_id") == config.WAREHOUSE
    counts = (here & kind.isin(INBOUND + OUTBOUND)) | (~here & (kind == TRANSFER))
    qty = F.coalesce("qty", F.lit(0)).cast(UNITS)
    dated = lines.filter(counts & F.col("batch_remark").rlike(config.BATCH_PATTERN))
    return dated.select(
        "location_id", "stock_id", F.substring("batch_remark", 1, 10).alias("expiry_str"), "doc_date", F.when(kind.isin(OUTBOUND), -qty).otherwise(qty).alias("units"), *extra
    )


def day_sums(lines: DataFrame) -> DataFrame:
    """Per batch and day: units that came and units that went; the rows of a batch lie in one task.

    Batches and days are nearly as many as lines, so a sum before the exchange would hold a whole split of the lines
    in memory. Lines are dealt out by batch, day and a few salts instead (one batch may have a third of them), and summed where they
    arrive; a day has at most SALTS rows when its batch is brought together.
    """
    zero = F.lit(0).cast(UNITS)
    salt = F.pmod(F.xxhash64("doc_id", "qty", "doc_type", "batch_remark"), F.lit(SALTS)).alias("salt")
    salted = dealt(signed_lines(lines, salt), *BATCH, "doc_date", "salt").groupBy(*BATCH, "doc_date", "salt").agg(
        F.sum(F.greatest("units", zero)).cast(UNITS).alias("came"), F.sum(F.greatest(-F.col("units"), zero)).cast(UNITS).alias("went")
    )
    whole = dealt(salted.drop("salt"), *BATCH).groupBy(*BATCH, "doc_date")
    return whole.agg(F.sum("came").cast(UNITS).alias("came"), F.sum("went").cast(UNITS).alias("went"))


def balances_on(lines: DataFrame, days: list[date]) -> DataFrame:
    """What each batch held at the end of each of some days, where positive: one pass and one exchange for all days."""
    held = signed_lines(lines)
    until = [F.col("doc_date").isNull() | (F.col("doc_date") <= day(d)) for d in days]
    sums = held.groupBy(*BATCH).agg(*[F.sum(F.when(u, F.col("units"))).alias(f"d{i}") for i, u in enumerate(until)])
    each = F.array(*[F.struct(day(d).alias("as_of"), F.col(f"d{i}").alias("units")) for i, d in enumerate(days)])
    return sums.select(*BATCH, F.inline(each)).filter(F.col("units") > 0)


def draw_down(lines: DataFrame, as_of: date | None = None) -> DataFrame:
    """Which units of which receipt went when, up to a day: batch, received_on, sent_on, units.

    A batch has at most as many rows as it has days of receipt and of dispatch together.
    """
    sums = day_sums(lines if as_of is None else lines.filter(F.col("doc_date").isNull() | (F.col("doc_date") <= day(as_of))))
    before = Window.partitionBy(*BATCH).orderBy("doc_date").rowsBetween(Window.unboundedPreceding, 0)
    laid = sums.withColumn("in_end", F.sum("came").over(before)).withColumn("out_end", F.sum("went").over(before))
    # a cut holds the end of one interval; the days are told apart from missing ones by structs
    stamp = F.struct(F.col("doc_date").alias("on"))
    cut = lambda end, received, sent: F.struct(F.col(end).cast(UNITS).alias("end"), received.alias("received"), sent.alias("sent"))
    none = F.lit(None).cast("struct<on:date>")
    cuts = laid.select(*BATCH, F.inline(F.filter(
        F.array(F.when(F.col("came") > 0, cut("in_end", stamp, none)), F.when(F.col("went") > 0, cut("out_end", none, stamp))), lambda c: c.isNotNull()
    )))
    order = Window.partitionBy(*BATCH).orderBy("end")
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    parts = cuts.select(
        *BATCH, (F.col("end") - F.coalesce(F.lag("end").over(order), F.lit(0))).cast(UNITS).alias("units"),
        F.first("received", ignorenulls=True).over(onward).alias("received"), F.first("sent", ignorenulls=True).over(onward).alias("sent"),
    )
    return parts.filter(F.col("units") > 0).select(
        *BATCH, F.col("received.on").alias("received_on"), F.col("sent.on").alias("sent_on"), "units",
        F.col("received").isNull().alias("unreceived"), F.col("sent").isNull().alias("held"),
    )


def lots_left(lines: DataFrame, as_of: date | None = None) -> DataFrame:
    """What is left of each receipt, and how long it has been there by `as_of`."""
    left = draw_down(lines, as_of).filter("held").groupBy(*BATCH, "received_on").agg(F.sum("units").cast(UNITS).alias("units"))
    age = F.lit(None).cast("int") if as_of is None else F.datediff(day(as_of), "received_on")
    return left.withColumn("age_days", age)
