"""Refreshing the movement summary by change: only stocks that a change touches are summed anew.

Stored, in hash buckets of the stock: day sums of the last year, and the rolled-up sums per stock
that they give (SMR-1, SMR-1b, SMR-2). A refresh adds new lines' day sums to the buckets of their
stocks and rolls those buckets up again; the other buckets are neither read nor written. When the day moves on, the
stocks that have sales on a day which leaves a window are touched too.

What depends on all stocks (maxima, class limits, scores: SMR-3, SMR-6 to SMR-9) is derived on reading from
one row per stock: a new maximum would otherwise touch every row.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions.expr import days_before
from stockloom.operators import facts
from stockloom.plans.summary import WINDOWS, day_grain, movement_summary, roll_up
from stockloom.sources.store import PartStore, bucket_of

BUCKETS = 256
_MONEY = [f"{c}_{n}d" for n in (7, 30, 90, 365) for c in ("rev", "gp")]
SCHEMAS = {
    "day_sums": "stock_id string, uom_id string, doc_date date, qty decimal(28,4), rev decimal(28,4), gp decimal(38,8)",
    "rolled": "stock_id string, " + ", ".join(f"qty_{n}d decimal(28,4)" for n in WINDOWS) + ", "
    + ", ".join(f"{c} decimal({'28,4' if c[0] == 'r' else '38,8'})" for c in _MONEY)
    + ", selling_days_30d long, selling_days_90d long, first_sale date, last_sale date, months long, cv double",
}


class SummaryStore:
    """The stored state of the movement summary under a root."""

    def __init__(self, spark, root: str, buckets: int = BUCKETS):
        self.store = PartStore(spark, root, SCHEMAS)
        self.buckets = self.store.current()["notes"].get("buckets", buckets)

    def as_of(self) -> date | None:
        noted = self.store.current()["notes"].get("as_of")
        return date.fromisoformat(noted) if noted else None

    def _store(self, version: int, grain: DataFrame, T, as_of: date, parts: list[str]) -> list[str]:
        days = self.store.write("day_sums", grain.withColumn("part", bucket_of("stock_id", self.buckets)), "stock_id")
        rolled = roll_up(self.store.read("day_sums", folders=days), T, as_of)
        sums = self.store.write("rolled", rolled.withColumn("part", bucket_of("stock_id", self.buckets)), "stock_id")
        self.store.publish(version, {"day_sums": (parts, days), "rolled": (parts, sums)}, {"as_of": as_of.isoformat(), "buckets": self.buckets})
        return parts

    def rebuild(self, T, as_of: date, version: int = 1) -> list[str]:
        """Sum the whole year anew; every bucket is replaced."""
        return self._store(version, day_grain(facts.cash_sales(T), as_of), T, as_of, [str(b) for b in range(self.buckets)])

    def _touched(self, new: DataFrame, as_of: date, also: DataFrame | None) -> list[str]:
        """Buckets of stocks with new lines, with days that leave a window, and of stocks named besides."""
        stocks = new.select("stock_id")
        last = self.as_of()
        if last is None:
            return [str(b) for b in range(self.buckets)]
        if as_of < last:
            raise ValueError(f"the stored state is of {last}, after {as_of}")
        if as_of > last:
            left = [(F.col("doc_date") >= days_before(last, n)) & (F.col("doc_date") < days_before(as_of, n)) for n in WINDOWS]
            any_left = left[0]
            for x in left[1:]:
                any_left = any_left | x
            stocks = stocks.unionByName(self.store.read("day_sums").filter(any_left).select("stock_id"))
        if also is not None:
            stocks = stocks.unionByName(also.select("stock_id"))
        # at most one row for each bucket
        return sorted(r.part for r in stocks.select(bucket_of("stock_id", self.buckets).alias("part")).distinct().collect())

    def refresh(self, new_lines: DataFrame, T, as_of: date, version: int, also: DataFrame | None = None) -> list[str]:
        """Add sales lines and move to a day; returns the buckets that were replaced.

        A version that is published already changes nothing. `also` names stocks whose master data changed
        (columns: stock_id): units are converted when a bucket is rolled up.
        """
        if version <= self.store.current()["version"]:
            return []
        new = day_grain(new_lines.filter(F.col("channel") == "CASH"), as_of)
        parts = self._touched(new, as_of, also)
        kept = facts.period(self.store.read("day_sums", parts), days_before(as_of, 365))
        both = kept.unionByName(new).groupBy("stock_id", "uom_id", "doc_date").agg(*[F.sum(c).alias(c) for c in ("qty", "rev", "gp")])
        return self._store(version, both, T, as_of, parts)

    def summary(self, T) -> DataFrame:
        """SMR-7 from the stored sums and the current dimension tables; no sales line is read."""
        return movement_summary(T, self.as_of(), rolled=self.store.read("rolled"))


def stream_refresh(lines: DataFrame, state: SummaryStore, T, as_of, checkpoint: str, trigger: dict | None = None, first_version: int = 2):
    """Refresh by each batch of a stream of sales lines; `as_of` gives the day of a batch.

    A batch is published under its own version, so one that is delivered again after a failure is not counted twice.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        state.refresh(batch, T, as_of(), first_version + batch_id)

    writer = lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "60 seconds"})).start()
