"""Months that are over, kept as sums: reports over months read lines of the open month only.

Stored per month: quantity by stock, for each kind of line (sales lines for SRC-5 and SEA-1, ledger sales for
MON-1). A closed month is final but for late lines, whose sums are added to it: a correction rewrites the months it falls
in, no other. Months that a report covers in part, and months that are not closed, come from the lines.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions.expr import day
from stockloom.sources.store import PartStore

SCHEMA = "stock_id string, month date, qty decimal(28,4)"


def month_sums(lines: DataFrame, qty: str) -> DataFrame:
    return lines.groupBy("stock_id", F.trunc("doc_date", "month").alias("month")).agg(F.sum(qty).cast("decimal(28,4)").alias("qty"))


class ClosedMonths:
    """Month sums of several kinds of lines under a root; `kinds` names the quantity column of each."""

    def __init__(self, spark, root: str, kinds: dict[str, str]):
        self.kinds = kinds
        self.store = PartStore(spark, root, dict.fromkeys(kinds, SCHEMA))

    def closed_until(self) -> date | None:
        """The first day of the first month that is open; months before it are closed."""
        noted = self.store.current()["notes"].get("until")
        return date.fromisoformat(noted) if noted else None

    def _keyed(self, sums: DataFrame) -> DataFrame:
        return sums.withColumn("part", F.col("month").cast("string"))

    def _from(self, lines: DataFrame, start: date | None, end: date) -> DataFrame:
        from stockloom.operators.facts import period

        return period(lines, None if start is None else day(start), day(end))

    def close(self, lines: dict[str, DataFrame], until: date, version: int) -> None:
        """Close all open months before `until`, the first day of a month; of each kind, `lines` holds at least those months."""
        if until.day != 1:
            raise ValueError("months are closed whole")
        start = self.closed_until()
        if start is not None and until <= start:
            raise ValueError(f"closed until {start} already")
        done = {}
        for kind, qty in self.kinds.items():
            folders = self.store.write(kind, self._keyed(month_sums(self._from(lines[kind], start, until), qty)), "stock_id")
            done[kind] = (list(folders), folders)
        self.store.publish(version, done, {"until": until.isoformat()})

    def correct(self, lines: dict[str, DataFrame], version: int) -> dict[str, list[str]]:
        """Add late lines to the closed months they belong to; returns the months rewritten, by kind.

        Lines of open months are left out: they are read where they lie. A version that is published already changes nothing.
        """
        if version <= self.store.current()["version"] or self.closed_until() is None:
            return {}
        done = {}
        for kind, late in lines.items():
            more = month_sums(self._from(late, None, self.closed_until()), self.kinds[kind])
            parts = sorted(r.m for r in more.select(F.col("month").cast("string").alias("m")).distinct().collect())  # one row a month
            both = self.store.read(kind, parts).unionByName(more).groupBy("stock_id", "month").agg(F.sum("qty").alias("qty"))
            done[kind] = (parts, self.store.write(kind, self._keyed(both), "stock_id") if parts else {})
        self.store.publish(version, done)
        return {kind: parts for kind, (parts, _) in done.items()}

    def monthly(self, kind: str, lines: DataFrame, start: date | None = None) -> DataFrame:
        """(stock_id, month, qty) from `start` on: whole closed months from the store, the rest from lines.

        Lines are filtered by date, and by month where they are stored so: of a closed past only the month that `start` cuts is read.
        """
        from stockloom.operators.facts import period

        until = self.closed_until()
        if until is None:
            return month_sums(period(lines, None if start is None else day(start)), self.kinds[kind])
        whole = start if start is None or start.day == 1 else _next_month(start)
        known = [p for p in self.store.current()["tables"][kind] if whole is None or date.fromisoformat(p) >= whole]
        out = self.store.read(kind, known).unionByName(month_sums(period(lines, day(until if start is None else max(until, start))), self.kinds[kind]))
        if start is not None and start.day != 1 and start < until:
            out = out.unionByName(month_sums(period(lines, day(start), day(whole)), self.kinds[kind]))
        return out


def _next_month(d: date) -> date:
    return date(d.year + d.month // 12, d.month % 12 + 1, 1)
