from collections import defaultdict
from datetime import date, timedelta
from decimal import Decimal
import random

from stockloom.operators import batchlog, expiry
from tests.tiny import AS_OF, frame, tables

EXPIRY = "2025-01-31"


def line(kind, qty, day, stock="A", place="WAREHOUSE", text=f"{EXPIRY} LOT1"):
    return dict(doc_type=kind, doc_id=1, location_id=place, stock_id=stock, qty=qty, batch_remark=text, doc_date=day)


def log(spark, rows):
    return frame(spark, "batch_log_line", rows)


def d(n):
    return AS_OF + timedelta(days=n)


def test_receipts_are_used_up_in_order(spark):
    rows = [line("SUP_INVOICE", 5, d(0)), line("RECEIVE", 5, d(2)), line("TRANSIT", 3, d(1)), line("SUP_CREDIT", 4, d(3)), line("TRANSIT", 1, d(9))]
    got = {(r.received_on, r.sent_on, int(r.units), r.held) for r in batchlog.draw_down(log(spark, rows), d(5)).collect()}
    assert got == {(d(0), d(1), 3, False), (d(0), d(3), 2, False), (d(2), d(3), 2, False), (d(2), None, 3, True)}
    left = [(r.received_on, int(r.units), r.age_days) for r in batchlog.lots_left(log(spark, rows), d(9)).collect()]
    assert left == [(d(2), 2, 7)]


def test_shortage_null_days_and_corrections(spark):
    rows = [
        line("RECEIVE", 2, None), line("TRANSIT", 5, d(0)), line("RECEIVE", 4, d(0), "B"), line("RECEIVE", -1, d(1), "B"), line("TRANSIT", None, d(0), "C"),
        line("RECEIVE", 9, d(0), "D", text="N/A"), line("RECEIVE", 9, d(0), "E", text=None), line("TRANSFER", 6, d(0), "F", "L1"), line("TRANSIT", 6, d(0), "G", "L1"),
    ]
    got = {(r.stock_id, r.received_on, r.sent_on, int(r.units), r.unreceived, r.held) for r in batchlog.draw_down(log(spark, rows)).collect()}
    assert got == {
        ("A", None, d(0), 2, False, False), ("A", None, d(0), 3, True, False), ("B", d(0), d(1), 1, False, False),
        ("B", d(0), None, 3, False, True), ("F", d(0), None, 6, False, True),
    }
    assert batchlog.draw_down(log(spark, [])).collect() == []


def test_against_units_one_by_one_and_today(spark):
    rng = random.Random(3)
    rows = [line(rng.choice(["SUP_INVOICE", "RECEIVE", "TRANSIT", "SUP_CREDIT"]), rng.randint(0, 6), d(rng.randint(0, 12)), rng.choice("AAAB")) for _ in range(80)]
    want = defaultdict(int)
    for stock in "AB":
        mine = [r for r in rows if r["stock_id"] == stock]
        came = [r["doc_date"] for r in sorted(mine, key=lambda r: r["doc_date"]) if r["doc_type"] in expiry.INBOUND for _ in range(r["qty"])]
        went = [r["doc_date"] for r in sorted(mine, key=lambda r: r["doc_date"]) if r["doc_type"] in expiry.OUTBOUND for _ in range(r["qty"])]
        for i in range(max(len(came), len(went))):
            want[stock, came[i] if i < len(came) else None, went[i] if i < len(went) else None] += 1
    got = {(r.stock_id, r.received_on, r.sent_on): int(r.units) for r in batchlog.draw_down(log(spark, rows)).collect()}
    assert got == dict(want)
    T = tables(spark, batches=rows)
    now = {(r.stock_id, r.expiry_str): r.qty for r in expiry.warehouse_batches(T).collect()}
    held = {(r.stock_id, r.expiry_str): r.units for r in batchlog.balances_on(log(spark, rows), [date(2099, 1, 1)]).collect()}
    assert held == now
    earlier = {r.stock_id: r.units for r in batchlog.balances_on(log(spark, rows), [d(5), d(12)]).filter(f"as_of = date'{d(5)}'").collect()}
    for stock in "AB":
        total = sum((1 if r["doc_type"] in expiry.INBOUND else -1) * r["qty"] for r in rows if r["stock_id"] == stock and r["doc_date"] <= d(5))
        assert earlier.get(stock, Decimal(0)) == max(total, 0)


def test_lines_are_dealt_out_before_they_are_summed(spark):
    rows = [line("RECEIVE", 1, d(n % 3)) for n in range(300)] + [line("TRANSIT", 2, d(5))]
    left = batchlog.lots_left(log(spark, rows), d(9))
    plan = left._jdf.queryExecution().executedPlan().toString()
    dealt = [n for n in plan.splitlines() if "Exchange hashpartitioning" in n]
    assert len(dealt) == 2 and all("REPARTITION_BY_NUM" in n for n in dealt)  # no sums hold a split of the lines
    first = plan.splitlines().index(dealt[-1])
    assert not any("Aggregate" in n for n in plan.splitlines()[first:])
    assert {(r.received_on, int(r.units)) for r in left.collect()} == {(d(0), 98), (d(1), 100), (d(2), 100)}
