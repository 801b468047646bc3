"""Stored state: refresh by change, closed months, sets, compaction, the current marker."""

import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stockloom.functions import sets
from stockloom.operators import facts
from stockloom.plans import closed, incremental, monthly, summary
from stockloom.plans.refresh import drop_old_runs, latest_summary, published_runs, store_summary
from stockloom.sources.schemas import SALES_LINE
from stockloom.sources.store import PartStore
from stockloom.streaming import refresh
from tests.tiny import AS_OF, balance, frame, product, sale, tables

STOCKS = [f"P{i}" for i in range(40)]


def lines(n, seed, last=AS_OF, stocks=STOCKS):
    rng = random.Random(seed)
    return [sale(rng.choice(stocks), last - timedelta(days=rng.randint(0, 420)), rng.randint(1, 9), rng.randint(5, 90), rng.choice(["CASH", "CASH", "INVOICE"]), rng.choice(["PCS", "BOX"]), rng.choice(["L1", "L2"]), doc=i) for i in range(n)]


def whole(spark, sales):
    products = [product(s, u, r) for s in STOCKS for u, r in (("PCS", 1), ("BOX", 12))]
    return tables(spark, sales, products, [balance(s, i) for i, s in enumerate(STOCKS)])


def files_below(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_refresh_rewrites_touched_buckets_only_and_equals_a_rebuild(spark, tmp_path):
    old = lines(600, 1)
    new = [sale("P3", AS_OF, 5, 70, doc=9001), sale("P3", AS_OF - timedelta(days=200), 2, 9, doc=9002), sale("P4", AS_OF, 1, 5, "INVOICE", doc=9003)]
    T = whole(spark, old)
    state = incremental.SummaryStore(spark, str(tmp_path), buckets=32)
    assert len(state.rebuild(T, AS_OF)) == 32
    before, folders = files_below(tmp_path), state.store.current()["tables"]
    after = whole(spark, old + new)
    parts = state.refresh(frame(spark, "sales_line", new), after, AS_OF, version=2)
    assert len(parts) == 1  # P4's line is an invoice, which the summary does not count
    now = state.store.current()["tables"]
    assert all((now[t][p] != folders[t][p]) == (p in parts) for t in now for p in now[t])
    assert all(files_below(tmp_path)[f] == at for f, at in before.items())
    assert sorted(state.summary(after).collect()) == sorted(summary.movement_summary(after, AS_OF).collect())
    # delivered again: nothing changes
    assert state.refresh(frame(spark, "sales_line", new), after, AS_OF, version=2) == [] and state.store.current()["tables"] == now
    # the state is found again under its root, with its number of buckets
    again = incremental.SummaryStore(spark, str(tmp_path))
    assert again.buckets == 32 and again.as_of() == AS_OF
    assert state.store.drop_old(keep=1) == 2 and len(files_below(tmp_path)) < len(before) + 4
    assert sorted(again.summary(after).collect()) == sorted(summary.movement_summary(after, AS_OF).collect())


def test_days_that_leave_a_window_touch_their_stocks(spark, tmp_path):
    sales = [sale("P0", AS_OF - timedelta(days=n), 1, 10, doc=n) for n in (3, 100)] + [sale("P1", AS_OF - timedelta(days=n), 2, 7, doc=n) for n in (6, 29, 364)] + [sale("P2", AS_OF - timedelta(days=50), doc=1)]
    T = whole(spark, sales)
    state = incremental.SummaryStore(spark, str(tmp_path), buckets=64)
    state.rebuild(T, AS_OF)
    none = frame(spark, "sales_line", [])
    later = AS_OF + timedelta(days=2)
    parts = state.refresh(none, T, later, version=2)
    assert len(parts) == 1 and state.as_of() == later  # of these only P1 has days that leave a window
    assert sorted(state.summary(T).collect()) == sorted(summary.movement_summary(T, later).collect())
    assert len(state.refresh(none, T, later, version=3, also=spark.createDataFrame([("P2",)], "stock_id string"))) == 1
    with pytest.raises(ValueError):
        state.refresh(none, T, AS_OF, version=4)


def test_streamed_refresh_counts_a_batch_once(spark, tmp_path):
    old, new = lines(200, 2), lines(60, 3)
    T = whole(spark, old + new)
    state = incremental.SummaryStore(spark, str(tmp_path / "state"), buckets=8)
    state.rebuild(whole(spark, old), AS_OF)
    for k in range(3):
        frame(spark, "sales_line", new[k::3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "new"))
    stream = spark.readStream.schema(SALES_LINE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "new"))
    for ck in ("a", "b"):  # the second reads everything again, as after a lost checkpoint
        incremental.stream_refresh(stream, state, T, lambda: AS_OF, str(tmp_path / ck), {"availableNow": True}).awaitTermination(120)
    assert state.store.current()["version"] == 4
    assert sorted(state.summary(T).collect()) == sorted(summary.movement_summary(T, AS_OF).collect())


def test_nothing_runs_while_a_stored_summary_is_built(spark, tmp_path):
    T = whole(spark, lines(50, 5))
    state = incremental.SummaryStore(spark, str(tmp_path), buckets=4)
    state.rebuild(T, AS_OF)
    spark.sparkContext.setJobGroup("stored", "")
    state.summary(T)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("stored")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_writers_that_fail_leave_the_published_version(spark, tmp_path):
    store = PartStore(spark, str(tmp_path), {"t": "k string, v long"})
    rows = lambda *r: spark.createDataFrame(list(r), "part string, k string, v long")
    store.publish(1, {"t": (["a", "b"], store.write("t", rows(("a", "x", 1), ("b", "y", 2)), "k"))})
    store.write("t", rows(("a", "x", 9)), "k")  # written, never published
    assert sorted(map(tuple, store.read("t").collect())) == [("x", 1), ("y", 2)]
    open_reader = store.read("t")
    store.publish(2, {"t": (["a"], {})})  # a part may become empty
    assert list(map(tuple, store.read("t").collect())) == [("y", 2)] and store.read("t", ["a"]).count() == 0
    assert open_reader.count() == 2  # a reader that looked before still sees its version
    with pytest.raises(ValueError):
        store.publish(2, {})
    assert store.drop_old(keep=1) == 2


def ledger(sales):
    return [dict(stock_id=s["stock_id"], uom_id="PCS", location_id=s["location_id"], doc_type="CUS_INVOICE", doc_date=s["doc_date"], qty_out=s["qty"], root_uom_qty_out=s["qty"], unit_price=1) for s in sales]


def test_closed_months(spark, tmp_path):
    on_time, late = lines(500, 7), lines(40, 8, last=AS_OF - timedelta(days=60))
    L = lambda sales: frame(spark, "stock_ledger", ledger(sales))
    S = lambda sales: frame(spark, "sales_line", sales)
    months = closed.ClosedMonths(spark, str(tmp_path), {"ledger": "root_uom_qty_out", "sales": "qty"})
    start = AS_OF - timedelta(days=200)
    plain = lambda sales: sorted(facts.monthly_sales(tables(spark, sales), start).selectExpr("stock_id", "month", "cast(qty as decimal(28,4)) qty").collect())
    assert sorted(months.monthly("sales", S(on_time), start).collect()) == plain(on_time)  # nothing closed yet
    months.close({"ledger": L(on_time), "sales": S(on_time)}, date(2024, 2, 1), 1)
    months.close({"ledger": L(on_time), "sales": S(on_time)}, date(2024, 6, 1), 2)
    assert months.closed_until() == date(2024, 6, 1)
    folders = months.store.current()["tables"]["ledger"]
    one = [s for s in late if s["doc_date"].month == 3 and s["doc_date"].year == 2024] or [sale("P1", date(2024, 3, 9))]
    assert months.correct({"ledger": L(one), "sales": S(one)}, 3) == {"ledger": ["2024-03-01"], "sales": ["2024-03-01"]}
    now = months.store.current()["tables"]["ledger"]
    assert {m for m in now if now[m] != folders.get(m)} == {"2024-03-01"}
    assert months.correct({"ledger": L(one)}, 3) == {}
    every = on_time + one
    open_only = [s for s in every if s["doc_date"] >= date(2024, 6, 1)]
    # lines of the open month are enough
    got = monthly.pivot(months.monthly("ledger", L(open_only), date(2023, 6, 1)), AS_OF)
    assert sorted(got.collect()) == sorted(monthly.monthly_pivot(L(every), AS_OF).collect())
    # a first month that is cut comes from its lines
    cut = [s for s in every if s["doc_date"] >= date(2024, 6, 1) or s["doc_date"] < date(2024, 1, 1)]
    assert sorted(months.monthly("sales", S(cut), start).collect()) == plain(every)
    with pytest.raises(ValueError):
        months.close({}, date(2024, 6, 15), 4)
    with pytest.raises(ValueError):
        months.close({}, date(2024, 6, 1), 4)


def test_open_month_only_is_scanned(spark, tmp_path):
    from stockloom.sources.catalog import ParquetTables, write_table

    sold = frame(spark, "stock_ledger", ledger(lines(300, 9)))
    write_table(sold, str(tmp_path / "tables"), "stock_ledger")
    stored = ParquetTables(spark, str(tmp_path / "tables")).stock_ledger
    months = closed.ClosedMonths(spark, str(tmp_path / "months"), {"ledger": "root_uom_qty_out"})
    months.close({"ledger": stored}, date(2024, 6, 1), 1)
    got = months.monthly("ledger", stored, date(2023, 6, 1))
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]
    assert sum("month" in f and "2024-06-01" in f for f in filters) == 1
    got.collect()
    assert sorted(monthly.pivot(got, AS_OF).collect()) == sorted(monthly.monthly_pivot(sold, AS_OF).collect())


def test_sets_add_up(spark):
    rng = random.Random(6)
    rows = [(rng.choice("abc"), rng.choice([None, *range(-130, 300)])) for _ in range(3000)] + [("d", None)]
    df = spark.createDataFrame(rows, "k string, m int")
    batches = [sets.sets(df.filter(F.pmod(F.xxhash64("m", "k"), F.lit(4)) == i), ["k"], F.col("m")) for i in range(4)]
    united = sets.union(batches[0].unionByName(batches[1]).unionByName(batches[2]).unionByName(batches[3]).unionByName(batches[1]), ["k"])
    for least in (None, -200, -64, -63, 0, 63, 64, 100, 400):
        bound = None if least is None else F.lit(least).cast("long")
        got = {r.k: r.n for r in united.groupBy("k").agg(sets.members(bound).alias("n")).collect()}
        assert got == {k: len({m for x, m in rows if x == k and m is not None and (least is None or m >= least)}) for k in "abc"}


def test_streamed_selling_days_and_compaction(spark, tmp_path):
    sales = lines(300, 11)
    T = whole(spark, sales)
    src, root = str(tmp_path / "lines"), str(tmp_path / "grain")
    for k in range(6):
        frame(spark, "sales_line", sales[k::6]).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SALES_LINE).option("maxFilesPerTrigger", 1).parquet(src)
    refresh.store_day_sums(stream, root, str(tmp_path / "ck"), {"availableNow": True}).awaitTermination(180)
    want = sorted(summary.rolling_sales(T, AS_OF).select("stock_id", "selling_days_30d", "selling_days_90d").collect())
    whole_summary = sorted(summary.movement_summary(T, AS_OF).collect())
    days = lambda: sorted(refresh.read_selling_days(spark, root, AS_OF).collect())
    assert days() == want
    plan = refresh.read_selling_days(spark, root, AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_date" not in plan
    opened_before = refresh.refreshed_summary(T, root, AS_OF, spark)
    (last,) = refresh.compact(spark, root).values()
    assert last == 4  # of batches 0 to 5 the newest stays as it is
    assert days() == want and sorted(refresh.refreshed_summary(T, root, AS_OF, spark).collect()) == whole_summary
    assert sorted(opened_before.collect()) == whole_summary
    assert refresh.drop_covered(root) == 8  # batches 0 to 3, twice
    # more lines, compacted again onto the first
    frame(spark, "sales_line", [sale("P1", AS_OF, 1, 10, doc=77)]).coalesce(1).write.mode("append").parquet(src)
    refresh.store_day_sums(stream, root, str(tmp_path / "ck"), {"availableNow": True}).awaitTermination(180)
    T = whole(spark, [*sales, sale("P1", AS_OF, 1, 10, doc=77)])
    assert list(refresh.compact(spark, root).values()) == [5]
    whole_summary = sorted(summary.movement_summary(T, AS_OF).collect())
    assert sorted(refresh.refreshed_summary(T, root, AS_OF, spark).collect()) == whole_summary
    assert refresh.drop_covered(root) >= 3 and sorted(refresh.refreshed_summary(T, root, AS_OF, spark).collect()) == whole_summary
    with pytest.raises(ValueError):
        refresh.store_day_sums(stream, root, str(tmp_path / "new"), {"availableNow": True})


def test_one_marker_and_no_run_twice(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "v long")
    for run in (1, 2, 5):
        store_summary(one.withColumn("v", F.lit(run)), str(tmp_path), run)
    with pytest.raises(ValueError):
        store_summary(one, str(tmp_path), 5)
    assert os.listdir(tmp_path / "stock_movement_summary_published") == ["current.json"]
    assert drop_old_runs(spark, str(tmp_path), keep=2) == [1] and published_runs(str(tmp_path)) == [5, 2]
    assert latest_summary(spark, str(tmp_path)).collect()[0].v == 5
