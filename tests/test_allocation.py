import random
from collections import defaultdict
from decimal import Decimal

from stockloom.operators import transfer


def shares(spark, rows):
    return spark.createDataFrame(rows, "stock_id string, location_id string, can_donate_qty double, need_qty double, days_of_inventory double, urgency_tier string, priority_score double")


def test_nobody_gives_or_gets_more_than_they_can(spark):
    rng = random.Random(4)
    rows = []
    for s in range(60):
        for loc in range(rng.randint(1, 25)):
            kind = rng.choice("grrb")
            q = rng.choice([0.00001, 1.0, 2.5, 7.0, round(rng.uniform(0, 90), 4)])
            rows.append((f"S{s}", f"L{loc:02d}", q if kind == "g" else 0.0, q if kind == "r" else 0.0, rng.choice([None, 5.0, 40.0, float(rng.randint(0, 90))]), "URGENT", 2.0))
    rows += [("Z", "L1", 5.0, 0.0, 9.0, "LOW", 1.0), ("Z", "L2", 0.0, 5.0, 1.0, "LOW", 1.0)]  # ends meet exactly
    exact = lambda x: Decimal(str(x)).quantize(Decimal("0.0001"))
    can, need = {}, {}
    for s, loc, g, w, *_ in rows:
        can[s, loc], need[s, loc] = exact(g), exact(w)
    given, got, per = defaultdict(Decimal), defaultdict(Decimal), defaultdict(int)
    for r in transfer.allocate(shares(spark, rows)).collect():
        given[r.stock_id, r.from_outlet] += exact(r.transfer_qty)
        got[r.stock_id, r.to_outlet] += exact(r.transfer_qty)
        per[r.stock_id] += 1
        assert r.transfer_qty > 0
    assert all(given[k] <= can[k] for k in given) and all(got[k] <= need[k] for k in got)
    for s in {k[0] for k in can}:
        total = lambda d, s=s: sum(v for (x, _), v in d.items() if x == s)
        assert total(given) == total(got) == min(total(can), total(need))
        assert per[s] < max(2, sum(1 for k in can if k[0] == s and (can[k] or need[k])))
    assert per["Z"] == 1


def test_longest_cover_gives_and_shortest_gets_first(spark):
    rows = [("A", "L1", 3.0, 0.0, 50.0, "LOW", 1.0), ("A", "L2", 3.0, 0.0, 90.0, "LOW", 1.0), ("A", "L3", 0.0, 4.0, 2.0, "LOW", 1.0), ("A", "L4", 0.0, 9.0, 1.0, "LOW", 1.0)]
    got = sorted((r.from_outlet, r.to_outlet, r.transfer_qty) for r in transfer.allocate(shares(spark, rows)).collect())
    assert got == [("L1", "L4", 3.0), ("L2", "L4", 3.0)]
    assert transfer.allocate(shares(spark, [])).count() == 0


def test_suggestions_for_all_outlets_equal_those_of_each(spark):
    from stockloom import config
    from stockloom.operators import outlet
    from tests.test_outlets import known, outlet_row, outlets, summary

    rng = random.Random(12)
    shops = [f"L{i}" for i in range(9)] + config.PSEUDO_LOCATIONS[:1]
    types = [None, "FLTHB", "FLTF1", "NA"]
    stocks = [f"S{i:02d}" for i in range(60)]
    rows = [
        outlet_row(loc, st, ams=float(rng.choice([0, 0.5, 1, 2, 3, 3.5, 8, 30])), outlet_demand_pattern=rng.choice(["STABLE", "GROWTH", "DECLINE"]), outlet_momentum_status=rng.choice(["GAINING", "STEADY"]))
        for loc in shops for st in stocks if rng.random() < 0.6
    ]
    o, s = outlets(spark, rows), summary(spark, [known(st, rng.choice(types), abc=rng.choice("ABC")) for st in stocks])
    for k in (3, 500):
        got = [r.asDict() for r in outlet.suggest_all(o, s, min_confidence=40, per_outlet=k).collect()]
        assert {r["location_id"] for r in got} <= set(shops[:-1])
        for loc in shops[:-1]:
            want = [r.asDict() for r in outlet.suggest(o, s, loc, min_confidence=40, limit=k).collect()]
            mine = [{c: v for c, v in r.items() if c != "location_id"} for r in got if r["location_id"] == loc]
            order = lambda r: r["stock_id"]
            assert sorted(mine, key=order) == sorted(want, key=order) and want


def test_suggestions_for_all_outlets_sum_up_the_sellers_once(spark):
    from stockloom.operators import outlet
    from tests.test_outlets import known, outlet_row, outlets, summary

    rows = [outlet_row(f"L{i}", f"S{j}", ams=9.0) for i in range(4) for j in range(5) if (i + j) % 3]
    o, s = outlets(spark, rows), summary(spark, [known(f"S{j}", "NA") for j in range(5)])
    got = outlet.suggest_all(o, s, min_confidence=0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan  # the sellers' sums are read from where they are kept
    assert got.count() > 0
