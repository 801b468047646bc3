import os

import pytest

import __spark_entry__ as entry
import oracles
from stockloom.plans.queries import QUERIES
from stockloom.sources.catalog import ParquetTables, jdbc_options, write_table
from tests.tiny import AS_OF, balance, product, sale, tables

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "bal2_balance_summary", "mov1_movement_analysis", "alr1_movement_alerts", "sea3_smart_cv", "yoy1_comparison", "abc5_matrix",
    "smr7_movement_summary", "dsh6_scorecard", "exp3_expiry_windows", "osi4_outlet_counts", "rot4_transfers_out", "po2_po_suppliers",
]


def test_every_query_has_sql_and_the_other_way_round():
    assert set(QUERIES) == set(oracles.SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")
@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted(str([dict(zip(cols, r))[c] for c in order]) for r in cur.fetchall())
    assert sorted(str([r[c] for c in order]) for r in df.collect()) == want


def test_stored_tables_round_trip(spark, tmp_path):
    T = tables(spark, [sale("A"), sale("A", AS_OF.replace(month=1), 3)], [product("A")], [balance("A")])
    for name in ("sales_line", "stock_master", "stock_balance", "location", "category", "brand", "uom"):
        write_table(getattr(T, name), str(tmp_path), name)
    stored = ParquetTables(spark, str(tmp_path))
    assert sorted(os.listdir(tmp_path / "sales_line"))[-2:] == ["month=2024-01-01", "month=2024-06-01"]
    from stockloom.operators.balance import movement_analysis

    a, b = movement_analysis(stored, AS_OF, "L1").collect(), movement_analysis(T, AS_OF, "L1").collect()
    assert a == b and len(a) == 1
    plan = movement_analysis(stored, AS_OF, "L1")._jdf.queryExecution().executedPlan().toString()
    assert any("month#" in part.split("PushedFilters")[0] for part in plan.split("PartitionFilters: [")[1:])
    from stockloom.operators.yoy import lfl

    assert lfl(stored, AS_OF).collect() == lfl(T, AS_OF).collect()


def test_jdbc_options_split_the_read():
    o = jdbc_options("jdbc:postgresql://h/db", "sales", "doc_date", "2024-01-01", "2024-07-01", 16, user="u")
    assert o["numPartitions"] == "16" and o["partitionColumn"] == "doc_date" and o["user"] == "u"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")
@pytest.mark.parametrize("counts, listed", [
    ("alr2_alert_summary", "alr1_movement_alerts_all"), ("sea1b_pattern_counts", "sea1_seasonal_patterns_all"), ("sea2b_index_counts", "sea2_seasonal_index_all"),
    ("sea3b_smart_counts", "sea3_smart_cv_all"), ("yoy1b_status_counts", "yoy1_comparison_all"),
])
def test_counts_cover_the_whole_result(spark, counts, listed):
    rows = entry.queries()[counts](spark, FOLDER).collect()
    total = sum(r["alert_count"] if "alert_count" in r else r["sku_count"] for r in rows)
    assert total == entry.queries()[listed](spark, FOLDER).count()
