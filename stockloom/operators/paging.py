"""Row numbers of the outlet lists, stored once, so that a deep page is a filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions.expr import dbl, lng
from stockloom.operators.pareto import number_rows
from stockloom.sources.store import PartStore

SCHEMA = "location_id string, stock_id string, outlet_ams decimal(18,4), current_balance decimal(18,4), row_num long"


def _place():
    """The order of the lists: outlet, then sales and balance, the largest first and nulls last, then stock."""
    last = lambda c: F.struct(F.col(c).isNull().alias("n"), (-F.col(c)).alias("v"))
    return F.struct(F.col("location_id").alias("l"), last("outlet_ams").alias("a"), last("current_balance").alias("b"), F.col("stock_id").alias("s"))


def numbered(o: DataFrame) -> DataFrame:
    """OSI-3's row numbers: rows dealt into ranges of the order of all outlets, numbered in each, with what lies before added.

    An outlet that holds a third of all rows is cut into several ranges. Returns the rows with part and row_num.
    """
    rows = o.select("location_id", "stock_id", "outlet_ams", "current_balance").withColumn("key", F.concat_ws("|", "location_id", "stock_id"))
    return number_rows(rows, "location_id", _place(), "key").drop("key")


class OutletOrder:
    """The stored order of all outlets' lists under a root."""

    def __init__(self, spark, root: str):
        self.store = PartStore(spark, root, {"rows": SCHEMA})

    def rebuild(self, o: DataFrame, version: int) -> None:
        """Number all rows anew; readers of the order before go on with that."""
        rows = numbered(o).withColumn("part", F.col("part").cast("string"))
        old = list(self.store.current()["tables"]["rows"])
        folders = self.store.write("rows", rows, "part", sort=["location_id", "row_num"])
        self.store.publish(version, {"rows": (old, folders)})

    def page(self, after_row: int = 0, limit: int = 500, outlet: str | None = None) -> DataFrame:
        """OSI-3: the rows after a row number, for every outlet or one: a filter that Parquet's statistics prune by."""
        rows = self.store.read("rows").filter((F.col("row_num") > after_row) & (F.col("row_num") <= after_row + limit))
        if outlet is not None:
            rows = rows.filter(F.col("location_id") == outlet)
        return rows.select("location_id", "stock_id", dbl("outlet_ams").alias("outlet_ams"), dbl("current_balance").alias("current_balance"), lng("row_num").alias("row_num"))
