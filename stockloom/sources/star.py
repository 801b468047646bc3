"""Canonical tables derived from a TPC-H style star schema on Parquet.

Every canonical row is computed from the star tables by a fixed rule, so any
scale of them gives a retail data set of the same shape.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.functions.expr import QTY, day, first_match
from stockloom.operators.facts import join_document
from stockloom.session import cut_lineage, dealt
from stockloom.sources.catalog import Tables

AS_OF = date(2001, 8, 1)
EXPIRY_AS_OF = date(2021, 8, 1)  # batch texts count only from 2020 on, so these dates sit twenty years later

# Test codes by part key modulo 12; the rest get NA
UD1_BY_PART = [
    "FLTHB", "FLTF1", "FLTF2", "FLTF3", "FLTMH", "FLTSC", "SPECIAL REQUEST", "DISCONTINUED",
]
DEMAND_PATTERNS = [
    "DEAD", "NEW", "DISC", "SPORADIC", "STRONG_DECLINE", "DECLINE", "STABLE", "GROWTH", "STRONG_GROWTH",
]
SEASON_TYPES = ["MONSOON", "Q4_PEAK", "Q1_PEAK", "SCHOOL", "NONE"]
SEASON_INTENSITY = ["TRUE_SEASONAL", "MODERATE", "VARIABLE", "STABLE"]
STAFF_GROUPS = ["ADMINISTRATORS", "PURCHASER", "AREA MANAGER", "PIC OUTLET", "CASHIER", None]
NATIONS = 25  # the star schema fixes the number of nations


# Explicit schemas: no job to infer one, and a changed file fails loudly
STAR_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def pick(values, index):
    """values[index] as an expression."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def outlet_id(key):
    return F.concat(F.lit("L"), F.lpad(key.cast("string"), 2, "0"))


class StarTables(Tables):
    def __init__(self, spark: SparkSession, folder: str, as_of: date = AS_OF):
        self.spark, self.folder, self.as_of = spark, folder, as_of

    def star(self, name: str) -> DataFrame:
        return self.spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    # --- dimensions ---------------------------------------------------------

    @cached_property
    def location(self):
        return self.star("nation").select(
            outlet_id(F.col("n_nationkey")).alias("location_id"),
            F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit(" - "), F.col("n_name")).alias("name"),
            F.col("n_name").alias("address"),
            F.lit("Y").alias("is_active"),
        )

    @cached_property
    def category(self):
        t = self.star("part").select("p_type").distinct()
        return t.select(F.col("p_type").alias("category_id"), F.concat(F.lit("Category "), "p_type").alias("description"))

    @cached_property
    def brand(self):
        t = self.star("part").select("p_brand").distinct()
        return t.select(F.col("p_brand").alias("brand_id"), F.upper("p_brand").alias("description"))

    @cached_property
    def uom(self):
        sizes = self.stock_master.select("uom_id", "uom_rate").distinct()
        return sizes.select(
            "uom_id", F.concat(F.col("uom_id"), F.lit(" OF "), F.col("uom_rate").cast("int").cast("string")).alias("description")
        )

    @cached_property
    def stock_master(self):
        p = F.col("p_partkey")
        units = F.when(p % 3 == 0, F.array(F.lit(1), F.lit(12))).otherwise(F.array(F.lit(1)))
        rate = F.col("rate")
        part = self.star("part").withColumn("rate", F.explode(units))
        cost = (F.col("p_retailprice").cast("decimal(12,2)") * (F.lit(16) + p % 50).cast("decimal(4,0)")
                * rate.cast("decimal(4,0)") * F.lit("0.05").cast("decimal(3,2)")).cast(QTY)
        return part.select(
            F.concat(F.lit("P"), p.cast("string")).alias("stock_id"),
            F.when(rate == 12, "BOX").otherwise("PCS").alias("uom_id"),
            F.lit("PCS").alias("base_uom_id"),
            rate.cast(QTY).alias("uom_rate"),
            F.upper("p_name").alias("name"),
            F.concat(F.lit("AI-"), F.col("p_size").cast("string")).alias("active_ingredient"),
            F.concat(F.lit("B"), p.cast("string")).alias("barcode"),
            F.col("p_type").alias("category_id"),
            F.col("p_brand").alias("brand_id"),
            first_match([(p % 12 < 8, pick(UD1_BY_PART, p % 12 % 8)), (p % 12 == 8, F.lit(None).cast("string"))], "NA").alias("ud1_code"),
            F.concat(F.col("p_type"), F.lit("-"), (F.col("p_size") % 10).cast("string")).alias("therapeutic_group"),
            cost.alias("cost"),
            F.when(p % 2 == 0, cost).otherwise(F.lit(0).cast(QTY)).alias("reference_cost"),
            F.when(p % 20 == 19, "N").otherwise("Y").alias("is_active"),
        )

    # --- facts --------------------------------------------------------------

    def sales(self, costed: bool = False) -> DataFrame:
        """Order lines as sales lines; line cost joins the part table only on demand."""
        lines = self.star("lineitem").select(
            F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"
        )
        orders = self.star("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderdate")
        home = self.star("customer").select("c_custkey", "c_nationkey")
        header = orders.join(home, "c_custkey").filter(F.col("o_orderdate").cast("date") >= self._open_date(F.col("c_nationkey")))
        doc = join_document(lines, header, "o_orderkey")
        box = (F.col("l_partkey") % 3 == 0) & (F.col("l_linenumber") % 4 == 0)
        cash = F.col("o_orderkey") % 5 != 0
        if costed:
            price = self.star("part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
            doc = doc.join(price, "l_partkey", "left")
            cost = (F.col("p_retailprice").cast("decimal(12,2)") * (F.lit(16) + F.col("l_partkey") % 50).cast("decimal(4,0)")
                    * F.when(box, 12).otherwise(1).cast("decimal(4,0)") * F.lit("0.05").cast("decimal(3,2)")).cast(QTY)
            cost = F.when(cash, cost)
        else:
            cost = F.lit(None).cast(QTY)
        return doc.select(
            F.when(cash, "CASH").otherwise("INVOICE").alias("channel"),
            F.col("o_orderkey").alias("doc_no"),
            F.col("l_linenumber").alias("item_no"),
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("stock_id"),
            F.when(box, "BOX").otherwise("PCS").alias("uom_id"),
            outlet_id(F.col("c_nationkey")).alias("location_id"),
            F.col("o_orderdate").cast("date").alias("doc_date"),
            F.col("l_quantity").cast(QTY).alias("qty"),
            (F.col("l_extendedprice").cast("decimal(13,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(3,2)"))).cast(QTY).alias("amount"),
            cost.alias("unit_cost"),
            (F.col("l_discount") >= 0.075).alias("has_promo"),
        )

    @cached_property
    def sales_line(self):
        return self.sales(costed=True)

    @staticmethod
    def _open_date(nation):
        return first_match(
            [(nation < 15, day("1995-01-01")), (nation < 20, day("2000-01-01")), (nation < 23, day("2001-02-15"))],
            day("2001-05-15"),
        )

    @cached_property
    def stock_balance(self):
        """Each part stocked at the outlets its key selects (at most one row per outlet).

        Parts are dealt out before they are multiplied: millions of them lie in one split of their file.
        """
        p, n = F.col("p_partkey"), F.col("n")
        spread = (p * 31 + n * 17)
        parts = dealt(self.star("part").select(p, F.concat(F.lit("P"), p.cast("string")).alias("stock_id")), "stock_id")
        return (
            parts.select("stock_id", p, F.explode(F.sequence(F.lit(0), F.lit(NATIONS - 1))).alias("n"))
            .filter((p * 7 + n * 13) % 4 == 0)
            .select(
                "stock_id",
                F.lit("PCS").alias("uom_id"),
                outlet_id(n).alias("location_id"),
                F.when(p % 4 == 1, spread % 7 - 1).otherwise(spread % 60 - 2).cast(QTY).alias("balance_qty"),
            )
        )

    @cached_property
    def stock_ledger(self):
        rate = F.when(F.col("uom_id") == "BOX", 12).otherwise(1).cast("decimal(4,0)")
        # price truncated to four places with whole-number division
        price = F.expr("(cast(amount * 10000 as bigint)) div (cast(qty as bigint))").cast("decimal(18,0)") * F.lit("0.0001").cast("decimal(5,4)")
        return self.sales().select(
            "stock_id", "uom_id", "location_id",
            F.when(F.col("channel") == "CASH", "CUS_CASH_SALES").otherwise("CUS_INVOICE").alias("doc_type"),
            "doc_date",
            F.col("qty").alias("qty_out"),
            (F.col("qty") * rate).cast(QTY).alias("root_uom_qty_out"),
            price.cast(QTY).alias("unit_price"),
        )

    # --- purchase and batch documents ---------------------------------------

    def _batch_lines(self):
        flag, status = F.col("l_returnflag"), F.col("l_linestatus")
        expiry = F.date_add(day(EXPIRY_AS_OF), ((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 500 - 100).cast("int")).cast("string")
        return self.star("lineitem").select(
            first_match(
                [
                    ((flag == "N") & (status == "O"), "SUP_INVOICE"),
                    (flag == "N", "RECEIVE"),
                    (flag == "R", "TRANSFER"),
                    (status == "O", "TRANSIT"),
                ],
                "SUP_CREDIT",
            ).alias("doc_type"),
            F.col("l_orderkey").alias("doc_id"),
            F.col("l_shipdate").cast("date").alias("doc_date"),
            F.when(flag == "R", outlet_id(F.col("l_orderkey") % NATIONS)).otherwise("WAREHOUSE").alias("location_id"),
            "l_partkey",
            "l_suppkey",
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("stock_id"),
            F.when((F.col("l_partkey") % 3 == 0) & (F.col("l_linenumber") % 4 == 0), "BOX").otherwise("PCS").alias("uom_id"),
            F.when(flag == "A", F.lit(1)).otherwise(F.col("l_quantity")).cast(QTY).alias("qty"),
            first_match(
                [
                    (F.col("l_linenumber") == 7, "N/A"),
                    (F.col("l_orderkey") % 11 == 0, F.concat(F.substring(expiry, 1, 8), F.lit("00 LOT"), F.col("l_suppkey").cast("string"))),
                ],
                F.concat(expiry, F.lit(" LOT"), F.col("l_suppkey").cast("string")),
            ).alias("batch_remark"),
        )

    @cached_property
    def batch_line(self):
        return self._batch_lines().select("doc_type", "doc_id", "location_id", "stock_id", "qty", "batch_remark")

    @cached_property
    def batch_log_line(self):
        return self._batch_lines().select("doc_type", "doc_id", "location_id", "stock_id", "qty", "batch_remark", "doc_date")

    @cached_property
    def purchase_order_line(self):
        b = self._batch_lines().filter((F.col("doc_type") == "SUP_INVOICE") & (F.col("doc_id") % 2 == 0))
        return b.select("doc_id", "stock_id", "uom_id")

    @cached_property
    def supplier_invoice_line(self):
        cost = self.stock_master.select("stock_id", "uom_id", "cost")
        b = self._batch_lines().filter(F.col("doc_type") == "SUP_INVOICE").join(cost, ["stock_id", "uom_id"], "left")
        markup = F.lit(1).cast("decimal(3,2)") + (F.col("l_suppkey") % 5).cast("decimal(3,0)") * F.lit("0.01").cast("decimal(3,2)")
        return b.select(
            "doc_id", "doc_date", "location_id", "stock_id", "uom_id", "qty",
            (F.col("cost") * markup).cast("decimal(20,6)").alias("unit_price"),
            "batch_remark",
        )

    # --- outlet by stock ----------------------------------------------------

    @cached_property
    def outlet_sku(self):
        first = F.add_months(F.trunc(day(self.as_of), "month"), -11)
        back = F.months_between(F.trunc(day(self.as_of), "month"), F.trunc("doc_date", "month")).cast("int")
        rate = F.when(F.col("uom_id") == "BOX", 12).otherwise(1).cast("decimal(4,0)")
        sold = (
            self.sales().filter(F.col("doc_date") >= first)
            .withColumn("back", back).withColumn("q", (F.col("qty") * rate).cast(QTY))
            .groupBy("location_id", "stock_id")
            .agg(*[F.sum(F.when(F.col("back") == i, F.col("q")).otherwise(F.lit(0))).cast(QTY).alias(f"qty_m{i + 1}") for i in range(12)])
        )
        held = self.stock_balance.select("location_id", "stock_id", F.col("balance_qty").alias("current_balance"))
        zero = F.lit(0).cast(QTY)
        months = [f"qty_m{i}" for i in range(1, 13)]
        both = sold.join(held, ["location_id", "stock_id"], "full").select(
            "location_id", "stock_id", F.coalesce("current_balance", zero).alias("current_balance"),
            *[F.coalesce(m, zero).alias(m) for m in months],
        )

        def span(a, b):
            out = F.col(f"qty_m{a}")
            for i in range(a + 1, b + 1):
                out = out + F.col(f"qty_m{i}")
            return out.cast(QTY)

        p = F.substring("stock_id", 2, 20).cast("bigint")
        both = both.select("*", p.alias("p"), span(1, 12).alias("total_12m"), span(1, 6).alias("h1"), span(7, 12).alias("h2"), span(1, 3).alias("r3"))
        tot, bal, h1, h2, r3 = (F.col(c) for c in ("total_12m", "current_balance", "h1", "h2", "r3"))
        both = both.withColumn("outlet_ams", (tot / F.lit(12)).cast(QTY)).withColumn(
            "days_of_inventory",
            F.when(tot > 0, F.try_divide(bal.cast("double") * 360, tot.cast("double"))).otherwise(9999.0).cast(QTY),
        )
        ams, doi = F.col("outlet_ams"), F.col("days_of_inventory")
        tenths = lambda n: F.lit(n).cast("decimal(3,2)")
        trend = F.when(h2 == 0, F.lit(1.0)).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.try_divide(h1.cast("double"), h2.cast("double")))))
        names = self.location.select("location_id", F.col("name").alias("location_name"))
        products = self.star("part").select(F.col("p_partkey").alias("p"), F.upper("p_name").alias("stock_name"))
        # a stored table wherever it is read, so it is materialised here too
        return cut_lineage(
            both.join(names, "location_id", "left").join(products, "p", "left")
            .select(
                "location_id", "location_name", "stock_id", "stock_name", *months, "total_12m", "outlet_ams",
                "current_balance", "days_of_inventory",
                F.when(F.col("p") % 3 == 0, 12).otherwise(1).cast(QTY).alias("order_uom_rate"),
                (ams * tenths("0.7")).cast(QTY).alias("reorder_point"),
                (ams * 3).cast(QTY).alias("max_stock"),
                (ams * 2).cast(QTY).alias("order_up_to_level"),
                trend.cast(QTY).alias("outlet_trend_index"),
                F.lit(None).cast(QTY).alias("pct_of_total"),
                (ams / F.lit(30)).cast(QTY).alias("velocity_daily"),
                (F.col("p") % 10 * F.lit("0.15").cast("decimal(3,2)")).cast(QTY).alias("outlet_cv"),
                F.lit(14).alias("safety_days"),
                F.lit(7).alias("outlet_safety_days"),
                first_match(
                    [
                        (bal <= 0, "STOCKOUT"), (tot <= 0, "REVIEW"),
                        (bal < ams * tenths("0.7"), "ORDER_NOW"), (bal < ams * tenths("1.05"), "ORDER_SOON"),
                        (doi > 180, "STOP_ORDERING"), (doi > 90, "REDUCE_ORDER"),
                    ],
                    "OPTIMAL",
                ).alias("reorder_recommendation"),
                first_match(
                    [
                        (tot <= 0, "DEAD"), (h2 == 0, "NEW"), (h1 > h2 * 3, "STRONG_GROWTH"),
                        (h1 > h2 * tenths("1.2"), "GROWTH"), (h1 * 3 < h2, "STRONG_DECLINE"), (h1 * tenths("1.2") < h2, "DECLINE"),
                    ],
                    "STABLE",
                ).alias("outlet_demand_pattern"),
                first_match([(r3 * 2 > h1, "GAINING"), (r3 * 2 < h1, "LOSING")], "STEADY").alias("outlet_momentum_status"),
                first_match([(ams >= 5, "A"), (ams >= 2, "B")], "C").alias("outlet_abc_class"),
                F.concat(F.lit("V"), (F.col("p") % 7 + 1).cast("string")).alias("outlet_variability_class"),
                F.lit("PCS").alias("base_uom"),
                F.when(F.col("p") % 3 == 0, "BOX").otherwise("PCS").alias("order_uom"),
                first_match([(F.col("p") % 12 < 8, pick(UD1_BY_PART, F.col("p") % 12 % 8)), (F.col("p") % 12 == 8, F.lit(None).cast("string"))], "NA").alias("ud1_code"),
                pick(DEMAND_PATTERNS, F.col("p") % 9).alias("demand_pattern"),
                F.concat(F.lit("V"), (F.col("p") % 7 + 1).cast("string")).alias("variability_class"),
                pick("ABC", F.col("p") % 3).alias("abc_class"),
                pick("ABC", F.col("p") % 3).alias("gp_abc_class"),
                (F.col("p") % 20 != 19).alias("is_active"),
                day(self.as_of).alias("last_updated"),
            )
        )

    # --- people and actions -------------------------------------------------

    @cached_property
    def staff(self):
        s = F.col("s_suppkey")
        home = self.star("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey", "n_name")
        # at most 25 outlets in a region, so each list is bounded
        region = self.star("nation").groupBy("n_regionkey").agg(
            F.sort_array(F.collect_list(F.struct(
                outlet_id(F.col("n_nationkey")).alias("id"),
                F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit(" - "), F.col("n_name")).alias("name"),
            ))).alias("outlets")
        )
        return (
            self.star("supplier").join(home, "s_nationkey").join(region, "n_regionkey")
            .select(
                F.concat(F.lit("U"), s.cast("string")).alias("staff_id"),
                first_match([(s % 6 == 0, "admin"), (s % 6 == 2, "area_manager")], "staff").alias("role"),
                pick(STAFF_GROUPS, s % 6).alias("pos_user_group"),
                (s % 10 != 9).alias("is_active"),
                outlet_id(F.col("s_nationkey")).alias("primary_outlet"),
                F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit(" - "), F.col("n_name")).alias("primary_outlet_name"),
                F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("region"),
                F.col("outlets.id").alias("allowed_outlets"),
                F.col("outlets.name").alias("allowed_outlet_names"),
            )
        )

    @cached_property
    def review_actions(self):
        p = F.col("p_partkey")
        return self.star("part").filter(p % 17 == 0).select(
            F.concat(F.lit("P"), p.cast("string")).alias("stock_id"),
            pick(["APPROVE", "DISMISS", "FLAG"], p % 3).alias("action"),
            F.lit("U1").alias("staff_id"),
            F.when(p % 2 == 1, F.concat(F.lit("note "), p.cast("string"))).alias("notes"),
            day(self.as_of).cast("timestamp").alias("at"),
        )

    @cached_property
    def sku_summary(self):
        """The rebuilt summary plus the fields another system is expected to fill in."""
        from stockloom.plans.monthly import monthly_analysis
        from stockloom.plans.summary import movement_summary

        s = monthly_analysis(movement_summary(self, self.as_of), self, self.as_of)
        p = F.substring("stock_id", 2, 20).cast("bigint")
        rate = F.col("order_uom_rate")
        stamp = day(self.as_of).cast("timestamp")
        return cut_lineage(s.withColumns({
            "order_uom_stock_name": F.col("order_uom_desc"),
            "is_active": p % 20 != 18,
            "demand_pattern": pick(DEMAND_PATTERNS, p % 9),
            "variability_class": F.concat(F.lit("V"), (p % 7 + 1).cast("string")),
            "seasonal_type_new": pick(SEASON_TYPES, p % 5),
            "seasonal_intensity": pick(SEASON_INTENSITY, p % 4),
            "cv_pct": F.col("cv_value") * 100,
            "trend_index": F.lit(1.0) + (p % 10) / 10,
            "momentum_status": pick(["GAINING", "STEADY", "LOSING"], p % 3),
            "momentum_index": F.lit(1.0),
            "ams_calculated": F.col("ams_3m") / rate,
            "ams_base_uom": F.col("ams_3m"),
            "velocity_daily": F.col("ams_3m") / 30,
            "max_stock": F.col("ams_3m") * 3 / rate,
            "order_up_to_level": F.col("ams_3m") * 2 / rate,
            "safety_multiplier": F.lit(1.5),
            "safety_days": F.lit(14),
            "ams_status": F.lit("OK"),
            "ams_action": F.lit(None).cast("string"),
            "gp_abc_class": pick("ABC", p % 3),
            "peak_months": F.lit(None).cast("string"),
            "review_flag": pick(["NEW_ITEM", "AMS_CHECK", None], p % 3),
            "review_reason": F.lit(None).cast("string"),
            "review_priority": F.lit(None).cast("int"),
            "review_notes": F.lit(None).cast("string"),
            "reviewed_at": F.when(p % 12 == 0, stamp),
            "reviewed_by": F.when(p % 12 == 0, F.lit("U1")),
            "active_months": (p % 12).cast("int"),
            "po_supplier_id": F.when(p % 11 != 5, F.concat(F.lit("S"), (p % 10).cast("string"))),
            "po_supplier_source": F.when(p % 5 == 0, "UNKNOWN").otherwise("PO_HISTORY"),
            "po_barcode": F.when(p % 7 == 0, "").otherwise(F.col("barcode")),
            "po_barcode_source": F.when(p % 7 == 0, "NONE").otherwise("MASTER"),
            "po_unit_price": F.when(p % 3 != 0, F.col("unit_cost") * rate),
            "po_price_source": pick(["NONE", "INVOICE_UOM", "INVOICE_ANY"], p % 3),
            "po_price_note": F.lit(None).cast("string"),
            "brand_description": F.col("brand"),
            "po_data_updated_at": stamp,
            "po_last_generated_at": F.when(p % 6 == 0, F.date_sub(day(self.as_of), (p % 40).cast("int")).cast("timestamp")),
        }))
