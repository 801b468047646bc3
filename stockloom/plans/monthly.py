"""Monthly analysis: columns added to the summary, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom import config
from stockloom.functions.expr import count_if, day, dbl, first_match, ratio, rnd
from stockloom.operators.facts import period

MONTHS = [f"qty_m{i}" for i in range(1, 13)]


def monthly_pivot(ledger: DataFrame, as_of) -> DataFrame:
    """MON-1: base-unit sales per month, m1 the current one, m12 eleven back.

    The window holds thirteen months but twelve are listed, and a month of net
    returns shows as 0 once the stock sold in any other month.
    """
    this = F.trunc(day(as_of), "month")
    sold = period(ledger, F.add_months(this, -12)).filter(F.col("doc_type").isin(config.SALES_DOC_TYPES))
    per_month = sold.groupBy("stock_id", F.trunc("doc_date", "month").alias("month")).agg(F.sum("root_uom_qty_out").alias("qty"))
    return pivot(per_month, as_of)


def pivot(per_month: DataFrame, as_of) -> DataFrame:
    """MON-1 from month sums (stock_id, month, qty), as plans.closed keeps them."""
    this = F.trunc(day(as_of), "month")
    pick = [
        F.max(F.when(F.col("month") == F.add_months(this, -i), F.col("qty")).otherwise(F.lit(0))).cast("decimal(28,4)").alias(m)
        for i, m in enumerate(MONTHS)
    ]
    return per_month.groupBy("stock_id").agg(*pick)


def add_months(summary: DataFrame, pivot: DataFrame) -> DataFrame:
    """Months on the summary; a stock without ledger rows gets 0."""
    df = summary.join(pivot, "stock_id", "left")
    return df.withColumns({m: F.coalesce(m, F.lit(0)).cast("decimal(28,4)") for m in MONTHS})


def add_ams(df: DataFrame) -> DataFrame:
    """MON-2: mean of the three full months before this one."""
    return df.withColumn("ams_3m", rnd(ratio(F.col("qty_m2") + F.col("qty_m3") + F.col("qty_m4"), F.lit(3)), 2))


def add_seasonality(df: DataFrame) -> DataFrame:
    """MON-3: best over worst month, and the season type from it and the variation."""
    low, high = F.least(*MONTHS), F.greatest(*MONTHS)
    swing, cv = F.col("seasonal_peak_trough_ratio"), F.col("cv_value")
    return df.withColumn("seasonal_peak_trough_ratio", F.when(low > 0, rnd(ratio(high, low), 2))).withColumn(
        "seasonality_type",
        first_match(
            [
                (F.col("ams_3m").isNull() | (F.col("ams_3m") == 0), "DEAD"),
                ((cv > 0.8) & (swing > 5.0), "HIGHLY_SEASONAL"),
                ((cv > 0.5) | (swing > 2.0), "MODERATELY_SEASONAL"),
            ],
            "STABLE",
        ),
    )


def add_velocity(df: DataFrame) -> DataFrame:
    """MON-4: ten a day is fast, one a day medium."""
    ams = F.col("ams_3m")
    return df.withColumn("velocity_category", first_match([(ams >= 300, "FAST"), (ams >= 30, "MEDIUM"), (ams > 0, "SLOW")], "DEAD"))


def add_lead_time(df: DataFrame) -> DataFrame:
    """MON-5: three months for the house brand, else two weeks."""
    house = F.coalesce(F.col("ud1_code") == config.HOUSE_BRAND, F.lit(False))
    return df.withColumns({
        "lead_time_category": F.when(house, "LONG").otherwise("STANDARD"),
        "lead_time_days": F.when(house, 90).otherwise(14).cast("bigint"),
    })


def add_target_doi(df: DataFrame) -> DataFrame:
    """MON-6: days of inventory to aim for."""
    rules = [
        (F.col("ud1_code") == config.HOUSE_BRAND, 120), (F.col("ud1_code") == "FLTF1", 100),
        (F.col("abc_class") == "A", 60), (F.col("abc_class") == "B", 75),
    ]
    return df.withColumn("target_doi", first_match(rules, 90).cast("bigint"))


def add_reorder_point(df: DataFrame) -> DataFrame:
    """MON-7: sales over the lead time and a spare week; NULL when nothing sells."""
    ams = F.col("ams_3m")
    return df.withColumn("reorder_point", F.when(ams > 0, rnd((F.col("lead_time_days") + 7) * ams / 30, 0)))


def add_trend_vs_ams(df: DataFrame) -> DataFrame:
    """MON-8: this week's daily rate against the three-month rate, percent."""
    ams = F.col("ams_3m")
    week = F.col("qty_last_7d")
    return df.withColumn("trend_7d_vs_ams", F.when(ams > 0, rnd(ratio(week * 30 - ams * 7, ams * 7) * 100, 1)))


def add_recommendation(df: DataFrame) -> DataFrame:
    """MON-9: what to do, first rule wins."""
    bal, point = F.col("current_balance"), F.coalesce("reorder_point", F.lit(0.0))
    doi, target = F.col("days_of_inventory"), F.coalesce("target_doi", F.lit(90))
    dead = F.col("velocity_category") == "DEAD"
    return df.withColumn(
        "reorder_recommendation",
        first_match(
            [
                (bal <= 0, "STOCKOUT"),
                (dead & (F.col("abc_class") == "C"), "DELIST_CANDIDATE"),
                (dead, "REVIEW"),
                (bal < point, "ORDER_NOW"),
                (bal < point * 1.5, "ORDER_SOON"),
                (doi > target * 2, "STOP_ORDERING"),
                (doi > target, "REDUCE_ORDER"),
            ],
            "HOLD",
        ),
    )


def add_uom_desc(df: DataFrame, uom: DataFrame) -> DataFrame:
    """MON-10: description of the base unit, where the unit table knows it."""
    names = uom.select(F.col("uom_id").alias("base_uom"), F.col("description").alias("unit_name"))
    return df.join(names, "base_uom", "left").withColumn("base_uom_desc", F.coalesce("unit_name", "base_uom_desc")).drop("unit_name")


def monthly_analysis(summary: DataFrame, T, as_of) -> DataFrame:
    """MON-1 to MON-10 on a movement summary."""
    df = add_months(summary, monthly_pivot(T.stock_ledger, as_of))
    for stage in (add_ams, add_seasonality, add_velocity, add_lead_time, add_target_doi, add_reorder_point, add_trend_vs_ams, add_recommendation):
        df = stage(df)
    df = add_uom_desc(df, T.uom)
    return df.withColumns({m: dbl(m) for m in MONTHS})


def monthly_stats(df: DataFrame) -> DataFrame:
    """MON-11: counts per season type, velocity, recommendation and trend band."""
    trend = F.col("trend_7d_vs_ams")
    is_ = lambda c, v: count_if(F.col(c) == v)
    return df.agg(
        *[is_("seasonality_type", v).alias(v.lower()) for v in ("HIGHLY_SEASONAL", "MODERATELY_SEASONAL", "STABLE", "DEAD")],
        *[is_("velocity_category", v).alias(v.lower()) for v in ("FAST", "MEDIUM", "SLOW")],
        *[is_("reorder_recommendation", v).alias(v.lower()) for v in ("ORDER_NOW", "ORDER_SOON", "STOP_ORDERING")],
        is_("reorder_recommendation", "DELIST_CANDIDATE").alias("delist_candidates"),
        count_if(trend > 50).alias("trend_spike"),
        count_if((trend > 30) & (trend <= 50)).alias("trend_rising"),
        count_if((trend >= -30) & (trend <= 30)).alias("trend_stable"),
        count_if((trend < -30) & (trend >= -50)).alias("trend_declining"),
        count_if(trend < -50).alias("trend_dropping"),
    )
