"""Running shares and ranks over a whole ordered column, without a one-task sort.

A plain ordered window would pull every row into one task. Here rows are dealt into ranges
of the order that are fitted to the data: the bounds are quantiles of a sample of the rows, those of
the smallest key hashes, so the same rows always give the same bounds, however
often and wherever a branch is computed. Ranges are about equally full whatever the values, as the order goes on
by key within equal values: a value that a third of all rows share is cut into
several ranges like any other. One exchange brings the rows of a range together, a window sums them up,
and one number for each range, what lies before it, completes the sum.

Equal values share their running total. Only those at a bound can lie in two ranges, so
each range also counts its rows that equal its lower bound's value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.expr import dbl, first_match

#: Sampled rows for each range: with 32, few ranges are over 1.6 times the mean.
SAMPLED = 32
MONEY = "decimal(38,4)"


def _place(key: str, value: str):
    """What rows are ordered by: value descending, the key's hash prefix, the key."""
    return F.struct((-F.col(value)).alias("v"), F.substring(F.md5(key), 1, 2).alias("h"), F.col(key).alias("k"))


def range_bounds(df: DataFrame, place, key: str, ranges: int):
    """Upper bounds of all ranges but the last, as one array: at most `ranges` entries, whatever the data."""
    sample = df.select(place.alias("p"), F.xxhash64(key).alias("x")).orderBy("x", "p").limit(ranges * SAMPLED)
    ordered = sample.agg(F.sort_array(F.collect_list("p")).alias("p"))
    every = F.filter("p", lambda x, i: (i + 1) % SAMPLED == 0)
    return ordered.select(every.alias("bounds")).scalar()


def range_number(place, bounds, ranges: int):
    """How many bounds lie below a place, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(ranges.bit_length()))])
    # a bound that does not exist compares as null and is not below
    return F.aggregate(steps, F.lit(0), lambda low, step: low + F.when(F.get(bounds, low + step - 1) < place, step).otherwise(0))


def ranged(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with a positive value plus rank, running_total (ties share it), grand_total and total_rows.

    Keys are unique. The rows are read for the bounds, for the totals and for the result; a frame
    that is not reduced yet is better stored or checkpointed before.
    """
    ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.filter(F.col(value) > 0)
    place = _place(key, value)
    bounded = rows.withColumn("bounds", range_bounds(rows, place, key, ranges)).withColumn("place", place)
    dealt = bounded.withColumn("part", range_number(F.col("place"), F.col("bounds"), ranges))
    # the value of the bound below a range and of its own upper bound
    below = F.when(F.col("part") > 0, -F.get("bounds", F.col("part") - 1)["v"])
    above = -F.get("bounds", F.col("part"))["v"]
    offsets = _offsets(dealt.withColumn("below", below), value)
    inside = Window.partitionBy("part").orderBy(F.desc("v"), "h", "k")
    equal = Window.partitionBy("part").orderBy(F.desc("v"))
    order = [F.col(value).alias("v"), F.col("place.h").alias("h"), F.col("place.k").alias("k")]
    run = (
        dealt.select(*df.columns, "part", above.alias("above"), *order)
        .withColumn("row", F.row_number().over(inside))
        .withColumn("run", F.sum("v").over(equal))  # equal values of the range included
        .join(F.broadcast(offsets), "part")
    )
    later = F.when((F.col("v") == F.col("above")) & (F.col("v") == F.col("next_below")), F.col("later")).otherwise(F.lit(0))
    return run.select(
        *df.columns, (F.col("rows_before") + F.col("row")).cast("bigint").alias("rank"),
        (F.col("sum_before") + F.col("run") + later).cast(MONEY).alias("running_total"), F.col("grand_total").cast(MONEY).alias("grand_total"), "total_rows",
    )


def _offsets(dealt: DataFrame, value: str) -> DataFrame:
    """Per range what lies before it, the totals, and the equals of its last value in later ranges; one row a range."""
    tied = F.col(value) == F.col("below")
    per = dealt.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).cast(MONEY).alias("s"), F.first("below").alias("below"), F.sum(F.when(tied, F.col(value)).otherwise(F.lit(0))).cast(MONEY).alias("tied")
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    onward = Window.partitionBy("below").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0)
    tails = per.withColumn("tail", F.sum("tied").over(onward))
    nextwards = Window.orderBy("part")
    return tails.select(
        "part", F.coalesce(F.sum("n").over(earlier), zero).alias("rows_before"), F.coalesce(F.sum("s").over(earlier), zero).alias("sum_before"),
        F.sum("s").over(whole).alias("grand_total"), F.sum("n").over(whole).alias("total_rows"),
        F.lead("below").over(nextwards).alias("next_below"), F.coalesce(F.lead("tail").over(nextwards), zero).alias("later"),
    )


def number_rows(df: DataFrame, group: str, place, key: str) -> DataFrame:
    """Rows plus row_num, their place in their group from 1 on, and part, the range they were numbered in.

    `place` is a struct of the group and what its rows are ordered by; rows that are equal in it are numbered in
    any order. Ranges run over all groups, so a group that holds a third of the rows is cut into several. `key` spreads the
    sample that the ranges are fitted to; it is unique.
    """
    ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn("bounds", range_bounds(df, place, key, ranges)).withColumn("place", place)
    dealt = dealt.withColumn("part", range_number(F.col("place"), F.col("bounds"), ranges)).drop("bounds")
    # ranges and groups meet in at most as many rows as there are of both
    sizes = dealt.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part", group).orderBy("place")
    numbered = dealt.withColumn("row", F.row_number().over(inside)).join(starts, [group, "part"])
    return numbered.select(*df.columns, "part", (F.col("row") + F.col("before")).cast("bigint").alias("row_num"))


def cumulative_by_value(df: DataFrame, value: str, key: str = "stock_id") -> DataFrame:
    """Per distinct positive value: the running total including its ties."""
    return ranged(df.select(key, value), key, value).select(value, "running_total").distinct()


def abc_label(share):
    """A up to 80 % of the running share, B up to 95 %, else C: the item that crosses 80 % is B."""
    return first_match([(share <= 0.80, "A"), (share <= 0.95, "B")], "C")


def _share():
    return F.try_divide(dbl("running_total"), dbl("grand_total"))


def add_abc(df: DataFrame, value: str, key: str = "stock_id") -> DataFrame:
    """Rows with a positive value plus rank, running_total, grand_total, total_rows, share and abc_class.

    Ties share a running total.
    """
    return ranged(df, key, value).withColumn("share", _share()).withColumn("abc_class", abc_label(F.col("share")))


def add_rank(df: DataFrame, key: str, value: str) -> DataFrame:
    """1-based rank by value descending; ties by the key's hash prefix, then the key."""
    return ranged(df.drop("rank", "running_total", "grand_total", "total_rows"), key, value).drop("running_total", "grand_total", "total_rows")


def abc_limits(df: DataFrame, key: str, value: str):
    """Least values of class A and of class B, as one struct (a, b); null where no row is in the class.

    The share rises as values fall, so a class is a range of values, and rows need not be moved to be labelled.
    """
    shares = ranged(df.select(key, value), key, value).withColumn("share", _share())
    least = lambda top: F.min(F.when(F.col("share") <= top, F.col(value)))
    return shares.agg(F.struct(least(0.80).alias("a"), least(0.95).alias("b")).alias("limits")).scalar()


def class_of(value: str, limits):
    """The class of a value against abc_limits; null unless it is positive."""
    v = F.col(value)
    return F.when(v > 0, first_match([(v >= limits["a"], "A"), (v >= limits["b"], "B")], "C"))
