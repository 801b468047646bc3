"""Sets of whole numbers as rows of 64 members each, so that distinct counts of batches add up.

A set is one row for each word it uses: (keys, word, bits), where member n is bit n mod 64 of word n div 64.
The union of sets is `bit_or` by key and word, which Spark combines before it shuffles; it
does not matter how often a member is added. A year of days takes at most seven words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def word(member: Column) -> Column:
    return F.floor(member / F.lit(WORD)).cast("int")


def bit(member: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(member, F.lit(WORD)).cast("int"))


def day_number(date: Column) -> Column:
    return F.unix_date(date)


def sets(rows: DataFrame, keys: list[str], member: Column) -> DataFrame:
    """The set of members per key; null members are none."""
    given = rows.select(*keys, member.cast("long").alias("m")).filter("m is not null")
    return given.groupBy(*keys, word(F.col("m")).alias("word")).agg(F.bit_or(bit(F.col("m"))).alias("bits"))


def union(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One set per key from the sets of many batches."""
    return rows.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def _from(least: Column) -> Column:
    """Bits of a word whose members are at least `least`."""
    below = F.greatest(F.lit(0), F.least(F.lit(WORD), least - F.col("word").cast("long") * WORD)).cast("int")
    ones = F.lit(-1).cast("long")
    return F.when(below >= WORD, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", ones, below))


def members(least: Column | None = None) -> Column:
    """Aggregate: members of a key's set, or those that are at least `least`; the set's words must be united."""
    bits = F.col("bits") if least is None else F.col("bits").bitwiseAND(_from(least))
    return F.coalesce(F.sum(F.bit_count(bits)), F.lit(0)).cast("bigint")
