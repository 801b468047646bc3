"""Column helpers shared by the operators.

Quantities and money are summed as decimals, so a total never depends on the
order in which tasks finish; ratios and scores are doubles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

QTY = "decimal(18,4)"
_ROUNDING = "decimal(38,10)"


def dbl(c) -> Column:
    return _col(c).cast("double")


def lng(c) -> Column:
    return _col(c).cast("bigint")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c, n: int) -> Column:
    """Round half up on the decimal value (0.125 -> 0.13), as double."""
    return F.round(_col(c).cast(_ROUNDING), n).cast("double")


def ratio(a, b) -> Column:
    """a / b as double, NULL when b is zero or NULL."""
    return F.try_divide(dbl(a), dbl(b))


def total(c) -> Column:
    """Exact sum, delivered as double."""
    return F.sum(_col(c)).cast("double")


def total_if(cond: Column, c) -> Column:
    """Exact sum over the rows that meet cond; 0 when none does."""
    return F.sum(F.when(cond, _col(c)).otherwise(F.lit(0))).cast("double")


def count_if(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")


def first_match(rules, default=None) -> Column:
    """CASE over (condition, value) pairs, first one wins."""
    (cond, value), *rest = rules
    chain = F.when(cond, F.lit(value) if not isinstance(value, Column) else value)
    for cond, value in rest:
        chain = chain.when(cond, F.lit(value) if not isinstance(value, Column) else value)
    if default is None:
        return chain
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def lookup(c, table: dict, default) -> Column:
    """Map a column through a small constant table."""
    return first_match([(_col(c) == k, v) for k, v in table.items()], default)


def steps_at_least(c, steps) -> Column:
    """Points for the first (floor, points) step the value reaches."""
    *rules, (_, last) = steps
    return first_match([(_col(c) >= floor, points) for floor, points in rules], last)


def steps_below(c, steps) -> Column:
    """Label of the first (ceiling, label) step the value stays under."""
    *rules, (_, last) = steps
    return first_match([(_col(c) < ceiling, label) for ceiling, label in rules], last)


def contains_any(c, words) -> Column:
    """True when the upper-cased text holds one of the words."""
    text = F.upper(_col(c))
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def stddev_from_sums(n, s, q) -> Column:
    """Sample deviation from count, sum and sum of squares; NULL below two.

    Built on exact sums, so unlike a merged running variance it is the same
    whatever the partitioning.
    """
    n, s, q = dbl(n), dbl(s), dbl(q)
    spread = F.greatest(n * q - s * s, F.lit(0.0))
    return F.when(n >= 2, F.sqrt(spread / (n * (n - F.lit(1.0)))))


def day(d) -> Column:
    return F.lit(d).cast("date")


def days_before(as_of, n: int) -> Column:
    return F.date_sub(day(as_of), n)


def like_text(columns, text: str) -> Column:
    """Case-insensitive "contains" over several columns."""
    needle = "%" + text + "%"
    return reduce(lambda a, b: a | b, [F.ilike(F.col(c), F.lit(needle)) for c in columns])


def top(df, *order, limit=None):
    """Ordered report, cut to its first rows when a limit is given."""
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)
