"""Column arithmetic that keeps exact sums exact until one final division.

Counts and sums of whole numbers and decimals do not depend on the order in
which tasks finish. Dividing once, at the end, gives the same double on every
run and keeps ties on a threshold where they belong.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = "decimal(38,0)"


def whole(value: Column) -> Column:
    """An integer column widened so that products of sums do not overflow."""
    return value.cast(WHOLE)


def ratio(top: Column, bottom: Column) -> Column:
    """Double quotient, NULL where the divisor is zero or NULL."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def amount_ratio(top: Column, bottom: Column) -> Column:
    """Quotient of an amount with two decimal places.

    Most such amounts have no exact double. Counted in hundredths both sides are
    whole numbers, and a quotient that ends on a half still rounds as one.
    """
    return ratio(whole(top * 100), whole(bottom) * 100)


def mean_gap(left_sum: Column, left_rows: Column, right_sum: Column, right_rows: Column) -> Column:
    """mean(left) - mean(right) from sums and counts, divided once."""
    left_rows, right_rows = whole(left_rows), whole(right_rows)
    return amount_ratio(left_sum * right_rows - right_sum * left_rows, left_rows * right_rows)


def mean_ratio(top_sum: Column, top_rows: Column, bottom_sum: Column, bottom_rows: Column) -> Column:
    """mean(top) / mean(bottom) from sums and counts, divided once."""
    return ratio(top_sum * whole(bottom_rows), bottom_sum * whole(top_rows))


def mean_product(left_sum: Column, left_rows: Column, right_sum: Column, right_rows: Column) -> Column:
    """mean(left) * mean(right) from sums and counts, divided once."""
    return amount_ratio(left_sum * right_sum, whole(left_rows) * whole(right_rows))


def scaled_spread(rows: Column, total: Column, squares: Column) -> Column:
    """rows * population deviation, from count, sum and sum of squares.

    Under the root stands a whole number, so equal values give exactly zero. The
    product fits 38 digits while rows * |value| stays below 1e19; past that Spark
    raises an overflow error under ANSI mode rather than return a wrong number.
    """
    return F.sqrt((whole(rows) * whole(squares) - whole(total) * whole(total)).cast("double"))


def larger(left: Column, right: Column) -> Column:
    """The larger of two, NULL when either is NULL (Spark's greatest skips NULLs)."""
    return F.when(left.isNotNull() & right.isNotNull(), F.greatest(left, right))


def whole_text(value: Column) -> Column:
    """A value rounded to units, as text without a decimal point."""
    return F.round(value, 0).cast("bigint").cast("string")
