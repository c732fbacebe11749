"""Comparisons that rounding does not decide.

Two figures that are equal in exact arithmetic, such as a close that is the mean of its window or
the band widths of two windows with the same closes in another order, differ in their last bits
as doubles, either way. They count as equal here.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

RELATIVE = 1e-10


def exceeds(a: Column, b: Column) -> Column:
    """``a`` is larger than ``b`` by more than rounding."""
    return a - b > F.abs(b) * RELATIVE


def difference(a: Column, b: Column) -> Column:
    """``a - b``, and zero where only rounding tells them apart."""
    return F.when(~exceeds(a, b) & ~exceeds(b, a), F.lit(0.0)).otherwise(a - b)


COLUMN_OPS = {
    ">": exceeds,
    ">=": lambda a, b: ~exceeds(b, a),
    "<": lambda a, b: exceeds(b, a),
    "<=": lambda a, b: ~exceeds(a, b),
}
