"""Exact money arithmetic and formatting.

Amounts are stored as DOUBLE and summed as DECIMAL(18,6), so a total does not
depend on how the rows were partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(18,6)"


def exact(amount: Column) -> Column:
    return amount.cast(EXACT)


def total(amount: Column, when: Column | None = None, digits: int = 2) -> Column:
    """Rounded exact sum; NULL when no row qualifies."""
    value = exact(amount)
    if when is not None:
        value = F.when(when, value)
    return F.round(F.sum(value), digits).cast("double")


def mean(amount: Column, digits: int = 2) -> Column:
    """Rounded mean, divided as decimals (half-up)."""
    return F.round(
        F.sum(exact(amount)) / F.count(amount).cast("decimal(20,0)"), digits
    ).cast("double")


def format_money(value: Column) -> Column:
    """Sign for gains, space between thousands, two decimals, euro sign."""
    return F.concat(
        F.when(value > 0, F.lit("+")).otherwise(F.lit("")),
        F.translate(F.format_number(value, 2), ",", " "),
        F.lit(" €"),
    )
