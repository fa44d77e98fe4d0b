"""Naming an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often ``body`` uses it.

    A stored column (``withColumn``) is not enough where filters are pushed down:
    the optimiser then writes its definition into every place that refers to it.
    """
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)
