"""Ranks, quantiles and top-k over all rows without a one-task window."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.operators.skew import attach_group_stats
from tallybook.session import reliable_checkpoint


# Ranges that values are cut into at a time, and distinct values that are looked at one by one.
RANGES = 256
FEW_VALUES = 4096


def _bucketed(values: DataFrame, by: str, buckets: int) -> DataFrame:
    """Add ``__bucket``: ranges of distinct values in SQL order, NULL first and NaN last."""
    probabilities = [i / buckets for i in range(1, buckets)]
    cuts = values.approxQuantile(by, probabilities, 0.25 / buckets) if probabilities else []
    splits = [-math.inf, *sorted({c for c in cuts if math.isfinite(c)}), math.inf]
    if len(splits) == 2:
        splits.insert(1, 0.0)
    ranged = Bucketizer(splits=splits, inputCol=by, outputCol="__bucket", handleInvalid="keep").transform(values)
    return ranged.withColumn("__bucket", F.when(F.col(by).isNull(), -1.0).otherwise(F.col("__bucket")))


def min_rank(
    df: DataFrame,
    by: str,
    spread_by: str,
    rank_col: str = "rank",
    rows_per_range: int = 1_000_000,
) -> DataFrame:
    """SQL ``rank() over (order by by)`` for a DOUBLE column, NULL first and NaN last.

    Rows are first counted per distinct value, so ties cost nothing. The values
    are cut into ranges, as many as the number of values asks for; each range is
    summed up in its own task, and the range totals give the offsets.
    """
    # Equal for equal values: Spark joins NaN to NaN, and NULL has a mark of its own.
    keys = ["__value", "__none"]
    keyed = df.withColumns({"__value": F.coalesce(F.col(by).cast("double") + F.lit(0.0), F.lit(0.0)), "__none": F.col(by).isNull()})
    counts = reliable_checkpoint(
        keyed.groupBy(*keys).agg(F.first(by).alias("__by"), F.count("*").alias("__rows"))
    )
    values = _bucketed(counts, "__by", math.ceil(counts.count() / rows_per_range) + 1)

    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per range, so this ordered window and the broadcast are small.
    offsets = (
        values.groupBy("__bucket")
        .agg(F.sum("__rows").alias("__range_rows"))
        .select("__bucket", F.coalesce(F.sum("__range_rows").over(before), F.lit(0)).alias("__offset"))
    )
    inside = (
        Window.partitionBy("__bucket").orderBy("__by").rowsBetween(Window.unboundedPreceding, -1)
    )
    ranks = (
        values.withColumn("__inside", F.coalesce(F.sum("__rows").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "__bucket")
        .select(*keys, "__rows", (F.col("__inside") + F.col("__offset") + 1).alias(rank_col))
    )
    return attach_group_stats(keyed, ranks, keys, "__rows", spread_by).drop("__rows", *keys)


def exact_quantile(df: DataFrame, by: str, q: float) -> float:
    """Linearly interpolated quantile of a DOUBLE column, exact at any size; NULL and NaN are left out.

    Rows are counted per distinct value. The values are cut into RANGES ranges, and only
    those that hold the wanted positions are looked at again, until FEW_VALUES are left.
    """
    known = df.select(by).filter(F.col(by).isNotNull() & ~F.isnan(by))
    values = reliable_checkpoint(known.groupBy(by).agg(F.count("*").alias("__rows")))
    rows, distinct = values.agg(F.sum("__rows"), F.count("*")).first()
    if not rows:
        raise ValueError("quantile of an empty column")
    position = q * (rows - 1)
    wanted = [math.floor(position), min(math.floor(position) + 1, rows - 1)]

    below = 0
    while distinct > FEW_VALUES:
        ranges = (
            _bucketed(values, by, RANGES).groupBy("__bucket")
            .agg(F.sum("__rows").alias("rows"), F.count("*").alias("n"), F.min(by).alias("low"), F.max(by).alias("high"))
            .orderBy("__bucket").collect()
        )
        held, at = [], below
        for r in ranges:
            if any(at <= w < at + r.rows for w in wanted):
                held.append((r, at))
            at += r.rows
        values = values.filter(F.col(by).between(held[0][0].low, held[-1][0].high))
        below, distinct = held[0][1], sum(r.n for r, _ in held)

    found, at = [], below
    for r in values.orderBy(by).collect():  # FEW_VALUES rows at most
        found += [r[by]] * sum(at <= w < at + r["__rows"] for w in wanted)
        at += r["__rows"]
    low, high = found[0], found[-1]
    return low + (high - low) * (position - wanted[0])


def lowest_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The ``k`` first rows in the given order (each task keeps only ``k``)."""
    return df.orderBy(*order).limit(k)
