"""Derived columns of the stored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import rules
from tallybook.functions.rules import Rule
from tallybook.schema import ENRICHED, require_columns


def calendar_parts(date: Column) -> dict[str, Column]:
    """Calendar year and month, ISO week (so 30 December may be week 1), Monday = 0."""
    return {
        "year": F.year(date),
        "month": F.month(date),
        "week": F.weekofyear(date),
        "day_of_week": F.weekday(date),
    }


def enrich(
    df: DataFrame,
    *,
    type_rules: Sequence[Rule] = tuple(rules.TYPE_RULES),
    internal_patterns: Sequence[str] = tuple(rules.INTERNAL_PATTERNS),
) -> DataFrame:
    raw = F.coalesce("raw_description", F.lit(""))
    return (
        require_columns(df)
        .withColumn("__folded", rules.fold(raw))
        .withColumns({
            "tx_type": rules.tx_type(F.col("__folded"), type_rules),
            "is_internal": rules.is_internal(raw, internal_patterns),
            **calendar_parts(F.col("date")),
        })
        .select(*ENRICHED.names)
    )


def merchant_categories(
    merchants: DataFrame,
    name: str = "merchant_category",
    category_rules: Sequence[Rule] = tuple(rules.CATEGORY_RULES),
) -> DataFrame:
    """Add the category the description alone decides (NULL: left to the sign)."""
    # Exploded, so that a filter on the category is not pushed below it: there each of some hundred
    # tests would hold copies of all that works out the description, too much for the planner.
    label = F.explode(F.array(rules.merchant_category(F.col("__folded"), category_rules))).alias(name)
    return (
        merchants.withColumn("__folded", rules.fold(F.col("description")))
        .select(*[F.col(f"`{c}`") for c in merchants.columns if c != name], "__folded", label)
        .drop("__folded")
    )


def with_rule_category(
    df: DataFrame,
    name: str = "rule_category",
    category_rules: Sequence[Rule] = tuple(rules.CATEGORY_RULES),
) -> DataFrame:
    """Rule cascade per row, the sign of the amount as the last resort."""
    return merchant_categories(df, name, category_rules).withColumn(
        name, F.coalesce(name, rules.sign_category(F.col("amount")))
    )
