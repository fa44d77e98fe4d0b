"""Table schemas, fixed category list and contract checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CANONICAL = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("raw_description", T.StringType()),
    T.StructField("amount", T.DoubleType(), False),
    T.StructField("currency", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("account", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
])

ENRICHED = T.StructType(CANONICAL.fields + [
    T.StructField("tx_type", T.StringType()),
    T.StructField("is_internal", T.BooleanType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("week", T.IntegerType()),
    T.StructField("day_of_week", T.IntegerType()),
])

# The spending categories, in report order.
CATEGORIES = [
    "Alimentation", "Restauration", "Transport", "Abonnements",
    "Shopping", "Beauté", "Loisirs", "Loyer", "Virements",
    "Revenus", "Autre",
]

UNCATEGORISED = "Uncategorized"


class ContractError(ValueError):
    """A DataFrame does not carry the columns an operator needs."""


def require_columns(df: DataFrame, schema: T.StructType = CANONICAL) -> DataFrame:
    """Check names and types against ``schema``; the plan itself is unchanged."""
    present = {f.name: f.dataType for f in df.schema.fields}
    missing = sorted(set(schema.names) - set(present))
    if missing:
        raise ContractError(f"missing required columns: {missing}")
    wrong = {
        f.name: f"{present[f.name].simpleString()} instead of {f.dataType.simpleString()}"
        for f in schema.fields
        if present[f.name] != f.dataType
    }
    if wrong:
        raise ContractError(f"columns of the wrong type: {wrong}")
    return df


def empty_canonical(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CANONICAL)
