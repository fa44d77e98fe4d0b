"""Statement rows derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import parsing, text
from tallybook.functions.identity import transaction_id
from tallybook.operators.enrich import enrich
from tallybook.schema import UNCATEGORISED

# Fixed values shared with the SQL oracle.
INGESTED_AT = "2002-01-01 08:00:00"
SOURCE_FILE = "lineitem"

_VERBS = [
    "PAIEMENT CB ", "VIR SEPA ", "RETRAIT DAB ", "PRELEVEMENT SEPA ",
    "Transfer to ", "Refund ", "", "Transfer to savings ",
]
_MERCHANTS = [
    "CARREFOUR", "UBER EATS", "SNCF", "NETFLIX", "AMAZON MARKETPLACE",
    "PHARMACIE", "CINEMA UGC", "LOYER", "Frais bancaires", "EDF",
]
_CURRENCIES = ["EUR", "usd"]


#: Session setting: deal the rows of the fixture's main table out to so many partitions. Unset by
#: default; of use where a table is one file of one row group, which Spark reads in one task.
SCAN_PARTITIONS = "spark.tallybook.scanPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(number: Column, values: list[str]) -> Column:
    """``values[number % len(values)]`` as a CASE."""
    slot = number % len(values)
    chain = F
    for i, value in enumerate(values[:-1]):
        chain = chain.when(slot == i, F.lit(value))
    return chain.otherwise(F.lit(values[-1]))


def _slot(number: Column, values: list[str]) -> Column:
    """The place in ``values`` that ``_pick`` takes for a number."""
    slot = (number % len(values)).cast("int")
    return F.when(slot.between(0, len(values) - 2), slot).otherwise(len(values) - 1)


def statements(spark: SparkSession, sf_dir: str, *, many_accounts: bool = False) -> DataFrame:
    """Raw rows: account, date, raw_description, amount, currency."""
    lineitem, part, orders, customer = (
        table(spark, sf_dir, t) for t in ("lineitem", "part", "orders", "customer")
    )
    dealt = spark.conf.get(SCAN_PARTITIONS, None)
    if dealt:
        needed = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate"]
        lineitem = lineitem.select(*needed).repartition(int(dealt), "l_orderkey", "l_linenumber")
    account = (
        F.concat(F.lit("ACC-"), (F.col("o_custkey") % 500).cast("string"))
        if many_accounts
        else F.col("c_mktsegment")
    )
    price = F.col("l_extendedprice")
    # What a line item gives goes through both shuffles as one small number, a day and an amount.
    slots = (_slot(F.col("l_orderkey"), _VERBS), _slot(F.col("l_suppkey"), _MERCHANTS), _slot(F.col("l_linenumber"), _CURRENCIES))
    code = (slots[0] * len(_MERCHANTS) + slots[1]) * len(_CURRENCIES) + slots[2]
    lines = lineitem.select(
        "l_orderkey", "l_partkey", F.col("l_shipdate").cast("date").alias("date"),
        F.when(F.col("l_returnflag") == "R", price).otherwise(-price).alias("amount"), code.cast("smallint").alias("code"),
    )
    # The orders meet their customers first: a line item is shuffled for its order and its part only.
    owners = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", account.alias("account"))
    merchant, currency = F.floor(F.col("code") / len(_CURRENCIES)), F.col("code")
    verb = F.floor(merchant / len(_MERCHANTS))
    return (
        lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "account",
            "date",
            F.concat(_pick(verb, _VERBS), _pick(merchant, _MERCHANTS), F.lit(" "), F.col("p_name")).alias("raw_description"),
            "amount",
            _pick(currency, _CURRENCIES).alias("currency"),
        )
    )


def canonical(spark: SparkSession, sf_dir: str, **kwargs) -> DataFrame:
    return canonical_of(statements(spark, sf_dir, **kwargs))


def canonical_of(statement_rows: DataFrame) -> DataFrame:
    rows = (
        statement_rows
        .withColumn("raw_description", text.strip(F.col("raw_description")))
        .withColumn("__clean", text.clean_description(F.col("raw_description")))
    )
    return rows.select(
        transaction_id(
            F.col("date"), F.col("raw_description"), F.col("amount"), F.col("account")
        ).alias("transaction_id"),
        "date",
        parsing.or_default(F.col("__clean"), "Unknown").alias("description"),
        "raw_description",
        "amount",
        parsing.parse_currency(F.col("currency"), "EUR").alias("currency"),
        F.lit(UNCATEGORISED).alias("category"),
        "account",
        F.lit(SOURCE_FILE).alias("source_file"),
        F.lit(INGESTED_AT).cast("timestamp").alias("ingested_at"),
    )


def transactions(spark: SparkSession, sf_dir: str, **kwargs) -> DataFrame:
    """The enriched table every report runs on."""
    return enrich(canonical(spark, sf_dir, **kwargs))
