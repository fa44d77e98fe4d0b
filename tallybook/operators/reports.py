"""Reports over the enriched table. All of them are lazy.

Every report takes an optional inclusive date range and filters before it
aggregates, so the range prunes year partitions of the stored table.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.money import exact, mean, total
from tallybook.functions.rules import CATEGORY_RULES, Rule, sign_category
from tallybook.operators.enrich import merchant_categories
from tallybook.schema import CATEGORIES

EVENT_COLUMNS = [
    "transaction_id", "date", "description", "amount", "currency",
    "category", "tx_type", "account",
]


def _period() -> Column:
    return F.format_string("%04d-%02d", F.col("year"), F.col("month"))


# -- filters -----------------------------------------------------------------

def real(tx: DataFrame) -> DataFrame:
    return tx.filter(~F.col("is_internal"))


def expenses(tx: DataFrame) -> DataFrame:
    return real(tx).filter(F.col("amount") < 0)


def income(tx: DataFrame) -> DataFrame:
    return real(tx).filter(F.col("amount") > 0)


def date_range(tx: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Inclusive on both ends; also stated on ``year`` so that partitions are pruned."""
    for bound, op in ((start, "__ge__"), (end, "__le__")):
        if bound is not None:
            tx = tx.filter(getattr(F.col("date"), op)(F.lit(bound)))
            if "year" in tx.columns:
                tx = tx.filter(getattr(F.col("year"), op)(F.lit(bound.year)))
    return tx


def month_of(tx: DataFrame, month: str | None) -> DataFrame:
    """Rows of one ``YYYY-MM`` month."""
    if month is None:
        return tx
    year, number = (int(part) for part in month.split("-"))
    return tx.filter((F.col("year") == year) & (F.col("month") == number))


# -- listings ----------------------------------------------------------------

def _listing(tx: DataFrame, month: str | None) -> DataFrame:
    rows = month_of(tx, month).select(*EVENT_COLUMNS)
    return rows.orderBy(F.desc("date"), "transaction_id")


def expense_listing(tx: DataFrame, month: str | None = None) -> DataFrame:
    return _listing(expenses(tx), month)


def income_listing(tx: DataFrame, month: str | None = None) -> DataFrame:
    return _listing(income(tx), month)


# -- totals ------------------------------------------------------------------

def summary(tx: DataFrame) -> DataFrame:
    amount, is_real = F.col("amount"), ~F.col("is_internal")
    return tx.agg(
        F.count("*").alias("total_tx"),
        F.count_if(is_real).alias("real_tx"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        total(amount, is_real & (amount > 0)).alias("total_income"),
        total(amount, is_real & (amount < 0)).alias("total_expenses"),
        total(amount, is_real).alias("net_balance"),
        F.countDistinct("account").alias("accounts"),
    )


def monthly(tx: DataFrame, *, exclude_internal: bool = True) -> DataFrame:
    """Income, expenses, net and row count per account and calendar month."""
    amount = F.col("amount")
    return (
        (real(tx) if exclude_internal else tx)
        .groupBy("account", "year", "month")
        .agg(
            total(amount, amount > 0).alias("income"),
            total(amount, amount < 0).alias("expenses"),
            total(amount).alias("net"),
            F.count("*").alias("tx_count"),
        )
        .withColumn("period", _period())
    )


def monthly_report(
    tx: DataFrame,
    *,
    exclude_internal: bool = True,
    first_period: str | None = None,
    last_period: str | None = None,
) -> DataFrame:
    """``monthly`` in account and month order, for an inclusive ``YYYY-MM`` range."""
    for bound, op in ((first_period, "__ge__"), (last_period, "__le__")):
        if bound is not None:
            year, month = (int(part) for part in bound.split("-"))
            at = F.col("year") * 12 + F.col("month")
            tx = tx.filter(getattr(F.col("year"), op)(year)).filter(getattr(at, op)(year * 12 + month))
    return monthly(tx, exclude_internal=exclude_internal).orderBy("account", "year", "month")


def merchants(tx: DataFrame) -> DataFrame:
    amount = F.col("amount")
    return tx.groupBy(F.col("description").alias("merchant")).agg(
        F.count("*").alias("tx_count"),
        total(amount).alias("total"),
        mean(amount).alias("avg_tx"),
        F.min("date").alias("first_seen"),
        F.max("date").alias("last_seen"),
    )


def top_merchants(tx: DataFrame, n: int = 20, *, expenses_only: bool = True) -> DataFrame:
    """The ``n`` merchants with the lowest (most negative) total."""
    rows = expenses(tx) if expenses_only else real(tx)
    return merchants(rows).orderBy("total", "merchant").limit(n)


def merchant_totals(tx: DataFrame) -> DataFrame:
    return merchants(expenses(tx)).drop("first_seen", "last_seen")


def merchant_spend(
    tx: DataFrame, n: int = 20, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Top merchants by spend within a date range, as positive figures."""
    top = top_merchants(date_range(tx, start, end), n)
    return top.select(
        "merchant",
        "tx_count",
        F.abs("total").alias("total_abs"),
        F.abs("avg_tx").alias("mean_abs"),
    )


def tx_types(tx: DataFrame) -> DataFrame:
    return (
        real(tx)
        .groupBy("tx_type")
        .agg(F.count("*").alias("tx_count"), total(F.col("amount")).alias("total"))
        .orderBy(F.desc("tx_count"), "tx_type")
    )


def daily_balance(
    tx: DataFrame, *by: str, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Net per day and running total since the first row; the range cuts afterwards.

    The window sees one row per day (and group), never the transactions.
    """
    days = real(tx).groupBy(*by, "date").agg(F.sum(exact(F.col("amount"))).alias("__net"))
    so_far = (Window.partitionBy(*by) if by else Window).orderBy("date")
    running = days.select(
        *by,
        "date",
        F.round("__net", 2).cast("double").alias("daily_net"),
        F.round(F.sum("__net").over(so_far), 2).cast("double").alias("cumulative"),
    )
    return date_range(running, start, end)


# -- categories --------------------------------------------------------------

def _category_totals(
    rows: DataFrame, label: str | None, *by: str, category_rules: Sequence[Rule]
) -> DataFrame:
    """Exact sum and count per category (and ``by``).

    Without a label column the rules decide. They run after a first aggregate by
    merchant and sign, so once per merchant instead of once per row.
    """
    amount = exact(F.col("amount"))
    if label is not None:
        return rows.groupBy(*by, F.col(label).alias("category")).agg(
            F.sum(amount).alias("__sum"), F.count("*").alias("tx_count")
        )
    merchants_ = rows.groupBy(*by, "description", F.signum("amount").alias("__sign")).agg(
        F.sum(amount).alias("__sum"), F.count("*").alias("__count")
    )
    labelled = merchant_categories(merchants_, "category", category_rules).withColumn(
        "category", F.coalesce("category", sign_category(F.col("__sign")))
    )
    return labelled.groupBy(*by, "category").agg(
        F.sum("__sum").alias("__sum"), F.sum("__count").alias("tx_count")
    )


def _rounded(value: str, digits: int = 2) -> Column:
    return F.round(value, digits).cast("double")


def by_category(
    tx: DataFrame,
    label: str | None = None,
    start: date | None = None,
    end: date | None = None,
    category_rules: Sequence[Rule] = tuple(CATEGORY_RULES),
) -> DataFrame:
    """Spend per category as positive totals, largest first, with share of the whole."""
    rows = expenses(date_range(tx, start, end))
    totals = _category_totals(rows, label, category_rules=category_rules)
    # One row per category is left, so this window is tiny.
    whole = F.sum("__sum").over(Window.partitionBy())
    return totals.select(
        "category",
        F.abs(_rounded("__sum")).alias("total"),
        "tx_count",
        F.round(F.col("__sum").cast("double") / whole.cast("double") * 100, 4).alias("share_pct"),
    ).orderBy(F.desc("total"), "category")


def category_month_pivot(
    tx: DataFrame,
    label: str | None = None,
    start: date | None = None,
    end: date | None = None,
    category_rules: Sequence[Rule] = tuple(CATEGORY_RULES),
) -> DataFrame:
    """Spend per month, one column per category, whole euros, 0 where none."""
    rows = expenses(date_range(tx, start, end)).withColumn("period", _period())
    totals = _category_totals(rows, label, "period", category_rules=category_rules)
    wide = totals.groupBy("period").pivot("category", CATEGORIES).agg(F.sum("__sum"))
    return wide.select(
        "period",
        *[F.coalesce(F.abs(_rounded(f"`{c}`", 0)), F.lit(0.0)).alias(c) for c in CATEGORIES],
    )


def category_summary(
    tx: DataFrame,
    label: str | None = None,
    category_rules: Sequence[Rule] = tuple(CATEGORY_RULES),
) -> DataFrame:
    """Count and signed total of real expenses per category."""
    totals = _category_totals(expenses(tx), label, category_rules=category_rules)
    return totals.select("category", "tx_count", _rounded("__sum").alias("total")).orderBy(
        "total", "category"
    )


def top_categories(
    tx: DataFrame,
    n: int = 5,
    label: str | None = None,
    category_rules: Sequence[Rule] = tuple(CATEGORY_RULES),
) -> DataFrame:
    """The ``n`` categories with the largest outflow, own-account moves included."""
    rows = tx.filter(F.col("amount") < 0)
    totals = _category_totals(rows, label, category_rules=category_rules)
    return totals.select("category", _rounded("__sum").alias("total")).orderBy(
        "total", "category"
    ).limit(n)


def label_distribution(
    tx: DataFrame,
    label: str | None = None,
    category_rules: Sequence[Rule] = tuple(CATEGORY_RULES),
) -> DataFrame:
    totals = _category_totals(tx, label, category_rules=category_rules)
    return totals.select("category", "tx_count").orderBy(F.desc("tx_count"), "category")


def category_detail(
    tx: DataFrame, label: str, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Expense rows with their category, newest first."""
    rows = expenses(date_range(tx, start, end))
    return rows.select("date", "description", "amount", F.col(label).alias("category")).orderBy(
        F.desc("date"), "description", "amount"
    )
