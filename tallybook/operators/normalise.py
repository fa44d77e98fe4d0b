"""Raw string rows -> canonical rows, quarantine and counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions import parsing, text
from tallybook.functions.binding import let
from tallybook.functions.identity import transaction_id
from tallybook.schema import CANONICAL, UNCATEGORISED
from tallybook.sources.profiles import SchemaProfile

EMPTY_AMOUNTS = "both debit and credit are empty/zero"


def _cell(df: DataFrame, name: str | None) -> Column:
    """Column ``name`` whatever its case; blank where the file has none."""
    if name:
        for present in df.columns:
            if present.strip().lower() == name.lower():
                return F.coalesce(df[f"`{present}`"], F.lit(""))
    return F.lit("")


def debit_credit(debit: Column, credit: Column) -> Column:
    """Money in is positive, money out negative."""
    return credit - debit


#: What a layout's columns mean; the cells that `normalise_cells` reads.
ROLES = ["date", "text", "signed", "outgoing", "incoming", "category", "currency"]


def normalise(
    df: DataFrame,
    profile: SchemaProfile,
    *,
    account: Column,
    source_file: Column,
    ingested_at: Column | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """All canonical columns plus ``errors`` and ``warnings``, one row per input row of one layout.

    ``keep`` names further input columns to carry along (row text, row order).
    """
    cells = F.struct(*[_cell(df, getattr(profile.columns, role)).alias(role) for role in ROLES])
    return normalise_cells(
        df, [profile], cells, account=account, source_file=source_file, ingested_at=ingested_at, keep=keep
    )


def _by_layout(profiles: list[SchemaProfile], name: Column | None, key: Callable, value: Callable) -> Column:
    """``value`` of each row's layout; layouts of one ``key`` share an expression."""
    groups: dict = {}
    for profile in profiles:
        groups.setdefault(key(profile), []).append(profile)
    found = [(members, value(members[0])) for members in groups.values()]
    out = found[-1][1]
    for members, column in reversed(found[:-1]):
        out = F.when(name.isin([p.name for p in members]), column).otherwise(out)
    return out


def normalise_cells(
    df: DataFrame,
    profiles: list[SchemaProfile],
    cells: Column,
    *,
    name: Column | None = None,
    account: Column,
    source_file: Column,
    ingested_at: Column | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """The same for rows of several layouts at once; ``name`` tells each row's.

    ``cells`` is a struct of ROLES, blank where a file lacks the column. The plan grows with
    the number of different formats among the layouts, not with headers or files.
    """
    staged = df.withColumn("__cells", cells)
    cell = {role: F.coalesce(F.col(f"__cells.{role}"), F.lit("")) for role in ROLES}

    def choose(key: Callable, value: Callable) -> Column:
        return _by_layout(profiles, name, key, value)

    def money(profile: SchemaProfile) -> Column:
        """(value, error)"""
        numbers = profile.numbers

        def parsed(text_: Column) -> Column:
            return parsing.parse_amount(text_, numbers.decimal, numbers.thousands)

        if profile.columns.signed:
            return let(parsed(cell["signed"]), lambda v: F.struct(
                v.alias("value"), parsing.amount_error(cell["signed"], v).alias("error")
            ))
        out = F.abs(parsed(cell["outgoing"])) if numbers.unsigned_outgoing else parsed(cell["outgoing"])
        both = F.struct(out.alias("out"), parsed(cell["incoming"]).alias("come"))
        return let(both, lambda v: F.struct(
            debit_credit(v["out"], v["come"]).alias("value"),
            F.coalesce(
                parsing.amount_error(cell["outgoing"], v["out"]),
                parsing.amount_error(cell["incoming"], v["come"]),
                F.when((v["out"] == 0) & (v["come"] == 0), F.lit(EMPTY_AMOUNTS)),
            ).alias("error"),
        ))

    raw = text.strip(cell["text"])
    staged = staged.withColumns({
        "__date": choose(lambda p: p.dates, lambda p: parsing.parse_date(cell["date"], list(p.dates))),
        "__money": choose(lambda p: (bool(p.columns.signed), p.numbers), money),
        # A layout without a currency column always takes its default.
        "__currency": choose(
            lambda p: (bool(p.columns.currency), p.currency),
            lambda p: parsing.parse_currency(cell["currency"], p.currency) if p.columns.currency else F.lit(p.currency),
        ),
        "__raw": raw,
    })
    # Exploded, so that each cell is parsed once: a filter on errors would otherwise be pushed below,
    # and with it a copy of every parser for each place where it names a cell.
    parsed = ["__date", "__money", "__currency", "__raw"]
    staged = (
        staged.withColumn("__parsed", F.struct(*parsed)).drop(*parsed)
        .select("*", F.inline(F.array("__parsed"))).drop("__parsed")
        .withColumn("__clean", text.clean_description(F.col("__raw")))
    )
    no_text = F.col("__clean") == ""
    return staged.select(
        transaction_id(F.col("__date"), F.col("__raw"), F.col("__money.value"), account).alias("transaction_id"),
        F.col("__date").alias("date"),
        F.when(no_text, F.lit("Unknown")).otherwise(F.col("__clean")).alias("description"),
        F.col("__raw").alias("raw_description"),
        F.col("__money.value").alias("amount"),
        F.col("__currency").alias("currency"),
        parsing.or_default(cell["category"], UNCATEGORISED).alias("category"),
        account.alias("account"),
        source_file.alias("source_file"),
        (F.current_timestamp() if ingested_at is None else ingested_at).alias("ingested_at"),
        F.filter(
            F.array(parsing.date_error(cell["date"], F.col("__date")), F.col("__money.error")),
            lambda e: e.isNotNull(),
        ).alias("errors"),
        F.filter(
            F.array(F.when(no_text, F.lit("empty description, using 'Unknown'"))),
            lambda w: w.isNotNull(),
        ).alias("warnings"),
        *(keep or []),
    )


def good_rows(normalised: DataFrame, *extra: str) -> DataFrame:
    return normalised.filter(F.size("errors") == 0).select(*CANONICAL.names, *extra)


def quarantine(normalised: DataFrame, row_text: str = "raw_description") -> DataFrame:
    """Rows that could not be read, with the first reason and all of them."""
    bad = normalised.filter(F.size("errors") > 0)
    return bad.select(
        "source_file",
        F.col(row_text).alias("row_text"),
        F.element_at("errors", 1).alias("reason"),
        "errors",
    )


def ingest_metrics(normalised: DataFrame, *by: str) -> DataFrame:
    """Per source: rows read, dropped, kept after dedup, and warnings."""
    ok = F.size("errors") == 0
    return normalised.groupBy(*(by or ("source_file",))).agg(
        F.count("*").alias("rows_read"),
        F.count_if(~ok).alias("rows_dropped"),
        F.countDistinct(F.when(ok, F.col("transaction_id"))).alias("rows_after_dedup"),
        F.coalesce(F.sum(F.when(ok, F.size("warnings")).otherwise(0)), F.lit(0))
        .cast("bigint").alias("row_warnings"),
    )


def dedup_first(df: DataFrame, *order: str, packed: bool = False) -> DataFrame:
    """Keep the first row of every ``transaction_id``.

    Spark limits each id to its first row before the shuffle too (WindowGroupLimit), so
    an id repeated any number of times sends one row per task. ``packed`` shuffles ids that are
    SHA-256 hashes in half their length.
    """
    if not packed:
        place = F.row_number().over(Window.partitionBy("transaction_id").orderBy(*order))
        return df.withColumn("__place", place).filter("__place = 1").drop("__place")
    given = F.col("transaction_id")
    is_hash = F.coalesce(given.rlike("\\A[0-9a-f]{64}\\z"), F.lit(False))
    split = df.withColumns({"__hash": F.when(is_hash, F.unhex(given)), "__other": F.when(~is_hash, given)}).drop("transaction_id")
    place = F.row_number().over(Window.partitionBy("__hash", "__other").orderBy(*order))
    first = split.withColumn("__place", place).filter("__place = 1")
    return first.withColumn("transaction_id", F.coalesce(F.lower(F.hex("__hash")), "__other")).select(*df.columns)
