"""Registered queries: one per operator, over the whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import money, parsing, rules, text
from tallybook.functions.sql import register_sql_functions
from tallybook.operators import anomaly, features, forecast, normalise, ranking, reports, store
from tallybook.operators.classify import CategoryModel, LinearWeights, TransactionClassifier
from tallybook.operators.enrich import calendar_parts, enrich, with_rule_category
from tallybook.plans.fixtures import (
    _pick,
    canonical,
    canonical_of,
    statements,
    table,
    transactions,
)
from tallybook.session import passing_copy, reliable_checkpoint, remove, shared_folder
from tallybook.sources.detect import match_profile, profile_by_filename
from tallybook.sources.profiles import Columns, FileFormat, ProfileRegistry, SchemaProfile
from tallybook.sources.statements import StatementReader
from tallybook.streaming.daily import read_daily_totals, start_daily_totals
from tallybook.streaming.inbox import InboxStream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixed values shared with the SQL oracle.
MONTH = "1998-03"
START, END = date(1997, 1, 15), date(1998, 6, 30)
ACCOUNT = "BUILDING"
FIRST_LOAD_UNTIL = date(1998, 6, 30)
HORIZON = 30

# Fixed values shared with the SQL oracle: headers and file names of real exports.
HEADERS = [
    "type,product,started date,completed date,description,amount,fee,currency,state,balance",
    "date;libellé;débit;crédit",
    "transaction date,post date,description,category,type,amount,memo",
    "date de comptabilisation;libellé;débit;crédit",
    "date,payee,amount (eur),category",
    "date,description,amount",
    "date;libelle;debit;credit",
    "date;libellé opération;montant",
    "when,what,how much",
]
FILE_NAMES = ["Revolut_2025-01", "export_BNP", "sg_", "CA_pro", "n26-csv", "Chase1234", "my_bank_of_america", "statement"]


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def _scratch(spark: SparkSession) -> str:
    """A fresh folder in the cluster's shared scratch space."""
    return f"{shared_folder(spark).rstrip('/')}/tallybook-{uuid.uuid4().hex}"


def _listing(tx: DataFrame) -> DataFrame:
    return tx.select("transaction_id", "date", "description", "amount", "tx_type", "account")


# -- enrichment --------------------------------------------------------------

@query("clean_description")
def _(spark, sf):
    return canonical(spark, sf).select("transaction_id", "raw_description", "description")


@query("transaction_id")
def _(spark, sf):
    return canonical(spark, sf).select("account", "date", "raw_description", "amount", "transaction_id")


@query("currency_norm")
def _(spark, sf):
    rows = statements(spark, sf).withColumn(
        "code", _pick(F.length("raw_description"), [" eur", "usd ", "", "EURO", "gBp"])
    )
    parsed = rows.select("account", "code", parsing.parse_currency(F.col("code"), "EUR").alias("currency"))
    return parsed.groupBy("account", "code", "currency").agg(F.count("*").alias("n_rows"))


@query("flag_internal")
def _(spark, sf):
    return transactions(spark, sf).select("transaction_id", "raw_description", "is_internal")


@query("tx_type")
def _(spark, sf):
    return transactions(spark, sf).select("transaction_id", "raw_description", "tx_type")


@query("calendar_parts")
def _(spark, sf):
    days = statements(spark, sf).groupBy("date").agg(F.count("*").alias("n_rows"))
    return days.withColumns(calendar_parts(F.col("date")))


@query("enrich")
def _(spark, sf):
    return transactions(spark, sf).drop("ingested_at", "source_file")


@query("rule_category")
def _(spark, sf):
    labelled = with_rule_category(transactions(spark, sf))
    return labelled.select("transaction_id", "description", "amount", "rule_category")


@query("format_money")
def _(spark, sf):
    days = reports.daily_balance(transactions(spark, sf))
    return days.select("date", "daily_net", money.format_money(F.col("daily_net")).alias("label"))


# -- parsing -----------------------------------------------------------------

def _date_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Each row's date written in one of twelve layouts, or left blank or broken."""
    day = F.col("date")
    layouts = [
        "dd/MM/yyyy", "yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy/MM/dd",
        "dd/MM/yy", "MM/dd/yy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss",
        "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss",
    ]
    written = [F.date_format(day, p) for p in layouts]
    written += [F.lit(" "), F.lit("31/02/2025"), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("x"))]
    kind = (F.length("raw_description") + F.dayofyear(day)) % len(written)
    cell = F.element_at(F.array(*written), kind + 1)
    return statements(spark, sf).select("account", "date", "raw_description", "amount", cell.alias("cell"))


@query("parse_dates")
def _(spark, sf):
    rows = _date_texts(spark, sf).withColumn(
        "parsed", parsing.parse_date(F.col("cell"), parsing.DAY_FIRST_FORMATS)
    )
    return rows.groupBy("cell", "parsed").agg(F.count("*").alias("n_rows"))


def _amount_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Each amount written in several ways, for a dot and for a comma locale."""
    size = F.abs("amount")
    grouped = F.format_number(size, 2)
    plain = F.format_string("%.2f", F.col("amount"))
    spaced = F.translate(grouped, ",.", " ,")
    odd = [F.lit(""), F.lit(" - "), F.lit("–"), F.lit("n/a"), F.concat(plain, F.lit("d")), F.lit("nan")]
    dot = [
        plain, grouped, F.concat(F.lit("("), grouped, F.lit(")")), F.concat(F.lit("$ "), grouped),
        F.concat(F.lit(" -€"), grouped, F.lit(" ")), F.concat(F.lit("+"), grouped), *odd,
    ]
    comma = [
        F.translate(plain, ".", ","), spaced, F.concat(F.lit("("), spaced, F.lit(")")),
        F.concat(spaced, F.lit(" €")), F.concat(F.lit("-"), spaced), F.concat(F.lit("+"), spaced), *odd,
    ]
    kind = (F.length("raw_description") + F.dayofyear("date")) % len(dot)
    return statements(spark, sf).select(
        "account", "date", "raw_description", "amount", kind.alias("kind"),
        F.element_at(F.array(*dot), kind + 1).alias("dot_cell"),
        F.element_at(F.array(*comma), kind + 1).alias("comma_cell"),
    )


@query("parse_amounts")
def _(spark, sf):
    return _amount_texts(spark, sf).select(
        "account", "date", "raw_description", "kind",
        parsing.parse_amount(F.col("dot_cell")).alias("dot_value"),
        parsing.parse_amount(F.col("comma_cell"), ",", " ").alias("comma_value"),
    )


def _split_rows(spark: SparkSession, sf: str) -> DataFrame:
    """String cells of a debit/credit layout with some unreadable rows in it."""
    size = F.translate(F.translate(F.format_number(F.abs("amount"), 2), ",", " "), ".", ",")
    kind = (F.length("raw_description") + F.dayofyear("date")) % 20
    bad_amount = F.lit("12d")
    return statements(spark, sf).select(
        F.when(kind == 1, F.lit("")).when(kind == 2, F.lit("31/02/2025"))
        .otherwise(F.date_format("date", "dd/MM/yyyy")).alias("Date"),
        F.when(kind == 3, F.lit("  ")).otherwise(F.concat(F.lit(" "), "raw_description")).alias("Libellé"),
        F.when((kind == 4) | (F.col("amount") > 0), F.lit("")).when(kind == 5, bad_amount)
        .otherwise(size).alias("Débit"),
        F.when(kind == 4, F.lit("0,00")).when((kind == 5) & (F.col("amount") > 0), bad_amount)
        .when(F.col("amount") > 0, size).otherwise(F.lit("")).alias("Crédit"),
        "account",
    )


def _normalised(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.normalise(
        _split_rows(spark, sf),
        ProfileRegistry().get("bnp"),
        account=F.col("account"),
        source_file=F.concat(F.lower("account"), F.lit(".csv")),
        ingested_at=F.lit("2002-01-01 08:00:00").cast("timestamp"),
    )


@query("debit_credit")
def _(spark, sf):
    size = F.abs("amount")
    rows = statements(spark, sf).withColumns({
        "debit": F.when(F.col("amount") < 0, size).otherwise(0.0),
        "credit": F.when(F.col("amount") > 0, size).otherwise(0.0),
    })
    signed = rows.withColumn("signed", normalise.debit_credit(F.col("debit"), F.col("credit")))
    return signed.select("account", "date", "raw_description", "debit", "credit", "signed")


@query("normalise")
def _(spark, sf):
    return normalise.good_rows(_normalised(spark, sf)).drop("ingested_at")


@query("quarantine")
def _(spark, sf):
    bad = normalise.quarantine(_normalised(spark, sf))
    return bad.groupBy("source_file", "reason").agg(
        F.count("*").alias("n_rows"), F.min("row_text").alias("first_text")
    )


@query("ingest_metrics")
def _(spark, sf):
    return normalise.ingest_metrics(_normalised(spark, sf))


@query("dedup_first")
def _(spark, sf):
    rows = canonical(spark, sf)
    names = F.explode(F.array(*map(F.lit, ("b.csv", "a.csv", "c.csv"))))
    copies = rows.drop("source_file").withColumn("source_file", names)
    return normalise.dedup_first(copies, "source_file", "currency").select(
        "transaction_id", "source_file", "currency", "description", "amount"
    )


# -- detection and files -----------------------------------------------------

@query("profile_detect")
def _(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", _pick(F.col("s_suppkey"), HEADERS).alias("header"))
    cells = F.transform(F.split("header", "[;,]"), lambda c: F.trim(c))
    best = match_profile(cells, ProfileRegistry())
    return rows.select("s_suppkey", "header", F.coalesce(best["profile"], F.lit("generic")).alias("profile"))


@query("profile_by_filename")
def _(spark, sf):
    name = F.concat(_pick(F.col("c_custkey"), FILE_NAMES), F.col("c_custkey").cast("string"), F.lit(".csv"))
    rows = table(spark, sf, "customer").select("c_custkey", name.alias("file_name"))
    return rows.select(
        "c_custkey", "file_name", profile_by_filename(F.col("file_name"), F.lit("generic")).alias("profile")
    )


def _write_layouts(spark: SparkSession, sf: str, folder: str) -> None:
    """All statement rows as CSV files, one layout (and folder) per group of accounts."""
    slot = F.length(F.coalesce("account", F.lit(""))) % 3
    rows = statements(spark, sf).select("date", "raw_description", "amount", "currency", slot.alias("slot"))
    plain = F.format_string("%.2f", F.col("amount"))
    comma = F.translate(F.format_string("%.2f", F.abs("amount")), ".", ",")
    layouts = {
        "revolut": (1, ",", [
            F.lit("CARD_PAYMENT").alias("Type"),
            F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("Started Date"),
            F.col("raw_description").alias("Description"),
            plain.alias("Amount"), F.col("currency").alias("Currency"),
        ]),
        "bnp": (2, ";", [
            F.date_format("date", "dd/MM/yyyy").alias("Date"),
            F.col("raw_description").alias("Libellé"),
            F.when(F.col("amount") < 0, comma).alias("Débit"),
            F.when(F.col("amount") > 0, comma).alias("Crédit"),
        ]),
        "chase": (0, ",", [
            F.date_format("date", "MM/dd/yyyy").alias("Transaction Date"),
            F.col("raw_description").alias("Description"),
            F.lit("Sale").alias("Category"), plain.alias("Amount"),
        ]),
    }
    # A copy, so that the tables are joined once and not for each layout; gone when the files are there.
    with passing_copy(rows) as rows:
        for name, (slot, sep, columns) in layouts.items():
            (
                rows.filter(F.col("slot") == slot).select(*columns)
                .write.option("header", True).option("sep", sep).csv(f"{folder}/{name}")
            )


@query("scan_csv")
def _(spark, sf):
    folder = _scratch(spark)
    size = F.format_string("%.2f", F.col("amount"))
    (
        statements(spark, sf)
        .select(F.date_format("date", "yyyy-MM-dd").alias("date"),
                F.col("raw_description").alias("description"), size.alias("amount"),
                F.col("account").alias("category"), "currency")
        .write.option("header", True).csv(folder)
    )
    rows = StatementReader(spark).ingest_directory(folder, account="all").rows
    return rows.select("date", "description", "raw_description", "amount", "category", "currency", "account")


@query("scan_csv_quoted")
def _(spark, sf):
    """Cells with line breaks, separators and quotes in them, written and read back."""
    folder = _scratch(spark)
    told = F.concat("raw_description", F.lit('\n"'), "currency", F.lit('", x'))
    # A copy, so that the files do not lie beside what the joins of the tables shuffled.
    with passing_copy(statements(spark, sf).select("date", "raw_description", "amount", "currency")) as rows:
        (
            rows.select(F.date_format("date", "yyyy-MM-dd").alias("date"), told.alias("description"),
                        F.format_string("%.2f", F.col("amount")).alias("amount"))
            .write.option("header", True).option("escape", '"').csv(folder)
        )
    registry = ProfileRegistry()
    registry.register_profile(SchemaProfile("quoted", Columns(signed="amount"), file=FileFormat(multiline=True)))
    rows = StatementReader(spark, registry).ingest_directory(folder, profile="quoted", account="all").rows
    return rows.select("date", "raw_description", "amount", F.size("errors").alias("n_errors"))


def _write_whole(rows: DataFrame, content: Column, folder: str, encoding: str | None = None) -> None:
    """A file of its own for each row."""
    writer = rows.select(content.cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
    if encoding:  # its line end has two bytes
        writer = writer.option("encoding", encoding).option("lineSep", "\n")
    writer.text(folder)


def _file_bodies(lines: DataFrame, per_file: int = 5000) -> DataFrame:
    """Column ``body``: the lines of about ``per_file`` rows of one ``slot``, joined. Keeps the column ``slot``."""
    rows = lines.groupBy("slot").agg(F.count("*").alias("n")).collect()  # one row a slot
    files = F.coalesce(*[F.when(F.col("slot") == r.slot, F.lit(max(1, r.n // per_file))) for r in rows], F.lit(1))
    part = F.pmod(F.xxhash64("line"), files)
    return lines.groupBy("slot", part.alias("part")).agg(F.array_join(F.collect_list("line"), "\n").alias("body"))


def _bodies_where_read(lines: DataFrame, per_file: int) -> DataFrame:
    """Column ``body``: ``per_file`` lines at a time as a task reads them, the rest of a task in one more. Nothing is shuffled."""
    def bodies(batches):
        held = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            full = len(held) // per_file * per_file
            for start in range(0, full, per_file):
                yield pa.RecordBatch.from_arrays([pa.array(["\n".join(held[start:start + per_file])], pa.string())], ["body"])
            held = held[full:]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(["\n".join(held)], pa.string())], ["body"])

    # A line that is null is no line, as for array_join.
    return lines.where(F.col("line").isNotNull()).select("line").mapInArrow(bodies, "body string")


@query("scan_csv_records")
def _(spark, sf):
    """Quoted line breaks below a preamble with blank lines; rows of the 13th lack their amount."""
    folder = _scratch(spark)
    told = F.concat(F.lit('"'), "raw_description", F.lit('\n""'), "currency", F.lit('"", x\n\nend"'))
    short = F.dayofmonth("date") == 13
    line = F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(","), told, F.when(short, "").otherwise(
        F.concat(F.lit(","), F.format_string("%.2f", F.col("amount")))))
    with passing_copy(statements(spark, sf).select("date", "raw_description", "amount", "currency")) as rows:
        bodies = _bodies_where_read(rows.select(line.alias("line")), 20_000)
        _write_whole(bodies, F.concat(F.lit("My bank\n\nnote, of the day\ndate,description,amount\n"), "body"), folder)
    registry = ProfileRegistry()
    registry.register_profile(SchemaProfile("quoted", Columns(signed="amount"), file=FileFormat(multiline=True)))
    rows = StatementReader(spark, registry).ingest_directory(folder, profile="quoted", account="all", glob="*.txt").rows
    reason = F.get("errors", F.lit(0))
    return rows.select("date", "raw_description", F.when(reason.isNull(), F.col("amount")).alias("amount"), reason.alias("reason"))


#: Layouts by slot: header, whether dates are month first, decimal comma, two money columns, currency column.
LAYOUTS = {
    "generic": "date,description,amount,category,currency", "bnp": "Date;Libellé;Débit;Crédit",
    "societe_generale": "Date de comptabilisation;Libellé;Débit;Crédit", "credit_agricole": "Date;Libellé opération;Montant",
    "revolut": "Type,Started Date,Description,Amount,Currency", "n26": "Date,Payee,Account number,Amount (EUR)",
    "chase": "Transaction Date,Description,Category,Amount", "bofa": "Date,Description,Amount,Running Bal.",
}


def _layout_line(name: str) -> Column:
    """A statement row as a line of a layout."""
    def day(pattern: str) -> Column:
        return F.date_format("date", pattern)

    text_, plain = F.concat(F.lit('"'), "raw_description", F.lit('"')), F.format_string("%.2f", F.col("amount"))
    comma, size = F.translate(plain, ".", ","), F.translate(F.format_string("%.2f", F.abs("amount")), ".", ",")
    out, come = F.when(F.col("amount") < 0, size).otherwise(""), F.when(F.col("amount") < 0, "").otherwise(size)
    blank = F.lit("")
    cells = {
        "generic": [day("yyyy-MM-dd"), text_, plain, blank, F.col("currency")],
        "bnp": [day("dd/MM/yyyy"), text_, out, come], "societe_generale": [day("dd/MM/yyyy"), text_, out, come],
        "credit_agricole": [day("dd/MM/yyyy"), text_, comma],
        "revolut": [F.lit("CARD"), day("yyyy-MM-dd HH:mm:ss"), text_, plain, F.col("currency")],
        "n26": [day("yyyy-MM-dd"), text_, blank, plain], "chase": [day("MM/dd/yyyy"), text_, F.lit("Sale"), plain],
        "bofa": [day("MM/dd/yyyy"), text_, plain, blank],
    }
    return F.concat_ws(";" if ";" in LAYOUTS[name] else ",", *cells[name])


@query("scan_layouts")
def _(spark, sf):
    """Files of every layout below preambles of 26 lines (6 where the layout has them), all read by one call."""
    folder, names = _scratch(spark), list(LAYOUTS)
    slot = F.length("raw_description") % len(names)
    line = F.element_at(F.array(*map(_layout_line, names)), slot + 1)
    heads = [("some note of the bank\n" * (6 if n == "bofa" else 26)) + LAYOUTS[n] + "\n" for n in names]
    bodies = _file_bodies(statements(spark, sf).select(slot.alias("slot"), line.alias("line")))
    _write_whole(bodies, F.concat(F.element_at(F.array(*map(F.lit, heads)), F.col("slot") + 1), "body"), folder)
    rows = StatementReader(spark).ingest_directory(folder, account="all", glob="*.txt").rows
    return rows.select("profile", "date", "raw_description", "amount", "currency", F.size("errors").alias("n_errors"))


#: Encodings by slot: what a text ends in there, and the charset that Spark writes it in.
ENCODINGS = [(" é€上", "UTF-8"), (" é", "ISO-8859-1"), (" é€", "ISO-8859-1"), (" é€上", "UTF-16LE"), (" é€上", "UTF-16BE")]


@query("scan_encodings")
def _(spark, sf):
    """UTF-8, Latin-1, Windows-1252 and UTF-16 files of both orders, recognised by their bytes."""
    folder = _scratch(spark)
    rows = statements(spark, sf).withColumn("slot", F.length("raw_description") % len(ENCODINGS))
    ending = F.element_at(F.array(*[F.lit(e) for e, _ in ENCODINGS]), F.col("slot") + 1)
    rows = rows.withColumn("raw_description", F.concat("raw_description", ending))
    # Stored once, a folder for each slot: every encoding is a write of its own.
    _file_bodies(rows.select("slot", _layout_line("bnp").alias("line"))).write.partitionBy("slot").parquet(f"{folder}-bodies")
    bodies = spark.read.schema("part long, body string, slot int").parquet(f"{folder}-bodies")
    for number, (_, charset) in enumerate(ENCODINGS):
        wide = charset.startswith("UTF-16")
        content = F.concat(F.lit("\ufeff" if wide else ""), F.lit(f"{LAYOUTS['bnp']}\n"), "body")
        if charset == "ISO-8859-1":  # the euro sign of Windows-1252
            content = F.translate(content, "€", "\x80")
        _write_whole(bodies.where(F.col("slot") == number), F.encode(content, charset), f"{folder}/{number}", charset if wide else None)
    rows = StatementReader(spark).ingest_directory(f"{folder}/*", account="all", glob="*.txt").rows
    return rows.select("date", "raw_description", "amount", F.size("errors").alias("n_errors"))


@query("multi_source_union")
def _(spark, sf):
    folder = _scratch(spark)
    _write_layouts(spark, sf, folder)
    good = StatementReader(spark).ingest_directory(f"{folder}/*", account="joint").good_stored()
    remove(spark, folder)  # this query's own files, read for the last time
    return good.select(
        "transaction_id", "date", "description", "raw_description", "amount", "currency", "category", "account"
    )


@query("stream_ingest")
def _(spark, sf):
    folder = _scratch(spark)
    _write_layouts(spark, sf, f"{folder}/in")
    target = store.TransactionStore(spark, f"{folder}/table")
    InboxStream(spark, f"{folder}/in/*", target, f"{folder}/checkpoint", account="joint").drain()
    return target.read().select(
        "transaction_id", "date", "description", "amount", "currency", "category", "tx_type", "is_internal"
    )


@query("merge_two_streams")
def _(spark, sf):
    """Two inboxes with a stream each load one store; nothing of either may get lost."""
    folder = _scratch(spark)
    _write_layouts(spark, sf, f"{folder}/in")
    target = store.TransactionStore(spark, f"{folder}/table")
    for names in ("{bnp,chase}", "revolut"):
        InboxStream(spark, f"{folder}/in/{names}", target, f"{folder}/checkpoint-{names[-3:]}", account="joint").drain()
    return target.read().select(
        "transaction_id", "date", "description", "amount", "currency", "category", "tx_type", "is_internal"
    )


# -- store -------------------------------------------------------------------

def _stored(spark: SparkSession, sf: str) -> store.TransactionStore:
    target = store.TransactionStore(spark, _scratch(spark))
    # A copy, so that what the load stores does not lie beside what the joins of the tables shuffled.
    with passing_copy(statements(spark, sf)) as rows:
        target.load(canonical_of(rows))
    return target


@query("merge_new_rows")
def _(spark, sf):
    """A first load up to a day, then the whole table again; what the second one added."""
    folder = _scratch(spark)
    rows = canonical(spark, sf)
    target = store.TransactionStore(spark, folder)
    target.load(rows.filter(F.col("date") <= F.lit(FIRST_LOAD_UNTIL)), load_id="first")
    target.load(rows, load_id="second")
    stored = target.read(with_load_id=True)
    return stored.select("transaction_id", "date", "amount", "year", "load_id")


@query("row_count")
def _(spark, sf):
    return _stored(spark, sf).read().agg(F.count("*").alias("n_rows"))


@query("scan_real")
def _(spark, sf):
    return _listing(reports.real(_stored(spark, sf).read()))


@query("adhoc_sql")
def _(spark, sf):
    store.views(transactions(spark, sf))
    return spark.sql("""
        SELECT e.account, e.tx_type, count(*) AS n_rows, min(e.amount) AS lowest, max(e.date) AS latest
        FROM v_expenses e
        GROUP BY e.account, e.tx_type
        HAVING count(*) > 10
    """)


@query("sql_functions")
def _(spark, sf):
    """The registered SQL functions, applied to every row."""
    register_sql_functions(spark)
    store.views(transactions(spark, sf))
    return spark.sql("""
        SELECT account, date, raw_description, amount, tx_type(raw_description) AS tx_type,
               is_internal_move(raw_description) AS is_internal,
               rule_category(description, amount) AS category,
               transaction_id(date, raw_description, amount, account) AS transaction_id,
               format_money(amount) AS label
        FROM transactions
    """)


# -- filters and listings ----------------------------------------------------

@query("v_real")
def _(spark, sf):
    return reports.real(transactions(spark, sf)).drop("ingested_at", "source_file")


@query("v_expenses")
def _(spark, sf):
    return _listing(reports.expenses(transactions(spark, sf)))


@query("v_income")
def _(spark, sf):
    return _listing(reports.income(transactions(spark, sf)))


@query("expenses_month")
def _(spark, sf):
    return reports.expense_listing(transactions(spark, sf), MONTH)


@query("income_month")
def _(spark, sf):
    return reports.income_listing(transactions(spark, sf), MONTH)


@query("date_range")
def _(spark, sf):
    return _listing(reports.date_range(transactions(spark, sf), START, END))


# -- reports -----------------------------------------------------------------

@query("summary")
def _(spark, sf):
    return reports.summary(transactions(spark, sf))


@query("monthly")
def _(spark, sf):
    return reports.monthly_report(transactions(spark, sf))


@query("monthly_all")
def _(spark, sf):
    return reports.monthly_report(transactions(spark, sf), exclude_internal=False)


@query("v_monthly")
def _(spark, sf):
    return reports.monthly(transactions(spark, sf))


@query("monthly_range")
def _(spark, sf):
    return reports.monthly_report(
        transactions(spark, sf), first_period=str(START)[:7], last_period=str(END)[:7]
    )


@query("top_merchants")
def _(spark, sf):
    return reports.top_merchants(transactions(spark, sf), 20)


@query("top_merchants_all")
def _(spark, sf):
    return reports.top_merchants(transactions(spark, sf), 20, expenses_only=False)


@query("v_top_merchants")
def _(spark, sf):
    return reports.merchant_totals(transactions(spark, sf))


@query("merchant_spend")
def _(spark, sf):
    return reports.merchant_spend(transactions(spark, sf), 20, START, END)


@query("tx_types")
def _(spark, sf):
    return reports.tx_types(transactions(spark, sf))


@query("daily_balance")
def _(spark, sf):
    return reports.daily_balance(transactions(spark, sf), start=START, end=END)


@query("daily_balance_account")
def _(spark, sf):
    return reports.daily_balance(transactions(spark, sf), "account")


@query("by_category")
def _(spark, sf):
    return reports.by_category(transactions(spark, sf), start=START, end=END).drop("share_pct")


@query("category_share")
def _(spark, sf):
    return reports.by_category(transactions(spark, sf)).select("category", "share_pct")


@query("category_month_pivot")
def _(spark, sf):
    return reports.category_month_pivot(transactions(spark, sf))


@query("category_summary")
def _(spark, sf):
    return reports.category_summary(transactions(spark, sf))


@query("category_detail")
def _(spark, sf):
    tx = with_rule_category(transactions(spark, sf))
    return reports.category_detail(tx, "rule_category", START, END)


@query("top_categories")
def _(spark, sf):
    return reports.top_categories(transactions(spark, sf))


@query("label_distribution")
def _(spark, sf):
    return reports.label_distribution(transactions(spark, sf))


# -- series and forecasts ----------------------------------------------------

def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("daily_expense")
def _(spark, sf):
    totals = forecast.daily_totals(transactions(spark, sf))
    return totals.select("ds", F.round("y", 2).cast("double").alias("y"))


@query("daily_series")
def _(spark, sf):
    series = forecast.daily_series(forecast.daily_totals(transactions(spark, sf)))
    return _rounded(series, 2, "y")


@query("daily_series_account")
def _(spark, sf):
    totals = forecast.daily_totals(transactions(spark, sf), account=ACCOUNT)
    return _rounded(forecast.daily_series(totals), 2, "y")


@query("daily_series_excl")
def _(spark, sf):
    tx = with_rule_category(transactions(spark, sf), "predicted_category")
    return _rounded(forecast.daily_series(forecast.daily_totals(tx)), 2, "y")


def _many_series(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.daily_totals(transactions(spark, sf, many_accounts=True), "account")


@query("forecast_eligible")
def _(spark, sf):
    fit = forecast.linear_fit(_many_series(spark, sf), "account")
    return fit.select(
        "account", "n_days", (F.col("n_days") >= forecast.MIN_DAYS).alias("eligible")
    )


@query("forecast_linear")
def _(spark, sf):
    fit = forecast.linear_fit(_many_series(spark, sf), "account")
    ahead = forecast.linear_forecast(fit, "account", horizon=HORIZON)
    return _rounded(ahead, 4, "yhat", "yhat_lower", "yhat_upper")


@query("forecast_summary")
def _(spark, sf):
    fit = forecast.linear_fit(forecast.daily_totals(transactions(spark, sf)))
    return forecast.forecast_summary(forecast.linear_forecast(fit, horizon=HORIZON))


@query("forecast_full")
def _(spark, sf):
    totals = forecast.daily_totals(transactions(spark, sf))
    ahead = forecast.linear_forecast(forecast.linear_fit(totals), horizon=HORIZON)
    full = forecast.with_history(forecast.daily_series(totals), ahead)
    return _rounded(full, 4, "yhat", "yhat_lower", "yhat_upper")


@query("forecast_monthly")
def _(spark, sf):
    totals = forecast.daily_totals(transactions(spark, sf))
    ahead = forecast.linear_forecast(forecast.linear_fit(totals), horizon=HORIZON)
    return forecast.forecast_monthly(totals, ahead)


@query("forecast_seasonal")
def _(spark, sf):
    ahead = forecast.seasonal_forecast(_many_series(spark, sf), "account", horizon=HORIZON)
    return ahead.filter("is_forecast")


# -- features, ranks and anomalies -------------------------------------------

@query("merchant_freq")
def _(spark, sf):
    tx = features.with_merchant_stats(transactions(spark, sf))
    return tx.select("transaction_id", "merchant_freq")


@query("merchant_stats")
def _(spark, sf):
    stats = features.merchant_stats(transactions(spark, sf))
    return _rounded(stats, 4, "merchant_std")


@query("amount_zscore")
def _(spark, sf):
    tx = features.with_merchant_stats(transactions(spark, sf))
    return tx.select("transaction_id", F.round(features.amount_zscore(), 6).alias("amount_zscore"))


@query("zscore_outliers")
def _(spark, sf):
    out = features.zscore_outliers(transactions(spark, sf), threshold=1.5)
    return out.select("transaction_id", "description", "amount")


@query("anomaly_features")
def _(spark, sf):
    tx = features.with_anomaly_features(reports.real(transactions(spark, sf)))
    return tx.select(
        "transaction_id", *[F.round(c, 6).alias(c) for c in features.ANOMALY_FEATURES]
    )


@query("standardise")
def _(spark, sf):
    tx = features.with_anomaly_features(reports.real(transactions(spark, sf)))
    # Stored: the figures are one pass over it, the scaled rows another.
    tx = reliable_checkpoint(tx.select("transaction_id", *features.ANOMALY_FEATURES))
    figures = features.scaling(tx, features.ANOMALY_FEATURES).first().asDict()
    scaled = features.standardise(tx, features.ANOMALY_FEATURES, figures)
    return scaled.select(
        "transaction_id", *[F.round(c, 5).alias(c) for c in features.ANOMALY_FEATURES]
    )


@query("global_rank")
def _(spark, sf):
    ranked = ranking.min_rank(transactions(spark, sf), "amount", "transaction_id", "amount_rank")
    return ranked.select("transaction_id", "amount", "amount_rank")


@query("exact_quantile")
def _(spark, sf):
    """Per account: rows below the exact 5 % quantile of all amounts."""
    tx = transactions(spark, sf).select("account", "amount")
    cut = ranking.exact_quantile(tx, "amount", 0.05)
    return tx.groupBy("account").agg(
        F.count_if(F.col("amount") < cut).alias("below"), F.lit(round(cut, 6)).alias("cut")
    )


@query("lowest_k")
def _(spark, sf):
    tx = transactions(spark, sf).select("transaction_id", "date", "description", "amount")
    return ranking.lowest_k(tx, 3, "amount", "transaction_id")


# Fixed values shared with the SQL oracle: a forest of full trees of three levels, by rule.
FOREST_TREES = 7
FOREST_CUTS = [9.5, 0.5, 2.5, 11.5, 0.5, 1.05, 0.755, 6.5]


def _fixed_forest(spark: SparkSession, sf: str) -> tuple[anomaly.AnomalyModel, DataFrame]:
    """The fixed forest and all real rows scored by it."""
    nodes = []
    for tree in range(FOREST_TREES):
        for node in range(15):
            leaf = node >= 7
            column = (3 * tree + node) % len(FOREST_CUTS)
            nodes.append((
                tree, node, -1 if leaf else column, 0.0 if leaf else FOREST_CUTS[column],
                node if leaf else 2 * node + 1, node if leaf else 2 * node + 2, 3 + (5 * tree + node) % 9 / 4 if leaf else 0.0,
            ))
    frame = pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "depth"])
    figures = {f"{c}_{part}": value for c in features.ANOMALY_FEATURES for part, value in (("mean", 0.0), ("std", 1.0))}
    model = anomaly.AnomalyModel(frame, figures, anomaly.SAMPLE_ROWS, 0.0)
    return model, reliable_checkpoint(model.raw_scores(reports.real(transactions(spark, sf))))


def _flagged_forest(spark: SparkSession, sf: str) -> DataFrame:
    """All real rows scored by the fixed forest, flagged and ranked."""
    model, scored = _fixed_forest(spark, sf)
    return model.flagged(scored, 0.05)


@query("forest_scores")
def _(spark, sf):
    return _flagged_forest(spark, sf).select("transaction_id", "anomaly_score", "anomaly_flag", "anomaly_rank")


@query("forest_top")
def _(spark, sf):
    model, scored = _fixed_forest(spark, sf)
    model.threshold = ranking.exact_quantile(scored, "__score", 0.05)
    return model.top(scored, 20)


@query("flagged_share")
def _(spark, sf):
    return anomaly.flagged_share(_flagged_forest(spark, sf))


@query("anomaly_scores")
def _(spark, sf):
    # A copy, so that what the fit stores does not lie beside what the joins of the tables shuffled.
    with passing_copy(statements(spark, sf)) as rows:
        tx = reports.real(enrich(canonical_of(rows)))
        scored = anomaly.AnomalyDetector().fit_predict(tx, keep=["transaction_id"])
    return scored.select("transaction_id", "anomaly_score", "anomaly_flag", "anomaly_rank")


@query("top_anomalies")
def _(spark, sf):
    return anomaly.AnomalyDetector().fit_top(reports.real(transactions(spark, sf)), 20)


# -- categories --------------------------------------------------------------

@query("char_ngrams")
def _(spark, sf):
    return features.ngram_counts(transactions(spark, sf))


@query("tfidf_top_terms")
def _(spark, sf):
    terms = features.vocabulary(transactions(spark, sf))
    return terms.select("term", "occurrences", "documents", F.round("idf", 8).alias("idf"))


@query("clf_features")
def _(spark, sf):
    tx = features.with_numeric_features(transactions(spark, sf))
    return tx.select("transaction_id", F.round("log_amount", 8).alias("log_amount"), "sign", "weekday_f")


# Fixed values shared with the SQL oracle: weights by rule, of a term by its rank in the vocabulary.
WEIGHT_LABELS = ["Courses", "Loyer", "Revenus", "Transport"]
WEIGHT_NUMERIC = [[0.3, -0.5, 0.05], [-0.2, 0.25, -0.1], [0.15, 1.0, 0.0], [-0.05, -0.75, 0.2]]
WEIGHT_INTERCEPTS = [0.5, -0.25, 0.0, 0.125]


def _fixed_weights(spark: SparkSession, sf: str) -> tuple[CategoryModel, DataFrame]:
    # Stored: its terms, its texts and its rows are a pass each.
    tx = reliable_checkpoint(transactions(spark, sf).select("transaction_id", "description", "amount", "day_of_week"))
    terms = features.vocabulary(tx).collect()
    by_term = [[((7 * p + 13 * c) % 11 - 5) / 4 for p in range(len(terms))] for c in range(len(WEIGHT_LABELS))]
    weights = LinearWeights(np.hstack([np.array(by_term), np.array(WEIGHT_NUMERIC)]), np.array(WEIGHT_INTERCEPTS))
    return CategoryModel([r.term for r in terms], [r.idf for r in terms], WEIGHT_LABELS, weights), tx


@query("weighted_categories")
def _(spark, sf):
    model, tx = _fixed_weights(spark, sf)
    return model.predict(tx).select("transaction_id", "description", "amount", "predicted_category")


@query("weighted_probabilities")
def _(spark, sf):
    model, tx = _fixed_weights(spark, sf)
    shares = [F.round(F.col(c), 6).alias(c) for c in WEIGHT_LABELS]
    return model.predict_proba(tx).select("transaction_id", *shares)


@query("classify")
def _(spark, sf):
    # Stored: the fit is one pass over the joined tables, the answer two more.
    tagged = TransactionClassifier().fit_predict(enrich(canonical_of(reliable_checkpoint(statements(spark, sf)))))
    return tagged.select("transaction_id", "description", "amount", "predicted_category")


@query("classify_proba")
def _(spark, sf):
    tx = enrich(canonical_of(reliable_checkpoint(statements(spark, sf))))
    return TransactionClassifier().fit(tx).predict_proba(tx)


# -- scalar functions --------------------------------------------------------

@query("scalar_math")
def _(spark, sf):
    amount = F.col("amount")
    return canonical(spark, sf).select(
        "transaction_id",
        F.abs(amount).alias("abs_amount"),
        F.round(amount, 1).alias("rounded"),
        F.round(F.log1p(F.abs(amount)), 8).alias("log_amount"),
        F.signum(amount).alias("sign"),
        F.least(F.lit(50000.0), F.greatest(F.lit(-50000.0), amount)).alias("clipped"),
        F.coalesce(F.when(amount > 0, amount), F.lit(0.0)).alias("gain"),
    )


@query("scalar_dates")
def _(spark, sf):
    days = statements(spark, sf).groupBy("date").agg(F.count("*").alias("n_rows"))
    return days.select(
        "date",
        "n_rows",
        F.date_format("date", "yyyy-MM").alias("period"),
        F.date_add("date", 45).alias("plus_45"),
        F.date_sub("date", 7).alias("minus_7"),
        F.datediff("date", F.lit(START)).cast("bigint").alias("days_since"),
        F.size(F.sequence(F.trunc("date", "MM"), F.col("date"))).cast("bigint").alias("day_of_month"),
        F.to_date(F.date_format("date", "dd.MM.yyyy"), "dd.MM.yyyy").alias("round_trip"),
    )


@query("scalar_strings")
def _(spark, sf):
    raw = F.col("raw_description")
    names = statements(spark, sf).groupBy("raw_description").agg(F.count("*").alias("n_rows"))
    return names.select(
        "raw_description",
        "n_rows",
        F.lower(raw).alias("lowered"),
        F.upper(raw).alias("uppered"),
        F.length(raw).cast("bigint").alias("n_chars"),
        F.replace(raw, F.lit(" "), F.lit("_")).alias("underscored"),
        raw.startswith("VIR").alias("is_wire"),
        raw.endswith("ring").alias("is_ring"),
        F.regexp_extract(raw, "^([A-Za-z]+)", 1).alias("first_word"),
        F.sha2(raw, 256).alias("digest"),
        text.title_case(raw).alias("title"),
    )


# -- stream ------------------------------------------------------------------

@query("stream_daily_totals")
def _(spark, sf):
    folder = _scratch(spark)
    start_daily_totals(
        spark, sf, f"{folder}/totals", f"{folder}/checkpoint", glob="events.parquet"
    ).awaitTermination()
    return read_daily_totals(spark, f"{folder}/totals")
