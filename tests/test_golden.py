"""Small statement files with known results."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallybook.functions import rules, text
from tallybook.operators import reports
from tallybook.operators.enrich import enrich, with_rule_category
from tallybook.sources.profiles import ProfileRegistry
from tallybook.sources.statements import StatementReader

REVOLUT = """Type,Product,Started Date,Completed Date,Description,Amount,Fee,Currency,State,Balance
CARD_PAYMENT,Current,2023-03-04 18:20:11,2023-03-05 01:00:00,Zumo Vinyl Club,-13.49,0.00,EUR,COMPLETED,210.00
TOPUP,Current,2023-03-09 07:45:00,2023-03-09 07:45:00,Top-Up by *8080,640.00,0.00,EUR,COMPLETED,850.00
TRANSFER,Current,2023-03-11 12:00:00,2023-03-11 12:00:00,Transfer to savings,-75.00,0.00,EUR,COMPLETED,775.00
CARD_PAYMENT,Current,2023-04-02 21:10:00,2023-04-02 21:10:00,Kino Lumen,-8.20,0.00,EUR,COMPLETED,766.80
"""
BNP = """Date;Libellé;Débit;Crédit
07/03/2023;PAIEMENT CB EPICERIE DU PONT;31,15;
09/03/2023;VIR SEPA ATELIER NORD;;1920,40
12/03/2023;RETRAIT DAB LILLE GARE;60,00;
21/04/2023;VIR SEPA REMBOURSEMENT DENTISTE;;18,70
"""
CHASE = """Transaction Date,Post Date,Description,Category,Type,Amount,Memo
03/15/2023,03/16/2023,Corner Hardware,Home,Sale,-24.99,
04/03/2023,04/04/2023,Garage Rental,Home,Payment,"-1,130.00",
04/06/2023,04/06/2023,Bike resale,Transfer,Payment,95.00,
"""


def digest(day, text, amount, account):
    """The id, worked out here without the engine."""
    return hashlib.sha256(f"{day}|{text.lower()}|{amount:.6f}|{account}".encode()).hexdigest()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("golden")
    (path / "revolut_2025-01.csv").write_text(REVOLUT, encoding="utf-8")
    (path / "bnp.csv").write_text(BNP, encoding="utf-8")
    (path / "chase.csv").write_text(CHASE, encoding="utf-8")
    return path


def test_totals_and_ids(spark, folder):
    reader = StatementReader(spark)
    result = reader.ingest(str(folder / "bnp.csv"), account="BNP Demo")
    rows = {r.raw_description: r for r in result.good.collect()}
    first = rows["PAIEMENT CB EPICERIE DU PONT"]
    assert first.transaction_id == digest("2023-03-07", first.raw_description, -31.15, "BNP Demo")
    assert (first.amount, first.currency, str(first.date)) == (-31.15, "EUR", "2023-03-07")
    revolut = reader.ingest(str(folder / "revolut_2025-01.csv"), account="Revolut Demo").good
    found = revolut.filter("raw_description = 'Zumo Vinyl Club'").first()
    assert found.transaction_id == digest("2023-03-04", "Zumo Vinyl Club", -13.49, "Revolut Demo")
    total = reports.summary(enrich(revolut)).first()
    assert (total.total_tx, total.real_tx) == (4, 3)
    assert (total.total_income, total.total_expenses, total.net_balance) == (640.0, -21.69, 618.31)


def test_us_dates_are_month_first(spark, folder):
    path = str(folder / "chase.csv")
    day = lambda reader: str(
        reader.ingest(path).good.filter("raw_description = 'Garage Rental'").first().date
    )
    assert day(StatementReader(spark)) == "2023-04-03"
    assert day(StatementReader(spark, ProfileRegistry(legacy_date_order=True))) == "2023-03-04"
    rows = StatementReader(spark).ingest(path).good.collect()
    assert {r.currency for r in rows} == {"USD"} and len(rows) == 3
    assert {r.account for r in rows} == {"chase"}


def test_directory_detects_each_file(spark, folder):
    result = StatementReader(spark).ingest_directory(str(folder), account_map={"bnp": "Main"})
    profiles = {r.path.rsplit("/", 1)[-1]: r.profile for r in result.files.collect()}
    assert profiles == {
        "revolut_2025-01.csv": "revolut", "bnp.csv": "bnp", "chase.csv": "chase",
    }
    assert result.good.count() == 11
    accounts = {r.account for r in result.good.select("account").distinct().collect()}
    assert accounts == {"revolut_2025-01", "Main", "chase"}


CASES = [
    ("PAIEMENT CB CARREFOUR MARKET", "CARREFOUR MARKET", "card_payment", False, "Alimentation"),
    ("PRELEVEMENT SEPA EDF", "EDF", "card_payment", False, "Autre"),
    ("CB NETFLIX", "NETFLIX", "card_payment", False, "Abonnements"),
    ("RETRAIT DAB PARIS 8EME", "PARIS 8EME", "atm", False, "Autre"),
    ("PAIEMENT CB AMAZON MARKETPLACE", "AMAZON MARKETPLACE", "card_payment", False, "Shopping"),
    ("PAIEMENT CB UBER EATS", "UBER EATS", "card_payment", False, "Restauration"),
    ("CB SNCF", "SNCF", "card_payment", False, "Transport"),
    ("Transfer to savings", "Transfer to savings", "transfer_out", True, "Virements"),
    ("Rent Payment", "Rent Payment", "card_payment", False, "Loyer"),
    ("Cinema UGC", "Cinema UGC", "card_payment", False, "Loisirs"),
    ("Starbucks Coffee", "Starbucks Coffee", "fee", False, "Restauration"),
    ("CB CAFÉ DE FLORE", "CAFÉ DE FLORE", "card_payment", False, "Restauration"),
    ("CB", "CB", "card_payment", False, "Autre"),
    ("ﬁnance\tlab  x", "finance lab x", "card_payment", False, "Autre"),
    ("Sephora refund", "Sephora refund", "refund", False, "Beauté"),
    ("amazon prime", "amazon prime", "card_payment", False, "Abonnements"),
    ("TOP UP", "TOP UP", "topup", False, "Revenus"),
    ("To pocket EUR holiday", "To pocket EUR holiday", "pocket_move", True, "Virements"),
]


def test_text_rules(spark):
    df = spark.createDataFrame([(c[0], -1.0, str(i)) for i, c in enumerate(CASES)],
                               "raw string, amount double, transaction_id string")
    df = df.withColumn("description", text.clean_description(F.col("raw"))).withColumn(
        "folded", rules.fold(F.col("raw"))
    )
    got = with_rule_category(
        df.withColumns({"t": rules.tx_type(F.col("folded")), "i": rules.is_internal(F.col("raw"))})
    )
    rows = {r.raw: (r.raw, r.description, r.t, r.i, r.rule_category) for r in got.collect()}
    for case in CASES:
        assert rows[case[0]] == case


def test_account_labels(spark):
    df = spark.createDataFrame(
        [("bnp_2025-08_2026-04", "bnp"), ("my_n26", "n26"), ("2025-01", "chase"), ("o'neil 2x a-b", "x")],
        "stem string, profile string",
    )
    labels = [r[0] for r in df.select(text.account_label(F.col("stem"), F.col("profile"))).collect()]
    assert labels == ["Bnp", "My N26", "Chase", "O'Neil 2X A-B"]
