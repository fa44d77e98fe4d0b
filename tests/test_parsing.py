"""Cells of every shape, and properties of the parsers."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallybook.functions import parsing
from tallybook.functions.money import format_money
from tallybook.operators.normalise import dedup_first

FEW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def _column(spark, cells, expression):
    df = spark.createDataFrame(list(enumerate(cells)), "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("c"))).collect()]


def test_amount_cells(spark):
    cells = {
        "1 234,56": 1234.56, "1 234,56": 1234.56, "(1 234,56)": -1234.56, "€12,00": 12.0,
        "-": 0.0, "–": 0.0, "n/a": 0.0, "": 0.0, "  ": 0.0, "12d": None, "1_000": 1000.0,
        "inf": None, "nan": None, "1e3": 1000.0, "--5": None, "+7": 7.0, ",5": 0.5, "€": None,
    }
    assert _column(spark, cells, lambda c: parsing.parse_amount(c, ",", " ")) == list(cells.values())
    dotted = {"1,234.56": 1234.56, "-$1,000": -1000.0, ".5": 0.5, "5.": 5.0, "1.2.3": None}
    assert _column(spark, dotted, parsing.parse_amount) == list(dotted.values())


def test_date_cells(spark):
    cells = {
        "15/01/2025": "2025-01-15", "5/1/2025": "2025-01-05", "01/15/2025": "2025-01-15",
        "31/02/2025": None, "15/01/75": "1975-01-15", "15/01/68": "2068-01-15",
        "15/01/69": "1969-01-15", "2025-01-15T10:00:00": "2025-01-15", "15.01.2025 x": None,
        "2025-01-15  10:00:00": "2025-01-15", "": None, " 2025/1/5 ": "2025-01-05", "29/02/2024": "2024-02-29",
    }
    got = _column(spark, cells, lambda c: parsing.parse_date(c, parsing.DAY_FIRST_FORMATS))
    assert [str(d) if d else None for d in got] == list(cells.values())


@FEW
@given(st.lists(st.integers(-10**11, 10**11), min_size=1, max_size=200))
def test_amounts_survive_formatting(spark, cents):
    amounts = [c / 100 for c in cents]
    texts = [f"{abs(a):,.2f}".translate(str.maketrans(",.", " ,")) for a in amounts]
    texts = [f"({t})" if a < 0 else f"{t} €" for t, a in zip(texts, amounts)]
    assert _column(spark, texts, lambda c: parsing.parse_amount(c, ",", " ")) == amounts


@FEW
@given(
    st.lists(st.dates(dt.date(1970, 1, 1), dt.date(2068, 12, 31)), min_size=1, max_size=100),
    st.sampled_from(parsing.DAY_FIRST_FORMATS),
)
def test_dates_survive_formatting(spark, days, layout):
    texts = [d.strftime(layout) for d in days]
    assert _column(spark, texts, lambda c: parsing.parse_date(c, [layout])) == days


@FEW
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 30)), min_size=1, max_size=60), st.randoms())
def test_dedup_does_not_depend_on_row_order(spark, rows, rng):
    first = {}
    for key, place in rows:
        first[key] = min(first.get(key, place), place)
    rng.shuffle(rows)
    df = spark.createDataFrame([(str(k), p, f"v{p}") for k, p in rows], "transaction_id string, place int, v string")
    got = {int(r.transaction_id): (r.place, r.v) for r in dedup_first(df, "place").collect()}
    assert got == {k: (p, f"v{p}") for k, p in first.items()}


def test_money_labels(spark):
    df = spark.createDataFrame([(1234567.891,), (-0.5,), (0.0,)], "v double")
    labels = [r[0] for r in df.select(format_money(F.col("v"))).collect()]
    assert labels == ["+1 234 567.89 €", "-0.50 €", "0.00 €"]
