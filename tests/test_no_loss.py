"""Rows must neither get lost nor come out wrong, whatever the file or the order of loads."""

import pytest

from tallybook.operators import ranking
from tallybook.operators.anomaly import AnomalyDetector
from tallybook.operators.store import TransactionStore
from tallybook.sources.profiles import Columns, FileFormat, ProfileRegistry, SchemaProfile
from tallybook.sources.statements import StatementReader
from tallybook.streaming.inbox import InboxStream
from tallybook.streaming.refit import Refit

HEADER = "date,description,amount\n"


def canonical(spark, tmp_path, name, lines):
    path = tmp_path / f"{name}.csv"
    path.write_text(HEADER + "".join(f"{line}\n" for line in lines))
    return StatementReader(spark).ingest(str(path)).good


def test_two_streams_and_a_fresh_checkpoint_keep_all_rows(spark, tmp_path):
    store = TransactionStore(spark, str(tmp_path / "t"))
    for inbox, checkpoint, name in (("a", "c1", "one"), ("b", "c2", "two"), ("a", "c3", "three")):
        (tmp_path / inbox).mkdir(exist_ok=True)
        (tmp_path / inbox / f"{name}.csv").write_text(HEADER + f"2025-01-01,{name},-1\nbad,{name},-1\n")
        InboxStream(spark, str(tmp_path / inbox), store, str(tmp_path / checkpoint)).drain()
    assert sorted(r.description for r in store.read().collect()) == ["one", "three", "two"]
    stored = spark.read.parquet(str(tmp_path / "c2-quarantine"))
    assert [r.row_text for r in stored.collect()] == ["bad,two,-1"]


def test_a_shorter_replay_leaves_exactly_its_rows(spark, tmp_path):
    store = TransactionStore(spark, str(tmp_path / "t"))
    both = canonical(spark, tmp_path, "both", ["2024-05-01,a,-1", "2025-05-01,b,-1", "2025-06-01,c,-1"])
    late = canonical(spark, tmp_path, "late", ["2025-06-01,c,-1"])
    assert store.load(both, load_id="x") == 3
    store.load(late, load_id="x")
    assert [r.description for r in store.read().collect()] == ["c"]
    store.load(canonical(spark, tmp_path, "none", []), load_id="x")
    assert store.row_count() == 0


def test_load_file(spark, tmp_path):
    (tmp_path / "f.csv").write_text(HEADER + "2025-01-01,x,-1\n2025-01-02,y,-2\n")
    store = TransactionStore(spark, str(tmp_path / "t"))
    assert (store.load_file(str(tmp_path / "f.csv")), store.load_file(str(tmp_path / "f.csv"))) == (2, 0)


def test_line_break_in_a_cell(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text(HEADER + '2025-01-01,"line one\nline, ""two""",-1.5\n2025-01-02,plain,-2\n')
    broken = StatementReader(spark).ingest(str(path))
    assert [r.raw_description for r in broken.good.collect()] == ["plain"] and broken.quarantine.count() == 2
    registry = ProfileRegistry()
    registry.register_profile(SchemaProfile("quoted", Columns(signed="amount"), file=FileFormat(multiline=True)))
    whole = StatementReader(spark, registry).ingest(str(path), profile="quoted").good.collect()
    assert sorted((r.raw_description, r.amount) for r in whole) == [('line one\nline, "two"', -1.5), ("plain", -2.0)]


def test_short_rows_are_not_zero(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text(HEADER + "2025-01-01,short\n2025-01-02,blank,\n2025-01-03,ok,-3\n")
    result = StatementReader(spark).ingest(str(path))
    assert sorted(r.raw_description for r in result.good.collect()) == ["blank", "ok"]
    assert [(r.row_text, r.reason) for r in result.quarantine.collect()] == [("2025-01-01,short", "too few cells")]


def test_preamble_of_one_file_is_data_of_another(spark, tmp_path):
    row = "2025-01-01,same,-1"
    for folder, text in (("m1", f"{row}\n\n{HEADER}2025-02-01,x,-1\n{row}\n"), ("m2", f"{HEADER}{row}\n2025-02-02,y,-1\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "d.csv").write_text(text)
    rows = StatementReader(spark).ingest_directory(f"{tmp_path}/m*").rows.filter("size(errors) = 0").collect()
    assert sorted((r.source_file.split("/")[-2], r.raw_description) for r in rows) == [
        ("m1", "same"), ("m1", "x"), ("m2", "same"), ("m2", "y"),
    ]


@pytest.mark.parametrize("skip, sep, wide", [(25, ",", 0), (3, "#", 0), (0, ",", 9000)])
def test_any_preamble_separator_and_header_length(spark, tmp_path, skip, sep, wide):
    registry = ProfileRegistry()
    registry.register_profile(SchemaProfile("own", Columns("day", "what", "sum"), file=FileFormat(sep, preamble=skip)))
    more = [f"column{i}" for i in range(wide)]
    lines = ["note"] * skip + [sep.join(["day", "what", "sum", *more]), sep.join(["2025-01-01", "x", "-4", *["v"] * wide])]
    path = tmp_path / "own.csv"
    path.write_text("\n".join(lines) + "\n")
    good = StatementReader(spark, registry).ingest(str(path), profile="own").good.collect()
    assert [(r.raw_description, r.amount) for r in good] == [("x", -4.0)]


def test_profile_encoding(spark, tmp_path):
    registry = ProfileRegistry()
    registry.register_profile(SchemaProfile("pl", Columns(signed="amount"), file=FileFormat(encoding="iso-8859-2")))
    path = tmp_path / "pl.csv"
    path.write_bytes((HEADER + "2025-01-01,Łódź,-1\n").encode("iso-8859-2"))
    assert StatementReader(spark, registry).ingest(str(path), profile="pl").good.first().raw_description == "Łódź"


def test_us_layouts_read_day_first_where_nothing_else_fits(spark, tmp_path):
    path = tmp_path / "chase.csv"
    path.write_text("Transaction Date,Post Date,Description,Category,Type,Amount,Memo\n"
                    "25/01/2025,,a,,,-1,\n25.01.2025,,b,,,-1,\n02/01/2025,,c,,,-1,\n")
    days = {r.raw_description: str(r.date) for r in StatementReader(spark).ingest(str(path)).good.collect()}
    assert days == {"a": "2025-01-25", "b": "2025-01-25", "c": "2025-02-01"}


def test_rank_takes_null_and_nan(spark):
    values = [None, 3.0, float("nan"), -1.0, None, 3.0, 0.0, -0.0, float("inf"), float("-inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    df.createOrReplaceTempView("ranked")
    want = {r.id: r.k for r in spark.sql("select id, rank() over (order by v) as k from ranked").collect()}
    for rows_per_range in (1, 3, 100):
        got = ranking.min_rank(df, "v", "id", rows_per_range=rows_per_range)
        assert {r.id: r["rank"] for r in got.collect()} == want


def test_refit_after_a_load(spark, tmp_path):
    texts = ["CB NETFLIX", "PAIEMENT CB CARREFOUR", "CB SNCF", "VIR SEPA EMPLOYEUR"]
    lines = [f"2025-{1 + i % 12:02d}-{1 + i % 28:02d},{texts[i % 4]},{2000 + i if i % 4 == 3 else -10 - i % 7}" for i in range(80)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(HEADER + "\n".join(lines) + "\n2025-05-05,CB SNCF,-99999\n")
    refit = Refit(str(tmp_path / "models"), detector=AnomalyDetector(n_estimators=20))
    stream = InboxStream(spark, str(tmp_path / "in"), TransactionStore(spark, str(tmp_path / "t")), str(tmp_path / "c"), on_new_rows=refit)
    stream.drain()
    assert not stream.hook_errors
    assert not refit.errors and len(refit.latest["lowest"]) == 3
    assert refit.latest["lowest"][0].amount == -99999 and refit.latest["lowest"][0].anomaly_rank == 1
    # Spend by hand: the rows of a merchant share its category, and salaries are no spend.
    spent = {}
    for i in range(80):
        if i % 4 != 3:
            spent[i % 4] = spent.get(i % 4, 0) - 10 - i % 7
    spent[2] -= 99999
    assert [r.spent for r in refit.latest["categories"]] == sorted(spent.values())
    assert 0 < refit.latest["flagged"] < 81
    assert (tmp_path / "models" / "categories" / "terms").exists() and (tmp_path / "models" / "anomalies" / "nodes").exists()


class _Broken:
    def fit(self, rows):
        raise RuntimeError("no model today")


def test_one_failing_model_does_not_stop_the_other(spark, tmp_path):
    lines = [f"2025-01-{1 + i % 28:02d},CB NETFLIX {i % 3},{-10 - i}" for i in range(40)]
    lines += ["2025-02-01,Transfer to savings,-500"]  # internal: for the classifier, not for the detector
    store = TransactionStore(spark, str(tmp_path / "t"))
    store.load(canonical(spark, tmp_path, "rows", lines))
    refit = Refit(str(tmp_path / "models"), classifier=_Broken(), detector=AnomalyDetector(n_estimators=10))
    refit(store)
    assert refit.errors == ["categories: no model today"]
    assert refit.latest["flagged"] > 0 and "categories" not in refit.latest
    assert all(r.description != "Transfer to savings" for r in refit.latest["lowest"])
