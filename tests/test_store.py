"""Idempotent loads and the file stream."""

import datetime as dt

from pyspark.sql import functions as F

import tallybook.operators.store as store_module
from tallybook.functions.identity import packed_id, unpacked_id, with_ids, without_ids
from tallybook.operators.normalise import dedup_first, good_rows
from tallybook.operators.store import TransactionStore, export_parquet
from tallybook.plans.fixtures import canonical
from tallybook.schema import CANONICAL, ContractError, empty_canonical, require_columns
from tallybook.session import reliable_checkpoint
from tallybook.sources.statements import StatementReader
from tallybook.streaming.inbox import InboxStream

SF = "/root/testdata/sf0.001"


def test_load_twice_is_load_once(spark, tmp_path):
    store = TransactionStore(spark, str(tmp_path / "t"))
    rows = canonical(spark, SF)
    assert store.row_count() == 0
    early = rows.filter("date < '1998-01-01'")
    n = early.count()
    assert store.load(early, "a") == n
    assert store.load(early, "b") == 0
    assert store.load(early, "a") == n  # the same load again replaces itself
    assert store.row_count() == n
    whole = rows.count()
    assert store.load(rows.unionByName(rows), "c") == whole - n
    assert store.row_count() == whole
    assert store.read().select("transaction_id").distinct().count() == whole
    assert store.load(empty_canonical(spark), "d") == 0
    assert store.query("SELECT count(*) FROM v_real").first()[0] <= whole
    export_parquet(store.read(), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == whole


def test_contract(spark):
    frame = empty_canonical(spark)
    assert require_columns(frame).schema.names == CANONICAL.names
    for broken in (frame.drop("amount"), frame.withColumn("amount", frame.currency)):
        try:
            require_columns(broken)
        except ContractError:
            continue
        raise AssertionError("accepted a broken frame")


def _write(path, n, start=0):
    lines = ["date,description,amount"]
    day = dt.date(2025, 1, 1)
    lines += [f"{day + dt.timedelta(i)},shop {i},-{i + 1}.50" for i in range(start, start + n)]
    path.write_text("\n".join(lines) + "\n")


def test_stream_equals_batch(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    _write(inbox / "one_2025-01.csv", 10)
    _write(inbox / "two.csv", 10, start=5)
    (inbox / "broken.csv").write_text("foo,bar\n1,2\n")
    store = TransactionStore(spark, str(tmp_path / "t"))
    seen = []
    args = (spark, str(inbox), store, str(tmp_path / "cp"))
    hook = lambda s, report: seen.append((report.inserted, s.row_count()))
    stream = InboxStream(*args, on_new_rows=hook)
    stream.drain()
    assert [(r.files_ok, r.files_failed, r.inserted) for r in stream.reports] == [(2, 1, 20)]
    assert seen == [(20, 20)]
    assert {r.account for r in store.read().select("account").distinct().collect()} == {"One", "Two"}
    assert spark.read.parquet(f"{tmp_path}/cp-failed").count() == 1

    batch = StatementReader(spark).ingest_directory(str(inbox)).good
    days = lambda df: sorted((r.date, r.amount) for r in df.select("date", "amount").collect())
    assert days(batch) == days(store.read())

    # The same rows in another file, then a restart with nothing new.
    (inbox / "one_2025-02.csv").write_text((inbox / "one_2025-01.csv").read_text())
    again = InboxStream(*args, on_new_rows=hook)
    again.drain()
    assert [r.inserted for r in again.reports] == [0]
    assert InboxStream(*args).drain() == []
    assert len(seen) == 1 and store.row_count() == 20


def test_replayed_batch_changes_nothing(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    _write(inbox / "one.csv", 5)
    store = TransactionStore(spark, str(tmp_path / "t"))
    stream = InboxStream(spark, str(inbox), store, str(tmp_path / "cp"))
    files = spark.read.format("binaryFile").load(str(inbox)).select("path")
    stream.process_batch(files, 7)
    stream.process_batch(files, 7)
    assert [r.inserted for r in stream.reports] == [5, 5]
    assert store.row_count() == 5


def test_failing_hook_does_not_stop_the_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    _write(inbox / "one.csv", 5)
    store = TransactionStore(spark, str(tmp_path / "t"))

    def hook(*_):
        raise RuntimeError("no model")

    stream = InboxStream(spark, str(inbox), store, str(tmp_path / "cp"), on_new_rows=hook)
    assert stream.drain()[0].inserted == 5
    assert list(stream.hook_errors) == ["batch 0: no model"]


def test_archive_moves_older_batches(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    store = TransactionStore(spark, str(tmp_path / "t"))
    for i in range(3):
        _write(inbox / f"f{i}.csv", 2, start=10 * i)
        InboxStream(
            spark, str(inbox), store, str(tmp_path / "cp"), archive=str(tmp_path / "done")
        ).drain()
    assert store.row_count() == 6
    assert {p.name for p in (tmp_path / "done").rglob("*.csv")} >= {"f0.csv"}


def test_good_rows_keep_the_canonical_schema(spark, tmp_path):
    _write(tmp_path / "x.csv", 1)
    rows = StatementReader(spark).ingest(str(tmp_path / "x.csv")).rows
    assert good_rows(rows).schema.names == CANONICAL.names


def test_a_load_in_parts_gives_the_same_table(spark, tmp_path, monkeypatch):
    """Ids that a row's columns give, and others; what is not yet whole is not part of the table."""
    monkeypatch.setattr(store_module, "ROWS_AT_ONCE", 50)
    rows = canonical(spark, SF).limit(300)
    other = rows.limit(20).withColumn("transaction_id", F.concat(F.lit("own-"), F.col("transaction_id")))
    rows = reliable_checkpoint(rows.unionByName(other).unionByName(rows.limit(30)))
    seen = []
    admit = TransactionStore._admit
    monkeypatch.setattr(TransactionStore, "_admit", lambda self, staging: (seen.append(self.read().count()), admit(self, staging)))
    target = TransactionStore(spark, str(tmp_path / "t"))
    n = rows.select("transaction_id").distinct().count()
    assert target.load(rows, "a") == n and target.load(rows, "a") == n and target.load(rows, "b") == 0
    assert seen == [0, 0, n]
    got, want = (d.select("transaction_id", "date", "amount", "account").distinct() for d in (target.read(), rows))
    assert target.row_count() == n and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert not list((tmp_path / "t").glob("_loading*"))


def test_ids_that_the_row_gives_are_not_stored(spark):
    rows = canonical(spark, SF).limit(50)
    odd = rows.limit(3).withColumn("transaction_id", F.lit("1"))
    packed = without_ids(rows.unionByName(odd))
    assert [r.n for r in packed.groupBy("transaction_id").agg(F.count("*").alias("n")).orderBy(F.col("transaction_id").asc_nulls_first()).collect()] == [50, 3]
    assert with_ids(packed).exceptAll(rows.unionByName(odd)).isEmpty()


def test_packed_dedup_keeps_the_same_rows(spark):
    rows = canonical(spark, SF).limit(60).withColumn("n", F.monotonically_increasing_id())
    ids = F.when(F.col("n") % 3 == 0, F.upper("transaction_id")).when(F.col("n") % 7 == 1, F.lit("1")).when(F.col("n") % 7 != 2, F.col("transaction_id"))
    rows = reliable_checkpoint(rows.withColumn("transaction_id", ids))
    rows = rows.unionByName(rows.withColumn("n", F.col("n") + 1000))
    plain, packed = (dedup_first(rows, "n", packed=p) for p in (False, True))
    assert plain.columns == packed.columns and plain.count() == packed.count() and packed.exceptAll(plain).isEmpty()


def test_packed_ids_come_back(spark):
    ids = ["ab" * 32, "AB" * 32, "1", "", "x" * 32, "ab" * 32 + "\n", "é", None]
    rows = spark.createDataFrame([(i,) for i in ids], "i string").select("i", packed_id(F.col("i")).alias("p"))
    back = rows.select("i", unpacked_id(F.col("p")).alias("b"), F.length("p").alias("n")).collect()
    assert all(r.i == r.b for r in back) and len({r.b for r in back}) == len(ids) and back[0].n == 33
