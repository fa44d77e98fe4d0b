"""Multi-line records in splits of any size, encodings of whole files, headers anywhere."""

import csv
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.session import reliable_checkpoint
from tallybook.sources.profiles import Columns, FileFormat, ProfileRegistry, SchemaProfile
from tallybook.sources.records import _states, assemble, split_cells
from tallybook.sources.statements import StatementReader

HEADER = "date,description,amount\n"


def quoted(spark):
    registry = ProfileRegistry()
    registry.register_profile(SchemaProfile("quoted", Columns(signed="amount"), file=FileFormat(multiline=True)))
    return StatementReader(spark, registry)


@pytest.fixture()
def tiny_splits(spark):
    """Every few bytes a split of their own."""
    names = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_multiline_preamble_and_short_rows(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("My bank\n\nnote\n" + HEADER + '2025-01-01,a,-1\n2025-01-02,"b ""x""\n\nsecond, line",-2\n2025-01-03,short\n2025-01-04,d,-4\n')
    result = quoted(spark).ingest(str(path), profile="quoted")
    good = sorted((r.raw_description, r.amount) for r in result.good.collect())
    assert good == [("a", -1.0), ('b "x"\n\nsecond, line', -2.0), ("d", -4.0)]
    assert [(r.row_text, r.reason) for r in result.quarantine.collect()] == [("2025-01-03,short", "too few cells")]


def records_of(seed, n):
    rnd = random.Random(seed)
    pool = ["plain", 'q "x" y', "a,b", "line\nbreak", '"', "", "two\n\nbreaks, and \"quotes\"\n", '\n"start', "x" * 60]
    return [(f"r{i}", rnd.choice(pool), rnd.choice(pool), str(i)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_gives_the_same_records(spark, tmp_path, tiny_splits, seed):
    rows = records_of(seed, 120)
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    (tmp_path / "r.csv").write_text(out.getvalue())
    lines = spark.read.text(str(tmp_path / "r.csv")).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("text"), F.lit(",").alias("sep"),
    )
    assert lines.select("block_start").distinct().count() > 50
    got = assemble(lines, [",", ";"]).orderBy("block_start", "line_no").select(split_cells(F.col("text"), ",").alias("c")).collect()
    want = list(csv.reader(io.StringIO(out.getvalue())))
    assert [r.c for r in got] == want and len(want) == len(rows)


def test_whole_file_in_many_splits(spark, tmp_path, tiny_splits):
    body = "".join(f'2025-01-{1 + i % 28:02d},"item {i}\nof, ""many""",-{i}.5\n' for i in range(1, 60))
    (tmp_path / "big.csv").write_text("bank\n\n" + HEADER + body)
    good = quoted(spark).ingest(str(tmp_path / "big.csv"), profile="quoted").good.collect()
    assert sorted((r.raw_description, r.amount) for r in good) == sorted((f'item {i}\nof, "many"', -i - 0.5) for i in range(1, 60))


def test_an_unclosed_quote_costs_one_row(spark, tmp_path):
    (tmp_path / "u.csv").write_text(HEADER + '2025-01-01,a,-1\n2025-01-04,5" pipe,-4\n2025-01-02,"open,-2\n2025-01-03,c,-3\n')
    result = quoted(spark).ingest(str(tmp_path / "u.csv"), profile="quoted")
    assert sorted(r.raw_description for r in result.good.collect()) == ["a", "c"]
    assert sorted(r.reason for r in result.quarantine.collect()) == ["unbalanced quote"] * 2


@pytest.mark.parametrize("sep", [",", ";", "\t", "|", "#", "^", "]"])
def test_cells_equal_a_csv_reader(spark, sep):
    rnd, texts = random.Random(3), []
    for _ in range(60):
        out = io.StringIO()
        csv.writer(out, delimiter=sep, lineterminator="").writerow([rnd.choice(["a", "", 'q"q', f"x{sep}y", "l\nm", " b ", sep, '""']) for _ in range(rnd.randint(2, 6))])
        texts.append(out.getvalue())
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_cells(F.col("t"), sep).alias("c")).collect()
    for r in got:
        assert r.c == next(csv.reader(io.StringIO(r.t, newline=""), delimiter=sep)), r.t


def test_encoding_is_one_of_the_whole_file(spark, tmp_path):
    body = "Date;Libellé;Débit;Crédit\r\n15/01/2025;CAFÉ Zoë;1 234,56;\r\n16/01/2025;上 naïve;;2,00\r\n"
    plain = body.replace("上", "u")
    files = {
        "utf8": body.encode(), "mark": b"\xef\xbb\xbf" + body.encode(), "latin": plain.encode("latin-1"),
        "windows": plain.replace("naïve", "5 €").encode("cp1252"), "le": b"\xff\xfe" + body.encode("utf-16-le"),
        "be": b"\xfe\xff" + body.encode("utf-16-be"), "bare": plain.encode("utf-16-le"),
        # A line that is UTF-8 by chance does not change how the others are read.
        "mixed": plain.replace("u naïve", "Ã© odd").encode("latin-1"),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.csv").write_bytes(data)
    result = StatementReader(spark).ingest_directory(str(tmp_path))
    assert result.failed_files.count() == 0 and result.quarantine.count() == 0
    texts = {}
    for r in result.rows.orderBy("date").collect():
        texts.setdefault(r.account, []).append(r.raw_description)
    assert texts == {
        "utf8": ["CAFÉ Zoë", "上 naïve"], "mark": ["CAFÉ Zoë", "上 naïve"], "latin": ["CAFÉ Zoë", "u naïve"],
        "windows": ["CAFÉ Zoë", "u 5 €"], "le": ["CAFÉ Zoë", "上 naïve"], "be": ["CAFÉ Zoë", "上 naïve"],
        "bare": ["CAFÉ Zoë", "u naïve"], "mixed": ["CAFÉ Zoë", "Ã© odd"],
    }


def test_header_far_down_and_in_a_later_split(spark, tmp_path, tiny_splits):
    (tmp_path / "far.csv").write_text("note of the bank\n" * 200 + HEADER + "2025-01-01,x,-1\n2025-01-02,y,-2\n")
    result = StatementReader(spark).ingest(str(tmp_path / "far.csv"))
    assert sorted(r.raw_description for r in result.rows.collect()) == ["x", "y"]
    assert result.files.first().profile == "generic"


def test_many_headers_are_one_plan(spark, tmp_path):
    for i in range(12):
        extra = "".join(f",more{k}" for k in range(i))
        (tmp_path / f"f{i}.csv").write_text(f"date,description,amount{extra}\n2025-01-01,t{i},-{i + 1}{',v' * i}\n")
    result = StatementReader(spark).ingest_directory(str(tmp_path))
    assert sorted((r.raw_description, r.amount) for r in result.good.collect()) == sorted((f"t{i}", -i - 1.0) for i in range(12))
    plan = result.rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [value") == 1


def test_an_unknown_file_system_ends_the_job(spark):
    with pytest.raises(Exception, match="nosuch|No FileSystem"):
        StatementReader(spark).ingest_directory("nosuch://bucket/inbox")


def test_states_of_lines_are_those_of_a_plain_walk():
    rnd = np.random.default_rng(5)
    for _ in range(300):
        out, inside = rnd.random((2, rnd.integers(1, 12))) < rnd.random()
        for start in (False, True):
            state, want = start, []
            for o, i in zip(out, inside):
                want.append(state)
                state = bool(i if state else o)
            got, end = _states(out, inside, start)
            assert got.tolist() == want and end == state


@pytest.mark.parametrize("split", ["40", "1m"])
def test_records_are_put_together_where_they_are_read(spark, tmp_path, tiny_splits, split):
    """Lines are not shuffled and no window holds a block; lines that lie anyhow are brought into order."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(records_of(7, 150))
    for name, tail in (("a", ""), ("b", 'x,"never closed\nlast,2\n')):
        (tmp_path / f"{name}.csv").write_text(out.getvalue() + tail)
    lines = spark.read.text(str(tmp_path)).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("text"), F.lit(",").alias("sep"),
    )
    here = assemble(lines, [",", ";"])
    assert "Window" not in here._jdf.queryExecution().optimizedPlan().toString()
    texts = [r.text for r in here.orderBy("source_file", "block_start", "line_no").collect()]
    whole = out.getvalue()[:-1]
    assert "\n".join(texts) == f'{whole}\n{whole}\nx,"never closed\nlast,2'
    assert len(texts) == 2 * 150 + 2
    anyhow = reliable_checkpoint(lines).repartition(7, "text")
    assert sorted(r.text for r in assemble(anyhow, [",", ";"], ordered=False).collect()) == sorted(texts)
