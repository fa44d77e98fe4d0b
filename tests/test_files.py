"""Encodings, headers, preambles and broken files."""

import pytest

from tallybook.sources.profiles import Columns, FileFormat, Numbers, ProfileRegistry, SchemaProfile
from tallybook.sources.statements import StatementReader


@pytest.fixture()
def reader(spark):
    return StatementReader(spark)


def _rows(result):
    return sorted(
        (str(r.date), r.description, r.amount, r.currency, r.category) for r in result.good.collect()
    )


def test_encodings(reader, tmp_path):
    body = "Date;Libellé;Débit;Crédit\r\n15/01/2025;CB CAFÉ;1 234,56;\r\n"
    (tmp_path / "utf8.csv").write_bytes(body.encode("utf-8"))
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbf" + body.encode("utf-8"))
    (tmp_path / "latin.csv").write_bytes(body.encode("latin-1"))
    (tmp_path / "windows.csv").write_bytes(body.replace(";1 234,56", ";1 234,56 €").encode("cp1252"))
    for name in ("utf8", "bom", "latin", "windows"):
        result = reader.ingest(str(tmp_path / f"{name}.csv"), account="a")
        assert _rows(result) == [("2025-01-15", "CAFÉ", -1234.56, "EUR", "Uncategorized")], name


def test_unaccented_header_uses_aliases(reader, tmp_path):
    (tmp_path / "x.csv").write_text("Date;Libelle;Debit;Credit\n15/01/2025;CB EDF;;10,00\n")
    assert _rows(reader.ingest(str(tmp_path / "x.csv"))) == [
        ("2025-01-15", "EDF", 10.0, "EUR", "Uncategorized")
    ]


def test_lower_case_header_is_generic(reader, tmp_path):
    (tmp_path / "x.csv").write_text(
        "date,description,amount,category,currency\n31/12/2024,Shop,\"1,000.50\",Food,usd\n"
    )
    result = reader.ingest(str(tmp_path / "x.csv"))
    assert result.files.first().profile == "generic"
    assert _rows(result) == [("2024-12-31", "Shop", 1000.5, "USD", "Food")]


def test_preamble(reader, tmp_path):
    preamble = "Description,,Summary Amt.\nBeginning balance,,1\nTotal credits,,2\nTotal debits,,3\nEnding,,4\n\n"
    (tmp_path / "my stmt+1.csv").write_text(
        preamble + 'Date,Description,Amount,Running Bal.\n02/03/2025,"Rent, flat",-10.00,5\n'
    )
    result = reader.ingest(str(tmp_path / "my stmt+1.csv"))
    assert result.files.first().profile == "bofa"
    assert result.rows.count() == 1
    assert _rows(result) == [("2025-02-03", "Rent, flat", -10.0, "USD", "Uncategorized")]
    assert result.good.first().account == "my stmt+1"


def test_quarantine_and_metrics(reader, tmp_path):
    (tmp_path / "x.csv").write_text(
        "date,description,amount\n2025-01-01,ok,1\n,no date,1\n31/02/2025,bad date,1\n"
        "2025-01-02,bad amount,12d\n2025-01-03,,5\n2025-01-01,OK,1\n2025-01-04,blank,\n"
    )
    result = reader.ingest(str(tmp_path / "x.csv"), account="a")
    reasons = {r.row_text.split(",")[1]: r.reason for r in result.quarantine.collect()}
    assert reasons == {
        "no date": "missing date",
        "bad date": "unparseable date '31/02/2025'",
        "bad amount": "unparseable amount '12d'",
    }
    m = result.metrics.first()
    assert (m.rows_read, m.rows_dropped, m.rows_after_dedup, m.row_warnings) == (7, 3, 3, 1)
    kept = {r.raw_description: r.description for r in result.good.collect()}
    assert kept == {"ok": "ok", "": "Unknown", "blank": "blank"}


def test_broken_files_are_listed(reader, tmp_path):
    (tmp_path / "good.csv").write_text("date,description,amount\n2025-01-01,a,1\n")
    (tmp_path / "bad.csv").write_text("foo,bar\n1,2\n")
    (tmp_path / "blank.csv").write_text("\n")
    result = reader.ingest_directory(str(tmp_path))
    assert result.good.count() == 1
    failed = {r.path.rsplit("/", 1)[-1]: r.error for r in result.failed_files.collect()}
    assert failed == {"bad.csv": "no known header", "blank.csv": "no known header"}
    with pytest.raises(ValueError, match="no known header"):
        reader.ingest(str(tmp_path / "bad.csv"))
    with pytest.raises(ValueError, match="required columns"):
        reader.ingest(str(tmp_path / "good.csv"), profile="bnp")
    with pytest.raises(FileNotFoundError):
        reader.ingest_directory(str(tmp_path), glob="*.txt")


def test_only_broken_files_give_an_empty_table(reader, tmp_path):
    (tmp_path / "bad.csv").write_text("foo,bar\n1,2\n")
    result = reader.ingest_directory(str(tmp_path))
    assert result.good.count() == 0 and result.metrics.count() == 0


def test_duplicates_across_files_keep_the_first(reader, tmp_path):
    for name, currency in (("b.csv", "USD"), ("a.csv", "GBP")):
        (tmp_path / name).write_text(
            f"date,description,amount,currency\n2025-01-01,x,1,{currency}\n2025-01-01,x,1.0,EUR\n"
        )
    good = reader.ingest_directory(str(tmp_path), account="joint").good.collect()
    assert len(good) == 1 and good[0].currency == "GBP" and good[0].source_file.endswith("a.csv")


def test_own_profile(spark, tmp_path):
    registry = ProfileRegistry()
    registry.register_profile(SchemaProfile(
        "acme", Columns("When", "What", outgoing="Out", incoming="In"), Numbers(unsigned_outgoing=True),
        FileFormat("|"), dates=("%d %m %Y",),
    ))
    assert "acme" in registry.list_profiles()
    (tmp_path / "x.csv").write_text("When|What|Out|In\n01 02 2025|thing|-3.5|\n")
    result = StatementReader(spark, registry).ingest(str(tmp_path / "x.csv"))
    assert _rows(result) == [("2025-02-01", "thing", -3.5, "EUR", "Uncategorized")]
    with pytest.raises(ValueError, match="no layout is called"):
        registry.get("nope")


def test_survey_hashes_its_lines(spark, tmp_path):
    from tallybook.sources.detect import raw_lines, survey
    from tallybook.sources.profiles import ProfileRegistry

    (tmp_path / "a.csv").write_bytes("date,description,amount\n2024-01-01,x,1\n".encode("utf-16-le"))
    (tmp_path / "b.csv").write_bytes(b"\xfe\xff\x00d\n")
    (tmp_path / "c.csv").write_bytes(b"date,description,amount\n")
    found = survey(raw_lines(spark, [str(tmp_path)], "*.csv"), list(ProfileRegistry()))
    first = {r.source_file[-5]: r.wide for r in found.orderBy("source_file", "first").collect()[::-1]}
    assert first == {"a": 0, "b": 1, "c": None}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
