"""Cheaper forms of text steps give what the plain ones give; a table is read as often as needed only."""

from pyspark.sql import functions as F

from tallybook.functions import identity, text
from tallybook.functions.rules import fold
from tallybook.functions.sql import register_sql_functions
from tallybook.plans.queries import QUERIES
from tallybook.sources.detect import SEPARATORS
from tallybook.sources.records import split_cells
from tallybook.sources.statements import StatementReader

SF = "/root/testdata/sf0.001"


def test_strip_takes_off_every_blank(spark):
    codes = spark.createDataFrame([(chr(c),) for c in [*range(1, 0xD800), *range(0xE000, 0x10000), 0x1F600]], "c string")
    told = F.concat("c", F.lit("a "), "c", F.lit("b"), "c")
    old = F.regexp_replace(told, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    assert codes.where(~text.strip(told).eqNullSafe(old)).isEmpty()
    assert codes.where(~fold(F.col("c")).eqNullSafe(F.lower(F.translate("c", "İıſK", "iisk")))).isEmpty()


def test_six_decimals(spark):
    odd = [0.0, -0.0, 1e-7, 4.999999e-7, 5e-7, 1e-6, 1.0000005, 0.1234565, -2.5e-6, 1e15, 1.1e15, 1e40, float("nan"), float("inf"), None]
    rows = spark.range(20_000).select(((F.xxhash64("id") % 10**9) / F.pow(F.lit(10.0), F.col("id") % 12)).alias("x"))
    rows = rows.union(spark.createDataFrame([(x,) for x in odd], "x double"))
    assert rows.where(~identity._six_decimals(F.col("x")).eqNullSafe(F.format_string("%.6f", "x"))).isEmpty()
    assert "format_string" in rows.select(identity._six_decimals(F.col("x")))._jdf.queryExecution().toString()


def test_dedup_reads_its_table_once(spark):
    plan = QUERIES["dedup_first"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") and plan.count("Relation") == 4


def test_sql_rules_use_no_regex_for_plain_words(spark):
    register_sql_functions(spark)
    plan = spark.sql("select rule_category(id || 'CARREFOUR', 1D) as c from range(3)")
    assert {r.c for r in plan.collect()} == {"Alimentation"}
    shown = plan._jdf.queryExecution().optimizedPlan().toString()
    assert shown.lower().count("rlike") < 10


def test_a_filter_on_errors_parses_no_cell_twice(spark, tmp_path):
    """Pushed below the parsers, it would hold a copy of them for each place that names a cell."""
    (tmp_path / "a.csv").write_text("date,description,amount\n2025-01-02,Shop,-1.00\n2025-01-02,Shop,-1.00\n2025-13-40,Shop,x\n")
    good = StatementReader(spark).ingest(str(tmp_path / "a.csv"), account="a").good
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == len(SEPARATORS)
    assert [(str(r.date), r.amount) for r in good.collect()] == [("2025-01-02", -1.0)]


def test_cells_are_split_without_compiling_a_pattern(spark):
    for sep in [*SEPARATORS, "^", "\\", "x", "::"]:
        line = spark.createDataFrame([(f"a.b{sep}{sep} c|d;e,f\tg{sep}",)], "line string")
        cells = line.select(split_cells(F.col("line"), sep).alias("cells"))
        assert cells.first().cells == line.first().line.split(sep)
        plan = cells._jdf.queryExecution().analyzed().toString()
        assert ("split(line#" in plan) and (f", \\{sep}, -1)" in plan) == (sep not in ("x", "::"))


def test_a_filter_on_the_category_stays_above_the_rules(spark):
    """Pushed below them, it would hold copies of the description's steps for each of their tests."""
    frame = QUERIES["daily_series_excl"](spark, SF)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000
    assert plan.count("Relation") == 4  # and the series reads its totals once
