"""The files that the queries over statement files write for themselves."""

from pyspark.sql import functions as F

from tallybook.plans import queries


def test_bodies_hold_the_rows_asked_for_in_every_slot(spark):
    lines = spark.range(8000).select((F.col("id") % 8).cast("int").alias("slot"), F.col("id").cast("string").alias("line"))
    bodies = queries._file_bodies(lines, 500).select("slot", F.split("body", "\n").alias("lines")).collect()
    assert sorted(int(n) for b in bodies for n in b.lines) == list(range(8000))
    assert len(bodies) <= 16  # 1,000 rows a slot in two files each


def test_encodings_work_out_their_bodies_once(spark, tmp_path, monkeypatch):
    """Five writes of one encoding each must not compute the statements five times."""
    wrote = []
    plan = queries._write_whole

    def write(rows, content, folder, encoding=None):
        wrote.append(rows._jdf.queryExecution().optimizedPlan().toString())
        plan(rows, content, folder, encoding)

    monkeypatch.setattr(queries, "_write_whole", write)
    queries.QUERIES["scan_encodings"](spark, "/root/testdata/sf0.001")
    assert len(wrote) == 5 and not any("Join" in w for w in wrote)


def test_bodies_where_read_hold_every_line_once(spark):
    lines = spark.range(0, 2500, 1, 2).select(F.when(F.col("id") != 7, F.col("id").cast("string")).alias("line"))
    frame = queries._bodies_where_read(lines, 500)
    bodies = [r.body.split("\n") for r in frame.collect()]
    assert sorted(int(n) for b in bodies for n in b) == [n for n in range(2500) if n != 7]
    assert len(bodies) == 6 and max(map(len, bodies)) == 500
    assert "Aggregate" not in frame._jdf.queryExecution().toString()
