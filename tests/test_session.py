import os

from pyspark.sql import functions as F

from tallybook.session import passing_copy, reliable_checkpoint, shared_folder


def _bytes(spark):
    folder = shared_folder(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(folder) for f in names)


def test_a_checkpoint_keeps_the_rows_and_is_compressed(spark):
    rows = spark.range(50_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("key"), F.lit("a" * 100).alias("same"))
    before = _bytes(spark)
    stored = reliable_checkpoint(rows)
    assert stored.exceptAll(rows).isEmpty() and stored.count() == 50_000
    # A key is 32 bytes of chance, written as 64 letters.
    assert _bytes(spark) - before < 50_000 * 60


def _shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(found.apply(i).getName().startswith("shuffle_") for i in range(found.size()))


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    before, setting = _shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    stored = reliable_checkpoint(spark.range(10_000).groupBy(F.col("id") % 100).agg(F.count("*").alias("n")))
    assert _shuffle_files(spark) <= before and stored.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_a_passing_copy_is_gone_afterwards(spark):
    before = _bytes(spark)
    with passing_copy(spark.range(1000)) as copy:
        assert copy.count() == 1000 and _bytes(spark) > before
    assert _bytes(spark) == before
