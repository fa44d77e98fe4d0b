"""The persistent transaction table: idempotent loads, views and export.

A Parquet folder partitioned by year and load. One writer at a time: plain
Parquet has no transactions across writers.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.identity import with_ids, without_ids
from tallybook.operators import reports
from tallybook.operators.enrich import enrich
from tallybook.operators.normalise import dedup_first
from tallybook.schema import CANONICAL, ENRICHED, require_columns
from tallybook.session import passing_copy, remove, shuffles_end
from tallybook.sources.statements import StatementReader

_STORED = T.StructType([*ENRICHED.fields, T.StructField("load_id", T.StringType())])


#: What decides which incoming row of an id comes first.
ARRIVAL = ("source_file", "ingested_at")
#: Rows of a load that are compared with each other and the table at a time; and in how many parts at most.
ROWS_AT_ONCE, MOST_PARTS = 1_000_000, 8


def new_rows(incoming: DataFrame, stored: DataFrame, order: Sequence[str] = ARRIVAL) -> DataFrame:
    """First incoming row of each id that the stored table does not have."""
    unknown = incoming.join(stored.select("transaction_id"), "transaction_id", "left_anti")
    return dedup_first(unknown, *order)


class TransactionStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path
        self.create()

    def create(self) -> None:
        """Make the (empty) table folder; does nothing to an existing table."""
        empty = self.spark.createDataFrame([], _STORED)
        empty.write.mode("append").partitionBy("year", "load_id").parquet(self.path)

    def read(self, *, with_load_id: bool = False) -> DataFrame:
        df = self.spark.read.schema(_STORED).parquet(self.path)
        return df if with_load_id else df.select(*ENRICHED.names)

    def load(self, canonical: DataFrame, load_id: str | None = None, *, order: Sequence[str] = ARRIVAL) -> int:
        """Enrich and append rows with unknown ids; returns how many were new.

        A load repeated under its own ``load_id`` replaces all that it wrote before, in
        every year, so a replay leaves exactly its own rows. ``order`` may name further columns
        of ``canonical``.

        The ids are cut into parts by their hash, one part after the other is shuffled, and its
        shuffle files go before the next one. What is written becomes part of the table at the end.
        """
        load_id = load_id or uuid.uuid4().hex
        more = [c for c in order if c not in CANONICAL.names]
        part = F.pmod(F.xxhash64("transaction_id"), F.lit(MOST_PARTS)).cast("tinyint")
        incoming = require_columns(canonical).select(*CANONICAL.names, *more)
        staging = f"{self.path.rstrip('/')}/_loading-{uuid.uuid4().hex}"
        # Read for its years and for each part: computed once.
        with passing_copy(without_ids(incoming.withColumn("__part", part))) as copy:
            # The day is part of the id, so only stored rows of the same years can match.
            found = copy.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n")).collect()
            years, own = [r.year for r in found], F.col("load_id") == load_id
            before = [r.year for r in self.read(with_load_id=True).filter(own).select("year").distinct().collect()]
            stored = self.read(with_load_id=True).filter(F.col("year").isin(years) & ~own)
            parts = min(MOST_PARTS, max(1, math.ceil(sum(r.n for r in found) / ROWS_AT_ONCE)))
            for number in range(parts):
                some, known = copy, stored
                if parts > 1:
                    some, known = (t.filter(p % parts == number) for t, p in ((copy, F.col("__part")), (stored, part)))
                # Derived columns come last: they are neither shuffled nor worked out for known rows.
                rows = enrich(new_rows(with_ids(some), known, order)).withColumn("load_id", F.lit(load_id))
                # Rows stay in the even partitions that the ids dealt them into: each writes a file for a
                # year, and a further shuffle by year would move every new row again.
                with shuffles_end(self.spark):
                    rows.write.mode("append").option("compression", "zstd").partitionBy("year", "load_id").parquet(staging)
        # What an earlier run of this load left goes, also in years that this one has no new rows for.
        for year in before:
            remove(self.spark, f"{self.path.rstrip('/')}/year={year}/load_id={load_id}")
        self._admit(staging)
        # Only this load's partitions are listed, and no column of them is read.
        return self.read(with_load_id=True).filter(F.col("year").isin(years) & own).count()

    def _admit(self, staging: str) -> None:
        """Move the partitions of a load into the table."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(staging).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for year in files.listStatus(path(staging)):
            if year.isDirectory():
                there = path(self.path, year.getPath().getName())
                files.mkdirs(there)
                for load in files.listStatus(year.getPath()):
                    to = path(there, load.getPath().getName())
                    if not files.rename(load.getPath(), to):
                        raise OSError(f"cannot move {load.getPath()} to {to}")
        files.delete(path(staging), True)

    def load_file(self, path: str, profile: str | None = None, account: str | None = None) -> int:
        """Read one statement file and load it; returns how many rows were new."""
        return self.load(StatementReader(self.spark).ingest(path, profile=profile, account=account).good)

    def row_count(self) -> int:
        return self.read().count()

    def register_views(self) -> None:
        """Temp views for ad-hoc SQL."""
        views(self.read())

    def query(self, sql: str) -> DataFrame:
        self.register_views()
        return self.spark.sql(sql)


def views(tx: DataFrame) -> None:
    """``transactions``, ``v_real``, ``v_expenses``, ``v_income``, ``v_monthly``, ``v_top_merchants``."""
    tx.createOrReplaceTempView("transactions")
    reports.real(tx).createOrReplaceTempView("v_real")
    reports.expenses(tx).createOrReplaceTempView("v_expenses")
    reports.income(tx).createOrReplaceTempView("v_income")
    reports.monthly(tx).createOrReplaceTempView("v_monthly")
    reports.merchant_totals(tx).createOrReplaceTempView("v_top_merchants")


def export_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
