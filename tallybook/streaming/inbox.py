"""Statement files as a stream: each micro-batch of new files is ingested and stored.

The checkpoint remembers which files were read, so nothing has to be moved for
correctness. Writers should land files with a rename: a file is read when it
appears.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallybook.operators.store import TransactionStore
from tallybook.sources.profiles import ProfileRegistry
from tallybook.sources.statements import ROW_ORDER, StatementReader

# Columns of the binary-file source; the content column is never selected.
_FILES = "path string, modificationTime timestamp, length bigint, content binary"


KEPT_REPORTS = 1000


@dataclass
class BatchReport:
    batch_id: int
    files_ok: int
    files_failed: int
    inserted: int


class InboxStream:
    """Watches a folder and loads what arrives.

    ``on_new_rows(store, report)`` runs after batches that added rows, e.g. to
    score them with the latest saved models; its errors do not stop the stream.
    """

    def __init__(
        self,
        spark: SparkSession,
        inbox: str,
        store: TransactionStore,
        checkpoint: str,
        *,
        archive: str | None = None,
        registry: ProfileRegistry | None = None,
        account: str | None = None,
        on_new_rows: Callable[[TransactionStore, BatchReport], None] | None = None,
        stream_name: str = "inbox",
    ) -> None:
        self.spark = spark
        self.inbox = inbox
        self.store = store
        self.checkpoint = checkpoint
        self.archive = archive
        self.reader = StatementReader(spark, registry)
        self.account = account
        self.on_new_rows = on_new_rows
        self.stream_name = stream_name
        self.own_id = uuid.uuid4().hex  # for batches that no stream runs
        self.quarantine = f"{checkpoint}-quarantine"
        # The latest batches only: a watched folder may run for years.
        self.reports: deque[BatchReport] = deque(maxlen=KEPT_REPORTS)
        self.hook_errors: deque[str] = deque(maxlen=KEPT_REPORTS)

    def process_batch(self, files: DataFrame, batch_id: int) -> None:
        result = self.reader.ingest_files(
            files.select("path"),
            account=self.account,
            use_filename=True,
            derive_account=self.account is None,
        )
        # A batch is named by the stream's own id, which lives in its checkpoint: a replay
        # rewrites the same rows, and another stream or a fresh checkpoint never does.
        stream = self.spark.sparkContext.getLocalProperty("sql.streaming.queryId") or self.own_id
        load_id = f"{self.stream_name}-{stream}-{batch_id}"
        # The load keeps the first row of each id, by its place as `good` does.
        inserted = self.store.load(result.kept, load_id=load_id, order=ROW_ORDER)
        result.quarantine.withColumn("load_id", F.lit(load_id)).write.mode("overwrite").parquet(
            f"{self.quarantine}/load={load_id}"
        )
        ok, failed = result.files.agg(
            F.count_if(F.col("error").isNull()), F.count_if(F.col("error").isNotNull())
        ).first()
        bad = result.failed_files
        if failed:
            bad.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
                f"{self.checkpoint}-failed/batch={batch_id}"
            )
        report = BatchReport(batch_id, ok, failed, inserted)
        self.reports.append(report)
        if inserted and self.on_new_rows is not None:
            try:
                self.on_new_rows(self.store, report)
            except Exception as exc:  # scoring must not stop the loads
                self.hook_errors.append(f"batch {batch_id}: {exc}")

    def _files(self) -> DataFrame:
        source = self.spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.csv")
        if self.archive:
            # Files move once a later batch has been committed.
            source = source.option("cleanSource", "archive").option("sourceArchiveDir", self.archive)
        return source.load(self.inbox).select("path")

    def _start(self, **trigger) -> StreamingQuery:
        return (
            self._files()
            .writeStream.foreachBatch(self.process_batch)
            .option("checkpointLocation", self.checkpoint)
            .trigger(**trigger)
            .start()
        )

    def watch(self, interval: str = "30 seconds") -> StreamingQuery:
        return self._start(processingTime=interval)

    def drain(self) -> list[BatchReport]:
        """Process what is there and stop."""
        self._start(availableNow=True).awaitTermination()
        return list(self.reports)
