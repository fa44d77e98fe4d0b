"""Refitting the models after a load: a hook for ``InboxStream(on_new_rows=...)``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.money import exact
from tallybook.operators import ranking, reports
from tallybook.operators.anomaly import AnomalyDetector
from tallybook.operators.classify import TransactionClassifier
from tallybook.operators.store import TransactionStore


@dataclass
class Refit:
    """Fits classifier and detector on the store and keeps them under ``folder``.

    The classifier learns from all rows, the detector from real ones. ``latest`` then holds
    ``categories`` (the five predicted categories with the largest spend: sums of negative
    amounts), ``flagged`` (how many rows the detector flags) and ``lowest`` (the three most
    anomalous of them). One that fails is noted in ``errors`` and does not keep the other
    from its work. Tables of fewer rows than ``least_rows`` are left alone.
    """

    folder: str
    classifier: TransactionClassifier = field(default_factory=TransactionClassifier)
    detector: AnomalyDetector = field(default_factory=AnomalyDetector)
    least_rows: int = 10
    latest: dict[str, object] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)

    def __call__(self, store: TransactionStore, report: object = None) -> None:
        rows = store.read()
        if rows.count() < self.least_rows:
            return
        self.latest, self.errors = {}, []
        for name, refit in (("categories", self._categories), ("anomalies", self._anomalies)):
            try:
                self.latest |= refit(store, rows)
            except Exception as exc:  # the other model is refitted all the same
                self.errors.append(f"{name}: {exc}")

    def _categories(self, store: TransactionStore, rows: DataFrame) -> dict[str, object]:
        model = self.classifier.fit(rows)
        model.save(store.spark, f"{self.folder}/categories")
        spent = model.predict(rows).where("amount < 0").groupBy("predicted_category").agg(
            F.round(F.sum(exact(F.col("amount"))), 2).cast("double").alias("spent")
        )
        return {"categories": ranking.lowest_k(spent, 5, "spent", "predicted_category").collect()}

    def _anomalies(self, store: TransactionStore, rows: DataFrame) -> dict[str, object]:
        model, scored = self.detector.fit_scored(reports.real(rows), keep_stats=True)
        model.save(store.spark, f"{self.folder}/anomalies")
        flagged = scored.where("anomaly_flag").select("transaction_id", "anomaly_rank", "date", "description", "amount", "anomaly_score")
        return {
            "flagged": flagged.count(),
            "lowest": ranking.lowest_k(flagged, 3, "anomaly_rank", "transaction_id").collect(),
        }
