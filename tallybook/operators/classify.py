"""Learned categories: weak labels from the rules, then a multi-class model.

Text features are sublinear TF-IDF over character n-grams, joined by amount
size, sign and weekday.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier, OneVsRest, OneVsRestModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tallybook.operators import softmax
from tallybook.operators.enrich import merchant_categories, with_rule_category
from tallybook.operators.features import char_ngrams, vocabulary, with_numeric_features
from tallybook.operators.skew import attach_group_stats
from tallybook.session import passing_copy

NUMERIC = ["log_amount", "sign", "weekday_f"]


@dataclass
class LinearWeights:
    """A row of weights per category - terms, then NUMERIC - and an intercept for each."""

    coefficients: np.ndarray
    intercepts: np.ndarray


def _sparse_vector(size: int, positions: Column, values: Column) -> Column:
    """A vector from its sorted positions and their values; JSON is how SQL can make one."""
    parts = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"),
        positions.alias("indices"), values.alias("values"),
    )
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), StructType([StructField("v", VectorUDT())]))["v"]


class CategoryModel:
    """Vocabulary with weights, label order, and linear weights or one tree ensemble per label."""

    def __init__(
        self, terms: list[str], idf: list[float], labels: list[str], model: LinearWeights | OneVsRestModel | None
    ) -> None:
        self.terms, self.idf, self.labels, self.model = terms, idf, labels, model

    def _weighed_terms(self, tx: DataFrame, per_term: list[list[float]] | None = None) -> DataFrame:
        """(description, __rows, position, value, weights): known terms of each distinct description.

        A description without any keeps one row of nulls. The list of terms is bounded by the
        size of the vocabulary, so it is broadcast; all else stays in the partitions that
        the grouping by description made.
        """
        per_term = per_term or [[] for _ in self.terms]
        known = tx.sparkSession.createDataFrame(
            [(t, i, float(w), c) for i, (t, w, c) in enumerate(zip(self.terms, self.idf, per_term))],
            "term string, position int, idf double, weights array<double>",
        )
        texts = tx.groupBy("description").agg(F.count("*").alias("__rows"))
        listed = texts.select("description", "__rows", F.explode_outer(char_ngrams(F.col("description"))).alias("term"))
        counted = listed.join(F.broadcast(known), "term", "left").groupBy("description", "position").agg(
            F.first("__rows").alias("__rows"), F.first("idf").alias("idf"), F.first("weights").alias("weights"),
            F.count("*").alias("tf"),
        )
        return counted.withColumn("value", (1 + F.log("tf")) * F.col("idf"))

    def _texts(self, tx: DataFrame) -> DataFrame:
        """(description, __rows, positions, values): the text part of each distinct description."""
        pairs = F.sort_array(F.collect_list(F.when(F.col("position").isNotNull(), F.struct("position", "value"))))
        texts = self._weighed_terms(tx).groupBy("description").agg(
            F.first("__rows").alias("__rows"), pairs.alias("__pairs"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("__norm")
        )
        return texts.select(
            "description", "__rows", F.col("__pairs.position").alias("positions"),
            F.transform("__pairs.value", lambda v: v / F.col("__norm")).alias("values"),
        )

    def features(self, tx: DataFrame, spread_by: str = "transaction_id") -> DataFrame:
        """``features`` vector per row; the text part is built once per description."""
        texts = self._texts(tx)
        vector = _sparse_vector(len(self.terms), F.col("positions"), F.col("values"))
        texts = texts.select("description", "__rows", vector.alias("__text"))
        rows = attach_group_stats(with_numeric_features(tx), texts, ["description"], "__rows", spread_by)
        assembler = VectorAssembler(inputCols=["__text", *NUMERIC], outputCol="features")
        return assembler.transform(rows).select(*tx.columns, "features")

    def _margins(self, tx: DataFrame) -> DataFrame:
        """Rows with ``__margins``: an array of one figure per label, the largest for the likeliest."""
        if isinstance(self.model, LinearWeights):
            return self._linear_margins(tx)
        scored, names = self.features(tx), []
        for i, ensemble in enumerate(self.model.models):
            names.append(f"__raw_{i}")
            ensemble.setFeaturesCol("features").setRawPredictionCol(names[-1])
            scored = ensemble.setPredictionCol("").setProbabilityCol("").transform(scored)
        return scored.select(*tx.columns, F.array(*[vector_to_array(n)[1] for n in names]).alias("__margins"))

    def _linear_margins(self, tx: DataFrame) -> DataFrame:
        """Weights of the known terms summed per distinct description; the rest is arithmetic on the row."""
        weights, n = self.model.coefficients, len(self.terms)
        terms = self._weighed_terms(tx, weights[:, :n].T.tolist())
        norm = F.sqrt(F.sum(F.col("value") * F.col("value")))
        sums = F.array(*[F.sum(F.col("value") * F.col("weights")[c]) / norm for c in range(len(self.labels))])
        texts = terms.groupBy("description").agg(F.first("__rows").alias("__rows"), sums.alias("__sums"))
        rows = attach_group_stats(with_numeric_features(tx), texts, ["description"], "__rows", "transaction_id")
        margins = []
        for c, intercept in enumerate(self.model.intercepts):
            margin = F.coalesce(F.col("__sums")[c], F.lit(0.0)) + F.lit(float(intercept))
            for name, weight in zip(NUMERIC, weights[c, n:]):
                margin = margin + F.col(name) * F.lit(float(weight))
            margins.append(margin)
        return rows.select(*tx.columns, F.array(*margins).alias("__margins"))

    def predict(self, tx: DataFrame, *, rule_first: bool = False) -> DataFrame:
        """Add predicted_category: the model's answer, or the rule's where one applies."""
        names = F.array(*[F.lit(label) for label in self.labels])
        best = F.array_position("__margins", F.array_max("__margins")).cast("int")
        out = self._margins(tx).select(*tx.columns, F.element_at(names, best).alias("predicted_category"))
        if rule_first:
            out = merchant_categories(out, "__rule").withColumn(
                "predicted_category", F.coalesce("__rule", "predicted_category")
            ).drop("__rule")
        return out

    def predict_proba(self, tx: DataFrame) -> DataFrame:
        """One DOUBLE column per category; a row's columns add up to one.

        Softmax of the linear margins. The ensembles each give the odds of their own label
        against the rest; these are brought to a sum of one.
        """
        if isinstance(self.model, LinearWeights):
            raw = F.transform("__margins", lambda m: F.exp(m - F.array_max("__margins")))
        else:
            raw = F.transform("__margins", lambda m: 1 / (1 + F.exp(-2 * m)))
        scored = self._margins(tx).withColumn("__raw", raw)
        total = F.aggregate("__raw", F.lit(0.0), lambda a, x: a + x)
        scored = scored.withColumn("__p", F.transform("__raw", lambda x: x / total))
        return scored.select(
            "transaction_id",
            *[F.col("__p")[i].alias(label) for i, label in enumerate(self.labels)],
        )

    def save(self, spark: SparkSession, path: str) -> None:
        linear = isinstance(self.model, LinearWeights)
        n, none = len(self.terms), np.zeros((len(self.labels), 0))
        by_label = self.model.coefficients if linear else none
        terms = [(i, t, float(w), by_label[:, i].tolist() if linear else []) for i, (t, w) in enumerate(zip(self.terms, self.idf))]
        spark.createDataFrame(terms, "position int, term string, idf double, weights array<double>").coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/terms")
        labels = [
            (i, label, by_label[i, n:].tolist(), float(self.model.intercepts[i]) if linear else None)
            for i, label in enumerate(self.labels)
        ]
        spark.createDataFrame(labels, "position int, label string, weights array<double>, intercept double").coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/labels")
        if not linear:
            self.model.write().overwrite().save(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str, *, trees: bool = False) -> CategoryModel:
        terms = spark.read.parquet(f"{path}/terms").orderBy("position").collect()
        labels = spark.read.parquet(f"{path}/labels").orderBy("position").collect()
        if trees:
            model = OneVsRestModel.load(f"{path}/model")
        else:
            by_term = np.array([r.weights for r in terms]).reshape(len(terms), len(labels)).T
            model = LinearWeights(
                np.hstack([by_term, np.array([r.weights for r in labels])]), np.array([r.intercept for r in labels])
            )
        return cls([r.term for r in terms], [r.idf for r in terms], [r.label for r in labels], model)


class TransactionClassifier:
    """Settings of the classifier; ``fit`` returns a model.

    The default is multinomial logistic regression. ``trees=True`` boosts one
    tree ensemble per category instead, which costs far more.
    """

    def __init__(
        self, *, vocabulary_size: int = 3000, max_iter: int = 25, trees: bool = False, n_trees: int = 200
    ) -> None:
        self.vocabulary_size = vocabulary_size
        self.max_iter = max_iter
        self.trees = trees
        self.n_trees = n_trees

    def _ensembles(self, train: DataFrame) -> OneVsRestModel:
        boosted = GBTClassifier(
            maxIter=self.n_trees, maxDepth=5, stepSize=0.1,
            subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42,
        )
        return OneVsRest(classifier=boosted, weightCol="weight").fit(train)

    def fit(self, tx: DataFrame) -> CategoryModel:
        """Learn from all rows: equal ones are one training row with their count as its weight."""
        day = F.col("day_of_week") if "day_of_week" in tx.columns else F.lit(0).alias("day_of_week")
        # Stored once: several passes follow, all of them here.
        alike = with_rule_category(tx.select("description", "amount", day), "__label")
        alike = alike.groupBy("description", "amount", "day_of_week", "__label").agg(F.count("*").alias("weight"))
        with passing_copy(alike) as rows:
            # Both lists are bounded: the vocabulary by its size, labels by the rule table.
            terms = vocabulary(rows, self.vocabulary_size, weight="weight").collect()
            labels = sorted(r[0] for r in rows.select("__label").distinct().collect())
            model = CategoryModel([r.term for r in terms], [r.idf for r in terms], labels, None)
            position = F.array_position(F.array(*[F.lit(label) for label in labels]), F.col("__label"))
            rows = rows.withColumn("label", position - 1)
            if self.trees:
                train = model.features(rows.withColumn("label", F.col("label").cast("double")), spread_by="amount")
                model.model = self._ensembles(train.select("features", "label", F.col("weight").cast("double").alias("weight")))
            else:
                # Stored once: every round of the fit is a pass over the blocks.
                figures = with_numeric_features(rows).select("description", "label", "weight", "amount", *NUMERIC)
                with passing_copy(softmax.blocks(figures, model._texts(rows), "description", NUMERIC, "amount")) as table:
                    model.model = LinearWeights(*softmax.fit(
                        table, len(model.terms), len(NUMERIC), len(labels), max_iter=self.max_iter, penalty=1e-4
                    ))
        return model

    def fit_predict(self, tx: DataFrame, **kwargs) -> DataFrame:
        return self.fit(tx).predict(tx, **kwargs)
