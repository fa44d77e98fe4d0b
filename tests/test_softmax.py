"""The category fit over blocks: each text once, results as MLlib's on every row."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from tallybook.operators import features, softmax
from tallybook.operators.classify import TransactionClassifier
from tallybook.plans import queries

TEXTS = {"a": ([0, 2], [0.6, 0.8]), "b": ([1], [1.0]), "c": ([0, 1, 2], [0.48, 0.6, 0.64]), "": ([], [])}


def _rows(n):
    rng = np.random.default_rng(5)
    names = rng.choice(list(TEXTS), n)
    return [
        (str(t), int((ord(t[0]) if t else 0) + (x > 0.4)) % 3, int(rng.integers(1, 4)), float(x), float(d))
        for t, x, d in zip(names, rng.normal(size=n), rng.integers(0, 7, n))
    ]


def _blocks(spark, rows):
    table = spark.createDataFrame(rows, "text string, label int, weight long, x double, d double")
    texts = spark.createDataFrame([(t, *v) for t, v in TEXTS.items()], "text string, positions array<int>, values array<double>")
    return softmax.blocks(table, texts, "text", ["x", "d"], "x")


@pytest.mark.parametrize("per_block", [20_000, 37])
def test_equals_mllib_on_every_row(spark, monkeypatch, per_block):
    monkeypatch.setattr(softmax, "ROWS_PER_BLOCK", per_block)
    monkeypatch.setattr(softmax, "ROWS_AT_ONCE", 50)  # cuts through blocks
    rows = _rows(900)
    weights, intercepts = softmax.fit(_blocks(spark, rows), 3, 2, 3, max_iter=100, penalty=1e-3, tolerance=1e-9)
    vectors = [
        (SparseVector(5, [*TEXTS[t][0], 3, 4], [*TEXTS[t][1], x, d]), float(label), float(w)) for t, label, w, x, d in rows
    ]
    plain = LogisticRegression(maxIter=100, regParam=1e-3, tol=1e-9, family="multinomial", weightCol="w").fit(
        spark.createDataFrame(vectors, ["features", "label", "w"])
    )
    assert weights == pytest.approx(plain.coefficientMatrix.toArray(), abs=1e-3)
    assert intercepts == pytest.approx(plain.interceptVector.toArray(), abs=1e-3)


def test_a_text_is_stored_once_for_many_rows_and_no_row_is_lost(spark, monkeypatch):
    monkeypatch.setattr(softmax, "ROWS_PER_BLOCK", 100)
    rows = _rows(900)
    stored = _blocks(spark, rows).select("positions", F.size("rows").alias("n"), F.explode("rows").alias("r")).cache()
    assert sorted((r.label, r.weight, *r.numeric) for (r,) in stored.select("r").collect()) == sorted(r[1:] for r in rows)
    blocks = _blocks(spark, rows).select(F.size("rows").alias("n")).collect()
    assert len(blocks) <= 15 and max(b.n for b in blocks) <= 200


def test_columns_that_never_differ_weigh_nothing(spark):
    rows = [("a", i % 2, 1, 3.0, float(i)) for i in range(40)]
    weights, _ = softmax.fit(_blocks(spark, rows), 3, 2, 2, max_iter=10, penalty=1e-4)
    assert not weights[:, :4].any() and weights[:, 4].any()


def test_fit_stores_no_vector_for_each_row(spark, monkeypatch):
    """One long text with 3,000 amounts: its terms are stored once, not 3,000 times."""
    seen = []
    fit = softmax.fit
    monkeypatch.setattr(softmax, "fit", lambda table, *a, **k: seen.append(table) or fit(table, *a, **k))
    name = " ".join(f"word{i}" for i in range(40))
    tx = spark.range(3000).select(
        F.col("id").cast("string").alias("transaction_id"), F.lit(name).alias("description"),
        (F.col("id") - 1500.5).alias("amount"), F.lit(1).alias("day_of_week"),
    )
    TransactionClassifier(max_iter=2).fit(tx)
    sizes = seen[0].agg(F.sum(F.size("positions")).alias("terms"), F.sum(F.size("rows")).alias("rows")).first()
    assert sizes.rows == 3000 and sizes.terms < 3000


def test_amounts_without_a_value_are_an_error(spark):
    with pytest.raises(ValueError, match="not finite"):
        softmax.fit(_blocks(spark, [("a", 0, 1, float("nan"), 1.0), ("b", 1, 1, 1.0, 2.0)]), 3, 2, 2, max_iter=3, penalty=1e-4)


def test_vocabulary_and_fixed_weights_work_out_their_table_once(spark):
    tx = spark.range(20).select(F.concat(F.lit("ab "), F.col("id") % 3).alias("description"))
    terms = features.vocabulary(tx, 50)
    assert "Range (" not in terms._jdf.queryExecution().optimizedPlan().toString()
    assert {r.term: (r.occurrences, r.documents) for r in terms.collect()}[" a"] == (20, 20)
    _, rows = queries._fixed_weights(spark, "/root/testdata/sf0.001")
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
