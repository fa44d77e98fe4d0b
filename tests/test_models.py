"""Ranks, features, forecasts, anomaly and category models against brute force."""

import datetime as dt
from fractions import Fraction
import math
import os
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallybook import session
from tallybook.operators import features, forecast, ranking, reports
from tallybook.operators.anomaly import AnomalyDetector, AnomalyModel, _depths, _grow, _pack, flagged_share, top_anomalies
from tallybook.operators.classify import CategoryModel, LinearWeights, TransactionClassifier
from tallybook.operators.enrich import with_rule_category
from tallybook.operators.skew import attach_group_stats
from tallybook.plans.fixtures import transactions
from tallybook.session import reliable_checkpoint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tx(spark):
    return reliable_checkpoint(transactions(spark, SF))


def test_rank_and_quantile(spark):
    rng = np.random.default_rng(1)
    values = [float(v) for v in np.concatenate([np.full(700, 3.0), rng.normal(3, 2, 1300).round(2)])]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    for buckets in (1, 7, 50):
        got = {r.id: r.rank for r in ranking.min_rank(df, "v", "id", rows_per_range=buckets).collect()}
        order = np.sort(values)
        assert got == {i: int(np.searchsorted(order, v)) + 1 for i, v in enumerate(values)}
    for q in (0.0, 0.05, 0.5, 0.731, 1.0):
        for limit in (10_000, 100, 20):
            assert ranking.exact_quantile(df, "v", q) == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_hot_groups_are_joined_whole(spark):
    keys = ["hot"] * 3000 + [f"k{i}" for i in range(3000)]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k string")
    stats = df.groupBy("k").agg(F.count("*").alias("n"))
    got = attach_group_stats(df, stats, ["k"], "n", "id").collect()
    assert len(got) == 6000
    assert all(r.n == (3000 if r.k == "hot" else 1) for r in got)


def _char_wb(text):
    grams = Counter()
    for word in text.lower().split():
        padded = f" {word} "
        for n in (2, 3, 4):
            grams.update(padded[i:i + n] for i in range(max(1, len(padded) - n + 1)))
            if len(padded) <= n:
                break
    return grams


def test_char_ngrams(spark):
    texts = ["a", "ab cd", "été  x", "Carrefour MARKET 12", "", "aaaa aaaa"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", features.char_ngrams(F.col("t")).alias("g")).collect():
        assert Counter(row.g) == _char_wb(row.t), row.t


def _series(spark, days, value):
    start = dt.date(2024, 1, 1)
    rows = [("s", start + dt.timedelta(i), float(value(i))) for i in range(days)]
    return spark.createDataFrame(rows, "account string, ds date, y double")


def test_linear_forecast_recovers_a_line(spark):
    totals = _series(spark, 400, lambda i: 10 + 0.5 * i)
    fit = forecast.linear_fit(totals, "account")
    ahead = forecast.linear_forecast(fit, "account", horizon=5).orderBy("ds").collect()
    assert [r.ds for r in ahead] == [dt.date(2024, 1, 1) + dt.timedelta(400 + i) for i in range(5)]
    for i, r in enumerate(ahead):
        assert r.yhat == pytest.approx(10 + 0.5 * (400 + i), rel=1e-4)
        assert r.yhat_lower < r.yhat < r.yhat_upper


def test_linear_fit_keeps_digits_of_large_amounts(spark):
    """Amounts of 10^9 on late dates with gaps, against exact arithmetic."""
    start = dt.date(2090, 1, 1)
    days = {i: Fraction(10**9) + Fraction(i * i % 97, 128) for i in range(0, 700, 3)}
    rows = [("a", start + dt.timedelta(i), float(y)) for i, y in days.items()]
    fit = forecast.linear_fit(spark.createDataFrame(rows, "account string, ds date, y double"), "account").first()
    n = max(days) + 1
    mean, middle = sum(days.values()) / n, Fraction(n - 1, 2)
    sxy = sum(y * (i - middle) for i, y in days.items())
    sxx = sum((i - middle) ** 2 for i in range(n))
    slope = sxy / (sxx + 1)
    variance = sum((days.get(i, 0) - mean) ** 2 for i in range(n)) / n
    assert fit.slope == pytest.approx(float(slope), rel=1e-12, abs=1e-9)
    assert fit.intercept == pytest.approx(float(mean - slope * middle), rel=1e-13)
    assert fit.spread == pytest.approx(float(variance) ** 0.5, rel=1e-12)
    flat = [("a", start + dt.timedelta(i), 1e9 + (i % 2) / 1024) for i in range(400)]
    fit = forecast.linear_fit(spark.createDataFrame(flat, "account string, ds date, y double"), "account").first()
    assert fit.spread == pytest.approx(1 / 2048, rel=1e-5)


def test_short_series_are_rejected(spark):
    totals = _series(spark, 13, lambda i: 1)
    fit = forecast.linear_fit(totals, "account")
    assert forecast.linear_forecast(fit, "account").count() == 0
    assert forecast.seasonal_forecast(totals, "account").count() == 0
    assert forecast.rejected(fit, "account").first().reason == "not enough history (13 days), need at least 14"


def test_seasonal_forecast_follows_the_week(spark):
    totals = _series(spark, 365, lambda i: 100 if i % 7 >= 5 else 20)
    ahead = forecast.seasonal_forecast(totals, "account", horizon=28).filter("is_forecast").collect()
    assert len(ahead) == 28
    for r in ahead:
        weekend = (r.ds - dt.date(2024, 1, 1)).days % 7 >= 5
        assert abs(r.yhat - (100 if weekend else 20)) < 15
        assert 0 <= r.yhat_lower <= r.yhat <= r.yhat_upper


def test_holidays():
    assert forecast.easter(2024) == dt.date(2024, 3, 31) and forecast.easter(2025) == dt.date(2025, 4, 20)
    days = forecast.holidays(2025)
    assert len(days) == 11 and days[dt.date(2025, 5, 29)] == "ascension"


def test_spine_is_gap_free(spark):
    totals = _series(spark, 100, lambda i: i + 1).filter("dayofmonth(ds) % 3 <> 0")
    series = forecast.daily_series(totals, "account")
    span = totals.agg(F.datediff(F.max("ds"), F.min("ds")) + 1).first()[0]
    assert series.count() == span
    assert series.agg(F.sum("y")).first()[0] == totals.agg(F.sum("y")).first()[0]


def test_categories_add_up(tx):
    parts = reports.category_summary(tx).agg(F.round(F.sum("total"), 2)).first()[0]
    assert parts == pytest.approx(reports.summary(tx).first().total_expenses, abs=0.05)


def test_planted_outliers_rank_first(spark):
    rng = np.random.default_rng(3)
    rows = [
        (str(i), dt.date(2024, 1, 1) + dt.timedelta(int(rng.integers(0, 28))), f"shop {i % 5}",
         -round(float(rng.normal(50, 5)), 2), "EUR", "card_payment", "a")
        for i in range(250)  # every tree sees the whole table
    ]
    rows += [("odd", dt.date(2024, 12, 29), "once only", 90000.0, "EUR", "card_payment", "a")]
    names = "transaction_id string, date date, description string, amount double, currency string, tx_type string, account string"
    tx = spark.createDataFrame(rows, names)
    scored = reliable_checkpoint(AnomalyDetector(n_estimators=100).fit_predict(tx))
    best = top_anomalies(scored, 5).collect()
    assert best[0].description == "once only" and best[0].anomaly_rank == 1
    assert [r.anomaly_rank for r in best] == sorted(r.anomaly_rank for r in best)
    share = flagged_share(scored).first()
    assert share.share == pytest.approx(0.05, abs=0.01) and share.scored == 251
    scores = [r[0] for r in scored.orderBy("anomaly_rank").select("anomaly_score").collect()]
    assert scores == sorted(scores)


def test_scores_follow_the_trees(spark, tx):
    real = reports.real(tx)
    model = AnomalyDetector(n_estimators=10).fit(real)
    nodes = {(n.tree, n.node): n for n in model.nodes.itertuples()}
    table = features.standardise(
        features.with_anomaly_features(real), features.ANOMALY_FEATURES, model.figures
    )
    norm = 2 * (math.log(255) + np.euler_gamma) - 2 * 255 / 256
    scores = {r.transaction_id: r["__score"] for r in model.raw_scores(real).collect()}
    for row in table.orderBy("transaction_id").limit(20).collect():
        depth = 0.0
        for tree in range(10):
            node = nodes[tree, 0]
            while node.feature >= 0:
                below = row[features.ANOMALY_FEATURES[node.feature]] <= node.cut
                node = nodes[tree, node.left if below else node.right]
            depth += node.depth
        assert scores[row.transaction_id] == pytest.approx(-(2 ** (-depth / 10 / norm)))


def test_packed_trees_equal_a_plain_walk():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(700, len(features.ANOMALY_FEATURES))), 1)
    x[:, 1], x[:, 3] = np.sign(x[:, 1]), 0.0
    names = ["tree", "node", "feature", "cut", "left", "right", "depth"]
    grown = [(t, *n) for t in range(12) for n in _grow(x[t * 50:t * 50 + (256 if t else 1)], rng, 8)]
    x[0, :], x[1, 0], x[2, 2] = np.nan, np.inf, -np.inf
    x[3, 0] = next(n[3] for n in grown if n[2] == 0)  # a value equal to a cut goes left
    nodes = {(n[0], n[1]): n for n in grown}
    want = []
    for row in x:
        total = 0.0
        for tree in range(12):
            node = nodes[tree, 0]
            while node[2] >= 0:
                node = nodes[tree, node[5] if row[node[2]] > node[3] else node[4]]
            total += node[6]
        want.append(total)
    assert _depths(x, _pack(pd.DataFrame(grown, columns=names))).tolist() == want


def test_top_ranks_as_all_ranks_do(tx):
    """Amounts by the hundred and one currency: many rows share a score."""
    real = reports.real(tx).withColumns({"amount": F.round("amount", -4), "description": F.lit("shop")})
    detector = AnomalyDetector(n_estimators=5)
    scored = reliable_checkpoint(detector.fit_predict(real))
    places = lambda df: [(r.anomaly_rank, r.anomaly_score) for r in df.collect()]
    assert places(detector.fit_top(real, 40)) == places(top_anomalies(scored, 40))
    assert len({rank for rank, _ in places(detector.fit_top(real, 40))}) < 40
    every = detector.fit_top(real, 100_000).collect()
    assert len(every) == scored.where("anomaly_flag").count()


def test_a_fit_works_its_rows_out_once(spark, tx):
    few = reliable_checkpoint(reports.real(tx).limit(300))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    AnomalyDetector(n_estimators=3).fit_predict(few.withColumn("description", told.asNondeterministic()("description")))
    assert seen.value == 300


def test_anomaly_model_is_repeatable_and_can_be_stored(spark, tx, tmp_path):
    real = reports.real(tx)
    detector = AnomalyDetector(n_estimators=40)
    model = detector.fit(real, keep_stats=True)
    scores = lambda df: {r.transaction_id: (r.anomaly_score, r.anomaly_flag) for r in df.collect()}
    first = scores(model.predict(real))
    assert first == scores(detector.fit_predict(real))
    model.save(spark, str(tmp_path / "m"))
    assert scores(AnomalyModel.load(spark, str(tmp_path / "m")).predict(real)) == first
    frozen = AnomalyModel.load(spark, str(tmp_path / "m"), frozen_stats=True)
    assert scores(frozen.predict(real, ranked=False)) == first
    few = frozen.predict(real.limit(5), ranked=False).collect()
    assert all(first[r.transaction_id] == (r.anomaly_score, r.anomaly_flag) for r in few)


@pytest.mark.parametrize("rows", [1, 3, 300, 700])
def test_small_tables_still_grow_every_tree(tx, rows):
    some = reliable_checkpoint(reports.real(tx).orderBy("transaction_id").limit(rows))
    model = AnomalyDetector(n_estimators=20).fit(some)
    assert model.nodes["tree"].nunique() == 20
    assert model.predict(some).count() == rows


def test_classifier(spark, tx, tmp_path):
    model = TransactionClassifier(vocabulary_size=500, max_iter=15).fit(tx)
    tagged = with_rule_category(model.predict(tx))
    hit = tagged.agg(F.avg((F.col("rule_category") == F.col("predicted_category")).cast("double"))).first()[0]
    assert hit > 0.97
    proba = model.predict_proba(tx)
    assert proba.columns == ["transaction_id", *model.labels]
    total = sum(F.col(f"`{c}`") for c in model.labels)
    assert proba.agg(F.max(F.abs(total - 1))).first()[0] < 1e-9
    model.save(spark, str(tmp_path / "c"))
    loaded = CategoryModel.load(spark, str(tmp_path / "c"))
    key = lambda df: sorted(map(tuple, df.select("transaction_id", "predicted_category").collect()))
    assert key(loaded.predict(tx)) == key(model.predict(tx))
    ruled = with_rule_category(model.predict(tx, rule_first=True))
    wrong = ruled.filter("rule_category not in ('Revenus', 'Autre') and rule_category <> predicted_category")
    assert wrong.count() == 0


def test_weights_of_counts_equal_all_rows(spark, tx):
    """Equal rows are one training row with a count: the fit is that of MLlib on every row."""
    few = reliable_checkpoint(tx.select("transaction_id", "description", F.round("amount", -2).alias("amount"), "day_of_week"))
    model = TransactionClassifier(vocabulary_size=200, max_iter=60).fit(few)
    labelled = with_rule_category(few, "label_name")
    label = F.array_position(F.array(*[F.lit(c) for c in model.labels]), F.col("label_name")) - 1
    rows = model.features(labelled.withColumn("label", label.cast("double")))
    plain = LogisticRegression(maxIter=60, regParam=1e-4, family="multinomial").fit(rows.select("features", "label"))
    proba = {r.transaction_id: list(r.p) for r in plain.transform(rows).select("transaction_id", vector_to_array("probability").alias("p")).collect()}
    for row in model.predict_proba(few).collect():
        assert list(row)[1:] == pytest.approx(proba[row[0]], abs=0.02)
    # The same weights give what MLlib gives for them.
    model.model = LinearWeights(plain.coefficientMatrix.toArray(), plain.interceptVector.toArray())
    for row in model.predict_proba(few).collect():
        assert list(row)[1:] == pytest.approx(proba[row[0]], abs=1e-9)


def test_tree_ensembles(spark, tx, tmp_path):
    some = reliable_checkpoint(tx.filter("pmod(xxhash64(transaction_id), 4) = 0"))
    model = TransactionClassifier(vocabulary_size=40, trees=True, n_trees=3).fit(some)
    proba = {r[0]: list(r)[1:] for r in model.predict_proba(some).collect()}
    tagged = {r.transaction_id: r.predicted_category for r in model.predict(some).collect()}
    for i, shares in proba.items():
        assert sum(shares) == pytest.approx(1) and min(shares) > 0
        assert shares[model.labels.index(tagged[i])] == pytest.approx(max(shares))
    right = with_rule_category(model.predict(some)).agg(F.avg((F.col("rule_category") == F.col("predicted_category")).cast("double")))
    assert right.first()[0] > 0.6
    model.save(spark, str(tmp_path / "t"))
    loaded = CategoryModel.load(spark, str(tmp_path / "t"), trees=True)
    assert {r[0]: list(r)[1:] for r in loaded.predict_proba(some).collect()} == proba


def test_texts_without_known_terms_and_one_label(spark):
    columns = "transaction_id string, description string, amount double, day_of_week int"
    df = spark.createDataFrame([("a", "netflix", -9.0, 1), ("b", "netflix", -9.0, 2)], columns)
    model = TransactionClassifier(vocabulary_size=20).fit(df)
    other = spark.createDataFrame([("c", "zz", -1.0, 0), ("d", "", 5.0, 0), ("e", None, 1.0, 0)], columns)
    assert [(r.transaction_id, r.predicted_category) for r in model.predict(other).orderBy("transaction_id").collect()] == [
        (i, model.labels[0]) for i in "cde"
    ]
    assert [r[1] for r in model.predict_proba(other).collect()] == [1.0] * 3


def test_tfidf_weights(spark):
    texts = ["ab ab", "ab cd"]
    df = spark.createDataFrame(
        [(str(i), t, -1.0, 0) for i, t in enumerate(texts)],
        "transaction_id string, description string, amount double, day_of_week int",
    )
    terms = features.vocabulary(df, 100).collect()
    model = CategoryModel([r.term for r in terms], [r.idf for r in terms], [], None)
    for row in model.features(df).collect():
        counts = _char_wb(row.description)
        docs = {t: sum(t in _char_wb(d) for d in texts) for t in counts}
        raw = {t: (1 + math.log(c)) * (math.log(3 / (1 + docs[t])) + 1) for t, c in counts.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        for t, v in raw.items():
            assert row.features[model.terms.index(t)] == pytest.approx(v / norm)


def test_series_of_repeated_blank_and_null_days(spark):
    rows = [("a", dt.date(2024, 1, 1), 2.0), ("a", dt.date(2024, 1, 4), None), ("a", None, 9.0), (None, dt.date(2024, 2, 1), 3.0), ("b", dt.date(2024, 1, 2), 1.0), ("b", dt.date(2024, 1, 2), 4.0)]
    series = forecast.daily_series(spark.createDataFrame(rows, "account string, ds date, y double"), "account")
    found = sorted((r.account or "", r.ds.isoformat(), r.y) for r in series.collect())
    assert found == [
        ("", "2024-02-01", 3.0), ("a", "2024-01-01", 2.0), ("a", "2024-01-02", 0.0), ("a", "2024-01-03", 0.0),
        ("a", "2024-01-04", 0.0), ("b", "2024-01-02", 1.0), ("b", "2024-01-02", 4.0),
    ]


def test_a_fit_leaves_only_the_scores_stored(spark, tx, monkeypatch):
    """The copies that the fit passes over are gone; a row's id is shuffled in half its length."""
    stored = []
    monkeypatch.setattr(session, "_store", lambda df, plain=session._store: stored.append(plain(df)) or stored[-1])
    scored = AnomalyDetector(n_estimators=5).fit_predict(reports.real(tx), keep=["transaction_id"])
    there = [d.columns for d, folder in stored if os.path.exists(folder.removeprefix("file:"))]
    assert ["transaction_id", "__score"] in there
    assert not any("log_amount" in c or "description" in c for c in there if "merchant_freq" not in c)
    assert "unhex" in scored._jdf.queryExecution().optimizedPlan().toString()
    assert scored.select("transaction_id").exceptAll(reports.real(tx).select("transaction_id")).isEmpty()


def test_a_classifier_leaves_no_rows_stored(spark, tx, monkeypatch):
    stored = []
    monkeypatch.setattr(session, "_store", lambda df, plain=session._store: stored.append(plain(df)) or stored[-1])
    TransactionClassifier(vocabulary_size=40, max_iter=2).fit(tx)
    gone = [d.columns for d, folder in stored if not os.path.exists(folder.removeprefix("file:"))]
    assert sum("weight" in c or "positions" in c for c in gone) == 2
