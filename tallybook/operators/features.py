"""Feature columns of the learned operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.money import exact
from tallybook.operators.skew import attach_group_stats
from tallybook.session import reliable_checkpoint

ANOMALY_FEATURES = [
    "log_amount", "sign", "day_of_week_f", "hour_f", "is_weekend",
    "log_freq", "amount_zscore", "month_f",
]

MIN_STD, MAX_Z = 1e-6, 5.0


def merchant_stats(tx: DataFrame) -> DataFrame:
    """Frequency, mean and sample deviation of |amount| per merchant (0 for singletons)."""
    size = F.abs("amount")
    return tx.groupBy("description").agg(
        F.count("*").alias("merchant_freq"),
        (F.sum(exact(size)).cast("double") / F.count("*")).alias("merchant_mean"),
        F.coalesce(F.stddev_samp(size), F.lit(0.0)).alias("merchant_std"),
    )


def with_merchant_stats(
    tx: DataFrame, stats: DataFrame | None = None, spread_by: str = "transaction_id"
) -> DataFrame:
    """Merchant figures on every row.

    ``stats`` freezes them as they were at another time (a stream scores against
    a saved table); a merchant it does not know counts as seen once.
    """
    if stats is None:
        return attach_group_stats(tx, merchant_stats(tx), ["description"], "merchant_freq", spread_by)
    known = attach_group_stats(tx, stats, ["description"], "merchant_freq", spread_by)
    return known.withColumns({
        "merchant_freq": F.coalesce("merchant_freq", F.lit(1)),
        "merchant_mean": F.coalesce("merchant_mean", F.abs("amount")),
        "merchant_std": F.coalesce("merchant_std", F.lit(0.0)),
    })


def amount_zscore() -> Column:
    """Deviation of |amount| from its merchant's mean, clipped to five deviations."""
    std = F.when(F.col("merchant_std") < MIN_STD, F.lit(1.0)).otherwise(F.col("merchant_std"))
    z = (F.abs("amount") - F.col("merchant_mean")) / std
    return F.least(F.lit(MAX_Z), F.greatest(F.lit(-MAX_Z), z))


def with_anomaly_features(
    tx: DataFrame,
    *,
    stats: DataFrame | None = None,
    hour_col: str = "ingested_at",
    spread_by: str = "transaction_id",
) -> DataFrame:
    """Eight DOUBLE columns; parts the table lacks are derived or take a default."""
    have = set(tx.columns)
    day = F.col("day_of_week") if "day_of_week" in have else F.weekday("date")
    month = F.col("month") if "month" in have else F.month("date")
    hour = F.hour(hour_col) if hour_col in have else F.lit(12)
    return with_merchant_stats(tx, stats, spread_by).withColumns({
        "log_amount": F.log1p(F.abs("amount")),
        "sign": F.signum("amount"),
        "day_of_week_f": day.cast("double"),
        "hour_f": hour.cast("double"),
        "is_weekend": (day >= 5).cast("double"),
        "log_freq": F.log1p(F.col("merchant_freq").cast("double")),
        "amount_zscore": amount_zscore(),
        "month_f": month.cast("double"),
    })


def scaling(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: row count, mean and population deviation (0 -> 1) of every column."""
    figures = [F.count("*").alias("n_rows")]
    for c in columns:
        std = F.stddev_pop(c)
        figures += [
            F.avg(c).alias(f"{c}_mean"),
            F.when(std > 0, std).otherwise(1.0).alias(f"{c}_std"),
        ]
    return df.agg(*figures)


def standardise(df: DataFrame, columns: list[str], figures: dict[str, float]) -> DataFrame:
    """Mean 0 and deviation 1, with the figures of ``scaling(...).first()``."""
    return df.withColumns({
        c: (F.col(c) - F.lit(figures[f"{c}_mean"])) / F.lit(figures[f"{c}_std"]) for c in columns
    })


def zscore_outliers(tx: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Rows whose amount is far from what their merchant usually charges."""
    scored = with_merchant_stats(tx).withColumn("amount_zscore", amount_zscore())
    return scored.filter(F.abs("amount_zscore") > threshold)


# -- text --------------------------------------------------------------------

NGRAM_SIZES = (2, 3, 4)


def char_ngrams(text: Column, sizes: tuple[int, ...] = NGRAM_SIZES) -> Column:
    """Character n-grams inside blank-padded words, as an array of terms.

    A padded word no longer than n counts once as it is, and larger n add nothing.
    """
    blank = r"(?U)\s+"
    words = F.filter(F.split(F.lower(text), blank), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def windows(word: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(word) - n + 1)
        return F.transform(starts, lambda i: F.substring(word, i, F.lit(n)))

    def grams(word: Column) -> Column:
        parts = []
        for n in sizes:
            smaller = max((m for m in sizes if m < n), default=0)
            parts.append(
                F.when(F.length(word) > n, windows(word, n))
                .when(F.length(word) > smaller, F.array(word))
                .otherwise(F.array().cast("array<string>"))
            )
        return F.concat(*parts)

    return F.flatten(F.transform(padded, grams))


def ngram_counts(tx: DataFrame, weight: str | None = None) -> DataFrame:
    """Per term: occurrences and documents (rows), counted once per distinct text.

    ``weight`` names a column of how many rows a row stands for.

    A text lists its terms with repeats and once more without; both lists go into
    one partial aggregate, so only per-task totals by term are shuffled.
    """
    return _term_counts(_texts(tx, weight))


def _texts(tx: DataFrame, weight: str | None) -> DataFrame:
    """(description, __rows): each distinct text and how many rows have it."""
    return tx.groupBy("description").agg((F.sum(weight) if weight else F.count("*")).alias("__rows"))


def _term_counts(texts: DataFrame) -> DataFrame:
    grams = F.col("__grams")
    every = F.transform(grams, lambda g: F.struct(g.alias("term"), F.lit(False).alias("once")))
    distinct = F.transform(
        F.array_distinct(grams), lambda g: F.struct(g.alias("term"), F.lit(True).alias("once"))
    )
    listed = texts.withColumn("__grams", char_ngrams(F.col("description"))).select(
        "__rows", F.inline(F.concat(every, distinct))
    )
    return listed.groupBy("term").agg(
        F.sum(F.when(~F.col("once"), F.col("__rows")).otherwise(0)).alias("occurrences"),
        F.sum(F.when(F.col("once"), F.col("__rows")).otherwise(0)).alias("documents"),
    )


def vocabulary(tx: DataFrame, size: int = 3000, weight: str | None = None) -> DataFrame:
    """The ``size`` most frequent terms with smooth inverse document frequency."""
    # Stored: the number of documents is one pass over it, the terms another.
    texts = reliable_checkpoint(_texts(tx, weight))
    documents = texts.agg(F.coalesce(F.sum("__rows"), F.lit(0))).scalar()
    return (
        _term_counts(texts)
        .orderBy(F.desc("occurrences"), "term")
        .limit(size)
        .withColumn("idf", F.log((1 + documents) / (1 + F.col("documents"))) + 1)
    )


def with_numeric_features(tx: DataFrame) -> DataFrame:
    """log(1+|amount|), sign and weekday (0 where the table has none)."""
    day = F.col("day_of_week") if "day_of_week" in tx.columns else F.lit(0)
    return tx.withColumns({
        "log_amount": F.log1p(F.abs("amount")),
        "sign": F.signum("amount"),
        "weekday_f": day.cast("double"),
    })
