"""Daily expense series and forecasts, for one series or very many.

``keys`` names the columns that tell series apart; without keys there is one.
Everything after the daily aggregate works on at most one row per day.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.money import exact
from tallybook.operators.reports import expenses

MIN_DAYS = 14
EXCLUDED_CATEGORIES = ("Loyer", "Virements")


# -- series ------------------------------------------------------------------

def daily_totals(
    tx: DataFrame,
    *keys: str,
    account: str | None = None,
    exclude: Sequence[str] = EXCLUDED_CATEGORIES,
    label: str = "predicted_category",
) -> DataFrame:
    """Absolute real expenses per day that has any.

    Excluding categories needs a label column; without one the whole spend counts.
    """
    rows = expenses(tx)
    if account is not None:
        rows = rows.filter(F.col("account") == account)
    if exclude and label in tx.columns:
        rows = rows.filter(~F.col(label).isin(list(exclude)))
    total = F.abs(F.sum(exact(F.col("amount")))).alias("y")
    return rows.groupBy(*keys, F.col("date").alias("ds")).agg(total)


def daily_series(totals: DataFrame, *keys: str) -> DataFrame:
    """Every day from first to last, 0 where nothing was spent.

    Each day with spend lists the days up to the next one, so the totals are worked out once.
    """
    # At most one row per day and series reaches this window.
    following = F.lead("ds").over(Window.partitionBy(*keys).orderBy("ds"))
    until = F.greatest("ds", F.date_sub(following, 1))
    spans = totals.filter(F.col("ds").isNotNull()).select(*keys, "ds", "y", until.alias("__until"))
    days = spans.select(*keys, "y", F.posexplode(F.sequence("ds", "__until")).alias("__after", "ds"))
    spent = F.when(F.col("__after") == 0, F.col("y").cast("double"))
    return days.select(*keys, "ds", F.coalesce(spent, F.lit(0.0)).alias("y"))


# -- linear model ------------------------------------------------------------

def linear_fit(totals: DataFrame, *keys: str) -> DataFrame:
    """Ridge regression (penalty 1 on the slope) of spend on the day index.

    Closed form from moments. Days without spend are zeros, so the gap-filled series is never
    built: its length is the span in days, and what the zeros change is added to the moments
    of the days with spend. These are centred and merge pairwise, so large amounts or late
    dates cost no digits.
    """
    y = F.col("y").cast("double")
    day = F.unix_date("ds").cast("double")
    known = totals.where(F.col("y").isNotNull())
    sums = known.groupBy(*keys).agg(
        F.min("ds").alias("first_ds"),
        F.max("ds").alias("last_ds"),
        F.count("*").alias("__days"),
        F.sum(y).alias("__y"),
        F.avg(y).alias("__y_mean"),
        F.avg(day).alias("__day_mean"),
        F.regr_sxy(y, day).alias("__own_sxy"),
        F.regr_syy(y, day).alias("__own_syy"),
    )
    n = (F.datediff("last_ds", "first_ds") + 1).cast("double")
    middle = F.unix_date("first_ds") + (n - 1) / 2
    return (
        sums.filter(F.col("first_ds").isNotNull())
        .withColumn("n_days", (F.datediff("last_ds", "first_ds") + 1).cast("bigint"))
        .withColumn("__mean", F.col("__y") / n)
        .withColumn("__sxx", n * (n * n - 1) / 12)
        .withColumn(
            "__sxy",
            F.col("__own_sxy") + (F.col("__day_mean") - middle) * F.col("__y"),
        )
        .withColumn("slope", F.col("__sxy") / (F.col("__sxx") + 1))
        .withColumn("intercept", F.col("__mean") - F.col("slope") * (n - 1) / 2)
        .withColumn(
            "spread",
            F.sqrt((
                F.col("__own_syy") + F.col("__days") * F.pow(F.col("__y_mean") - F.col("__mean"), 2)
                + (n - F.col("__days")) * F.pow("__mean", 2)
            ) / n),
        )
        .select(*keys, "first_ds", "last_ds", "n_days", "slope", "intercept", "spread")
    )


def eligible(fit: DataFrame, min_days: int = MIN_DAYS) -> DataFrame:
    """Series with enough history; short ones are in ``rejected``."""
    return fit.filter(F.col("n_days") >= min_days)


def rejected(fit: DataFrame, *keys: str, min_days: int = MIN_DAYS) -> DataFrame:
    reason = F.format_string("not enough history (%d days), need at least %d", "n_days", F.lit(min_days))
    return fit.filter(F.col("n_days") < min_days).select(*keys, "n_days", reason.alias("reason"))


def linear_forecast(fit: DataFrame, *keys: str, horizon: int = 30) -> DataFrame:
    """``horizon`` days after the last one: value and band, never below 0."""
    ahead = eligible(fit).withColumn(
        "__step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    )
    raw = F.col("intercept") + F.col("slope") * (F.col("n_days") - 1 + F.col("__step"))
    zero = F.lit(0.0)
    return (
        ahead.withColumn("yhat", F.greatest(zero, raw))
        .withColumn("ds", F.date_add("last_ds", F.col("__step")))
        .select(
            *keys,
            "ds",
            "yhat",
            F.greatest(zero, F.col("yhat") - F.col("spread")).alias("yhat_lower"),
            (F.col("yhat") + F.col("spread")).alias("yhat_upper"),
        )
    )


# -- seasonal model ----------------------------------------------------------

def easter(year: int) -> date:
    """Gregorian Easter Sunday (anonymous computus)."""
    a, (b, c) = year % 19, divmod(year, 100)
    d, e = divmod(b, 4)
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = divmod(c, 4)
    m = (32 + 2 * e + 2 * i - h - k) % 7
    p = (a + 11 * h + 22 * m) // 451
    month, day = divmod(h + m - 7 * p + 114, 31)
    return date(year, month, day + 1)


# French public holidays as (month, day) and days after Easter.
FIXED_HOLIDAYS = {
    "new_year": (1, 1), "labour_day": (5, 1), "victory_day": (5, 8),
    "national_day": (7, 14), "assumption": (8, 15), "all_saints": (11, 1),
    "armistice": (11, 11), "christmas": (12, 25),
}
EASTER_HOLIDAYS = {"easter_monday": 1, "ascension": 39, "whit_monday": 50}


def holidays(year: int) -> dict[date, str]:
    days = {date(year, m, d): name for name, (m, d) in FIXED_HOLIDAYS.items()}
    sunday = easter(year)
    days.update({sunday + timedelta(after): name for name, after in EASTER_HOLIDAYS.items()})
    return days


# Settings of the seasonal model.
MONTH_LENGTH, MONTH_ORDER, WEEK_ORDER = 30.5, 5, 3
CHANGEPOINTS, CHANGEPOINT_RANGE, CHANGEPOINT_SCALE = 25, 0.8, 0.15
SEASON_SCALE, BAND = 10.0, (0.10, 0.90)


def _season_columns(days: pd.DatetimeIndex) -> np.ndarray:
    """Weekly and monthly Fourier terms and one indicator per holiday."""
    t = (days - pd.Timestamp("1970-01-01")).days.to_numpy(dtype=float)
    waves = [
        wave(2 * np.pi * k * t / length)
        for length, order in ((7.0, WEEK_ORDER), (MONTH_LENGTH, MONTH_ORDER))
        for k in range(1, order + 1)
        for wave in (np.sin, np.cos)
    ]
    names = [*FIXED_HOLIDAYS, *EASTER_HOLIDAYS]
    calendar = {}
    for year in range(days.min().year, days.max().year + 1):
        calendar.update(holidays(year))
    kinds = np.array([calendar.get(d.date(), "") for d in days])
    return np.column_stack([*waves, *[(kinds == n).astype(float) for n in names]])


def _ridge(x: np.ndarray, y: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Least squares with a normal prior of the given scale on each coefficient."""
    return np.linalg.solve(x.T @ x + np.diag(1.0 / scale**2), x.T @ y)


def _seasonal_days(history: pd.DataFrame, horizon: int) -> pd.DataFrame:
    """Fit one series (days with spend) and list its history and future days.

    Model: trend * (1 + season). The trend is piecewise linear with shrunken
    slope changes; trend and season are fitted in turn.
    """
    spent = history.assign(ds=pd.to_datetime(history["ds"])).set_index("ds")["y"].astype(float)
    past = pd.date_range(spent.index.min(), spent.index.max(), freq="D")
    days = past.append(pd.date_range(past[-1] + pd.Timedelta(days=1), periods=horizon))
    y = spent.reindex(past, fill_value=0.0).to_numpy()
    size = max(float(np.abs(y).max()), 1e-9)
    scaled, n = y / size, len(past)

    t = np.arange(len(days)) / max(n - 1, 1)
    knots = np.linspace(0, CHANGEPOINT_RANGE, min(CHANGEPOINTS, n // 2) + 1)[1:]
    trend_x = np.column_stack([np.ones_like(t), t, *[np.clip(t - k, 0, None) for k in knots]])
    season_x = _season_columns(days)
    trend_scale = np.array([5.0, 5.0] + [CHANGEPOINT_SCALE] * len(knots))
    season_scale = np.full(season_x.shape[1], SEASON_SCALE)

    season = np.zeros(len(days))
    for _ in range(5):
        trend = trend_x @ _ridge(trend_x[:n] * (1 + season[:n, None]), scaled, trend_scale)
        beta = _ridge(season_x[:n] * trend[:n, None], scaled - trend[:n], season_scale)
        season = season_x @ beta
    fitted = trend * (1 + season) * size
    low, high = np.quantile(y - fitted[:n], BAND)
    return pd.DataFrame({
        "ds": days.date,
        "yhat": np.clip(fitted, 0, None),
        "yhat_lower": np.clip(fitted + low, 0, None),
        "yhat_upper": np.clip(fitted + high, 0, None),
        "is_forecast": np.arange(len(days)) >= n,
    })


def seasonal_forecast(totals: DataFrame, *keys: str, horizon: int = 30) -> DataFrame:
    """Trend, week, month and holiday model per series.

    A group holds one row per day with spend, so its size is bounded by the
    calendar, not by the number of transactions. Series shorter than the
    minimum history are left out (see ``rejected``).
    """
    series = list(keys)
    types = dict(totals.dtypes)
    schema = ", ".join(
        [f"`{k}` {types[k]}" for k in series]
        + ["ds date", "yhat double", "yhat_lower double", "yhat_upper double", "is_forecast boolean"]
    )

    def fit(history: pd.DataFrame) -> pd.DataFrame:
        span = pd.to_datetime(history["ds"])
        if (span.max() - span.min()).days + 1 < MIN_DAYS:
            return pd.DataFrame(columns=[*series, "ds", "yhat", "yhat_lower", "yhat_upper", "is_forecast"])
        out = _seasonal_days(history, horizon)
        for position, key in enumerate(series):
            out.insert(position, key, history[key].iloc[0])
        return out

    rows = totals.select(*series, "ds", F.col("y").cast("double").alias("y"))
    return rows.groupBy(*series).applyInPandas(fit, schema)


# -- result tables -----------------------------------------------------------

def with_history(series: DataFrame, forecast: DataFrame) -> DataFrame:
    """History (its value as its own band) followed by the forecast."""
    keys = [c for c in series.columns if c not in ("ds", "y")]
    y = F.col("y")
    past = series.select(
        *keys, "ds", y.alias("yhat"), y.alias("yhat_lower"), y.alias("yhat_upper")
    )
    return past.unionByName(forecast)


def forecast_summary(forecast: DataFrame, *keys: str) -> DataFrame:
    """Future days only, rounded to cents."""
    return forecast.select(
        *keys,
        F.col("ds").alias("date"),
        F.round("yhat", 2).alias("forecast"),
        F.round("yhat_lower", 2).alias("lower"),
        F.round("yhat_upper", 2).alias("upper"),
    )


def forecast_monthly(totals: DataFrame, forecast: DataFrame, *keys: str) -> DataFrame:
    """Month totals, past and predicted; the month in progress appears as both.

    Takes the daily totals, not the gap-filled series, and adds the months
    within a series' span that saw no spend.
    """
    def period(day: Column) -> Column:
        return F.date_format(day, "yyyy-MM").alias("period")

    span = totals.groupBy(*keys).agg(F.min("ds").alias("__from"), F.max("ds").alias("__to"))
    month = F.expr("interval 1 month")
    months = F.explode(F.sequence(F.trunc("__from", "MM"), F.trunc("__to", "MM"), month))
    spine = span.select(*keys, months.alias("__month")).select(*keys, period(F.col("__month")))
    sums = totals.groupBy(*keys, period(F.col("ds"))).agg(F.sum("y").alias("__y"))
    past = spine.join(sums, [*keys, "period"], "left").select(
        *keys,
        "period",
        F.coalesce(F.round("__y", 2).cast("double"), F.lit(0.0)).alias("total"),
        F.lit(False).alias("is_forecast"),
    )
    ahead = forecast.groupBy(*keys, period(F.col("ds"))).agg(
        F.round(F.sum("yhat"), 2).alias("total")
    )
    return past.unionByName(ahead.withColumn("is_forecast", F.lit(True)))
