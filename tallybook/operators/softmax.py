"""Multinomial logistic regression where many rows share one sparse text part.

Rows lie in blocks: a text's terms once, beside the figures of its rows. A pass over the
blocks works out the text's share of the margins once per block and only the few numeric
columns per row, so neither time nor storage is rows times terms. Loss and gradient are sums
that Spark adds up by column; the driver holds the weights only. Objective, scaling and
starting point are those of MLlib's LogisticRegression (standardised columns, L2).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 20_000
#: Rows whose margins a task holds at once.
ROWS_AT_ONCE = 65_536
#: Positions of sums that belong to no column.
TOTALS, INTERCEPTS = -2, -1


def blocks(rows: DataFrame, texts: DataFrame, key: str, numeric: list[str], spread_by: str) -> DataFrame:
    """(positions, values, rows): a text's terms beside at most about ROWS_PER_BLOCK of its rows.

    ``rows`` has ``label``, ``weight`` and the numeric columns, ``texts`` one row per ``key`` with
    its sorted ``positions`` and ``values``. Texts of very many rows get several blocks.
    """
    large = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > ROWS_PER_BLOCK)
    slices = large.select(key, F.ceil(F.col("__n") / ROWS_PER_BLOCK).alias("__slices"))
    salt = F.pmod(F.xxhash64(spread_by), F.coalesce("__slices", F.lit(1))).alias("__salt")
    figures = F.struct("label", "weight", F.array(*[F.col(c).cast("double") for c in numeric]).alias("numeric"))
    grouped = rows.join(slices, key, "left").select(key, salt, figures.alias("__row")).groupBy(key, "__salt").agg(
        F.collect_list("__row").alias("rows")
    )
    none = F.array()

    def part(name: str, kind: str) -> Column:
        return F.coalesce(name, none.cast(kind)).cast(kind).alias(name)

    return grouped.join(texts, key, "left").select(part("positions", "array<int>"), part("values", "array<double>"), "rows")


def _arrays(batch: pa.RecordBatch, n_numeric: int):
    """Numpy columns of blocks: terms with their block, rows with their block."""
    positions, values, rows = (batch.column(n) for n in ("positions", "values", "rows"))
    flat = rows.flatten()
    in_block = [np.repeat(np.arange(batch.num_rows), np.diff(c.offsets.to_numpy())) for c in (positions, rows)]
    label, weight, numeric = flat.flatten()
    return (
        in_block[0], positions.flatten().to_numpy(), values.flatten().to_numpy(),
        in_block[1], label.to_numpy(), weight.to_numpy().astype(float),
        numeric.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n_numeric),
    )


def _summed(table: DataFrame, work: Callable, width: int) -> dict[int, np.ndarray]:
    """Sums by position of what ``work`` adds to its task's array over the batches."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = work(batches)
        sums = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), width).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)) + TOTALS, pa.int32()), sums], ["position", "sums"])

    by_task = table.mapInArrow(task, "position int, sums array<double>")
    added = by_task.groupBy("position").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    return {r.position: np.array(r.sums) for r in added.collect()}


def _moments(table: DataFrame, n_terms: int, n_numeric: int, n_labels: int):
    """Weight of all rows and its square's sum, weight by label, mean and sample variance by column."""
    width = max(2, n_labels)

    def work(batches):
        total = np.zeros((2 + n_terms + n_numeric, width))
        for batch in batches:
            of_term, positions, values, of_row, label, weight, numeric = _arrays(batch, n_numeric)
            total[0, :2] += weight.sum(), (weight**2).sum()
            total[1, :n_labels] += np.bincount(label, weight, n_labels)
            heavy = np.bincount(of_row, weight, batch.num_rows)[of_term]
            for power in (1, 2):
                total[2:2 + n_terms, power - 1] += np.bincount(positions, heavy * values**power, n_terms)
                total[2 + n_terms:, power - 1] += weight @ numeric**power
        return total

    sums = _summed(table, work, width)
    n, squares = sums[TOTALS][:2]
    by_column = np.array([sums[i][:2] for i in range(n_terms + n_numeric)])
    mean = by_column[:, 0] / n
    spread = by_column[:, 1] - n * mean**2
    spread[spread <= 1e-12 * by_column[:, 1]] = 0  # the same value in all rows
    # As MLlib weighs it; a single row has no spread.
    variance = spread / (n - squares / n) if n > squares / n else np.zeros_like(spread)
    return n, sums[INTERCEPTS][:n_labels], mean, variance


def _loss(table: DataFrame, weights: np.ndarray, intercepts: np.ndarray, n_terms: int):
    """Sums of loss and of its gradient by the weights (label by column) and the intercepts."""
    n_labels, n_columns = weights.shape
    by_term, by_numeric = weights[:, :n_terms].copy(), weights[:, n_terms:].copy()

    def work(batches):
        total = np.zeros((2 + n_columns, n_labels))
        for batch in batches:
            of_term, positions, values, of_row, label, weight, numeric = _arrays(batch, n_columns - n_terms)
            size = batch.num_rows
            margins = np.stack([np.bincount(of_term, values * w[positions], size) for w in by_term]) + intercepts[:, None]
            wrong = np.zeros((n_labels, size))
            for start in range(0, len(of_row), ROWS_AT_ONCE):
                some = slice(start, start + ROWS_AT_ONCE)
                # One row a label: sums over the labels then run along rows.
                m = margins[:, of_row[some]] + by_numeric @ numeric[some].T
                m -= m.max(axis=0)
                at = (label[some], np.arange(m.shape[1]))
                own = m[at]
                share = np.exp(m, out=m)
                whole = share.sum(axis=0)
                total[0, 0] += weight[some] @ (np.log(whole) - own)
                share *= weight[some] / whole
                share[at] -= weight[some]
                here = of_row[some] - of_row[start]
                wrong[:, of_row[start]:of_row[some][-1] + 1] += [np.bincount(here, s) for s in share]
                total[2 + n_terms:] += (share @ numeric[some]).T
            total[1] += wrong.sum(axis=1)
            for c in range(n_labels):
                total[2:2 + n_terms, c] += np.bincount(positions, values * wrong[c, of_term], n_terms)
        return total

    sums = _summed(table, work, n_labels)
    return sums[TOTALS][0], np.array([sums[i] for i in range(n_columns)]).T, sums[INTERCEPTS]


def fit(
    table: DataFrame, n_terms: int, n_numeric: int, n_labels: int, *, max_iter: int, penalty: float, tolerance: float = 1e-6
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (label by column) and intercepts, the latter centred."""
    n, by_label, mean, variance = _moments(table, n_terms, n_numeric, n_labels)
    inverse = np.divide(1, np.sqrt(variance), out=np.zeros_like(variance), where=variance > 0)
    shape = (n_labels, n_terms + n_numeric)

    def plain(point: np.ndarray):
        weights = point[n_labels:].reshape(shape) * inverse
        return weights, point[:n_labels] - weights @ mean

    def evaluate(point: np.ndarray):
        loss, slopes, by_intercept = _loss(table, *plain(point), n_terms)
        if not np.isfinite(loss):
            raise ValueError("amounts or days that are null or not finite")
        scaled = point[n_labels:]
        slopes = (slopes - np.outer(by_intercept, mean)) * inverse / n
        gradient = np.concatenate([by_intercept / n, slopes.ravel() + penalty * scaled])
        return loss / n + penalty / 2 * scaled @ scaled, gradient

    start = np.zeros(n_labels * (1 + shape[1]))
    start[:n_labels] = np.log(by_label) - np.log(by_label).mean()
    weights, intercepts = plain(minimise(evaluate, start, max_iter, tolerance))
    return weights, intercepts - intercepts.mean()


def minimise(evaluate: Callable, point: np.ndarray, max_iter: int, tolerance: float, memory: int = 10) -> np.ndarray:
    """L-BFGS with steps that meet the strong Wolfe conditions."""
    value, gradient = evaluate(point)
    scale, values, pairs = abs(value), [value], []
    for iteration in range(max_iter):
        if np.linalg.norm(gradient) <= max(tolerance * abs(value), 1e-8):
            break
        direction, factors = -gradient, []
        for step, change in reversed(pairs):
            factors.append(step @ direction / (step @ change))
            direction = direction - factors[-1] * change
        if pairs:
            direction = direction * (pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]))
        for (step, change), factor in zip(pairs, reversed(factors)):
            direction = direction + step * (factor - change @ direction / (step @ change))
        found = _line(evaluate, point, value, gradient, direction, 1.0 if pairs else 1 / np.linalg.norm(direction))
        if found is None:
            break
        moved, value, slope = found
        if (moved - point) @ (slope - gradient) > 0:
            pairs = [*pairs, (moved - point, slope - gradient)][-memory:]
        point, gradient = moved, slope
        # No gain against the values of the last rounds.
        if len(values) >= 20 and abs(value - np.mean(values[-20:])) <= tolerance * scale:
            break
        values.append(value)
    return point


def _line(evaluate: Callable, point, value, gradient, direction, step, tries: int = 20):
    """A point along ``direction`` that lowers the value enough and flattens the slope, with its value and gradient."""
    slope = gradient @ direction
    low, high, best = (0.0, value, slope), None, None
    for _ in range(tries):
        moved = point + step * direction
        new, there = evaluate(moved)
        rise = there @ direction
        if new > value + 1e-4 * step * slope or new >= low[1]:
            high = (step, new, rise)
        else:
            best = (moved, new, there)
            if abs(rise) <= -0.9 * slope:
                break
            if high is None and rise < 0:
                low, step = (step, new, rise), step * 1.5
                continue
            if high is None or rise * (high[0] - low[0]) >= 0:
                high = low
            low = (step, new, rise)
        # Least value of the cubic through both ends, kept off them.
        (a, fa, da), (b, fb, db) = sorted([low, high])
        d1 = da + db - 3 * (fa - fb) / (a - b)
        root = d1 * d1 - da * db
        step = (a + b) / 2
        if root >= 0 and db - da + 2 * np.sqrt(root) != 0:
            step = b - (b - a) * (db + np.sqrt(root) - d1) / (db - da + 2 * np.sqrt(root))
        step = min(max(step, a + 0.1 * (b - a)), b - 0.1 * (b - a))
    return best
