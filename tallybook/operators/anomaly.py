"""Isolation forest over transactions (Liu, Ting and Zhou, 2008).

Each tree sees at most 256 rows, so trees are grown in parallel from a small
hashed sample; scoring is one vectorised pass over all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import ExitStack, nullcontext
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.functions.identity import packed_id, unpacked_id
from tallybook.operators.features import (
    ANOMALY_FEATURES,
    merchant_stats,
    scaling,
    standardise,
    with_anomaly_features,
)
from tallybook.operators.ranking import exact_quantile, lowest_k, min_rank
from tallybook.session import passing_copy, reliable_checkpoint

SAMPLE_ROWS = 256
# Arrow batches scored at a time, and values of a feature up to which its comparisons are kept for a batch.
BATCHES, FEW_VALUES = 8, 64
_NODES = "tree int, node int, feature int, cut double, left int, right int, depth double"
_TOP_COLUMNS = [
    "anomaly_rank", "date", "description", "amount",
    "currency", "tx_type", "account", "anomaly_score",
]
# What the features are made of, besides the hour.
_READ_COLUMNS = ["date", "description", "amount", "day_of_week", "month"]


def _mean_depth(rows: np.ndarray | float) -> np.ndarray:
    """Average depth of an unsuccessful search among ``rows`` leaves."""
    rows = np.asarray(rows, dtype=float)
    safe = np.maximum(rows, 3)
    deep = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(rows <= 1, 0.0, np.where(rows == 2, 1.0, deep))


def _grow(sample: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes of one tree as (node, feature, cut, left, right, depth); leaves have feature -1."""
    nodes, todo = [], [(0, sample, 0)]
    next_node = 1
    while todo:
        node, rows, depth = todo.pop()
        done = depth >= max_depth or len(rows) <= 1
        spread = [] if done else np.flatnonzero(rows.max(axis=0) > rows.min(axis=0))
        if len(spread) == 0:
            nodes.append((node, -1, 0.0, node, node, depth + float(_mean_depth(len(rows)))))
            continue
        feature = int(rng.choice(spread))
        cut = float(rng.uniform(rows[:, feature].min(), rows[:, feature].max()))
        goes_left = rows[:, feature] <= cut
        nodes.append((node, feature, cut, next_node, next_node + 1, 0.0))
        todo += [(next_node, rows[goes_left], depth + 1), (next_node + 1, rows[~goes_left], depth + 1)]
        next_node += 2
    return nodes


def _tree_samples(df: DataFrame, key: str, rows: int, trees: int, seed: int) -> DataFrame:
    """``tree`` column added: every tree gets its own random rows without repeats.

    Rows are put into a random (hash) order and dealt out in consecutive blocks.
    A small table is dealt out again in a fresh order until all trees are
    served. About trees x 256 rows leave this function however large the table.
    """
    block = min(SAMPLE_ROWS, rows)
    per_round = min(trees, rows // block)
    rounds = math.ceil(trees / per_round)
    wanted = per_round * block
    # Only the lowest hashes compete: four times the need is let through, which always
    # holds the lowest `wanted`, so the sample is the same as without this cut.
    share = min(1.0, 4.0 * wanted / rows)
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("__round"), F.col(key)), 1)
    keep = order <= F.lit(min(int(share * (1 << 63)), (1 << 63) - 1))
    dealt = (
        df.withColumn("__round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
        .withColumn("__order", order)
        .filter(keep)
    )
    # Bounded: about 4 x wanted rows per round reach this window.
    place = F.row_number().over(Window.partitionBy("__round").orderBy("__order", key)) - 1
    tree = F.col("__round") * per_round + F.floor(F.col("__place") / block).cast("int")
    return (
        dealt.withColumn("__place", place)
        .filter(F.col("__place") < wanted)
        .withColumn("tree", tree.cast("int"))
        .filter(F.col("tree") < trees)
    )


def _without_noise(features: DataFrame) -> DataFrame:
    """Equal deviations differ in their last bits by the order of summing; no tree may split on that."""
    return features.withColumn("amount_zscore", F.round("amount_zscore", 9))


@dataclass
class AnomalyModel:
    """Grown trees, scaling figures and the score below which a row is flagged."""

    nodes: pd.DataFrame
    figures: dict[str, float]
    sample_rows: int
    threshold: float
    stats: DataFrame | None = None
    hour_col: str = "ingested_at"
    key: str = "transaction_id"

    def raw_scores(self, tx: DataFrame) -> DataFrame:
        """``__score`` per row: minus the anomaly measure of the paper (higher = normal)."""
        features = with_anomaly_features(
            tx, stats=self.stats, hour_col=self.hour_col, spread_by=self.key
        )
        return self._score(_without_noise(features), tx.columns)

    def _score(self, features: DataFrame, keep: list[str]) -> DataFrame:
        features = standardise(features, ANOMALY_FEATURES, self.figures)
        # Bounded by trees x (2 x 256 - 1) nodes, whatever the data.
        forest = features.sparkSession.sparkContext.broadcast(_pack(self.nodes))
        norm = float(_mean_depth(self.sample_rows))

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            while some := list(islice(batches, BATCHES)):
                x = np.concatenate([np.column_stack([c.to_numpy(dtype=float) for c in columns]) for columns in some])
                values = -np.exp2(-_depths(x, forest.value) / len(forest.value[1]) / max(norm, 1e-9))
                for part in np.split(values, np.cumsum([len(columns[0]) for columns in some])[:-1]):
                    yield pd.Series(part)

        return features.select(*keep, score(*ANOMALY_FEATURES).alias("__score"))

    def predict(self, tx: DataFrame, *, ranked: bool = True) -> DataFrame:
        """Add anomaly_score, anomaly_flag and, if asked, anomaly_rank (1 = most anomalous)."""
        scored = self.raw_scores(tx)
        return self._finish(reliable_checkpoint(scored) if ranked else scored, ranked)

    def flagged(self, scored: DataFrame, contamination: float) -> DataFrame:
        """``raw_scores`` with the threshold set so that this share of them is flagged, and ranks."""
        self.threshold = exact_quantile(scored, "__score", contamination)
        return self._finish(scored)

    def _finish(self, scored: DataFrame, ranked: bool = True) -> DataFrame:
        value = F.col("__score") - F.lit(self.threshold)
        columns = [c for c in scored.columns if c != "__score"]
        if ranked:
            # Every row is shuffled for its rank, so its id goes in half its length.
            packed = scored.withColumn(self.key, packed_id(F.col(self.key)))
            ranks = min_rank(packed, "__score", self.key, "anomaly_rank")
            scored = ranks.withColumn(self.key, unpacked_id(F.col(self.key)))
        return scored.select(
            *columns,
            F.round(value, 4).alias("anomaly_score"),
            (value < 0).alias("anomaly_flag"),
            *([F.col("anomaly_rank")] if ranked else []),
        )

    def top(self, scored: DataFrame, n: int = 20) -> DataFrame:
        """``top_anomalies`` of ``raw_scores``. No other row is ranked: all rows with a lower score are among these."""
        flagged = scored.filter(F.col("__score") - F.lit(self.threshold) < 0)
        lowest = lowest_k(flagged, n, "__score", self.key)
        # A window over n rows.
        ranked = lowest.withColumn("anomaly_rank", F.rank().over(Window.orderBy("__score")).cast("bigint"))
        return top_anomalies(self._finish(ranked, ranked=False), n)

    # -- storage -------------------------------------------------------------

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, _NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        scalars = {**self.figures, "__sample_rows": float(self.sample_rows), "__threshold": self.threshold}
        spark.createDataFrame(
            [(k, float(v)) for k, v in scalars.items()], "name string, value double"
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/figures")
        if self.stats is not None:
            self.stats.write.mode("overwrite").parquet(f"{path}/merchants")

    @classmethod
    def load(cls, spark: SparkSession, path: str, *, frozen_stats: bool = False, **kwargs) -> AnomalyModel:
        """``frozen_stats`` scores against the merchant figures saved with the model."""
        figures = {r.name: r.value for r in spark.read.parquet(f"{path}/figures").collect()}
        rows, threshold = int(figures.pop("__sample_rows")), figures.pop("__threshold")
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        stats = spark.read.parquet(f"{path}/merchants") if frozen_stats else None
        return cls(nodes, figures, rows, threshold, stats, **kwargs)


def _pack(nodes: pd.DataFrame) -> tuple[list[np.ndarray], list[tuple]]:
    """The cuts of each feature in order, and for each tree its splits from the top, its levels and leaf depths.

    A split is (node, feature, number of its cut, level, left, right); a child that is a leaf is
    None. Depths stand at the code of the way to a leaf: the bit of a level is set where it goes right.
    """
    inner = nodes[nodes["feature"] >= 0]
    cuts = [np.unique(inner.loc[inner["feature"] == f, "cut"].to_numpy(dtype=float)) for f in range(len(ANOMALY_FEATURES))]
    trees = []
    for _, tree in nodes.groupby("tree"):
        rows = {int(r.node): r for r in tree.itertuples()}
        splits, leaves, todo = [], {}, [(0, 0, 0)]
        for node, level, code in todo:
            row = rows[node]
            f, left, right = int(row.feature), int(row.left), int(row.right)
            if f < 0:
                leaves[code] = row.depth
                continue
            todo += [(left, level + 1, code), (right, level + 1, code | 1 << level)]
            further = [child if rows[child].feature >= 0 else None for child in (left, right)]
            splits.append((node, f, int(np.searchsorted(cuts[f], row.cut)), level, *further))
        levels = 1 + max((s[3] for s in splits), default=0)
        depth = np.zeros(1 << levels)
        depth[list(leaves)] = list(leaves.values())
        trees.append((splits, levels, depth))
    return cuts, trees


def _depths(x: np.ndarray, forest: tuple[list[np.ndarray], list[tuple]]) -> np.ndarray:
    """Sum over the trees of the depth that each row ends at.

    Values become the number of cuts below them, so a split is one comparison of small numbers
    for all rows; features of few values (weekday, sign) are compared once for all trees. A NaN
    is above no cut.
    """
    cuts, trees = forest
    codes, slots, known = [], [], {}
    for f, marks in enumerate(cuts):
        code = np.searchsorted(marks, x[:, f]).astype(np.int32)
        code[np.isnan(x[:, f])] = 0
        seen = np.unique(code)
        codes.append(code.astype(np.int16) if len(marks) < 1 << 15 else code)
        # Cuts between the same two values that occur give the same answer.
        slots.append(np.searchsorted(seen, np.arange(len(marks)), side="right").tolist() if len(seen) <= FEW_VALUES else None)
    total = np.zeros(len(x))
    for splits, levels, depth in trees:
        reach, taken = {}, [np.zeros(len(x), dtype=bool) for _ in range(levels)]
        for node, f, cut, level, left, right in splits:
            if slots[f] is None:
                above = codes[f] > cut
            else:
                place = f, slots[f][cut]
                above = known.get(place)
                if above is None:
                    above = known[place] = codes[f] > cut
            here = reach.pop(node, None)  # None at the top: all rows
            goes = above if here is None else here & above
            if left is not None:
                reach[left] = ~goes if here is None else here ^ goes
            if right is not None:
                reach[right] = goes
            taken[level] |= goes
        at = np.zeros(len(x), dtype=np.uint16)  # trees of SAMPLE_ROWS rows have 8 levels at most
        for level, bits in enumerate(taken):
            at += bits.astype(np.uint16) << level
        total += depth.take(at)
    return total


class AnomalyDetector:
    """Isolation forest settings; ``fit`` returns a model."""

    def __init__(
        self,
        *,
        contamination: float = 0.05,
        n_estimators: int = 200,
        random_state: int = 42,
        hour_col: str = "ingested_at",
        key: str = "transaction_id",
    ) -> None:
        self.contamination = contamination
        self.n_estimators = n_estimators
        self.random_state = random_state
        self.hour_col = hour_col
        self.key = key

    def fit(self, tx: DataFrame, *, keep_stats: bool = False) -> AnomalyModel:
        return self._fit(tx, keep_stats)[0]

    def fit_predict(self, tx: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
        """Fit on ``tx`` and score it; the rows are scored once. ``keep`` names the columns that stay (all)."""
        model, scored = self._fit(tx, False, keep)
        return model._finish(scored)

    def fit_top(self, tx: DataFrame, n: int = 20) -> DataFrame:
        """``top_anomalies`` of ``fit_predict``, of which only those rows are ranked."""
        model, scored = self._fit(tx, False, [*dict.fromkeys([c for c in _TOP_COLUMNS if c in tx.columns] + [self.key])])
        return model.top(scored, n)

    def fit_scored(self, tx: DataFrame, *, keep_stats: bool = False) -> tuple[AnomalyModel, DataFrame]:
        """The model and its answer for the rows that it was fitted on."""
        model, scored = self._fit(tx, keep_stats)
        return model, model._finish(scored)

    def _fit(self, tx: DataFrame, keep_stats: bool, keep: list[str] | None = None) -> tuple[AnomalyModel, DataFrame]:
        keep = keep or tx.columns
        read = [c for c in tx.columns if c in (*keep, *_READ_COLUMNS, self.hour_col, self.key)]
        # The merchants' figures are a pass of their own, so what the rows take to work out is stored;
        # the copy goes when the features are there, unless the model keeps the figures.
        rows = tx.select(*read)
        with ExitStack() as later:
            with nullcontext(reliable_checkpoint(rows)) if keep_stats else passing_copy(rows) as tx:
                features = _without_noise(with_anomaly_features(tx, hour_col=self.hour_col, spread_by=self.key))
                # Read three times (scaling, sampling, scoring), so stored once; without what nothing reads there.
                features = features.select(*dict.fromkeys([*keep, self.key, *ANOMALY_FEATURES]))
                features = later.enter_context(passing_copy(features))
            model, scored = self._grown(features, keep)
        model.threshold = exact_quantile(scored, "__score", self.contamination)
        if keep_stats:
            model.stats = merchant_stats(tx)
        return model, scored

    def _grown(self, features: DataFrame, keep: list[str]) -> tuple[AnomalyModel, DataFrame]:
        """The trees, and the stored scores of all rows."""
        figures = scaling(features, ANOMALY_FEATURES).first().asDict()
        rows = int(figures.pop("n_rows"))
        if rows == 0:
            raise ValueError("cannot fit on an empty table")

        seed, block = self.random_state, min(SAMPLE_ROWS, rows)
        max_depth = math.ceil(math.log2(max(block, 2)))

        def grow(sample: pd.DataFrame) -> pd.DataFrame:
            tree = int(sample["tree"].iloc[0])
            ordered = sample.sort_values("__place")[ANOMALY_FEATURES].to_numpy(dtype=float)
            rng = np.random.default_rng([seed, tree])
            names = ["node", "feature", "cut", "left", "right", "depth"]
            out = pd.DataFrame(_grow(ordered, rng, max_depth), columns=names)
            out.insert(0, "tree", tree)
            return out

        sample = _tree_samples(features, self.key, rows, self.n_estimators, seed)
        scaled = standardise(sample, ANOMALY_FEATURES, figures)
        # A fixed partition count: the sample is small, growing a tree is not.
        tasks = min(self.n_estimators, features.sparkSession.sparkContext.defaultParallelism)
        nodes = (
            scaled.select("tree", "__place", *ANOMALY_FEATURES)
            .repartition(tasks, "tree")
            .groupBy("tree")
            .applyInPandas(grow, _NODES)
        )
        model = AnomalyModel(
            nodes.toPandas(), figures, block, 0.0, None, self.hour_col, self.key
        )
        return model, reliable_checkpoint(model._score(features, keep))


def top_anomalies(scored: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most anomalous flagged rows with their context."""
    columns = [c for c in _TOP_COLUMNS if c in scored.columns]
    return (
        scored.filter("anomaly_flag")
        .orderBy("anomaly_rank", "transaction_id")
        .select(*columns)
        .limit(n)
    )


def flagged_share(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count_if("anomaly_flag").alias("flagged"),
        F.count("*").alias("scored"),
        F.avg(F.col("anomaly_flag").cast("double")).alias("share"),
    )
