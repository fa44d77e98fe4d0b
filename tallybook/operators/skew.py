"""Joining per-group results back to rows when some groups are huge.

A window over such a group would put all its rows in one task. Here the group
is aggregated first (partial aggregation makes its size harmless) and joined
back; rows of hot groups are spread over several join partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.session import reliable_checkpoint

# A group is hot above total/HOT_GROUPS rows, so there are fewer than HOT_GROUPS
# of them whatever the data: that bounds the broadcast list below.
HOT_GROUPS = 512
# Rows of a hot group that meet in one slice.
ROWS_PER_SLICE = 100_000


def attach_group_stats(
    df: DataFrame,
    stats: DataFrame,
    keys: list[str],
    rows_col: str,
    spread_by: str,
) -> DataFrame:
    """Left-join ``stats`` (one row per key, ``rows_col`` = group size) onto ``df``.

    ``spread_by`` is a column whose values differ within a group; it decides
    which slice of a hot group a row goes to, and stays the same on a re-run.

    The stats are stored first: finding the hot groups and joining would
    otherwise each aggregate the whole input again.
    """
    stats = reliable_checkpoint(stats)
    total = stats.agg(F.sum(rows_col)).first()[0] or 0
    is_hot = F.col(rows_col) * HOT_GROUPS > F.lit(total)
    slices = F.ceil(F.col(rows_col) / ROWS_PER_SLICE).cast("int")
    hot_keys = stats.filter(is_hot).select(*keys, slices.alias("__slices"))

    rows = df.join(F.broadcast(hot_keys), keys, "left").withColumn(
        "__salt", F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("__slices")).cast("int"), F.lit(0))
    )
    all_slices = F.when(is_hot, F.sequence(F.lit(0), slices - 1)).otherwise(F.array(F.lit(0)))
    salted = stats.withColumn("__salt", F.explode(all_slices))
    return rows.join(salted, [*keys, "__salt"], "left").drop("__salt", "__slices")
