"""What several operators of this subpackage share: tables, checkpoints, distributed running sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Blank characters of the word definition; fixed by the result contract.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of the decontamination contract.
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z alone; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; the warehouse where the cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows stored on the shared file system, so that a lost executor costs no rerun of the plan."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def place(*parts: Column) -> Column:
    """31 even bits of a row's parts: the order of rows where no other is asked for."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 33)


def bucket_of(spot: Column, buckets: int) -> Column:
    """Equal ranges of place(): a row of a lower bucket has a lower place."""
    return F.floor(spot * F.lit(buckets) / F.lit(float(1 << 31))).cast("long")


def buckets_for(rows: int, rows_per_bucket: int) -> int:
    return max(1, math.ceil(rows / rows_per_bucket))


def running_total(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str | Column], weight: Column, out: str
) -> DataFrame:
    """Adds the sum of weight over a key's rows before each row, by (bucket, order).

    Two levels: sums of whole buckets give each its offset, and only the rows of one
    bucket of one key meet in a task. So a key of a third of all rows is spread over as
    many tasks as it has buckets. Rows that tie in order get their sums in either order.
    """
    weighed = df.withColumn("_weight", weight.cast("long"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = weighed.groupBy(*keys, bucket).agg(F.sum("_weight").alias("_sum"))
    offsets = sums.select(
        *[F.col(k).alias(f"_at_{k}") for k in [*keys, bucket]],
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = weighed.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in [*keys, bucket]]
    joined = ranked.join(offsets, same)
    return joined.withColumn(out, F.col("_inside") + F.col("_offset")).drop(
        "_weight", "_inside", "_offset", *[f"_at_{k}" for k in [*keys, bucket]]
    )


#: Keys with more than 1/HOT_SHARE of the rows: fewer than HOT_SHARE of them can exist.
HOT_SHARE = 1000


def join_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], count: str, total: int) -> DataFrame:
    """Left join of rows with one row of facts per key, safe for keys of a third of all rows.

    facts holds in `count` how many of the `total` rows have the key. Keys above
    total / HOT_SHARE are broadcast: HOT_SHARE rows at most, whatever the data. Their rows
    then go through the shuffle under a spread-out key, so no task gets a hot key. Null
    keys match null keys.
    """
    values = [c for c in facts.columns if c not in (*keys, count)]
    hot = F.col(count) * HOT_SHARE > total

    def side(part: DataFrame, mark: str) -> DataFrame:
        return part.select(
            *[F.col(k).alias(f"_{mark}_{k}") for k in keys], F.struct(F.lit(1).alias("_is"), *values).alias(f"_{mark}")
        )

    def same(mark: str) -> list[Column]:
        return [F.col(k).eqNullSafe(F.col(f"_{mark}_{k}")) for k in keys]

    joined = rows.join(F.broadcast(side(facts.where(hot), "hot")), same("hot"), "left")
    spread = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.lit(1) + F.pmod(F.xxhash64(*rows.columns), F.lit(9973)))
    joined = joined.withColumn("_spread", spread.cast("int"))
    cold = side(facts.where(~hot), "cold").withColumn("_none", F.lit(0))
    joined = joined.join(cold, [*same("cold"), F.col("_spread") == F.col("_none")], "left")
    found = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *[found[v].alias(v) for v in values])
