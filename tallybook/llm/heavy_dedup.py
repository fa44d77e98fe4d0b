"""Exact duplicates with a heavy-hitter split: frequent digests go by broadcast, the rest by shuffle.

Two texts are equal if they are identical after lower-casing A-Z; of equal texts the row
with the largest doc_id stays. Each text is reduced to its SHA-256 once. A Misra-Gries
summary then names every digest that may be frequent: Spark's approx_top_k aggregates are
the mergeable Misra-Gries variant of the DataSketches frequent-items sketch, so each task
sends at most TRACKED counters, which are merged in MERGERS groups first and then in one
(2,048 counters a group, whatever the input). The candidates are verified: an exact count
and the winning id of each, pre-aggregated in every task. The verified winners, WINNERS
rows at most, are broadcast, and rows with such a digest are settled where they lie. All
other digests are counted and joined by an ordinary shuffle; none of them has more than
about 1/WINNERS + 4/TRACKED of the rows.

Cases: a null text counts as empty, and empty texts are equal. A null doc_id stays only
where all its equal texts have null ids. Rows that repeat both id and text are each
returned by `exact_duplicates` with the same verdict; `without_duplicates` keeps one of
them. An empty table gives no rows. Only id and text are read by `exact_duplicates`, so
other columns cannot clash; column names that start with an underscore are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import checkpointed, lower_ascii, table, text_or_empty

#: Counters of a summary: an item missing from it has less than 4/TRACKED of the rows.
TRACKED = 4096
#: Frequent digests that may be broadcast, about 100 bytes each.
WINNERS = 1000
#: Summaries are merged in so many groups before they meet in one.
MERGERS = 512


def digest_of(name: str = "text"):
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(lower_ascii(text_or_empty(name)), 256))


def _item():
    """What the summary tracks: eight bytes of the digest. Its counts are estimates anyway."""
    return F.xxhash64("digest")


def frequent_items(digests: DataFrame, tracked: int = TRACKED, winners: int = WINNERS) -> DataFrame:
    """(item): a row for each of the most frequent items, from merged Misra-Gries summaries."""
    parts = digests.select(_item().alias("item"), F.spark_partition_id().alias("part"))
    parts = parts.groupBy("part").agg(F.expr(f"approx_top_k_accumulate(item, {tracked})").alias("summary"))
    for group in (F.pmod("part", F.lit(MERGERS)), F.lit(0)):
        parts = parts.groupBy(group.alias("part")).agg(F.expr(f"approx_top_k_combine(summary, {tracked})").alias("summary"))
    found = parts.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {winners})")).alias("top"))
    return found.where("top.count > 1").select("top.item")


def exact_duplicates(docs: DataFrame, tracked: int = TRACKED, winners: int = WINNERS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) for every row of docs."""
    digests = checkpointed(docs.select("doc_id", digest_of().alias("digest")))

    candidates = F.broadcast(frequent_items(digests, tracked, winners))
    verified = digests.join(candidates, _item() == F.col("item"), "left_semi")
    facts = [F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")]
    top = checkpointed(verified.groupBy("digest").agg(*facts).orderBy(F.desc("group_size"), "digest").limit(winners))

    heavy = digests.join(F.broadcast(top), "digest")
    light = digests.join(F.broadcast(top.select("digest")), "digest", "left_anti")
    light = light.join(light.groupBy("digest").agg(*facts), "digest")
    both = heavy.unionByName(light)
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def without_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with the columns of docs."""
    stays = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    marked = docs.withColumn("_digest", digest_of())
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    kept = marked.join(stays.withColumnRenamed("_digest", "_of"), same & (F.col("_digest") == F.col("_of")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_digest"]).select(*docs.columns)


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The row that stays, for all documents."""
    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


#: The same in DuckDB SQL, by one window over all equal texts.
ORACLE = """
with digests as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id is not distinct from max(doc_id) over same as kept, text_sha256
from digests window same as (partition by text_sha256)"""
