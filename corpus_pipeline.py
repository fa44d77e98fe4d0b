"""Corpus pipeline over the documents table: five stages, each an operator of tallybook.llm.

A stage takes (spark, docs, sf_dir) and gives a DataFrame, which is stored as Parquet and
read again as the next one's docs. All but the last give the columns of documents.

Cases: null, empty and blank texts are not toxic, have no benchmark words, and are near
duplicates of one another, so one of them stays; a text of any length is read whole; of
rows that repeat one text one stays; a null doc_id is kept like any other and stays in a
group only if all its ids are null; rows without a source share a stream; an empty table
passes through empty; further columns of documents are kept, also where a stage's own
results have their name, unless they start with an underscore.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.common import shared_folder, table
from tallybook.llm.decontaminate import clean_documents
from tallybook.llm.mixing import WEIGHTS, mix
from tallybook.llm.pigeonring import without_near_duplicates
from tallybook.llm.propagation import shards
from tallybook.llm.toxic_grammar import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar scores below 0.7."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints of three-word shingles, linked at three bits or fewer."""
    return without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: file after file, row after row."""
    mixed = mix(docs, WEIGHTS, rest=45).repartitionByRange("position").sortWithinPartitions("position")
    return mixed.select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document; slots follow the order of the mixture. Links are shared lines.

    The stages before leave no copies to link. That order is the one of the stored files: their names count up, and so do the rows in them.
    """
    file = F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long"), F.lit(0))
    mixed = docs.withColumns({"file": file, "row": F.col("_metadata.row_index")})
    found = shards(mixed, carry=["source", "lang", "file", "row"], order=["file", "row"])
    return found.select("doc_id", "source", "lang", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Learning, fingerprints and schedules are beyond SQL: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
