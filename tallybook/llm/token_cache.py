"""Token counts from a cache of digests: only texts whose digest is new are encoded.

A cache row is (content, tokenizer, n_tokens). `content` is the SHA-256 of the
normalised text: null becomes the empty text and nothing else changes, since every
other change could change the count. `tokenizer` is the SHA-256 of the model file.

Cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows keep their number
and share one cache row; an empty table gives an empty result; columns of the input
other than the id and the text are ignored, so names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm.common import text_or_empty

SCHEMA = T.StructType([
    T.StructField("content", T.BinaryType()),
    T.StructField("tokenizer", T.StringType()),
    T.StructField("n_tokens", T.LongType()),
])

def tokenizer_digest(model_file: str) -> str:
    return hashlib.sha256(Path(model_file).read_bytes()).hexdigest()


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; an empty one is made where the folder holds none."""
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def fill_cache(texts: DataFrame, model_file: str, path: str, text_col: str = "text") -> None:
    """Encodes the distinct texts whose digest the cache lacks and appends their counts.

    Copies merge before and after the shuffle (partial aggregate), so a group of copies of
    any size is one row. An append is one commit: a failed one leaves nothing behind, and
    digests that two writers add at once hold equal counts.
    """
    spark, version = texts.sparkSession, tokenizer_digest(model_file)
    known = open_cache(spark, path).where(F.col("tokenizer") == version).select("content")
    distinct = (
        texts.select(text_or_empty(text_col).alias("text"))
        .select(F.unhex(F.sha2("text", 256)).alias("content"), "text")
        .groupBy("content")
        .agg(F.first("text").alias("text"))
    )
    missing = distinct.join(known, "content", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for batch in batches:
            counts = [len(model.encode(text.as_py(), num_threads=1)) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())],
                names=["content", "tokenizer", "n_tokens"],
            )

    missing.mapInArrow(encode, SCHEMA).write.mode("append").parquet(path)


def token_counts(docs: DataFrame, model_file: str, path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Every row of docs with n_bytes, n_tokens, over_limit and the digest of its content."""
    fill_cache(docs, model_file, path, text_col)
    cache = (
        open_cache(docs.sparkSession, path)
        .where(F.col("tokenizer") == tokenizer_digest(model_file))
        .groupBy("content")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    text = text_or_empty(text_col)
    rows = docs.drop("content", "n_bytes", "n_tokens", "over_limit").withColumns({
        "n_bytes": F.octet_length(text).cast("long"),
        "content": F.unhex(F.sha2(text, 256)),
    })
    return rows.join(cache, "content").withColumn("over_limit", F.col("n_tokens") > limit)
