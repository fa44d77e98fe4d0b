"""Registered queries of this subpackage. Each applies its operator to a whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import conversation_repair, decontaminate, heavy_dedup, line_frequency, reputation, word_runs
from tallybook.llm.common import shared_folder, table
from tallybook.llm.conversation_repair import op12_turn_repair
from tallybook.llm.credentials import op10_credentials
from tallybook.llm.decontaminate import op9_decontaminate
from tallybook.llm.heavy_dedup import op13_exact_dedup
from tallybook.llm.html_blocks import op3_html_text
from tallybook.llm.line_frequency import op6_line_frequency
from tallybook.llm.mixing import op1_pfair_mix
from tallybook.llm.pigeonring import op4_simhash
from tallybook.llm.propagation import op7_shards
from tallybook.llm.reputation import op2_url_reputation
from tallybook.llm.token_cache import token_counts
from tallybook.llm.toxic_grammar import op8_toxicity
from tallybook.llm.word_runs import op11_word_runs


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of documents. Each call starts a cache of its own, so that it does all the work."""
    cache = f"{shared_folder(spark)}/token-cache-{uuid.uuid4().hex}"
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, model, cache).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pfair_mix": op1_pfair_mix,
    "op2_url_reputation": op2_url_reputation,
    "op3_html_text": op3_html_text,
    "op4_simhash": op4_simhash,
    "op5_token_counts": op5_token_counts,
    "op6_line_frequency": op6_line_frequency,
    "op7_shards": op7_shards,
    "op8_toxicity": op8_toxicity,
    "op9_decontaminate": op9_decontaminate,
    "op10_credentials": op10_credentials,
    "op11_word_runs": op11_word_runs,
    "op12_turn_repair": op12_turn_repair,
    "op13_exact_dedup": op13_exact_dedup,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op2_url_reputation": reputation.ORACLE,
    "op6_line_frequency": line_frequency.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op11_word_runs": word_runs.ORACLE,
    "op12_turn_repair": conversation_repair.ORACLE,
    "op13_exact_dedup": heavy_dedup.ORACLE,
}
