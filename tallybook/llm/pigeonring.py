"""Near-duplicates by SimHash, with candidates from pigeonring chains.

A fingerprint is a ring of 8 segments of 8 bits. Where two differ in at most 3 bits,
some start on the ring has the property that the differences summed over the first l
segments from it stay within l * 3/8, for every l (the strong form of the pigeonring
principle). From such a start the first two segments are equal and the next three
differ in at most one bit in all. So at least two of these three are equal too, and the
pair shares one of 8 * 3 keys of four equal segments (32 bits). A pair found by a key is
then held to the budgets all along the chain, and only survivors get the full Hamming
check.

Pairs inside a key are not all formed. First every fingerprint meets the key's pivot
(the one that most documents have); this is one pair per row. The links found give
components. Then only fingerprints outside a key's largest component meet the others
of the key, and only across components: pairs within a component could not change it.
Even these meet only where they share one more segment, which a pair in reach always does:
its 3 bits leave one of the four segments outside the key alone. So a key of many texts
around one passage, all apart from each other, is cut 64 times smaller and loses no link.

Cases: a null or blank text has fingerprint 0 and links like any other; exact copies and
repeated rows share a fingerprint and meet once; a null doc_id is kept and never names
a component unless all its members are null; an empty table gives no rows; only the id
and the text of the input are read, so names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import WORD, checkpointed, join_facts, table, text_or_empty
from tallybook.llm.components import components

SEGMENTS, WIDTH, LIMIT = 8, 8, 3
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Over UTF-8 bytes: the blanks between words are all ASCII.
TOKEN = re.compile(WORD.encode())
#: The bits of each byte value, highest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Majority of each bit over the XXH64 of all shingles, as a signed 64-bit number."""
    import xxhash

    tokens = TOKEN.findall((text or b"").translate(FOLD))
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, 42) for s in shingles]), dtype=np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(hashes[:, i], minlength=256) @ BITS for i in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs with a column fingerprint (long); each Arrow batch is worked on as it comes."""

    @F.pandas_udf("long")
    def of_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.withColumn("fingerprint", of_text(F.col("text").cast("binary")))


def _turned(value: Column, start: int) -> Column:
    """The ring read from segment `start` on."""
    bits = start * WIDTH
    return F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(value, 64 - bits)) if bits else value


def chain_keys(value: Column) -> Column:
    """The 24 keys: start, which of the segments 3 to 5 may differ, and the other four."""
    keys = []
    for start in range(SEGMENTS):
        for free in (2, 3, 4):
            mask = sum(0xFF << (64 - WIDTH * (s + 1)) for s in range(5) if s != free)
            signed = mask - (1 << 64) if mask >> 63 else mask
            keys.append(_turned(value, start).bitwiseAND(F.lit(signed)).bitwiseOR(F.lit(start * 3 + free - 2)))
    return F.array(*keys)


def chain_holds(key: Column, a: Column, b: Column) -> Column:
    """Whether differences stay within budget on every part of the chain from the key's start."""
    start = F.floor(key.bitwiseAND(F.lit(0xFF)) / 3)
    xor, holds = a.bitwiseXOR(b), F.lit(False)
    for s in range(SEGMENTS):
        turned = _turned(xor, s)
        parts = [F.bit_count(F.shiftrightunsigned(turned, 64 - WIDTH * n)) <= n * LIMIT // SEGMENTS for n in range(1, 8)]
        within = parts[0]
        for part in parts[1:]:
            within = within & part
        holds = F.when(start == s, within).otherwise(holds)
    return holds


def rest_segments(key: Column, value: Column) -> Column:
    """The four segments that the key leaves open, each as its value and place."""
    which = key.bitwiseAND(F.lit(0xFF)).cast("int")
    bits = F.floor(which / 3).cast("int") * WIDTH
    turned = F.call_function("shiftleft", value, bits).bitwiseOR(F.call_function("shiftrightunsigned", value, 64 - bits))
    parts = []
    for n, place in enumerate((which % 3 + 2, F.lit(5), F.lit(6), F.lit(7))):
        low = F.call_function("shiftrightunsigned", turned, 64 - WIDTH * (place + 1)).bitwiseAND(F.lit(0xFF))
        parts.append(low.cast("int") * 4 + n)
    return F.array(*parts)


def near(key: Column, a: Column, b: Column) -> Column:
    return chain_holds(key, a, b) & (F.bit_count(a.bitwiseXOR(b)) <= LIMIT)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints at LIMIT or fewer bits. prints: fp, docs."""
    index = checkpointed(prints.select("fp", "docs", F.explode(chain_keys(F.col("fp"))).alias("key")))
    shared = checkpointed(
        index.groupBy("key")
        .agg(F.count("*").alias("members"), F.max(F.struct("docs", "fp")).getField("fp").alias("pivot"))
        .where("members > 1")
    )
    stars = index.join(shared, "key").where("fp != pivot").where(near(F.col("key"), F.col("fp"), F.col("pivot")))
    stars = checkpointed(stars.select(F.col("fp").alias("a"), F.col("pivot").alias("b")).distinct())

    # A key of two is done; in the others, those outside the largest component are left.
    first = components(stars).select(F.col("node").alias("fp"), "component")
    members = index.join(shared.where("members > 2").select("key"), "key", "left_semi").select("key", "fp")
    members = checkpointed(
        members.join(first, "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("component"))
    )
    largest = (
        members.groupBy("key", "component").agg(F.count("*").alias("n"))
        .groupBy("key").agg(F.max(F.struct("n", "component")).getField("component").alias("main"), F.count("*").alias("parts"))
        .where("parts > 1").select("key", "main")
    )
    open_keys = members.join(largest, "key").select("*", F.explode(rest_segments(F.col("key"), F.col("fp"))).alias("part"))
    left = open_keys.where("component != main").select("key", "part", F.col("fp").alias("a"), F.col("component").alias("ca"))
    right = open_keys.select("key", "part", F.col("fp").alias("b"), F.col("component").alias("cb"))
    across = left.join(right, ["key", "part"]).where("ca != cb").where(near(F.col("key"), F.col("a"), F.col("b")))
    return stars.union(across.select("a", "b").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, fingerprint as long, class, component_id) of every row of docs.

    `class` is the component's smallest fingerprint, which tells components apart even
    where all ids are null; `digest` is the XXH64 of the text.
    """
    texts = docs.select("doc_id", "text", F.xxhash64(text_or_empty()).alias("digest"))
    rows = checkpointed(with_fingerprints(texts).select("doc_id", "digest", "fingerprint"))
    prints = checkpointed(
        rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.count("*").alias("docs"), F.min("doc_id").alias("least"))
    )
    parts = components(fingerprint_links(prints)).select(F.col("node").alias("fp"), "component")
    named = prints.join(parts, "fp", "left").select("fp", "docs", "least", F.coalesce("component", "fp").alias("class"))
    classes = named.groupBy("class").agg(F.min("least").alias("component_id"))
    classes = named.join(classes, "class").select(F.col("fp").alias("fingerprint"), "docs", "class", "component_id")
    found = join_facts(rows, classes, ["fingerprint"], "docs", rows.count())
    return found.select("doc_id", "digest", "fingerprint", "class", "component_id")


def without_near_duplicates(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row of each component with the columns of docs: that of the id which names it.

    Where the id is on several rows of the component, the smallest digest wins, and of
    rows that repeat one text any one stays. `found` gives the components of another
    measure (doc_id, digest, class, component_id).
    """
    found = near_duplicates(docs) if found is None else found
    found = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    winners = found.groupBy("class").agg(F.min("digest").alias("_digest"), F.first("doc_id").alias("doc_id"))
    winners = winners.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), "_digest")
    marked = docs.withColumns({
        "_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
        "_digest": F.xxhash64(text_or_empty()),
    })
    kept = marked.join(winners, ["_id", "_digest"], "left_semi")
    return kept.dropDuplicates(["_id", "_digest"]).select(*docs.columns)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
