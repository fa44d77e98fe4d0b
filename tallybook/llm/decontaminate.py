"""Benchmark passages in documents, by a prefix-filtered join of word windows.

A window is `words` consecutive words of a benchmark item (the whole item where it has
fewer). Full containment of a window of k words needs all k of them, so one necessary
word is enough as its prefix: the rarest by document frequency, which sends the fewest
document positions into the join. The offset of that word in the window fixes where the
window must start and end in the document (positional and length bound); the words there
are then compared, so a hit is exact.

Frequencies are counted over all documents. Which words matter is told to the tasks by a
bitmap of fixed size (`MAP_BITS`), so that the benchmark may grow: a fuller map lets more
positions into the join, which still gives the same result.

Cases: a null text has no words and no hits; an item without words has no window; a null
item_id counts as the text "null"; items that share an item_id count once in n_items;
repeated documents keep their number; an empty table on either side gives rows without
hits or no rows; only the id and the text of either table are read, so names cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import LETTERS, checkpointed, lower_ascii, table, text_or_empty

#: Bits of the word maps sent to tasks: 1 MB each, whatever the tables hold.
MAP_BITS = 1 << 23
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Over UTF-8 bytes: the signs between words are all ASCII.
TOKEN = re.compile(LETTERS.encode())


def _slot(word: bytes) -> int:
    """The slot that Spark's xxhash64 gives: MAP_BITS divides 2^64, so its sign makes no difference."""
    import xxhash

    return xxhash.xxh64_intdigest(word, 42) % MAP_BITS


def _word_map(words: DataFrame) -> np.ndarray:
    """Bitmap of the slots that the words of a column `word` take: MAP_BITS bits at most."""
    slots = words.select(F.pmod(F.xxhash64("word"), F.lit(MAP_BITS)).alias("slot")).distinct().toArrow()
    bits = np.zeros(MAP_BITS, dtype=bool)
    bits[slots.column("slot").to_numpy()] = True
    return np.packbits(bits)


class _Chosen:
    """Set test of a word against a bitmap; answers are remembered per worker, up to a bound."""

    def __init__(self, bitmap: np.ndarray, remembered: int = 300_000):
        self.bits, self.remembered, self.known = np.unpackbits(bitmap).astype(bool), remembered, {}

    def __call__(self, words: set[bytes]) -> list[bytes]:
        known, found = self.known, []
        for word in words:
            hit = known.get(word)
            if hit is None:
                if len(known) > self.remembered:
                    known.clear()
                hit = known[word] = bool(self.bits[_slot(word)])
            if hit:
                found.append(word)
        return found


def words_of(text: bytes | None) -> list[bytes]:
    return TOKEN.findall((text or b"").translate(FOLD))


def item_windows(items: DataFrame, words: int) -> DataFrame:
    """(item, window, n): every distinct window of every item, as an array of words."""
    every = F.regexp_extract_all(lower_ascii(text_or_empty()), F.lit(LETTERS), F.lit(0))
    tokens = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), every.alias("tokens")
    ).where(F.size("tokens") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("tokens") - words + 1, F.lit(1)))
    return (
        tokens.select("item", F.explode(F.transform(starts, lambda i: F.slice("tokens", i, words))).alias("window"))
        .distinct()
        .withColumn("n", F.size("window"))
    )


def document_frequency(docs: DataFrame, word_map: np.ndarray) -> DataFrame:
    """(word, df) over all documents, for words of the map; counts merge per batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = _Chosen(word_map)
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for text in batch.column(0):
                counts.update(chosen(set(words_of(text.as_py()))))
            yield pa.RecordBatch.from_pydict(
                {"word": [w.decode() for w in counts], "df": pa.array(counts.values(), pa.int64())},
                schema=pa.schema([("word", pa.string()), ("df", pa.int64())]),
            )

    found = docs.select(F.col("text").cast("binary")).mapInArrow(count, "word string, df long")
    return found.groupBy("word").agg(F.sum("df").alias("df"))


def rarest_words(windows: DataFrame, frequency: DataFrame) -> DataFrame:
    """The windows with their prefix word and its offset. A word that no document has stays at 0."""
    each = windows.select("*", F.posexplode("window").alias("offset", "word"))
    ranked = each.join(frequency, "word", "left").select(
        "item", "window", "n", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "offset").alias("rare")
    )
    return ranked.groupBy("item", "window", "n").agg(F.min("rare").alias("rare")).select(
        "item", "window", "n", F.col("rare.df").alias("df"), F.col("rare.word").alias("word"), F.col("rare.offset").alias("offset")
    )


def _decoded(words: list[bytes]) -> list[str]:
    return [w.decode() for w in words]


def row_key() -> Column:
    """Equal for rows of one id (or none) and text."""
    return F.xxhash64(F.struct(F.col("doc_id").isNull(), F.col("doc_id")), text_or_empty()).alias("row")


#: One row per document; `spots` are the positions of prefix words, with the words around them.
PROBE = (
    "row long, n_words long, "
    "spots array<struct<word:string, at:int, left:array<string>, right:array<string>>>"
)


def document_spots(docs: DataFrame, word_map: np.ndarray, words: int) -> DataFrame:
    """(doc_id, row, n_words, spots) of each document, repeated rows included."""
    around = words - 1
    spot_type = pa.struct([
        ("word", pa.string()), ("at", pa.int32()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string())),
    ])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = _Chosen(word_map)
        for batch in batches:
            lengths, spots = [], []
            for text in batch.column("text"):
                tokens = words_of(text.as_py())
                lengths.append(len(tokens))
                wanted = set(chosen(set(tokens)))
                spots.append([
                    {"word": w.decode(), "at": i, "left": _decoded(tokens[max(0, i - around):i]),
                     "right": _decoded(tokens[i:i + words])}
                    for i, w in enumerate(tokens) if w in wanted
                ] if wanted else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(lengths, pa.int64()),
                 pa.array(spots, pa.list_(spot_type))],
                names=["doc_id", "row", "n_words", "spots"],
            )

    rows = docs.select("doc_id", F.col("text").cast("binary"), row_key())
    return rows.mapInArrow(probe, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PROBE}")


def window_hits(spots: DataFrame, prefixed: DataFrame) -> DataFrame:
    """(row, at, n, item): verified occurrences, `at` the first word's position."""
    each = spots.where(F.size("spots") > 0).select("row", F.inline("spots"))
    before = F.greatest(F.size("left") - F.col("offset") + 1, F.lit(1))
    fits = (F.slice("left", before, F.col("offset")) == F.slice("window", F.lit(1), F.col("offset"))) & (F.slice("right", F.lit(1), F.col("n") - F.col("offset")) == F.slice("window", F.col("offset") + 1, F.col("n")))
    joined = each.join(prefixed.where("df > 0"), "word").where(F.size("left") >= F.col("offset"))
    return joined.where(fits).select("row", (F.col("at") - F.col("offset")).alias("at"), "n", "item")


def contamination(docs: DataFrame, items: DataFrame, words: int = 10) -> DataFrame:
    """Each document with n_words, n_hit, items (sorted ids) and hits (disjoint spans of words)."""
    windows = checkpointed(item_windows(items, words))
    vocabulary = windows.select(F.explode("window").alias("word"))
    frequency = document_frequency(docs, _word_map(vocabulary))
    prefixed = checkpointed(rarest_words(windows, frequency))
    spots = checkpointed(document_spots(docs, _word_map(prefixed.where("df > 0").select("word")), words))
    hits = window_hits(spots, prefixed)

    # Copies of a row give the same hits, so a set per row holds each once.
    spans = hits.groupBy("row", "at").agg(F.max(F.col("at") + F.col("n")).alias("end"))
    earlier = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(earlier), F.lit(-1))
    so_far = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    apart = spans.withColumn("begins", (F.col("at") > reach).cast("int")).withColumn("run", F.sum("begins").over(so_far))
    runs = apart.groupBy("row", "run").agg(F.min("at").alias("start"), F.max("end").alias("end"))
    union = runs.groupBy("row").agg(
        F.sum(F.col("end") - F.col("start")).alias("n_hit"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("hits"),
    )
    named = hits.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = union.join(named, "row")
    return spots.select("doc_id", "row", "n_words").join(found, "row", "left").select(
        "doc_id", "row", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("hits", F.array().cast("array<struct<start:int,end:int>>")).alias("hits"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, words: int = 10) -> DataFrame:
    """The rows of docs in which no window of an item occurs, with their own columns."""
    dirty = contamination(docs, items, words).where("n_hit > 0").select(F.col("row").alias("_row")).distinct()
    return docs.join(dirty, row_key() == F.col("_row"), "left_anti")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Benchmark hits of all documents."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The same in DuckDB SQL: whole windows are compared, without prefixes.
ORACLE = r"""
with folded as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents),
items as (
  select coalesce(cast(item_id as varchar), 'null') as item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark),
windows as (
  select distinct item, least(len(words), 10) as n, array_to_string(list_slice(words, i, i + 9), ' ') as gram
  from (select item, words, unnest(generate_series(1, greatest(len(words) - 9, 1))) as i from items where len(words) > 0)),
sizes as (select distinct n from windows),
places as (
  select rid, i, n, array_to_string(list_slice(words, i, i + n - 1), ' ') as gram
  from (select rid, words, n, unnest(generate_series(1, len(words) - n + 1)) as i
    from folded, sizes where len(words) >= n)),
found as (select rid, i, places.n, item from places join windows on places.gram = windows.gram and places.n = windows.n),
hit as (select rid, count(distinct spot) as n_hit
  from (select rid, unnest(generate_series(i, i + n - 1)) as spot from found) group by rid),
named as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct rid, item from found) group by rid)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from folded left join hit on hit.rid = folded.rid left join named on named.rid = folded.rid"""
