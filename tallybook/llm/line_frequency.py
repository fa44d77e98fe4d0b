"""Quality rules: line frequency across the documents of a host, after counts inside each text.

A line is normalised (A-Z lowered, blanks turned into one space, trimmed) and hashed. For each
host the documents that hold a line are counted, copies of one text as one document; lines in
`percent` of the host's documents are removed, if that is `least` documents or more. So the
limit follows the host, and like data give like verdicts at every size. A document that
keeps less than `min_share` of its words, or nothing, is rejected as depleted. Before that, two rules inside a text: too few
words, or too many words in five-word windows that the text repeats.

Only DataFrame functions are used, and all work of a text happens in its own row: repeated
windows are found by sorting their hashes, not by a shuffle of all words. Line counts merge
before the shuffle, and removed lines reach their documents by a join that is safe for a
line or host of a third of all rows.

Cases: a null or blank text has no words, lines or windows and fails the base rules; a null
host is a host of its own; repeated rows keep their number and count as one document; an
empty table gives no rows; result columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import WORD, checkpointed, join_facts, lower_ascii, table, text_or_empty

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _row_of(*columns: str) -> Column:
    """Equal for equal rows; tells a null from a value."""
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in columns])


def with_text_counts(docs: DataFrame, window: int = 5) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = [c for c in docs.columns if c not in names]
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    rows = docs.select(*kept, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"), lines.alias("_lines"), text.alias("_text"))
    count = F.size("_words")
    starts = F.when(count >= window, F.sequence(F.lit(0), count - window)).otherwise(F.array().cast("array<int>"))
    rows = rows.select(
        *kept, count.alias("_n"),
        F.length(F.translate("_text", BLANKS, "")).alias("_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).alias("_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("_dup"),
        F.transform(starts, lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(window)])).alias("_hashes"),
    )
    # Most texts repeat no window: only the others sort theirs.
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    pairs = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_pairs", F.when(repeats, pairs)).drop("_hashes")
    again = F.filter("_pairs", lambda p, i: (p["h"] == F.get("_pairs", i - 1)["h"]) | (p["h"] == F.get("_pairs", i + 1)["h"]))
    rows = rows.withColumn("_at", F.sort_array(F.transform(again, lambda p: p["i"]))).drop("_pairs")
    # Each repeated window covers up to the next one; the last covers all its words.
    covered = F.aggregate(
        F.transform("_at", lambda at, i: F.least(F.lit(window), F.coalesce(F.get("_at", i + 1) - at, F.lit(window)))),
        F.lit(0), lambda total, n: total + n,
    )
    return rows.select(
        *kept, F.col("_n").cast("long").alias("n_words"), F.col("_chars").cast("long").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"), F.col("_dup").cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def normalised_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(lower_ascii(line), r"[\x20\x09-\x0D]+", " "))


def line_hashes(text: Column) -> Column:
    """(h, words) of each line that has a word, in order; h is that of its `normalised_line`.

    The same in cheaper steps: blanks change once a text and only where there is more than single
    spaces, lines in ASCII are lower-cased as they are, and words are counted in bytes.
    """
    odd = reduce(Column.__or__, [F.contains(text, F.lit(b)) for b in ("  ", "\t", "\x0b", "\x0c", "\r")])
    flat = F.when(odd, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")).otherwise(text)
    folded = lambda x: F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(lower_ascii(x))
    lines = F.filter(F.transform(F.split(flat, "\n"), lambda x: folded(F.trim(x))), lambda x: x != "")
    words = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), words(x).alias("words")))


def frequent_lines(rows: DataFrame, percent: int, least: int) -> DataFrame:
    """(host, h, docs, rows) of the lines above the host's limit. rows: host, digest, lines."""
    each = rows.select("host", "digest", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    per_text = each.groupBy("host", "h", "digest").agg(F.count("*").alias("rows"))
    found = per_text.groupBy("host", "h").agg(F.count("*").alias("docs"), F.sum("rows").alias("rows"))
    found = checkpointed(found.where(F.col("docs") >= least))
    hosts = rows.groupBy("host", "digest").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_docs"))
    lines = found.groupBy("host").agg(F.count("*").alias("n")).withColumnRenamed("host", "of")
    hosts = hosts.join(lines, F.col("host").eqNullSafe(F.col("of"))).drop("of")
    sized = join_facts(found, hosts, ["host"], "n", found.count())
    return sized.where(100 * F.col("docs") >= percent * F.col("host_docs")).drop("host_docs")


def judged(
    docs: DataFrame, host: str = "source", percent: int = 2, least: int = 5, min_share: float = 0.7,
    min_words: int = 10, repeat_percent: int = 20, carry: Sequence[str] = (),
) -> DataFrame:
    """Each row's doc_id, host, text counts, base_failed, removed (hashes of lines taken out), kept_words, kept."""
    extra = [c for c in carry if c not in ("doc_id", "host", "text")]
    rows = docs.select("doc_id", F.col(host).alias("host"), "text", *extra)
    rows = rows.withColumns({"digest": F.xxhash64(text_or_empty()), "lines": line_hashes(text_or_empty())})
    rows = with_text_counts(rows).drop("text").withColumn("_row", _row_of("doc_id", "host", "digest"))
    rows = checkpointed(rows)
    frequent = checkpointed(frequent_lines(rows, percent, least))
    each = rows.select("_row", "host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    total = rows.agg(F.sum(F.size("lines"))).first()[0] or 0
    hit = join_facts(each, frequent, ["host", "h"], "rows", total).where("docs is not null")
    removed = hit.groupBy("_row").agg(F.collect_set("h").alias("removed"))  # a text's own lines
    rows = rows.join(removed, "_row", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<bigint>")))
    left = F.filter("lines", lambda x: ~F.array_contains("removed", x["h"]))
    kept_words = F.aggregate(left, F.lit(0).cast("long"), lambda total, x: total + x["words"])
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    rows = rows.withColumns({"base_failed": base_failed, "kept_words": kept_words})
    depleted = (F.col("kept_words") == 0) | (F.col("kept_words") < min_share * F.col("n_words"))
    return rows.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("_row", "lines", "digest")


def clean_text(text: Column, removed: Column) -> Column:
    """The text without its removed lines; other lines stay as they are."""
    left = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(removed, F.xxhash64(normalised_line(x))))
    return F.array_join(left, "\n")


def filtered(docs: DataFrame, host: str = "source", **settings) -> DataFrame:
    """The kept rows of docs, their text without the removed lines."""
    text = docs.select("*", F.col("text").alias("_whole"))
    found = judged(text, host, carry=["_whole", *(c for c in docs.columns if c not in ("doc_id", "text"))], **settings)
    cleaned = found.where("kept").withColumn("text", clean_text(F.col("_whole"), F.col("removed")))
    return cleaned.select(*docs.columns)


def op6_line_frequency(spark, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents; the host of a document is its source."""
    found = judged(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


#: The same in DuckDB SQL.
ORACLE = r"""
with rows as (
  select row_number() over () as rid, doc_id, source, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents),
windows as (select rid, i, array_to_string(list_slice(words, i, i + 4), ' ') as gram
  from (select rid, words, unnest(generate_series(1, len(words) - 4)) as i from rows where len(words) >= 5)),
repeated as (select rid, i from (select rid, i, count(*) over (partition by rid, gram) as n from windows) where n > 1),
covered as (select rid, count(distinct i + k) as n from repeated, (select unnest(generate_series(0, 4)) as k) group by rid),
lines as (select rid, source, text, unnest(string_split(text, chr(10))) as line from rows),
normal as (select rid, source, text, line, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as norm from lines),
worded as (select rid, source, text, line, norm, len(string_split(norm, ' ')) as n from normal where norm <> ''),
hosts as (select source, count(distinct text) as docs from rows group by source),
frequent as (select w.source, norm from worded w join hosts h on w.source is not distinct from h.source
  group by w.source, norm, h.docs having count(distinct text) >= 5 and 100 * count(distinct text) >= 2 * h.docs),
left_over as (select rid, count(*) - count(distinct line) as dup,
    sum(case when exists (select 1 from frequent f where f.source is not distinct from worded.source and f.norm = worded.norm)
      then 0 else n end) as kept_words
  from worded group by rid),
counts as (select doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(dup, 0) as n_dup_lines,
    coalesce(covered.n, 0) as n_repeat_words, coalesce(kept_words, 0) as kept_words
  from rows left join covered on covered.rid = rows.rid left join left_over on left_over.rid = rows.rid),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counts)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
  cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not base_failed and kept_words > 0 and kept_words >= 0.7 * n_words as kept
from judged"""
