"""Periodic runs of words, from Lyndon arrays of Baier's grouping.

A run is a maximal stretch of words with smallest period q that is at least 4 q and 6
words long. By the runs theorem (Bannai et al. 2017), every run holds Lyndon words of
length q that are the longest ones at their start, in the order of the words or in its
reverse. Both Lyndon arrays come from phase one of Baier's suffix sorting (2016), without
the suffix array: suffixes stand in groups by the prefix known so far; the highest group
leaves the text, and the nearest position that is left before its members takes them over
and moves up behind its old group, by how many members it took. What a position covers
when its own group leaves is its longest Lyndon word. A root that is followed by two more
of its kind is then extended to both sides by longest common extensions.

Before that, words that cannot stand in a run are cut out: within a piece of L words, a
word of a run occurs four times and again within L / 4. Pieces that are left after
repeated cuts are the whole places of all runs, so nothing is lost by it.

Cases: a null or blank text has no words and no runs; a null or otherwise odd doc_id is
never planted and keeps its words; repeated rows give repeated results; an empty table
gives no rows; a text of any length is one row of work and is read whole; only the id and
the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import WORD, table
from tallybook.llm.sql_text import CRC_TABLE, crc32

TOKEN = re.compile(WORD.encode())
#: Repetitions and words that make a stretch a run.
REPEATS, SHORTEST = 4, 6


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each position; the end of the text is the smallest."""
    n = len(ranks)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    lengths, group = [0] * n, [0] * n
    # Groups are linked from high to low; group 0 stands below all others.
    numbers = {rank: g for g, rank in enumerate(sorted(set(ranks)), 1)}
    members: list[list[int]] = [[] for _ in range(len(numbers) + 1)]
    for i, rank in enumerate(ranks):
        group[i] = g = numbers[rank]
        members[g].append(i)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    current = len(members) - 1
    while current > 0:
        taken: dict[int, int] = {}
        for i in members[current]:  # ascending, so the position before i is of a lower group
            if group[i] == current:
                left, right = before[i], after[i]
                lengths[i] = right - i
                if right < n:
                    before[right] = left
                if left >= 0:
                    after[left] = right
                    taken[left] = taken.get(left, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for i, count in taken.items():
            moves.setdefault((count, group[i]), []).append(i)
        # Just above the old group; those that took fewer members come later, so they end up lower.
        for count, old in sorted(moves, reverse=True):
            fresh, high = len(members), above[old]
            members.append(moves[count, old])
            for i in members[fresh]:
                group[i] = fresh
            above[old] = below[high] = fresh
            above.append(high)
            below.append(old)
        current = below[current]
    return lengths


def _equal_stretch(a: np.ndarray, b: np.ndarray) -> int:
    """Longest common prefix of two views of one length, in blocks that double."""
    at, size, n = 0, 16, len(a)
    while at < n:
        differ = np.flatnonzero(a[at : at + size] != b[at : at + size])
        if len(differ):
            return at + int(differ[0])
        at, size = at + size, size * 2
    return n


def _roots_extended(ids: np.ndarray, lengths: np.ndarray, found: set[tuple[int, int, int]]) -> None:
    """Adds (start, length, period) of the runs whose Lyndon roots are in the array."""
    n, at = len(ids), np.arange(len(ids))
    third = at + 2 * lengths
    inside = third < n
    at, period, third = at[inside], lengths[inside], third[inside]
    # A run of four periods holds its root three times in a row.
    thrice = (lengths[at + period] == period) & (lengths[third] == period) & (ids[at] == ids[at + period])
    done: dict[int, int] = {}
    for i, q in zip(at[thrice].tolist(), period[thrice].tolist(), strict=True):
        if i + q < done.get(q, 0):
            continue  # inside the last stretch of this period
        right = _equal_stretch(ids[i : n - q], ids[i + q :])
        left = _equal_stretch(ids[:i][::-1], ids[q : i + q][::-1])
        done[q] = i + q + right
        length = left + q + right
        if length >= max(SHORTEST, REPEATS * q):
            found.add((i - left, length, q))


def _pieces(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches outside of which no run can be: no word of theirs is too rare or too far from its like."""
    at = np.flatnonzero(np.bincount(ids)[ids] >= REPEATS)
    while True:
        piece = np.cumsum(np.diff(at, prepend=-1) != 1)
        size = np.bincount(piece)[piece] if len(at) else at
        long = size >= SHORTEST
        at, piece, size = at[long], piece[long], size[long]
        if not len(at):
            return []
        word = ids[at]
        order = np.lexsort((at, word, piece))
        same = (np.diff(word[order]) == 0) & (np.diff(piece[order]) == 0)
        gap = np.where(same, np.diff(at[order]), len(ids))
        nearest = np.minimum(np.append(gap, len(ids)), np.append(len(ids), gap))
        _, which, count = np.unique(np.cumsum(np.append(True, ~same)), return_inverse=True, return_counts=True)
        keep = np.empty(len(at), dtype=bool)
        keep[order] = (nearest * REPEATS <= size[order]) & (count[which] >= REPEATS)
        left = int(keep.sum())
        if left * 8 > len(at) * 7:  # little to gain: the next step is exact on any piece
            ends = np.flatnonzero(np.append(np.diff(at) != 1, True))
            starts = np.append(0, ends[:-1] + 1)
            return list(zip(at[starts].tolist(), (at[ends] + 1).tolist(), strict=True))
        at = at[keep]


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text of word numbers, by start and period."""
    found: set[tuple[int, int, int]] = set()
    for start, end in _pieces(ids) if len(ids) >= SHORTEST else ():
        _, ranks = np.unique(ids[start:end], return_inverse=True)
        here: set[tuple[int, int, int]] = set()
        for ordered in (ranks, ranks.max() - ranks):
            _roots_extended(ranks, np.array(lyndon_array(ordered.tolist())), here)
        found |= {(start + s, length, q) for s, length, q in here}
    return sorted(found, key=lambda run: (run[0], run[2]))


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words of the result contract: one document in ten repeats a stretch up to its end."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def analyse(words: list[bytes]) -> tuple[list[tuple[int, int, int]], bytes]:
    """The runs of a text and its words without the repetitions, joined by single spaces."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    runs = runs_of(ids)
    if not runs:
        return runs, b" ".join(words)
    dropped = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        dropped[start + q] += 1
        dropped[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(dropped[:-1]) == 0)
    return runs, b" ".join([words[i] for i in kept.tolist()])


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
#: Bytes of collapsed text in an output batch.
BATCH_BYTES = 8 << 20


def word_runs(docs: DataFrame, prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of docs.

    collapsed is the text without the words that a run repeats. prepare changes the words
    of a document before they are searched.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        names = ("start", "length", "period")

        def packed(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            sizes, runs, texts = zip(*rows, strict=True)
            runs = [[dict(zip(names, r, strict=True)) for r in found] for found in runs]
            arrays = [ids, pa.array(sizes, pa.int64()), pa.array(runs, run_type), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "runs", "collapsed"])

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows, first, held = [], 0, 0
            for i in range(batch.num_rows):
                words = TOKEN.findall(texts[i].as_py() or b"")
                if prepare:
                    words = prepare(ids[i].as_py(), words)
                runs, collapsed = analyse(words)
                rows.append((len(words), runs, collapsed.decode(errors="replace")))
                held += len(collapsed)
                if held > BATCH_BYTES:
                    yield packed(ids.slice(first, len(rows)), rows)
                    rows, first, held = [], i + 1, 0
            if rows:
                yield packed(ids.slice(first, len(rows)), rows)

    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(work, schema)


def op11_word_runs(spark, sf_dir: str) -> DataFrame:
    """The runs of all documents, one in ten of them planted."""
    found = word_runs(table(spark, sf_dir, "documents"), planted)

    def ahead(best, run):
        """Exact length / period first, then the smaller start and period; runs come by (start, period)."""
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    top = found.withColumn("top", F.aggregate("runs", none, ahead))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(F.lit(1000) * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The same in DuckDB SQL: equal words at each distance, joined to stretches; no Lyndon words.
ORACLE = rf"""
with {CRC_TABLE},
plain as (
  select row_number() over () as rid, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
    {crc32("coalesce(cast(doc_id as varchar), '1')")} as h
  from documents, crc_table),
placed as (
  select *, len(words) as n, h // 10 as g, case when len(words) > 0 then (h // 10) % len(words) end as a from plain),
planted as (
  select rid, doc_id, n, case when h % 10 = 0 and n > 0 then
    list_transform(range(n), lambda i: words[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end])
    else words end as words
  from placed),
spots as (select rid, n, unnest(range(n)) as i, unnest(words) as word from planted),
pairs as (
  select x.rid, x.i, y.i - x.i as q from spots x join spots y
  on x.rid = y.rid and x.word = y.word and y.i > x.i and y.i - x.i <= x.n // 4),
stretches as (
  select rid, q, min(i) as s, count(*) + q as length
  from (select *, i - row_number() over (partition by rid, q order by i) as part from pairs)
  group by rid, q, part having count(*) + q >= greatest(6, 4 * q)),
runs as (
  select * from stretches r where not exists (
    select 1 from stretches o where o.rid = r.rid and o.q < r.q and o.s <= r.s and r.s + r.length <= o.s + o.length)),
firsts as (
  select rid, s, length, q from runs
  qualify row_number() over (partition by rid order by cast(length as double) / q desc, s, q) = 1),
listed as (
  select rid, count(*) as n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' order by s, q) as lines
  from runs group by rid),
dropped as (select distinct rid, unnest(range(s + q, s + length)) as i from runs),
kept as (
  select rid, string_agg(word, ' ' order by i) as words
  from (select spots.* from spots anti join dropped on spots.rid = dropped.rid and spots.i = dropped.i) group by rid)
select doc_id, cast(coalesce(n_runs, 0) as bigint) as n_runs, cast(s as bigint) as start, cast(length as bigint) as length,
  cast(q as bigint) as period, cast(1000 * length // q as bigint) as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept.words, '')) as collapsed_sha256
from planted left join firsts using (rid) left join listed using (rid) left join kept using (rid)"""
