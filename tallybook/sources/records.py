"""Records of delimited text files, read in splits of any size.

A line break inside a quoted cell does not end a record, and whether a line stands inside
quotes depends on all lines before it. So every line is a function of two states (outside
or inside quotes at its start) to the state at its end. Such functions compose: within a
block as its task reads it in order, then over the blocks of a file, of which there are few.
That tells each line's state, however a file was split, and no task reads a whole file. The
records inside a block are put together where they are read; only those that go from one
block to the next are shuffled.

A quote that is never closed would take in the rest of its file. Its lines are records of
their own instead; the first of them is malformed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.session import reliable_checkpoint

#: Columns that place a line: its file, the split it is from, and a number that counts up within that.
PLACE = ["source_file", "block_start", "line_no"]


def for_separator(sep: Column, known: list[str], value) -> Column:
    """``value`` for each row's separator, so that its patterns are literals."""
    out = value(known[-1])
    for one in reversed(known[:-1]):
        out = F.when(sep == one, value(one)).otherwise(out)
    return out


def _class(sep: str) -> str:
    return f"[^{re.escape(sep)}]" if sep not in "\\]^" else f"[^\\{sep}]"


_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'


def split_cells(line: Column, sep: str) -> Column:
    """The cells of a record, unquoted; a quote counts where a cell starts."""
    cell = rf"\Q{sep}\E(?:{_QUOTED}{_class(sep)}*+|{_class(sep)}*+)"
    raw = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f"(?s){cell}"), F.lit(0))
    plain = F.transform(raw, lambda c: F.substr(c, F.lit(1 + len(sep))))
    whole = F.transform(plain, lambda c: F.when(
        F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"')) & (F.length(c) > 1),
        F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')),
    ).otherwise(c))
    # Java splits at an escaped sign without compiling a pattern for each row.
    mark = f"\\{sep}" if len(sep) == 1 and not sep.isalnum() else rf"\Q{sep}\E"
    return F.when(F.contains(line, F.lit('"')), whole).otherwise(F.split(line, mark, -1))


def _ends_inside(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a line ends inside quotes, if it starts outside and if it starts inside."""
    other, mark = _class(sep), rf"\Q{sep}\E"
    opened = rf'(?:(?:{_QUOTED}{other}*+|(?!"){other}*+){mark})*+"[^"]*+(?:""[^"]*+)*+$'
    inside = rf'^[^"]*+(?:""[^"]*+)*+(?:$|"{other}*+{mark}{opened})'
    quote = F.contains(line, F.lit('"'))
    return quote & F.regexp_like(line, F.lit(f"^{opened}")), ~quote | F.regexp_like(line, F.lit(inside))


def _run(partition: list[str], order: str, from_out: str, from_in: str, mark: str):
    """Adds mark_out and mark_in: the state before a row, from either state before the first."""
    before = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col(from_out) == F.col(from_in)
    turns = F.col(from_out) & ~F.col(from_in)

    def add(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("__turns", F.coalesce(F.sum(turns.cast("int")).over(before), F.lit(0)))
        known = F.when(fixed, F.struct(F.col(from_out).alias("state"), F.col("__turns").alias("turns")))
        rows = rows.withColumn("__known", F.last(known, ignorenulls=True).over(before))

        def state(start: bool) -> Column:
            since = F.col("__turns") - F.coalesce(F.col("__known.turns"), F.lit(0))
            return F.coalesce(F.col("__known.state"), F.lit(start)) != (since % 2 == 1)

        return rows.withColumns({f"{mark}_out": state(False), f"{mark}_in": state(True)}).drop("__turns", "__known")

    return add


def _states(out: np.ndarray, inside: np.ndarray, start: bool) -> tuple[np.ndarray, bool]:
    """Whether each line starts inside quotes, if the first does as told; and how the last one ends."""
    turns = np.cumsum(out & ~inside)
    known = np.maximum.accumulate(np.where(out == inside, np.arange(len(out)), -1))
    known = np.concatenate([[-1], known[:-1]])
    turned = np.concatenate([[0], turns[:-1]]) - np.where(known >= 0, turns[known], 0)
    state = np.where(known >= 0, out[known], start) != (turned % 2 == 1)
    return state, bool((inside if state[-1] else out)[-1])


def _runs(batch: pa.RecordBatch) -> list[tuple[tuple, int, int]]:
    """(file and block, from, to) of the stretches of a batch."""
    files, blocks = batch.column("source_file"), batch.column("block_start")
    other = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(blocks[1:], blocks[:-1])).to_numpy(zero_copy_only=False)
    bounds = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
    return [((files[a].as_py(), blocks[a].as_py()), a, b) for a, b in pairwise(bounds)]


def _flags(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(bool) for n in names]


_BLOCKS = (
    "source_file string, block_start bigint, __out boolean, __in boolean, "
    "__first_out bigint, __first_in bigint, __last_out bigint, __last_in bigint"
)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of lines in order: its end and its first and last start of a record, from either state."""
    names = ["source_file", "block_start", "__out", "__in", "__first_out", "__first_in", "__last_out", "__last_in"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4]

    def row(key, ends, first, last):
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*key, *ends, *first, *last), kinds)], names)

    key = ends = first = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        numbers = batch.column("line_no").to_numpy()
        out, inside = _flags(batch, "__out", "__in")
        for here, a, b in _runs(batch):
            if here != key:
                if key is not None:
                    yield row(key, ends, first, last)
                key, ends, first, last = here, [False, True], [None, None], [None, None]
            for k in (0, 1):
                state, ends[k] = _states(out[a:b], inside[a:b], ends[k])
                starts = numbers[a:b][~state]
                if len(starts):
                    first[k], last[k] = int(starts[0]) if first[k] is None else first[k], int(starts[-1])
    if key is not None:
        yield row(key, ends, first, last)


def _folded(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """A row for each start: the texts up to the next one, joined by line breaks."""
    if len(starts) == batch.num_rows:
        return batch
    texts = batch.column("text")
    parts = pa.ListArray.from_arrays(pa.array([*starts.tolist(), batch.num_rows], pa.int32()), texts)
    first = batch.take(pa.array(starts))
    joined = pc.binary_join(parts, pa.scalar("\n", texts.type))
    return first.set_column(first.schema.get_field_index("text"), "text", joined)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of lines in order; a block's first line here starts one, and a line of its own is one."""
    key, state, held = None, False, []  # held: lines of a record that may go on

    def whole(parts):
        one = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        return _folded(one, np.array([0]))

    for batch in batches:
        if not batch.num_rows:
            continue
        out, inside, own = _flags(batch, "__out", "__in", "__own")
        starts = np.zeros(batch.num_rows, dtype=bool)
        for here, a, b in _runs(batch):
            if here != key:
                key, state = here, False
                starts[a] = True
            inner, state = _states(out[a:b], inside[a:b], state)
            starts[a:b] |= ~inner | own[a:b]
        lines = batch.drop_columns(["__out", "__in", "__own"])
        at = np.flatnonzero(starts)
        if not len(at):
            held.append(lines)
            continue
        if held or at[0]:
            yield whole([*held, lines.slice(0, at[0])])
        if len(at) > 1:
            yield _folded(lines.slice(at[0], at[-1] - at[0]), at[:-1] - at[0])
        held = [lines.slice(at[-1])]
    if held:
        yield whole(held)


def assemble(lines: DataFrame, separators: list[str], ordered: bool = True) -> DataFrame:
    """Records of lines (PLACE, text, sep, carried columns of the file), `text` with its line breaks.

    ``ordered``: the lines of a block lie in one partition, in order, as a scan gives them; and the
    blocks are few enough to be broadcast. Lines that are not so are shuffled.
    """
    carried = [c for c in lines.columns if c not in (*PLACE, "text")]
    out = for_separator(F.col("sep"), separators, lambda s: _ends_inside(F.col("text"), s)[0])
    inside = for_separator(F.col("sep"), separators, lambda s: _ends_inside(F.col("text"), s)[1])

    def in_order(rows: DataFrame) -> DataFrame:
        return rows if ordered else rows.repartition("source_file", "block_start").sortWithinPartitions(*PLACE)

    flags = in_order(lines.select(*PLACE, out.alias("__out"), inside.alias("__in")))
    blocks = flags.mapInArrow(_summaries, _BLOCKS)
    blocks = _run(["source_file"], "block_start", "__out", "__in", "__at")(blocks)

    def actual(name: str) -> Column:
        # A file starts outside of quotes.
        return F.when(F.col("__at_out"), F.col(f"__{name}_in" if name else "__in")).otherwise(F.col(f"__{name}_out" if name else "__out"))

    blocks = blocks.select(
        "source_file", "block_start", actual("").alias("__ends"), actual("first").alias("__first"), actual("last").alias("__last"),
    ).withColumn("__start", F.when(F.col("__last").isNotNull(), F.struct("block_start", F.col("__last").alias("line_no"))))
    order = Window.partitionBy("source_file").orderBy("block_start")
    whole = Window.partitionBy("source_file")
    # Stored: a row a block. The lines are read for it once, and once more for the records.
    blocks = reliable_checkpoint(blocks.select(
        F.col("source_file").alias("__file"), F.col("block_start").alias("__block"), "__ends", "__first", "__last",
        F.last("__start", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.when(F.max_by("__ends", "block_start").over(whole), F.max("__start").over(whole)).alias("__unclosed"),
    ))
    lines = lines.join(
        F.broadcast(blocks) if ordered else blocks,
        (F.col("source_file") == F.col("__file")) & (F.col("block_start") == F.col("__block")),
    )
    place = F.struct("block_start", "line_no")
    own = F.coalesce(place >= F.col("__unclosed"), F.lit(False))
    # What goes on from the block before, and what goes on in the next one.
    goes_on = F.col("__first").isNull() | (F.col("line_no") < F.col("__first"))
    open_ = F.col("__ends") & (F.col("line_no") >= F.col("__last"))
    split = ~own & (goes_on | F.coalesce(open_, F.lit(False)))
    inner = lines.where(~split).select(*PLACE, "text", *carried, out.alias("__out"), inside.alias("__in"), own.alias("__own"))
    single = in_order(inner).mapInArrow(_merged, inner.drop("__out", "__in", "__own").schema)
    record = F.when(goes_on, F.col("__before")).otherwise(F.struct("block_start", F.col("__last").alias("line_no")))
    parts = lines.where(split).withColumn("__record", record).groupBy("source_file", "__record").agg(
        F.sort_array(F.collect_list(F.struct("block_start", "line_no", "text"))).alias("__parts"),
        *[F.first(c).alias(c) for c in carried],
    )
    joined = parts.select(
        "source_file", "__record.block_start", "__record.line_no",
        F.array_join(F.transform("__parts", lambda p: p["text"]), "\n").alias("text"), *carried,
    )
    return single.unionByName(joined)
