"""Mixing sources to target weights by Pfair scheduling of blocks.

Rows of a source stream form blocks. With p units of weight among Q in all, the stream's
block i is released at slot floor(i*Q/p) and due by slot ceil((i+1)*Q/p); in every slot
the released block with the earliest deadline goes first. All blocks then meet their
deadlines, so after any number of slots a stream is less than one block away from its
share. The pattern repeats after Q slots. It is worked out once for Q slots, and the slot
of any block follows by arithmetic, so rows are placed in parallel.

When a stream ends, the others keep their units and a new pattern starts from there (a
phase). No row is dropped or repeated: the weights decide the order, and every prefix of
the mixture holds each unfinished stream at its weight.

Bounds: the weights name the streams, and sources without a weight (null among them)
share one stream of `rest` units; units add up to UNITS at most. So the tables sent to
all tasks hold at most (streams + 1) * UNITS rows, whatever the data.

Cases: an empty table gives no rows; a weight for an absent source plays no part; with
rest = 0 and rows outside the weights, these come last, as a phase of their own; repeated
rows keep their number; columns of the input stay, and those named like the results
(stream, block, release, deadline, slot, position) are replaced.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import bucket_of, buckets_for, place, running_total, table

UNITS = 100_000
REST = "(rest)"
RESULT = ["stream", "block", "release", "deadline", "slot", "position"]


def pfair_pattern(units: Mapping[str, int]) -> dict[str, list[int]]:
    """The slot of each of a stream's p blocks in one round of sum(units) slots."""
    total = sum(units.values())
    released: dict[int, list[tuple[int, str]]] = {}
    for name, p in units.items():
        for i in range(p):
            released.setdefault(i * total // p, []).append((-(-(i + 1) * total // p), name))
    waiting: list[tuple[int, str]] = []
    slots: dict[str, list[int]] = {name: [] for name in units}
    for slot in range(total):
        for block in released.get(slot, ()):
            heapq.heappush(waiting, block)
        _, name = heapq.heappop(waiting)
        slots[name].append(slot)
    return slots


def phases(blocks: Mapping[str, int], units: Mapping[str, int]) -> list[dict]:
    """From each stream's end on, the streams that are left: start slot, pattern, first blocks."""
    done, start, found = dict.fromkeys(blocks, 0), 0, []
    while alive := {s: units[s] for s in sorted(blocks) if done[s] < blocks[s] and units[s] > 0} or {
        s: 1 for s in sorted(blocks) if done[s] < blocks[s]
    }:
        pattern, total = pfair_pattern(alive), sum(alive.values())

        def slot_of(stream: str, i: int, pattern=pattern, total=total, alive=alive) -> int:
            return i // alive[stream] * total + pattern[stream][i % alive[stream]]

        length = 1 + min(slot_of(s, blocks[s] - done[s] - 1) for s in alive)
        found.append({"start": start, "units": alive, "pattern": pattern, "first": {s: done[s] for s in alive}})
        rounds, part = divmod(length, total)
        for s in alive:
            done[s] += rounds * alive[s] + sum(slot < part for slot in pattern[s])
        start += length
    return found


def mix(
    docs: DataFrame, weights: Mapping[str, int], rest: int = 1, source: str = "source",
    block_rows: int = 32, rows_per_bucket: int = 5_000,
) -> DataFrame:
    """docs with stream, block, release, deadline, slot (in blocks) and position (in rows).

    Within a stream rows go by a hash of their columns, so neighbours in the input part, and so
    do rows without an id or with one id; only rows equal in every column stay together.
    """
    if sum(weights.values()) + rest > UNITS or min([rest, *weights.values()]) < 0:
        raise ValueError(f"units must be 0 or more and add up to {UNITS} at most")
    spark, units = docs.sparkSession, {**weights, REST: rest}
    named = F.col(source).cast("string").isin(list(weights))
    rows = docs.drop(*RESULT).withColumn("stream", F.when(named, F.col(source).cast("string")).otherwise(REST))
    hashed = [c for c, kind in docs.dtypes if c not in ("doc_id", *RESULT) and "map<" not in kind and "variant" not in kind]
    rows = rows.withColumn("_text", F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in hashed]))
    rows = rows.withColumn("_at", place(F.col("doc_id"), F.col("_text"), F.lit(7)))

    counts = {r["stream"]: r["count"] for r in rows.groupBy("stream").count().collect()}
    buckets = buckets_for(sum(counts.values()), rows_per_bucket)
    rows = rows.withColumn("_bucket", bucket_of(F.col("_at"), buckets))
    ranked = running_total(rows, ["stream"], "_bucket", ["_at", "doc_id", "_text"], F.lit(1), "_rank")
    ranked = ranked.withColumn("block", F.floor(F.col("_rank") / block_rows).cast("long"))

    plan = phases({s: math.ceil(n / block_rows) for s, n in counts.items()}, units)
    ranges, turns = [], []
    for k, phase in enumerate(plan):
        total = sum(phase["units"].values())
        for s, p in phase["units"].items():
            after = next((later["first"][s] for later in plan[k + 1:] if s in later["first"]), 1 << 62)
            ranges.append((s, k, phase["first"][s], after, phase["start"], p, total))
            turns += [(s, k, i, slot) for i, slot in enumerate(phase["pattern"][s])]
    ranges = spark.createDataFrame(
        ranges, "_stream string, _phase int, _first long, _after long, _start long, _units long, _total long"
    )
    turns = spark.createDataFrame(turns, "_s string, _k int, _i long, _turn long")
    inside = (F.col("stream") == F.col("_stream")) & (F.col("block") >= F.col("_first")) & (F.col("block") < F.col("_after"))
    i = F.col("block") - F.col("_first")
    turn = (F.col("stream") == F.col("_s")) & (F.col("_phase") == F.col("_k")) & (F.pmod(i, "_units") == F.col("_i"))
    placed = ranked.join(F.broadcast(ranges), inside).join(F.broadcast(turns), turn).withColumns({
        "release": F.col("_start") + F.floor(i * F.col("_total") / F.col("_units")),
        "deadline": F.col("_start") + F.ceil((i + 1) * F.col("_total") / F.col("_units")),
        "slot": F.col("_start") + F.floor(i / F.col("_units")) * F.col("_total") + F.col("_turn"),
    })
    # Only a stream's last block can be short; what it lacks moves later rows forward.
    short = F.lit(0).cast("long")
    for s, n in counts.items():
        lack = -n % block_rows
        if lack:
            last = (n - 1) // block_rows
            phase = next(p for p in reversed(plan) if s in p["units"] and p["first"][s] <= last)
            at, p = last - phase["first"][s], phase["units"][s]
            slot = phase["start"] + at // p * sum(phase["units"].values()) + phase["pattern"][s][at % p]
            short = short + F.when(F.col("slot") > slot, F.lit(lack)).otherwise(F.lit(0))
    placed = placed.withColumn("position", F.col("slot") * block_rows + F.pmod("_rank", F.lit(block_rows)) - short)
    return placed.drop(*[c for c in placed.columns if c.startswith("_") and c not in docs.columns])


#: Units of the registered query: the hot source is held to a tenth, the others share the rest.
WEIGHTS = {"src0": 100} | {f"src{i}": 45 for i in range(1, 20)}


def op1_pfair_mix(spark, sf_dir: str) -> DataFrame:
    """The mixing order of all documents."""
    mixed = mix(table(spark, sf_dir, "documents"), WEIGHTS, rest=45)
    return mixed.select("doc_id", "source", "stream", *RESULT[1:])
