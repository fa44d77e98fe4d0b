import math
from fractions import Fraction

import pytest

from tallybook.llm.mixing import REST, mix, pfair_pattern, phases


def simulate(blocks, units):
    """Slot by slot: the released block with the earliest deadline, and each stream within a block of its share."""
    done, order = dict.fromkeys(blocks, 0), []
    while any(done[s] < blocks[s] for s in blocks):
        alive = {s: units[s] for s in blocks if done[s] < blocks[s]}
        total, used, t = sum(alive.values()), dict.fromkeys(alive, 0), 0
        while all(done[s] < blocks[s] for s in alive):
            released = [s for s in alive if used[s] * total // alive[s] <= t]
            chosen = min(released, key=lambda s: (math.ceil(Fraction((used[s] + 1) * total, alive[s])), s))
            order.append((chosen, done[chosen]))
            used[chosen] += 1
            done[chosen] += 1
            t += 1
            assert all(abs(Fraction(t * alive[s], total) - used[s]) < 1 for s in alive)
    return order


def test_pattern_keeps_every_deadline():
    units = {"a": 7, "b": 3, "c": 1, "d": 5}
    total = sum(units.values())
    for name, slots in pfair_pattern(units).items():
        for i, slot in enumerate(slots):
            assert i * total // units[name] <= slot < -(-(i + 1) * total // units[name])


def test_mix_matches_a_slot_by_slot_run(docs):
    source = {i: "x" if i % 3 else ("y" if i % 2 else None) for i in range(200)}
    mixed = mix(docs([(i, f"t{i}") for i in range(200)], source), {"x": 2, "y": 5, "gone": 9}, rest=3, block_rows=4, rows_per_bucket=17)
    rows = sorted(mixed.collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(200))
    counts = {s: sum(r.stream == s for r in rows) for s in ("x", "y", REST)}
    got = list(dict.fromkeys((r.stream, r.block) for r in rows))
    assert got == simulate({s: math.ceil(n / 4) for s, n in counts.items()}, {"x": 2, "y": 5, REST: 3})
    assert all(r.release <= r.slot < r.deadline for r in rows)


def test_odd_rows_and_empty_table(docs, odd_texts):
    table = docs(odd_texts).unionByName(docs([(None, "x")]))
    out = mix(table.withColumnRenamed("lang", "slot"), {"a": 1}, rest=0)
    assert sorted(r.position for r in out.collect()) == list(range(len(odd_texts) + 1))
    assert mix(docs([]), {"a": 1}).count() == 0
    with pytest.raises(ValueError):
        mix(docs([]), {"a": 10**9})


def test_streams_without_weight_come_last():
    plan = phases({"a": 2, REST: 3}, {"a": 1, REST: 0})
    assert [p["start"] for p in plan] == [0, 2]


def test_rows_without_ids_spread_over_buckets(docs):
    from pyspark.sql import functions as F

    from tallybook.llm.common import bucket_of

    mixed = mix(docs([(None, f"text {i}") for i in range(2000)]), {"a": 1}, rows_per_bucket=50)
    at = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 33)
    assert mixed.count() == 2000 and mixed.select(bucket_of(at, 40)).distinct().count() == 40
    order = [r.text for r in mixed.orderBy("position").collect()]
    again = mix(docs([(None, f"text {i}") for i in reversed(range(2000))]), {"a": 1}, rows_per_bucket=50)
    assert order == [r.text for r in again.orderBy("position").collect()]
