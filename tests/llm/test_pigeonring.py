import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tallybook.llm.components import components
from tallybook.llm.pigeonring import chain_keys, fingerprint, fingerprint_links, near, near_duplicates, without_near_duplicates

FOLD = {c: c + 32 for c in range(65, 91)}


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_classes(prints, limit=3):
    parent = {p: p for p in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(prints)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= limit:
                parent[top(a)] = top(b)
    return {p: top(p) for p in prints}


def signed(x):
    return x - 2**64 if x >> 63 else x


def test_fingerprints(odd_texts):
    for _, text in [*odd_texts, (0, "Ünïcode WORDS a b c d d d"), (0, "x y")]:
        assert fingerprint(text.encode() if text is not None else None) == signed(brute_fingerprint(text))


def test_links_lose_nothing(frame):
    """Chains, balls around a centre and chance neighbours give the classes of all pairs."""
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(120):
            x = centre
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    walk = rng.getrandbits(64)
    for _ in range(60):
        for _ in range(3):
            walk ^= 1 << rng.randrange(64)
        prints.add(walk)
    rows = frame([(signed(p), rng.randint(1, 5)) for p in prints], "fp long, docs long")
    parts = {r.node: r.component for r in components(fingerprint_links(rows)).collect()}
    want = brute_classes({signed(p) for p in prints})
    by_want, by_got = {}, {}
    for p in want:
        by_want.setdefault(want[p], set()).add(p)
        by_got.setdefault(parts.get(p, p), set()).add(p)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))


def test_every_near_pair_shares_a_key_and_holds_its_chain(frame):
    rng, pairs = random.Random(1), []
    for _ in range(2000):
        a = b = rng.getrandbits(64)
        for _ in range(rng.randint(0, 3)):
            b ^= 1 << rng.randrange(64)
        pairs.append((signed(a), signed(b)))
    rows = frame(pairs, "a long, b long")
    shared = rows.select("a", "b", F.explode(F.array_intersect(chain_keys(F.col("a")), chain_keys(F.col("b")))).alias("key"))
    assert shared.where(near(F.col("key"), F.col("a"), F.col("b"))).select("a", "b").distinct().count() == len(set(pairs))


def test_documents(docs, odd_texts):
    base = " ".join(f"token{i}" for i in range(400))
    pairs = [*odd_texts, (20, base), (21, base + " end"), (22, base.upper()), (None, base), (30, "quite another text of its own")]
    table = docs(pairs).withColumnRenamed("lang", "component_id")
    rows = near_duplicates(table).collect()
    want = brute_classes({signed(brute_fingerprint(t)) for _, t in pairs})
    least = {}
    for i, t in pairs:
        c = want[signed(brute_fingerprint(t))]
        least[c] = min(x for x in (least.get(c), i) if x is not None) if i is not None or c in least else least.get(c)
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in rows)
    assert got == sorted((i or -1, signed(brute_fingerprint(t)), least[want[signed(brute_fingerprint(t))]]) for i, t in pairs)
    kept = without_near_duplicates(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert near_duplicates(docs([])).count() == 0 and without_near_duplicates(docs([])).count() == 0


def test_bits_of_a_byte():
    assert np.unpackbits(np.array([0x81], dtype=np.uint8)).tolist() == [1, 0, 0, 0, 0, 0, 0, 1]


def test_pairs_in_reach_share_an_open_segment(spark):
    from tallybook.llm.pigeonring import rest_segments

    rnd, pairs = random.Random(8), []
    for _ in range(300):
        a = rnd.getrandbits(64)
        flips = sum(1 << b for b in rnd.sample(range(64), 3))
        pairs.append((signed(a), signed(a ^ flips)))
    frame = spark.createDataFrame(pairs, "a long, b long")
    frame = frame.withColumn("key", F.explode(F.array_intersect(chain_keys(F.col("a")), chain_keys(F.col("b")))))
    shared = F.array_intersect(rest_segments(F.col("key"), F.col("a")), rest_segments(F.col("key"), F.col("b")))
    rows = frame.select("key", "a", "b", F.size(shared).alias("n")).collect()
    assert {(r.a, r.b) for r in rows} == set(pairs) and all(r.n >= 1 for r in rows)
    wide = spark.createDataFrame([(0x0102030405060708,)], "v long")
    # Key of start 1 that leaves segment 4 (the third of the chain) open: it and the last three of the ring stay.
    got = wide.select(rest_segments(F.lit(1 * 3 + 0).cast("long"), F.col("v")).alias("x")).first().x
    assert got == [0x04 * 4, 0x07 * 4 + 1, 0x08 * 4 + 2, 0x01 * 4 + 3]


def test_many_apart_in_one_key(spark):
    """Fingerprints of one passage: equal in four segments, most of them unlinked."""
    rnd = random.Random(9)
    base = rnd.getrandbits(64) & ~0xFFFFFFFF
    prints = {base | rnd.getrandbits(32) for _ in range(400)}
    prints |= {p ^ (1 << rnd.randrange(32)) for p in list(prints)[:50]}
    frame = spark.createDataFrame([(signed(p), 1) for p in prints], "fp long, docs long")
    linked = {r.node & (2**64 - 1): r.component for r in components(fingerprint_links(frame)).collect()}
    want = brute_classes(prints)
    groups = {}
    for p in prints:
        groups.setdefault(want[p], set()).add(linked.get(p, ("alone", p)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
