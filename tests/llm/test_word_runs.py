import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.llm.word_runs import analyse, lyndon_array, op11_word_runs, planted, runs_of, word_runs


def brute_runs(words):
    """Every stretch and period by comparison; a stretch counts for its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1) if j > i else i + 1
    runs = [(s, e - s, q) for (s, e), q in found.items()]
    # A stretch may also lie inside a longer one of a smaller period.
    return sorted((s, n_, q) for s, n_, q in runs if not any(q % r == 0 and r < q and a <= s and s + n_ <= a + b for a, b, r in runs))


def brute_lyndon(t):
    n = len(t)
    return [next(j for j in range(i + 1, n + 1) if j == n or t[j:] < t[i:]) - i for i in range(n)]


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_lyndon_arrays_of_both_orders(letters):
    rnd = random.Random(letters)
    for _ in range(200):
        t = [rnd.randrange(letters) for _ in range(rnd.randrange(1, 40))]
        assert lyndon_array(t) == brute_lyndon(t)
        turned = [-x for x in t]
        assert lyndon_array(turned) == brute_lyndon(turned)


def periodic(rnd):
    t = []
    while len(t) < 60:
        root = [rnd.randrange(4) for _ in range(rnd.randrange(1, 7))]
        t += (root * 8)[: rnd.randrange(1, 8 * len(root) + 1)]
    return t


def test_runs_equal_brute_force():
    rnd = random.Random(7)
    texts = [[rnd.randrange(k) for _ in range(rnd.randrange(0, 50))] for k in (1, 2, 3) for _ in range(150)]
    texts += [periodic(rnd) for _ in range(400)]
    # Periodic stretches between words of their own, as in prose.
    texts += [[100 + i if rnd.random() < 0.05 else w for i, w in enumerate(periodic(rnd))] for _ in range(200)]
    for t in texts:
        assert runs_of(np.array(t, dtype=np.int64)) == brute_runs(t), t


def test_long_texts_stay_fast():
    for q in (1, 2, 977):
        runs = runs_of(np.arange(40_000, dtype=np.int64) % q)
        assert runs == [(0, 40_000, q)]


def test_collapsed_keeps_the_first_period():
    runs, text = analyse(b"x a b a b a b a b y".split())
    assert runs == [(1, 8, 2)] and text == b"x a b y"


def test_planting():
    n_planted = 0
    for doc_id in range(200):
        words = [f"w{i}".encode() for i in range(50)]
        got, h = planted(doc_id, words), zlib.crc32(str(doc_id).encode())
        if h % 10:
            assert got == words
            continue
        n_planted += 1
        g, n = h // 10, 50
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert got == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    assert n_planted
    assert planted(None, [b"a"]) == [b"a"] and planted(7, []) == []


def test_odd_rows(docs, odd_texts):
    frame = docs([*odd_texts, (None, "a a a a a a b")]).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("c"))
    got = sorted(word_runs(frame, planted).collect(), key=str)
    want = sorted(((i, *analyse(planted(i, (t or "").encode().split()))) for i, t in [*odd_texts, (None, "a a a a a a b")]), key=str)
    assert [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed.encode()) for r in got] == want
    assert word_runs(docs([])).count() == 0


def test_query_on_a_small_table(spark, docs, tmp_path):
    rnd = random.Random(3)
    pairs = [(i, " ".join(f"w{x}" for x in periodic(rnd))) for i in range(80)] + [(90, None), (91, "short text")]
    docs(pairs).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op11_word_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(pairs)
    for i, t in pairs:
        words = planted(i, (t or "").encode().split())
        runs = brute_runs(words)
        top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        r = got[i]
        assert (r.n_runs, (r.start, r.length, r.period)) == (len(runs), top or (None, None, None))
        assert r.exponent_milli == (1000 * top[1] // top[2] if top else None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        drop = {k for s, n, q in runs for k in range(s + q, s + n)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in drop)
        assert r.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
