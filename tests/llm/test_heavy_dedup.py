import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallybook.llm.heavy_dedup import exact_duplicates, frequent_items, without_duplicates

FOLD = {c: c + 32 for c in range(65, 91)}


def brute(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[(t or "").translate(FOLD)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, sha) for i in ids]
    return sorted(out, key=str)


def rows(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in df.collect()], key=str)


@pytest.mark.parametrize(("tracked", "winners"), [(4096, 1000), (16, 3)])
def test_equals_grouping_with_heavy_and_light_texts(docs, tracked, winners):
    rnd = random.Random(5)
    pairs = [(i, "A hot text" if i % 3 == 0 else rnd.choice(["Éa b", "éa b", "x", "X", None, ""]) if i % 7 == 0 else f"text {rnd.randrange(900)}")
             for i in range(3000)]
    assert rows(exact_duplicates(docs(pairs), tracked, winners)) == brute(pairs)


def test_odd_rows(docs, odd_texts):
    pairs = [*odd_texts, (None, "one"), (None, "lonely"), (None, "lonely")]
    assert rows(exact_duplicates(docs(pairs))) == brute(pairs)
    assert exact_duplicates(docs([])).count() == 0


def test_only_capitals_of_ascii_fold(docs):
    got = {r.doc_id: r.keep_id for r in exact_duplicates(docs([(1, "ABC É"), (2, "abc É"), (3, "abc é")])).collect()}
    assert got == {1: 2, 2: 2, 3: 3}


def test_one_row_of_each_group_stays(docs, odd_texts):
    frame = docs(odd_texts).withColumn("group_size", F.lit("clash")).withColumn("digest", F.lit(0))
    kept = without_duplicates(frame)
    assert kept.columns == frame.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in odd_texts})
    assert max(r.doc_id for r in kept.collect() if not r.text) == 2


def test_summary_names_each_frequent_digest(spark):
    many = spark.range(20_000).select(F.when(F.col("id") % 4 == 0, F.col("id") % 20).otherwise(F.col("id")).cast("string").cast("binary").alias("digest"))
    items = {r.item for r in frequent_items(many, 256, 100).collect()}
    hot = {r[0] for r in many.where("digest in (X'30', X'34', X'38', X'3132', X'3136')").select(F.xxhash64("digest")).distinct().collect()}
    assert hot <= items
