import random
import re

import pytest

from tallybook.llm.decontaminate import clean_documents, contamination

FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(docs, items, size):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + size]), set()).add("null" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        out.append((i or -1, len(w), len(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("size", [10, 3])
def test_against_brute_force(docs, frame, odd_texts, size):
    rng = random.Random(2)
    vocabulary = ["the", "of", "and", *(f"w{i}" for i in range(60))]
    passage = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, passage(rng.randint(1, 30))) for i in range(12)] + [(3, None), (4, ""), (None, "Lone ITEM, here"), (5, "the the the the the the the the the the the the")]
    rows = list(odd_texts)
    for i in range(80):
        text = passage(rng.randint(0, 40))
        if i % 3 == 0:
            text += " " + rng.choice(items[:12])[1].upper().replace(" ", ", ") + " " + passage(5)
        rows.append((100 + i, text))
    rows += [(None, items[0][1]), (900, "a lone item here"), (901, " ".join(["the"] * 40)), (901, " ".join(["the"] * 40))]
    table = docs(rows).withColumnRenamed("lang", "word").withColumnRenamed("source", "item")
    bench = frame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as window")
    got = contamination(table, bench, size)
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r.items) for r in got.collect()) == brute(rows, items, size)
    clean = clean_documents(table, bench, size)
    assert clean.columns == table.columns
    assert sorted(r.doc_id or -1 for r in clean.collect()) == [i for i, _, n, _ in brute(rows, items, size) if not n]


def test_spans(docs, frame):
    row = contamination(docs([(1, "x a b c d y b c d e")]), frame([(1, "a b c d e")], "item_id long, text string"), 3).first()
    assert [tuple(s) for s in row.hits] == [(1, 5), (6, 10)] and row.n_hit == 8


def test_empty_sides(docs, frame):
    none = frame([], "item_id long, text string")
    assert contamination(docs([]), frame([(1, "a b")], "item_id long, text string")).count() == 0
    assert [r.n_hit for r in contamination(docs([(1, "a b")]), none).collect()] == [0]


def test_ids_keep_their_type(spark, frame):
    passage = " ".join(f"word{chr(97 + i)}" for i in range(12))
    names = frame([("a-1", passage), ("b", "nothing here"), (None, passage)], "doc_id string, text string")
    items = frame([("x", passage)], "item_id string, text string")
    found = contamination(names, items)
    assert dict(found.dtypes)["doc_id"] == "string"
    assert sorted(((r.doc_id or "", r.n_hit) for r in found.collect())) == [("", 12), ("a-1", 12), ("b", 0)]
    assert [r.doc_id for r in clean_documents(names, items).collect()] == ["b"]
