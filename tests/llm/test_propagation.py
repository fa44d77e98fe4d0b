import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallybook.llm.propagation import OWN, SHARED, _choice, _hub_sums, _seated, _votes, cut_links, cut_weight, shared_lines, shards


def check(rows, n, total):
    counts = Counter(r.shard for r in rows)
    assert sum(counts.values()) == len(rows) == total
    sizes = [counts.get(s, 0) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(n):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def cut(rows):
    places = {}
    for r in rows:
        places.setdefault(r.unit, set()).add(r.shard)
    return Counter(len(p) for p in places.values())


def test_copies_meet_and_counts_stay_even(docs):
    pairs = [(i, f"text {i % 90}" if i < 300 else f"single {i}") for i in range(700)]
    rows = shards(docs(pairs), 8, rows_per_bucket=50).collect()
    check(rows, 8, 700)
    assert set(cut(rows)) == {1}
    for r in rows:
        text = dict(pairs)[r.doc_id].encode()
        assert r.size == len(text) + 8 and r.text_crc32 == zlib.crc32(text)


def test_a_third_in_one_group_fills_whole_shards(docs):
    pairs = [(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(600)]
    rows = shards(docs(pairs), 12, rows_per_bucket=40).collect()
    check(rows, 12, 600)
    # Every row is in a group, so no shard has slack: few groups may be cut, and the hot one
    # takes little more than the four shards that it fills.
    hot = {r.shard for r in rows if pairs[r.doc_id][1] == "hot"}
    assert 4 <= len(hot) <= 7
    assert sum(n for parts, n in cut(rows).items() if parts > 1) <= 40


def test_links_pull_units_together(docs, frame):
    pairs = [(i, f"t{i}") for i in range(400)]
    links = [(4 * k, 4 * k + j, 1) for k in range(50) for j in (1, 2, 3)] + [(1, 9999, 1), (None, 2, 1), (5, 5, 1)]
    rows = shards(docs(pairs), 4, links=frame(links, "doc_id long, linked_id long, weight int")).collect()
    check(rows, 4, 400)
    at = {r.doc_id: r.shard for r in rows}
    assert sum(at[4 * k] == at[4 * k + j] for k in range(50) for j in (1, 2, 3)) > 75  # 37 by chance


def test_cut_links_weigh_links_between_shards(frame):
    cells = frame([(1, 0, 3), (1, 1, 1), (2, 0, 1), (3, 1, 2)], "unit long, shard int, n long")
    links = frame([(1, 2, 5), (2, 1, 5), (1, 3, 2), (3, 1, 2)], "unit long, other long, weight int")
    assert cut_links(cells, links) == 2 * 2 * OWN


def test_odd_rows(docs, odd_texts):
    table = docs([*odd_texts, (None, "x"), (None, None)]).withColumnRenamed("lang", "shard")
    rows = shards(table, 3, carry=["source", "shard"]).collect()
    check(rows, 3, len(odd_texts) + 2)
    assert shards(docs([]), 3).count() == 0


def test_slots_follow_a_given_order(docs):
    rows = shards(docs([(i, f"t{i % 20}") for i in range(100)]).selectExpr("*", "doc_id div 30 as part"), 4, carry=["part"], order=["part", "_id"]).collect()
    check(rows, 4, 100)
    for s in range(4):
        parts = [r.part for r in sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)]
        assert parts == sorted(parts)


def lines_of(text):
    folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
    found = (" ".join(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in folded.split("\n"))
    return {x for x in found if x.count(" ") >= 4}


def brute_votes(cells, texts, n_shards):
    """Votes by pairs: every unit asks each unit that shares a line with it."""
    holders = defaultdict(set)
    for unit, text in texts.items():
        for line in lines_of(text):
            holders[line].add(unit)
    votes = defaultdict(int)
    for unit, shard, n in cells:
        votes[unit, shard] += OWN * n
    for units in holders.values():
        if len(units) > 1:
            weight = max(1, SHARED // len(units))
            for unit in units:
                for other, shard, n in cells:
                    if other in units:
                        votes[unit, shard] += weight * n
    return {k: v for k, v in votes.items() if v}


def linked_pairs(seed, n):
    rnd = random.Random(seed)
    shared = [f"Line {i} that some documents share with others" for i in range(n // 6)]
    pairs = []
    for i in range(n):
        own = f"only document {i} has these words here"
        lines = [own, *([shared[i // 6]] if i % 3 else []), *(["every third page has this line as well"] if i % 3 == 0 else []), "short line"]
        rnd.shuffle(lines)
        pairs.append((i, "\n".join(lines)))
    return pairs


def test_votes_of_shared_lines_equal_those_of_all_pairs(spark, docs):
    pairs = linked_pairs(1, 60)
    members = shared_lines(docs([*pairs, *pairs[:5]]))
    key = {text: row.unit for text in dict(pairs).values() for row in [spark.range(1).select(F.md5(F.lit(text)).alias("unit")).first()]}
    rnd = random.Random(2)
    cells = [(key[text], shard, rnd.randrange(1, 4)) for _, text in pairs for shard in rnd.sample(range(4), rnd.randrange(1, 3))]
    frame = spark.createDataFrame(cells, "unit string, shard int, n long")
    sums = _hub_sums(frame, members)
    got = {(r.unit, r.shard): r.votes for r in _votes(frame, None, members, sums, members.count()).collect() if r.votes}
    assert got == brute_votes(cells, {key[t]: t for _, t in pairs}, 4)
    assert cut_weight(sums) > 0


def test_shared_lines_bring_documents_together(docs):
    pairs = linked_pairs(3, 600)
    table = docs(pairs)
    alone, linked = (shards(table, 6, by_lines=by, rows_per_bucket=60).collect() for by in (False, True))
    members = shared_lines(table)

    def weight(rows):
        check(rows, 6, 600)
        cells = table.sparkSession.createDataFrame([(r.unit, r.shard, 1) for r in rows], "unit string, shard int, n long")
        return cut_weight(_hub_sums(cells, members))

    assert weight(linked) < 0.7 * weight(alone)


def test_a_large_unit_fills_whole_shards(spark):
    cells = spark.createDataFrame([(1, s, 30) for s in range(4)] + [(2, s, 5) for s in range(4)], "unit long, shard int, n long")
    rows = _seated(cells, dict.fromkeys(range(4), 40)).collect()
    assert sorted(r.n for r in rows if r.unit == 1) == [40, 40, 40]
    assert {r.shard for r in rows if r.unit == 1}.isdisjoint(r.shard for r in rows if r.unit == 2)
    assert sum(r.n for r in rows if r.unit == 2) == 20


def test_choice_works_its_key_out_once(spark):
    rows = spark.range(30).select(F.col("id").cast("int").alias("key"))
    found = rows.select("key", _choice({i: 10 * i for i in range(24) if i != 7}, F.col("key")).alias("v"))
    assert {r.key: r.v for r in found.collect()} == {i: 10 * i if i < 24 and i != 7 else None for i in range(30)}
    assert "CASE" not in found._jdf.queryExecution().optimizedPlan().toString()
