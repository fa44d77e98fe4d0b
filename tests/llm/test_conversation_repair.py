import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallybook.llm import conversation_repair, turn_grammar
from tallybook.llm.conversation_repair import damaged, op12_turn_repair, repair_report, repaired_turns

KIND = "conv_id long, turn long, role string, text string"
PATTERN = re.compile("(s?(ua)+)?")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        last = WORD.findall(text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "cut")
        seen.add((role, text))
    return out


def brute_repair(turns):
    """Dijkstra over (turns done, role initials given), all edits; the first whole pattern is the answer."""
    kinds = faults(turns)
    queue = [(0, "", 0, (), "")]
    done = set()
    while queue:
        cost, audit, i, out, roles = heapq.heappop(queue)
        if (i, roles) in done:
            continue
        done.add((i, roles))
        if i == len(turns) and PATTERN.fullmatch(roles):
            return cost, audit, list(out)

        def go(letter, price, nxt, *turn):
            new = roles + "".join(r[:1] for r, _ in turn)
            # Only prefixes of the pattern can be completed.
            if re.fullmatch("s?(ua)*u?", new) and len(new) <= 2 * len(turns) + 2:
                heapq.heappush(queue, (cost + price, audit + letter, nxt, out + turn, new))

        for role in ("user", "assistant"):
            go("I", 2, i, (role, ""))
        if i < len(turns):
            (role, text), kind = turns[i], kinds[i]
            go("D", 3, i + 1)
            if kind in ("", "cut"):
                if role:  # a row without an initial cannot stay as it is
                    go("K", kind == "cut", i + 1, (role, text))
                for new in ("user", "assistant"):
                    go("R", 2 + (kind == "cut"), i + 1, (new, text))


def brute_report(rows, ids):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).digest(), text, turn))
    out = {}
    for conv in ids:
        ordered = sorted(groups.get(conv, []), key=lambda r: (r[0], r[1], r[2].encode(), r[3]))
        turns = [(r[2], r[4]) for r in ordered]
        kinds = faults(turns)
        known = [r[5] for r in ordered if r[5] is not None]
        cost, audit, left = brute_repair(turns)
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0,
            kinds.count("blank"), kinds.count("duplicate"), kinds.count("cut"),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest(),
        )
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def table_of(rnd, conversations, most):
    rows = []
    for conv in range(conversations):
        for turn in range(rnd.randrange(1, most)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["Yes.", "No", "Why? ", "Well!\n", "a. b", " ", "", None, "é.", "done.\t x"])
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 1, None]), role, text))
    return rows


def got(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def spaced(rows):
    return [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]


@pytest.mark.parametrize("block", [2048, 3])
def test_report_equals_search_over_all_edits(spark, frame, monkeypatch, block):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    rows = table_of(random.Random(block), 150, 9)
    ids = {c for c, *_ in rows}
    assert got(repair_report(frame(rows, KIND))) == brute_report(spaced(rows), ids)
    hurt = damaged(frame(rows, KIND))
    assert sorted(map(tuple, hurt.collect()), key=str) == sorted(brute_damage(rows), key=str)
    assert got(repair_report(hurt, frame(rows, KIND))) == brute_report(brute_damage(rows), ids)


def test_turns_are_those_of_the_digest(spark, frame, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK", 4)
    rows = frame(table_of(random.Random(1), 60, 12), KIND)
    turns = defaultdict(list)
    for r in repaired_turns(rows).orderBy("conv_id", "position").collect():
        turns[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, values in got(repair_report(rows)).items():
        assert hashlib.sha256("\n".join(turns[conv]).encode()).hexdigest() == values[-1]


def test_query_odd_rows_and_columns(spark, frame, tmp_path):
    rows = [
        (None, None, None, None), (None, 1, "user", "x"), (1, None, "assistant", "y."), (1, None, "assistant", "y."),
        (2, 5, "system", "s."), (2, 5, "system", "s."), (3, 7, "user", "long. " * 50_000), (4, 1, "", ""),
    ]
    rows += [(10 + i, 0, "user", "gone or not.") for i in range(60)]
    frame(rows, KIND).withColumn("audit", F.lit("clash")).withColumn("digest", F.lit(1)).write.parquet(str(tmp_path / "conversations.parquet"))
    want = brute_report(brute_damage(rows), {c for c, *_ in rows})
    assert got(op12_turn_repair(spark, str(tmp_path))) == want
    empty = hashlib.sha256(b"").hexdigest()
    assert any(v == (0, 0, 0, 0, 0, 0, "", empty) for v in want.values())


def test_empty_table(frame):
    assert repair_report(frame([], KIND)).count() == 0
    assert repaired_turns(frame([], KIND)).count() == 0


def test_large_conversation_of_many_blocks(frame, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK", 16)
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"turn {i}." if i % 11 else "cut") for i in range(3000)]
    ((gaps, blank, duplicate, cut, illegal, cost, audit, _),) = got(repair_report(frame(rows, KIND))).values()
    assert (gaps, blank, cut, illegal) == (0, 0, 2, 0) and duplicate == len(range(0, 3000, 11)) - 2
    assert audit.count("D") == duplicate and cost >= 3 * duplicate + 2


def test_rules_share_no_symbol_and_change_nothing():
    rnd = random.Random(4)
    plain = turn_grammar.Grammar()
    texts = ["".join(rnd.choice(turn_grammar.TERMINALS) for _ in range(rnd.randrange(1, 30))) for _ in range(60)] + ["uauauaua" * 8]

    def count_pairs(rules):
        counts = defaultdict(int)
        for t in texts:
            t = turn_grammar.Grammar(rules).compressed(t)
            for pair in re.findall("(?=(..))", t):
                counts[pair] += 1
        return list(counts.items())

    grammar = turn_grammar.re_pair(count_pairs, 40, 8)
    assert 8 < len(grammar.rules) <= 40 and len({s for s, _ in grammar.rules}) == len(grammar.rules)
    for t in texts:
        assert len(grammar.compressed(t)) <= len(t)
        a, b = plain.matrix(t), grammar.matrix(t)
        assert [[(c, turn_grammar.flat(r)) for c, r in row] for row in a] == [[(c, turn_grammar.flat(r)) for c, r in row] for row in b]
    assert len(grammar.compressed("uauauaua" * 8)) < 20
