import re
from collections import Counter

from pyspark.sql import functions as F

from tallybook.llm.line_frequency import filtered, judged, line_hashes, normalised_line

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def norm(line):
    return " ".join(WORD.findall(line.translate(FOLD)))


def brute(rows, percent=2, least=5, share=0.7):
    seen, sizes = Counter(), Counter()
    for host, text in {(h, t or "") for _, h, t in rows}:
        sizes[host] += 1
        seen.update({(host, norm(line)) for line in text.split("\n") if norm(line)})
    out = []
    for i, host, text in rows:
        text = text or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if norm(x)]
        windows = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
        covered = {j for k in range(len(words) - 4) if windows[tuple(words[k:k + 5])] > 1 for j in range(k, k + 5)}
        left = sum(len(norm(x).split(" ")) for x in lines if seen[host, norm(x)] < least or 100 * seen[host, norm(x)] < percent * sizes[host])
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        out.append((i or -1, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
                    len(covered), failed, not failed and left > 0 and left >= share * len(words)))
    return sorted(out)


def test_against_brute_force(frame, odd_texts):
    body = " ".join(f"w{i}" for i in range(30))
    rows = [(i, "h", t) for i, t in odd_texts]
    rows += [(100 + i, "h" if i % 2 else None, f"Shared  LINE of every page here to remove it\n{body} own{i} #$") for i in range(12)]
    rows += [(200 + i, "h", f"shared line of every page here to remove it\n\nx{i} y") for i in range(3)]
    rows += [(300, "h", "a b c d e f a b c d e g " + body), (301, "g", "é 👍 à b c d e f g h\n\n x|y"), (None, "h", body), (300, "h", body + "\n" + body)]
    table = frame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as kept", "2 as lines", "3 as n_words")
    got = judged(table).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted((r[0] or -1, *r[1:]) for r in got.collect()) == brute(rows)
    kept = filtered(table.drop("kept", "lines", "n_words"))
    assert kept.columns == ["doc_id", "source", "text"]
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[101] == f"{body} own1 #$" and 200 not in texts


def test_copies_count_once(frame):
    text = "\n".join(" ".join(f"w{i}x{k}" for k in range(9)) for i in range(3))
    rows = [(i, "h", text) for i in range(50)]
    assert judged(frame(rows, "doc_id long, source string, text string")).where("kept").count() == 50


def test_empty(frame):
    assert judged(frame([], "doc_id long, source string, text string")).count() == 0


def test_a_host_of_thirty_documents_loses_its_lines(frame):
    """The limit is a share of the host: the same line is common on one host and rare on another."""
    menu = "home about contact imprint privacy terms search login"
    own = [" ".join(f"w{i}x{k}" for k in range(12)) for i in range(600)]
    rows = [(i, "small", f"{menu}\n{own[i]}" if i < 6 else own[i]) for i in range(30)]
    rows += [(100 + i, "large", f"{menu}\n{own[30 + i]}" if i < 6 else own[30 + i]) for i in range(400)]
    rows += [(901 + i, "small", f"{menu}\n{own[500 + i]} {own[550 + i]}\n{own[450 + i]}") for i in range(2)]
    table = frame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in judged(table).collect()}
    assert all(len(got[i].removed) == 1 for i in (*range(6), 901, 902))
    assert not any(got[i].removed for i in [*range(6, 30), *range(100, 500)])
    rejected = {i for i, r in got.items() if not r.kept}
    assert rejected == {*range(6)} and not any(got[i].base_failed for i in rejected)
    cleaned = {r.doc_id: r.text for r in filtered(table).collect()}
    assert cleaned[901] == f"{own[500]} {own[550]}\n{own[450]}"
    assert sorted((r[0] or -1, *r[1:]) for r in judged(table).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()) == brute(rows)


def test_query_decides_on_the_given_table(spark):
    from tallybook.llm.line_frequency import op6_line_frequency

    rows = op6_line_frequency(spark, "/root/testdata/sf0.01").collect()
    assert sum(not r.kept and not r.base_failed for r in rows) > 0


def test_line_hashes_are_those_of_normalised_lines(spark, frame):
    text = "  A  b\tC \n\n \r\x0b\n\u00c9t\u00c9 AB  x\r\none\n\tD\x0ce\u00a0F\x0b "
    lines = [x for x in text.split("\n") if norm(x)]
    want = frame([(x,) for x in lines], "line string").select(F.xxhash64(normalised_line(F.col("line")))).collect()
    got = frame([(text,)], "text string").select(line_hashes(F.col("text")).alias("found")).first().found
    assert [(x.h, x.words) for x in got] == [(r[0], len(norm(x).split(" "))) for r, x in zip(want, lines, strict=True)]
    plan = frame([(text,)], "text string").select(line_hashes(F.col("text")).alias("found"))._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan
