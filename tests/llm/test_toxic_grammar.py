import random
import re
import zlib

from pyspark.sql import functions as F

from tallybook.llm.toxic_grammar import INSULT, LABELS, NEGATION, PRIOR, REPORT, SEEDS, TARGET, THREAT, ToxicModel, _sample, fit, held_out, with_toxicity, without_toxic


def labels_of(text):
    found, _ = ToxicModel({}, PRIOR).labels(text)
    return [(LABELS[k], text[a:b]) for k, _, a, b in found]


def test_grammar_reads_clauses():
    assert labels_of("You are an idiot.") == [("insult+target", "idiot")]
    assert labels_of("not an Idiot at all") == [("insult+negated", "Idiot")]
    assert labels_of("he said idiot, idiot") == [("insult+target+reported", "idiot"), ("insult", "idiot")]
    assert labels_of("we will hurt you") == [("threat+target", "hurt")]
    assert labels_of("never one two three four five moron") == [("insult", "moron")]
    assert labels_of("a calm text about nothing. Not you!") == [] == labels_of(None) == labels_of("")


def corpus(seed, n):
    rng = random.Random(seed)
    made = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(600)]
    rows = []
    for i in range(n):
        words, toxic = rng.choices(made, k=rng.randint(5, 120)), int(rng.random() < 0.15)
        if toxic:
            for _ in range(rng.randint(1, 5)):
                words.insert(rng.randint(0, len(words)), rng.choice(["scum", "zwixq" + rng.choice(made), "vraxz" + rng.choice(made)]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy(docs, frame):
    rows = corpus(3, 1500)
    table = docs([(i, t) for i, t, _ in rows]).withColumnRenamed("lang", "toxicity")
    labels = frame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    scored = {r.doc_id: r for r in with_toxicity(table, fit(table, labels)).select("*", held_out(F.col("doc_id")).alias("out")).collect()}
    out = [(i, y) for i, _, y in rows if scored[i].out]
    assert {i for i, _ in out} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum((scored[i].toxicity >= 0.7) == bool(y) for i, y in out) / len(out) > 0.98
    kept = without_toxic(docs([(i, t) for i, t, _ in rows]), labels)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 1200 < kept.count() < 1320


def test_no_labels_and_odd_rows(docs, frame, odd_texts):
    nothing = frame([], "doc_id long, quality int, toxic int")
    model = fit(docs(odd_texts), nothing)
    rows = with_toxicity(docs([*odd_texts, (None, "you idiot")]), model).collect()
    assert len(rows) == len(odd_texts) + 1
    assert all((r.toxicity >= 0.7) == (r.doc_id is None) for r in rows)
    assert with_toxicity(docs([]), model).count() == 0


def test_the_fit_repeats(docs, frame):
    rows = corpus(5, 300)
    labels = frame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    a, b = (fit(docs([(i, t) for i, t, _ in rows]).repartition(n), labels) for n in (2, 7))
    assert a.lexicon == b.lexicon and a.weights == b.weights


def naive_labels(text):
    """Clause by clause: each hit looks at the words around it."""
    kinds = {w: k for k, words in ((1, SEEDS[INSULT]), (3, SEEDS[THREAT]), (4, SEEDS[TARGET]), (5, SEEDS[NEGATION]), (6, SEEDS[REPORT])) for w in words.split()}
    for kind in (INSULT, THREAT, TARGET, NEGATION, REPORT):  # the first kind that lists a word has it
        for w in SEEDS[kind].split():
            kinds[w] = min(kinds[w], kind)
    out = []
    for clause in re.split(r"[.!?;:,\n]+", text.lower()):
        words = re.findall(r"[^\W\d_]+", clause)
        symbols = [kinds.get(w, 0) for w in words]
        for i, s in enumerate(symbols):
            if s in (INSULT, THREAT):
                target = TARGET in symbols[max(0, i - 4):i] or TARGET in symbols[i + 1:]
                negated, reported = NEGATION in symbols[max(0, i - 3):i], REPORT in symbols[:i]
                name = "insult" if s == INSULT else "threat"
                out.append((name + "+target" * target + "+negated" * negated + "+reported" * reported, words[i]))
    return out


def test_product_machine_equals_a_naive_clause_reader():
    rng = random.Random(12)
    some = ["idiot", "scum", "kill", "hurt", "you", "they", "not", "never", "said", "calls", "plain", "words", "of", "no", "use", "table"]
    for _ in range(3000):
        text = "".join(rng.choice(some) + rng.choice([" "] * 8 + [". ", ", ", "\n", "! ", " 12 "]) for _ in range(rng.randint(0, 25)))
        assert labels_of(text) == naive_labels(text), text


def test_the_fit_takes_no_more_rows_than_its_bound(docs, frame):
    rows = [(1, f"text number {i} idiot") for i in range(500)] + [(i, f"other {i}") for i in range(2, 40)]
    labels = frame([(i, 1, i % 2) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    assert _sample(docs(rows), labels, 3).count() <= 3
    assert sorted(map(tuple, _sample(docs(rows), labels, 30).collect())) == sorted(map(tuple, _sample(docs(rows[::-1]), labels, 30).collect()))
    scored = with_toxicity(docs(rows), fit(docs(rows), labels, fit_rows=5))
    assert scored.count() == len(rows)
