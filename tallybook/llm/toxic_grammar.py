"""Toxicity from clauses matched by a weighted finite-state grammar.

Words of a clause become symbols: insult, slur (a stem that ordinary words share), threat,
target, negation, report (of speech) or other. Six small transducers read the symbols side
by side, and their product is one transducer over (state, symbol): an insult, slur or
threat that it reads is given out with a label that says whether a target is near in the
clause, whether a negation stands before it, and whether the clause reports speech. So
"you are no idiot" and "he said idiot" give other labels than "you idiot". The score is
the logistic of the labels' weights over all matched clauses, against the matches that a
harmless text of that length would have.

What is learned, from labelled rows that are not held out: the lexicon of insults and
slurs (words and stems whose share of toxic documents is above the base rate by a
likelihood test that allows for the number of candidates) and the weights. The fit takes at most `fit_rows`
rows, one for each id, the lowest by a hash of the id, so that what is sent to the tasks is bounded; every
row is scored.

Cases: null and empty texts match nothing and get the base score; labels that are null
are left out, of repeated labels the larger holds; without toxic labels the seed words
and the prior weights stand; repeated rows and rows without id are scored like any other;
an empty table gives no rows; score columns replace columns of the same name.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import table

OTHER, INSULT, SLUR, THREAT, TARGET, NEGATION, REPORT, END = range(8)

#: Words known from the start, in four languages; insults grow by learning.
SEEDS = {
    INSULT: "idiot moron loser scum stupid pathetic worthless disgusting trash clown imbecile dumb "
            "idioten dummkopf abschaum arschloch imbécile salaud connard ordure imbécil estúpido basura escoria",
    THREAT: "kill hurt destroy beat murder burn stab shoot töten umbringen schlagen tuer détruire frapper matar destruir golpear",
    TARGET: "you your yours he she him her they them these those people du dich dein ihr euch sie er "
            "tu toi vous votre ils elles usted tú vosotros ellos ellas",
    NEGATION: "not no never nobody nicht kein keine nie pas jamais aucun nunca ningún ninguna jamás",
    REPORT: "said says say called calls wrote quoted told claims reported sagte schrieb nannte dit disait écrit appelé "
            "dijo llamó escribió",
}
LABELS = [f"{kind}{t}{n}{r}" for kind in ("insult", "slur", "threat") for t in ("", "+target") for n in ("", "+negated") for r in ("", "+reported")]
WORDS = re.compile(r"[^\W\d_]+")
PARTS = re.compile(r"[^\W\d_]+|[.!?;:,\n]+")
STEMS = range(3, 9)
#: Log odds from which a term is an insult; below, a slur.
STRONG = 4.0


class Machine:
    """A transducer whose next[state][symbol] is a state and out[state][symbol] an output."""

    def __init__(self, following: list[list[int]], out: list[list[tuple]]):
        self.next, self.out = following, out

    def __mul__(self, other: Machine) -> Machine:
        """Both read each symbol; the outputs join. States that cannot be reached are left out."""
        index, queue = {(0, 0): 0}, [(0, 0)]
        following, out = [], []
        for a, b in queue:
            row = []
            for symbol in range(END + 1):
                pair = (self.next[a][symbol], other.next[b][symbol])
                if pair not in index:
                    index[pair] = len(queue)
                    queue.append(pair)
                row.append(index[pair])
            following.append(row)
            out.append([self.out[a][s] + other.out[b][s] for s in range(END + 1)])
        return Machine(following, out)


def seen_within(symbol: int, reach: int | None) -> Machine:
    """Gives out 1 while `symbol` was read at most `reach` words ago in the clause (None: anywhere before)."""
    states = 2 if reach is None else reach + 1
    following, out = [], []
    for state in range(states):
        ahead = state if reach is None else max(0, state - 1)
        following.append([0 if s == END else states - 1 if s == symbol else ahead for s in range(END + 1)])
        out.append([(int(state > 0),)] * (END + 1))
    return Machine(following, out)


def reads(symbol: int) -> Machine:
    """Gives out 1 where the symbol itself is read."""
    return Machine([[0] * (END + 1)], [[(int(s == symbol),) for s in range(END + 1)]])


#: Outputs: insult, slur, threat, target near before, negation near before, report before.
GRAMMAR = reads(INSULT) * reads(SLUR) * reads(THREAT) * seen_within(TARGET, 4) * seen_within(NEGATION, 3) * seen_within(REPORT, None)


@dataclass
class ToxicModel:
    """Lexicon (term to surprise and log odds), weights of the features, slurs per harmless word."""

    lexicon: dict[str, tuple[float, float]]
    weights: list[float]
    slur_rate: float = 0.0
    known: dict[str, tuple[int, float]] = field(default_factory=dict, repr=False)

    def symbol(self, word: str) -> tuple[int, float]:
        """The word's symbol and strength: of its terms the one with the most evidence counts."""
        terms = [self.lexicon.get(word), *(self.lexicon.get(word[:n] + "*") for n in STEMS if n < len(word))]
        _, odds = max((t for t in terms if t), default=(0.0, 0.0))
        if odds:
            return (INSULT if odds >= STRONG else SLUR), odds
        return next((kind for kind, words in _SEED_SETS.items() if word in words), OTHER), STRONG

    def labels(self, text: str | None) -> tuple[list[tuple[int, float, int, int]], int]:
        """(label, strength, start, end) of matches, and the number of distinct words.

        A target behind the match in its clause counts too.
        """
        text = (text or "").lower()
        known, words = self.known, set(WORDS.findall(text))
        if len(known) > 300_000:
            known.clear()
        hot = False
        for word in words:
            found = known.get(word)
            if found is None:
                found = known[word] = self.symbol(word)
            hot = hot or INSULT <= found[0] <= THREAT
        if not hot:
            return [], len(words)
        state, matches, clause, following, out, end = 0, [], [], GRAMMAR.next, GRAMMAR.out, (END, 0.0)
        for part in itertools.chain(PARTS.finditer(text), [None]):
            symbol, strength = known.get(part.group(), end) if part else end
            insult, slur, threat, target, negated, reported = out[state][symbol]
            if insult or slur or threat:
                clause.append([slur + 2 * threat, target, negated, reported, strength, part.start(), part.end()])
            elif symbol == TARGET:
                for match in clause:
                    match[1] = 1
            elif symbol == END and clause:
                matches += [(m[0] * 8 + m[1] * 4 + m[2] * 2 + m[3], m[4], m[5], m[6]) for m in clause]
                clause = []
            state = following[state][symbol]
        return matches, len(words)

    def features(self, matches: list[tuple[int, float, int, int]], words: int) -> list[float]:
        sums = [0.0] * len(LABELS)
        for label, strength, _, _ in matches:
            sums[label] += strength / STRONG
        return [*map(math.log1p, sums), math.log1p(words * self.slur_rate)]

    def score(self, matches: list[tuple[int, float, int, int]], words: int) -> float:
        z = self.weights[-1] + sum(w * x for w, x in zip(self.weights, self.features(matches, words), strict=False))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


_SEED_SETS = {kind: frozenset(words.split()) for kind, words in SEEDS.items()}
#: Before any label is seen: matches count, less so if negated or reported. Then the length, then the base.
PRIOR = [
    (5.0, 2.0, 1.0)[k // 8] + 1.0 * bool(k & 4) - 1.5 * bool(k & 2) - 1.0 * bool(k & 1) for k in range(len(LABELS))
] + [-1.0, -2.5]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(text, toxic) of at most fit_rows rows: one text of each labelled id that is not held out."""
    each = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    each = each.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    each = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # fit_rows short rows
    # An id on several rows gives the text with the smallest hash.
    one = each.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return one.select("text", F.col("toxic").cast("int").alias("toxic"))


def _term_counts(sample: DataFrame) -> DataFrame:
    """(term, toxic documents, clean documents); counts merge per batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad, good = Counter(), Counter()
            for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
                words = set(WORDS.findall((text.as_py() or "").lower()))
                terms = words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS))
                (bad if toxic.as_py() else good).update(terms)
            terms = list(bad)
            yield pa.RecordBatch.from_pydict(
                {"term": terms, "bad": [bad[t] for t in terms], "good": [good[t] for t in terms]},
                schema=(schema := pa.schema([("term", pa.string()), ("bad", pa.int64()), ("good", pa.int64())])),
            )
            rest = [t for t in good if t not in bad]
            yield pa.RecordBatch.from_pydict({"term": rest, "bad": [0] * len(rest), "good": [good[t] for t in rest]}, schema=schema)

    found = sample.mapInArrow(count, "term string, bad long, good long")
    return found.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("bad > 0")


def learn_lexicon(sample: DataFrame, lift: float = 1.0, error: float = 0.05) -> dict[str, tuple[float, float]]:
    """Terms that stand in toxic documents too often for chance: surprise and log odds.

    A term of n documents, b of them toxic, passes if its surprise n * KL(b/n || base rate)
    exceeds ln(candidates / error) and its log odds exceed those of the base rate by `lift`:
    few terms can, and no more than the sample holds.
    """
    totals = sample.agg(F.sum(F.col("toxic")).alias("bad"), F.count("*").alias("n")).first()
    if not totals.bad or totals.bad == totals.n:
        return {}
    rate = totals.bad / totals.n
    terms = _term_counts(sample).cache()
    candidates = terms.count()
    n, p = F.col("bad") + F.col("good"), F.col("bad") / (F.col("bad") + F.col("good"))
    surprise = n * (p * F.log(p / rate) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - rate))).otherwise(0.0))
    odds = F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5)) - math.log(rate / (1 - rate))
    enough = (surprise > math.log(max(candidates, 1) / error)) & (odds >= lift)
    rows = terms.where(enough).select("term", surprise.alias("surprise"), odds.alias("odds")).collect()
    terms.unpersist()
    return {r.term: (r.surprise, r.odds) for r in rows}


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 12_000, steps: int = 100) -> ToxicModel:
    """Lexicon and weights from a bounded sample; the driver holds 27 numbers for each of its rows."""
    sample = _sample(docs, labels, fit_rows)
    model = ToxicModel(learn_lexicon(sample), PRIOR)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.labels(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([model.features(*f)[:-1] for f in found], pa.list_(pa.float64())),
                 pa.array([sum(8 <= m[0] < 16 for m in f[0]) for f in found], pa.int64()),
                 pa.array([f[1] for f in found], pa.int64()), batch.column("toxic")],
                names=["x", "slurs", "words", "toxic"],
            )

    found = sample.mapInArrow(measure, "x array<double>, slurs long, words long, toxic int").toPandas()
    if found.toxic.nunique() < 2:
        return model
    clean = found[found.toxic == 0]
    rate = float(clean.slurs.sum() / max(1, clean.words.sum()))
    rows = zip(found.x, found.words, found.toxic, strict=True)
    # The same order whatever task a row came from, so that a fit repeats to the last bit.
    x = np.array(sorted([*row, math.log1p(n * rate), float(y)] for row, n, y in rows))
    x, y = np.hstack([x[:, :-1], np.ones((len(x), 1))]), x[:, -1]
    prior, penalty = np.array(PRIOR), np.array([0.3] * len(LABELS) + [0.1, 1e-3])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(penalty * (w - prior) ** 2))

    w = prior
    for _ in range(steps):  # Newton with halved steps; the penalty draws to the prior
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (q - y) + penalty * (w - prior)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(penalty), grad)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return ToxicModel(model.lexicon, [float(v) for v in w], rate)


def with_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """docs with toxicity (0 to 1) and toxic_matches (label, start, end of each match in the text)."""

    @F.pandas_udf("toxicity double, toxic_matches array<struct<label:string,start:int,end:int>>")
    def of_text(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [model.labels(t) for t in texts]
            yield pd.DataFrame({
                "toxicity": [model.score(*f) for f in found],
                "toxic_matches": [[{"label": LABELS[k], "start": a, "end": b} for k, _, a, b in f[0]] for f in found],
            })

    scored = docs.drop("toxicity", "toxic_matches").withColumn("_toxic", of_text(F.col("text").cast("string")))
    return scored.select("*", "_toxic.*").drop("_toxic")


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.7) -> DataFrame:
    """The rows of docs that score below the limit, with their own columns."""
    return with_toxicity(docs, fit(docs, labels)).where(F.col("toxicity") < limit).select(*docs.columns)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.7).cast("int").alias("predicted"),
    )
