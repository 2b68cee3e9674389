"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are read by two lexicon transducers: insults by learned beginnings, threats by fixed
stems and their endings; both write a kind of word (insult, threat, target, negation, reported
speech, other). Three transducers then read a clause's kinds in order, each what the one before
it wrote: negation reaches the next ``REACH`` words only, and a second one within reach lifts it;
reported speech holds for what follows the reporting word; targets may stand before or after.
Their composition is one table of weighted arcs. An arc that reads an insult or a threat names
the pattern it is part of, and the part of the word's weight that counts there.
Isolated words are not scored: a clause is, by its patterns.

Insults are learned: word beginnings that labelled toxic documents have and clean ones don't,
with a test against chance, so that inflected forms count and any language can be learned. The
other words are fixed, in four languages. The weights of the patterns come from a logistic
regression on the same rows.

Labels are learned from at most ``TRAIN_ROWS`` labelled documents, chosen by a hash of their
id; everything else reads all rows and whole texts.

Defined results: null and empty texts get the score of no matched clause; without labels of
both kinds, prior weights stand; labels that repeat or contradict for a doc_id count as
toxic if any is; null labels are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerwise.llm.common import bounded_broadcast, short_batches, stage, text_of

THRESHOLD = 0.3
TRAIN_ROWS = 20_000
HELD_OUT = (4, 2)  # crc32 of the id as text, modulo and remainder
#: Beginnings of words that are candidates for learned insults.
STEM_LENGTHS = (4, 5, 6, 7, 8)
#: A stem is learned if chance gives it so seldom, over all stems, and so clean a record.
CHANCE = 0.01
PRECISION = 0.95

# Fixed word lists. Threats are stems with the endings of their language.
THREATS = (
    ("kill hurt destroy beat burn shoot stabb stab strangl strangle crush murder", "s ed d ing en t er"),
    ("töt getöt umbring umgebracht verprügel erschieß erschoss erwürg verbrenn erstech", "e est st t et en n te ten"),
    ("tuer tue frapp étrangl brûl égorg poignard massacr", "e es ez er ai as a ons ont é ée és"),
    ("matar mato maté golpe estrangul quem apuñal dispar", "e é a á o ó as ar aré emos an ado ando"),
)
TARGETS = (
    "you", "your", "yours", "yourself", "he", "him", "his", "she", "her", "they", "them", "their",
    "this", "that", "these", "those", "people", "du", "dich", "dir", "euch", "ihr", "ihn", "sie", "tu",
    "te", "toi", "vous", "il", "elle", "lui", "usted", "ustedes", "ella", "ellos",
)
NEGATIONS = (
    "not", "no", "never", "neither", "nobody", "nicht", "kein", "keine", "nie", "pas", "jamais",
    "nunca", "isn't", "aren't", "wasn't", "weren't", "don't", "doesn't", "didn't", "won't",
)
REPORTS = (
    "said", "says", "say", "called", "calls", "quoted", "quote", "wrote", "reported", "claimed",
    "sagte", "sagten", "schrieb", "nannte", "dit", "disait", "dijo", "llamó", "escribió",
)

#: A colon ends no clause, as what is reported follows it.
CLAUSE_END = re.compile(r"[.!?;,\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "ihtnro"
#: Words that a negation reaches, and the part of a word's weight that counts when negated or reported.
REACH = 3
PART = {"negated": 0.5, "reported": 0.5}


def threat_words() -> set[str]:
    """Every stem alone and with each ending of its language."""
    return {
        stem + end for stems, ends in THREATS for stem in stems.split() for end in ("", *ends.split())
    }


#: A transducer: (state, read) -> (state, written, weight). State 0 is the first.
Arcs = dict[tuple[int, str], tuple[int, str, float]]


def negation_arcs() -> Arcs:
    """The state is the number of words still within reach of a negation."""
    arcs: Arcs = {}
    for reach in range(REACH + 1):
        left = max(0, reach - 1)
        for kind in (TARGET, REPORT, OTHER):
            arcs[reach, kind] = (left, kind, 1.0)
        for kind in (INSULT, THREAT):
            arcs[reach, kind] = (left, "negated", PART["negated"]) if reach else (0, kind, 1.0)
        arcs[reach, NEGATION] = (0 if reach else REACH, OTHER, 1.0)
    return arcs


def report_arcs() -> Arcs:
    """State 1 follows a reporting word."""
    arcs: Arcs = {}
    for state in (0, 1):
        for kind in (TARGET, OTHER, "negated"):
            arcs[state, kind] = (state, kind, 1.0)
        for kind in (INSULT, THREAT):
            arcs[state, kind] = (1, "reported", PART["reported"]) if state else (0, kind, 1.0)
        arcs[state, REPORT] = (1, OTHER, 1.0)
    return arcs


def target_arcs() -> Arcs:
    """State 1 has seen a target; other kinds pass, targets themselves are taken out."""
    arcs: Arcs = {}
    for state in (0, 1):
        for kind in (INSULT, THREAT, "negated", "reported", OTHER):
            arcs[state, kind] = (state, kind, 1.0)
        arcs[state, TARGET] = (1, OTHER, 1.0)
    return arcs


def compose(first: Arcs, second: Arcs) -> tuple[Arcs, list[tuple[int, int]]]:
    """``second`` reads what ``first`` writes; weights multiply. States are numbered as they
    are met from the start; the list names the pair that each number stands for."""
    kinds = sorted({kind for _, kind in first})
    pairs, arcs, done = [(0, 0)], {}, 0
    number = {(0, 0): 0}
    while done < len(pairs):
        p, q = pairs[done]
        for kind in kinds:
            p2, written, weight = first[p, kind]
            q2, out, more = second[q, written]
            if (p2, q2) not in number:
                number[p2, q2] = len(pairs)
                pairs.append((p2, q2))
            arcs[done, kind] = (number[p2, q2], out, weight * more)
        done += 1
    return arcs, pairs


_SAID, _ = compose(negation_arcs(), report_arcs())
GRAMMAR, _PAIRS = compose(_SAID, target_arcs())
#: States in which the clause has a target.
AIMED = {n for n, (_, aimed) in enumerate(_PAIRS) if aimed}
#: Patterns in the order of their features, with prior weights.
PATTERNS = ("insult", "insult at target", "threat at target", "negated", "reported")
PRIOR = np.array([2.0, 3.0, 1.0, 1.0, 1.0])
PRIOR_BIAS = -3.0


def matched(clause: Iterable[tuple[str, float]]) -> dict[str, float]:
    """Weights of the patterns of one clause, given as (kind, weight) of its words in order."""
    state, found = 0, {}
    for kind, own in clause:
        state, out, part = GRAMMAR[state, kind]
        if out != OTHER:
            found[out] = found.get(out, 0.0) + own * part
    insult, threat = found.pop(INSULT, 0.0), found.pop(THREAT, 0.0)
    if insult:
        found["insult at target" if state in AIMED else "insult"] = insult
    if threat and state in AIMED:
        found["threat at target"] = threat
    return found


@dataclass
class Grammar:
    """Learned insult stems with weights, and the weights of the patterns."""

    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    bias: float = PRIOR_BIAS

    def reader(self):
        import ahocorasick

        triggers = ahocorasick.Automaton()
        threats = threat_words()
        for word in [*self.stems, *threats]:
            triggers.add_word(word, len(word))
        triggers.make_automaton()
        kind = dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(REPORTS, REPORT)
        lengths = sorted({len(s) for s in self.stems})

        def read(word: str) -> tuple[str, float]:
            for n in lengths:
                if n <= len(word) and (weight := self.stems.get(word[:n])) is not None:
                    return INSULT, weight
            return (THREAT, 1.0) if word in threats else (kind.get(word, OTHER), 0.0)

        def features(text: str) -> np.ndarray:
            """Sum of the clauses' weights by pattern."""
            text = text.lower().replace("’", "'")
            found = np.zeros(len(PATTERNS))
            done = 0
            for end, length in triggers.iter(text):
                start = end - length + 1
                if start < done or (start and (text[start - 1].isalpha())):
                    continue
                cut = CLAUSE_END.search(text, start)
                upto = cut.start() if cut else len(text)
                begin = done
                for brk in CLAUSE_END.finditer(text, done, start):
                    begin = brk.end()
                done = upto
                words = (read(m.group()) for m in WORD.finditer(text, begin, upto))
                for name, weight in matched(words).items():
                    found[PATTERNS.index(name)] += weight
            return np.log1p(found)

        return features

    def score(self, features: np.ndarray) -> float:
        x = float(features @ self.weights + self.bias)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def held_out(doc_id) -> F.Column:
    modulo, rest = HELD_OUT
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulo == rest, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of at most about ``rows`` labelled documents that aren't held out."""
    known = (
        labels.filter("toxic is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .filter(~held_out("doc_id"))
    )
    known = stage(known, "labels")
    share = max(1, math.ceil(known.count() / rows))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    known = bounded_broadcast(stage(known.withColumnRenamed("doc_id", "_id"), "train-labels"))
    own = docs.select("doc_id", text_of("text").alias("text"))
    return own.join(known, F.col("doc_id") == F.col("_id")).select("text", "toxic")


def learn_stems(train: DataFrame) -> dict[str, float]:
    """Insult stems of the labelled rows with their log odds."""
    totals = train.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    n, bad = totals["n"] or 0, totals["bad"] or 0
    if not 0 < bad < n:
        return {}
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    cut = F.flatten(F.transform(F.array(*map(F.lit, STEM_LENGTHS)), lambda k: F.transform(
        F.filter(F.col("words"), lambda w: F.length(w) >= k), lambda w: F.substring(w, F.lit(1), k)
    )))
    each = train.select("toxic", F.explode(words).alias("word")).filter(F.length("word") >= min(STEM_LENGTHS))
    # forms of a word within a document: words first, then their beginnings, each combined
    # before it is shuffled
    counted = each.groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
    stems = (
        counted.withColumn("words", F.array("word"))
        .select(F.explode(F.array_distinct(cut)).alias("stem"), "n", "bad")
        .groupBy("stem")
        .agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    )
    rate = bad / n
    kinds = 300_000
    least = math.ceil(math.log(kinds / CHANCE) / -math.log(rate))
    rows = stems.filter((F.col("bad") >= least) & (F.col("bad") >= PRECISION * F.col("n"))).collect()
    found = {r["stem"]: (r["bad"], r["n"]) for r in rows}
    out: dict[str, float] = {}
    for stem in sorted(found, key=lambda s: (len(s), s)):
        if not any(stem.startswith(short) for short in out):
            hits, seen = found[stem]
            out[stem] = math.log((hits + 0.5) / (seen - hits + 0.5) / (rate / (1 - rate)))
    return out


def learn_weights(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method, pulled to the prior weights."""
    data = np.hstack([x, np.ones((len(x), 1))])
    prior = np.append(PRIOR, PRIOR_BIAS)
    pull = np.append(np.full(len(PRIOR), 1.0), 0.01)
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(data @ w, -30, 30)))
        slope = data.T @ (p - y) + pull * (w - prior)
        curve = (data * (p * (1 - p))[:, None]).T @ data + np.diag(pull)
        change = np.linalg.solve(curve, slope)
        w = w - np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _feature_rows(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = grammar.reader()
        for batch in batches:
            found = [read(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic").cast(pa.int32()), pa.array(found, pa.list_(pa.float64()))],
                names=["toxic", "x"],
            )

    return run


def _count_same(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r["x"] for r in rows], dtype=float), np.array([r["toxic"] for r in rows], float)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Grammar:
    """Learn stems and pattern weights from the labelled rows that aren't held out."""
    train = stage(training_rows(docs, labels, rows), "train")
    grammar = Grammar(learn_stems(train))
    if grammar.stems:
        # ten numbers for each of at most about ``rows`` rows
        found = train.mapInArrow(_feature_rows(grammar), "toxic int, x array<double>").collect()
        grammar.weights, grammar.bias = learn_weights(*_count_same(found))
    return grammar


def _score_rows(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = grammar.reader()
        for batch in batches:
            scores = [grammar.score(read(t)) for t in batch.column("_text").to_pylist()]
            kept = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(scores, pa.float64())],
                names=[*kept, "_score"],
            )

    return run


def scored(rows: DataFrame, grammar: Grammar) -> DataFrame:
    """``rows`` that have ``_text``, with ``_score`` in its place."""
    short_batches(rows.sparkSession)
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    schema = T.StructType([*kept, T.StructField("_score", T.DoubleType())])
    return rows.mapInArrow(_score_rows(grammar), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted."""
    grammar = fit(docs, labels)
    out = scored(docs.select("doc_id", text_of("text").alias("_text")), grammar)
    return out.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
