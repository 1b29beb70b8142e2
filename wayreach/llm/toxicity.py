"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, reporting verb, other); a
clause's symbols run through the composition of four small transducers.  The
negation and reported-speech transducers mark an insult or threat in their scope,
the target transducer marks one that has a person in its clause, and the weighing
transducer turns each marked symbol into a factor of the word's own weight.  The
score is a logistic function of the clauses' summed weight, not of isolated words.

Word weights: a general list has a common weight; stems that the labelled sample
shows to be telling have their log odds.  The fit is bounded (``FIT_TOXIC`` and
``FIT_CLEAN`` labelled rows, and the bounds of ``common.fit_rows``); scoring is one
pass, no shuffle.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, documents, fit_rows

#: Bounds of the labelled rows that a fit reads, by label.
FIT_TOXIC, FIT_CLEAN = 1_500, 3_000
STEM_MIN, STEM_MAX = 5, 14
#: Weight of listed words.
LISTED = 5.0

INSULTS = """idiot idiots stupid moron morons loser losers scum trash pathetic worthless disgusting clown clowns fool
fools dumb imbecile jerk filth vermin coward liar ugly garbage idiota idiotas estúpido estúpida imbécil basura escoria
tonto payaso asqueroso patético inútil cretino abruti débile ordure minable dégoûtant crétin nul raclure dummkopf
trottel abschaum müll versager erbärmlich widerlich wertlos blödmann""".split()
THREATS = """kill hurt destroy murder shoot stab strangle slaughter beat crush matar mataré destruir golpear tuer frapper
détruire töten umbringen schlagen vernichten""".split()
TARGETS = """you your yours yourself he she him her they them their people everyone tú usted ustedes ellos ella él tu vous
toi ils elle elles il lui leur du dich dir sie ihr ihnen er""".split()
NEGATIONS = "not no never neither nor without isn't aren't wasn't don't nunca jamás sin pas jamais sans nicht kein keine nie ohne".split()
REPORTS = """said says say called calls wrote writes claimed claims reported quoted alleged dijo dice llamó escribió dit
appelé écrit sagte sagt nannte schrieb""".split()

CLAUSE_END = re.compile(r"[.,;:!?\n\r()|]")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_SYMBOL = {**{w: "T" for w in TARGETS}, **{w: "N" for w in NEGATIONS}, **{w: "R" for w in REPORTS}}


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol out, weight); symbols without an arc pass and keep the state."""

    start: object
    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 1.0))

    def compose(self, other: "Transducer", symbols) -> "Transducer":
        """What ``other`` makes of this one's output, as one machine over ``symbols``."""
        start = (self.start, other.start)
        out, todo, seen = Transducer(start), [start], {start}
        while todo:
            at = todo.pop()
            for s in symbols:
                a, middle, w1 = self.step(at[0], s)
                b, last, w2 = other.step(at[1], middle)
                out.arcs[at, s] = ((a, b), last, w1 * w2)
                if (a, b) not in seen:
                    seen.add((a, b))
                    todo.append((a, b))
        return out


def _scope(opener: str, length: int, marks: dict) -> Transducer:
    """After ``opener``, the symbols in ``marks`` are rewritten for ``length`` words."""
    t = Transducer(0)
    for state in range(length + 1):
        t.arcs[state, opener] = (length, opener, 1.0)
        for s in "IHTNRO":
            if s != opener:
                left = max(0, state - 1)
                t.arcs[state, s] = (left, marks.get(s, s) if state else s, 1.0)
    return t


def _machines() -> tuple[Transducer, ...]:
    """Negation, reported speech, target and weighing, in the order in which symbols run through them."""
    negation = _scope("N", 3, {"I": "i", "H": "h"})  # lower case: negated
    report = Transducer(0)
    for s in "IHih":
        report.arcs[1, s] = (1, s + "'", 1.0)  # primed: reported
    report.arcs[0, "R"] = (1, "R", 1.0)
    target = Transducer(0)
    target.arcs[0, "T"] = (1, "T", 1.0)
    for s in ("I", "H", "i", "h", "I'", "H'", "i'", "h'"):
        target.arcs[1, s] = (1, s + "@", 1.0)  # aimed at somebody
    weigh = Transducer(0)
    for s in ("I", "H", "i", "h", "I'", "H'", "i'", "h'"):
        w = (1.0 if s[0] in "Ii" else 0.25) * (0.3 if s[0] in "ih" else 1.0) * (0.6 if "'" in s else 1.0)
        weigh.arcs[0, s] = (0, "!", w)
        # A threat needs someone to aim at; an insult is one by itself.
        weigh.arcs[0, s + "@"] = (0, "!", w * (1.2 if s[0] in "Ii" else 4.0))
    return negation, report, target, weigh


#: The symbols of a clause's words: insult, threat, target, negation, reporting verb, other.
SYMBOLS = "IHTNRO"
MACHINES = _machines()
GRAMMAR = reduce(lambda a, b: a.compose(b, SYMBOLS), MACHINES)


@dataclass
class ToxicModel:
    weights: dict  # word or stem -> (symbol, weight, is stem)
    calibration: tuple = (-3.0, 2.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for key, value in self.weights.items():
            a.add_word(key, (len(key), *value))
        a.make_automaton()
        return a

    def evidence(self, text: str | None, automaton) -> float:
        """Summed weight of the clauses that the grammar matches."""
        low = (text or "").lower()
        hits: dict[int, tuple] = {}
        for end, (n, symbol, weight, stem) in automaton.iter(low):
            begin = end - n + 1
            if begin and low[begin - 1].isalpha() or not stem and end + 1 < len(low) and low[end + 1].isalpha():
                continue
            if begin not in hits or n > hits[begin][0]:
                hits[begin] = (n, symbol, weight)
        if not hits:
            return 0.0
        ends = [m.start() for m in CLAUSE_END.finditer(low)]
        total, done = 0.0, -1
        for begin in sorted(hits):
            if begin < done:
                continue
            k = bisect_left(ends, begin)
            left, done = ends[k - 1] + 1 if k else 0, ends[k] if k < len(ends) else len(low)
            words = [(m.start(), m.group()) for m in WORD.finditer(low, left, done)]
            aimed = [w for _, w in words if _SYMBOL.get(w) == "T"]
            state = GRAMMAR.start
            if aimed:  # a target stands for its whole clause, before or after
                state = GRAMMAR.step(state, "T")[0]
            for at, w in words:
                _, symbol, weight = hits.get(at, (0, _SYMBOL.get(w, "O"), 0.0))
                state, out, factor = GRAMMAR.step(state, symbol)
                if out == "!":
                    total += weight * factor
        return total

    def score(self, text: str | None, automaton) -> float:
        e = self.evidence(text, automaton)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.calibration, _inputs(e, text)))))))


def _inputs(evidence: float, text: str | None) -> tuple:
    some = float(evidence > 0)
    return 1.0, math.log1p(evidence), some, some * math.log1p(len(text or "")) / 10


def _prefixes(word: str):
    return (word[:n] for n in range(STEM_MIN, min(len(word), STEM_MAX) + 1))


def learn_stems(texts: list, labels: np.ndarray, least: int = 5, odds: float = 12.0) -> dict:
    """Stems whose document frequency among toxic rows is ``odds`` times that among the others.

    A stem is left out where a shorter one says as much.  Equal texts count once,
    and listed words, which need no learning, not at all.
    """
    known = set(INSULTS)
    once = dict(zip(texts, labels))
    texts, labels = list(once), np.array(list(once.values()), int)
    stems = lambda t: {p for w in set(WORD.findall((t or "").lower())) - known for p in _prefixes(w)}
    toxic = Counter()
    for t, y in zip(texts, labels):
        if y:
            toxic.update(stems(t))
    toxic = {p: n for p, n in toxic.items() if n >= least}
    clean = Counter()
    for t, y in zip(texts, labels):
        if not y:
            clean.update(stems(t).intersection(toxic))
    n1, n0 = max(1, int((labels == 1).sum())), max(1, int((labels == 0).sum()))
    lift = {p: (n + 0.5) / (n1 + 1) / ((clean[p] + 0.5) / (n0 + 1)) for p, n in toxic.items()}
    chosen: dict = {}
    for p in sorted((p for p in lift if lift[p] >= odds), key=len):
        above = max((lift[p[:n]] for n in range(STEM_MIN, len(p)) if p[:n] in chosen), default=0.0)
        if lift[p] > 2.0 * above:
            chosen[p] = math.log(lift[p])
    return chosen


def fit_toxicity(texts: list, labels: np.ndarray, toxic_share: float | None = None) -> ToxicModel:
    """Stem weights and the calibration from labelled rows; without both labels, the listed words and a start calibration.

    ``toxic_share`` is the label's share where the rows come from, if they hold
    another: the calibration weighs them to it.
    """
    labels = np.asarray(labels, int)
    weights = {w: ("I", LISTED, False) for w in INSULTS} | {w: ("H", LISTED, False) for w in THREATS}
    if not len(labels) or labels.min() == labels.max():
        return ToxicModel(weights)
    weights |= {p: ("I", w, True) for p, w in learn_stems(texts, labels).items()}
    model = ToxicModel(weights)
    automaton = model.automaton()
    x = np.array([_inputs(model.evidence(t, automaton), t) for t in texts])
    own = labels.mean()
    share = own if toxic_share is None else min(max(toxic_share, 1e-3), 1 - 1e-3)
    weight = np.where(labels == 1, share / own, (1 - share) / (1 - own))
    c = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps on the ridge logistic loss
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(c))
        c = c - np.linalg.solve(h, x.T @ (weight * (p - labels)) + 0.05 * c)
    model.calibration = tuple(float(v) for v in c)
    return model


def is_held_out(doc_id):
    return F.coalesce(crc_mod(doc_id, 5) == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[list, np.ndarray, float | None]:
    """(texts, labels, share of toxic among all rows to learn from)."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__y")).where(~is_held_out(F.col("__id")))
    by_hash = F.md5(F.col("__id").cast("string").cast("binary"))
    ids = known.where("__y = 1").orderBy(by_hash, "__id").limit(FIT_TOXIC).unionByName(
        known.where("__y = 0").orderBy(by_hash, "__id").limit(FIT_CLEAN)
    )
    table = fit_rows(docs, ids)
    share = known.where("__y IN (0, 1)").agg(F.avg("__y")).first()[0]
    return table["text"].tolist(), table["__y"].to_numpy(), share


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score, predicted for every row; null and empty texts score as texts without a match.

    A score of 0.5 is predicted 1.  Equal rows score alike and each comes out; an
    empty table gives no rows.  Texts and clauses of any length are read whole.
    Columns beyond doc_id and text are left out, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.calibration))

    def run(batches):
        m = ToxicModel(*shared.value)
        automaton = m.automaton()
        for b in batches:
            s = np.array([m.score(t, automaton) for t in b.column("text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; labels with crc32(doc_id) mod 5 = 0 are held out of the fit."""
    docs = documents(spark, sf_dir)
    model = fit_toxicity(*_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score_toxicity(docs, model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
