"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, reporting verb, other).
Small transducers for insults, negation, reported speech and targets read a
clause from the left and are composed into one machine; what they write is read
from the right by a second machine, composed of those for reported speech,
targets and threats and of a weigher.  So a target or a reporting verb counts
on either side of a hit, as in "you idiot" and "idiots like you".  A hit counts
with its word's weight times the machine's factor: more when aimed at somebody
or heaped on another, less when negated or reported.  Hits are added up by
clause, and a logistic curve maps the clauses of a document to a score.

Insults are learned from labelled documents as words and word stems that occur
in toxic documents in many different contexts and hardly anywhere else; counting
contexts instead of documents keeps copied documents from promoting their other
words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_rows, crc_mod, discard, stored, texts
from .stats import labelled_sample

FIT_ROWS = 20_000
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:|\n]+")
_END = frozenset(".!?;:|\n")
STEM_LENGTHS = (4, 5, 6)

# Closed word classes in the four languages of the corpus.
NEGATIONS = frozenset("not no never nor neither without isn aren wasn nicht kein keine nie niemals ne pas jamais aucun sin nunca jamás tampoco ningún".split())
TARGETS = frozenset("you your yours he she they them him her these those people du dich dir ihr euch sie tu toi te vous ton votre eux ils elles tú ti usted ustedes ellos ellas vosotros".split())
REPORTS = frozenset("said says say wrote writes claimed claims called reported quoted alleged sagte schrieb meinte behauptet nannte dit écrit affirme dijo escribió afirma llamó".split())
THREATS = frozenset("kill hurt destroy beat stab shoot murder attack töten umbringen verletzen schlagen tuer frapper détruire blesser matar golpear destruir herir".split())


@dataclass
class Transducer:
    """Deterministic: arcs[state][symbol] = (next state, output, log weight); absent symbols pass through."""

    arcs: dict[object, dict[str, tuple[object, str, float]]] = field(default_factory=dict)
    start: object = 0

    def step(self, state, symbol: str):
        return self.arcs[state].get(symbol, (state, symbol, 0.0))


#: Hits of the left machine: an insult, one more after it, a threat.
HITS = ("I", "J", "T")
#: Marks of a hit, in the order in which they are written: negated, reported, aimed.
MARKS = "~\"@"
_SUBSETS = ["".join(m for k, m in enumerate(MARKS) if bits >> k & 1) for bits in range(8)]
_EVERY_HIT = [h + marks for h in HITS for marks in _SUBSETS]


def _with(hit: str, mark: str) -> str:
    return hit[0] + "".join(m for m in MARKS if m in hit[1:] or m == mark)


def insult(reach: int = 2) -> Transducer:
    """An insult is a hit, and one that follows another within ``reach`` words a heaped one."""
    arcs = {0: {"I": (reach, "I", 0.0)}}
    for left in range(1, reach + 1):
        arcs[left] = {s: (left - 1, s, 0.0) for s in "oTGNR"} | {"I": (reach, "J", 0.0)}
    return Transducer(arcs)


def negation(reach: int = 3) -> Transducer:
    """Marks hits within ``reach`` words after a negation; negations are ordinary words from here on."""
    arcs = {}
    for left in range(reach + 1):
        after = max(0, left - 1)
        arcs[left] = {"N": (reach, "o", 0.0)} | {s: (after, s, 0.0) for s in "oGR"} | {h: (after, _with(h, "~") if left else h, 0.0) for h in HITS}
    return Transducer(arcs)


def _after(trigger: str, mark: str) -> Transducer:
    """From ``trigger`` on to the clause's end, in the direction of reading, hits get ``mark``."""
    return Transducer({0: {trigger: (1, trigger, 0.0)}, 1: {h: (1, _with(h, mark), 0.0) for h in _EVERY_HIT}})


def reported() -> Transducer:
    return _after("R", '"')


def targeted() -> Transducer:
    return _after("G", "@")


def threat() -> Transducer:
    """A threatening verb is a hit only when aimed; else it is an ordinary word."""
    return Transducer({0: {h: (0, "H" + h[1:] if "@" in h else "o", 0.0) for h in _EVERY_HIT if h[0] == "T"}})


def weigher() -> Transducer:
    """Log factors: negated hits count a third, reported ones a half, aimed ones one and a half, heaped ones a quarter more."""
    factors = {"~": math.log(1 / 3), '"': math.log(1 / 2), "@": math.log(3 / 2), "J": math.log(5 / 4)}
    return Transducer({0: {k + m: (0, k + m, sum(factors.get(c, 0.0) for c in k + m)) for k in "IJH" for m in _SUBSETS}})


def compose(first: Transducer, second: Transducer, alphabet: list[str]) -> Transducer:
    """The machine that feeds the first one's output to the second; only reachable states are built."""
    start = (first.start, second.start)
    arcs: dict = {}
    todo = [start]
    while todo:
        state = todo.pop()
        if state in arcs:
            continue
        arcs[state] = {}
        for symbol in alphabet:
            a, middle, w = first.step(state[0], symbol)
            b, out, v = second.step(state[1], middle)
            arcs[state][symbol] = ((a, b), out, w + v)
            todo.append((a, b))
    return Transducer(arcs, start)


ALPHABET = ["o", "I", "T", "G", "N", "R"]


def _machine(parts: list[Transducer], alphabet: list[str]) -> Transducer:
    """All parts in one, states numbered from 0."""
    machine = parts[0]
    for part in parts[1:]:
        machine = compose(machine, part, alphabet)
    number = {state: i for i, state in enumerate(machine.arcs)}
    return Transducer({number[s]: {c: (number[n], out, w) for c, (n, out, w) in row.items()} for s, row in machine.arcs.items()}, number[machine.start])


def grammar() -> tuple[Transducer, Transducer]:
    """The machine that reads clauses from the left, and the one that reads its output from the right."""
    left = _machine([insult(), negation(), reported(), targeted()], ALPHABET)
    between = sorted({out for row in left.arcs.values() for _, out, _ in row.values()})
    return left, _machine([reported(), targeted(), threat(), weigher()], between)


#: What an aimed threat weighs, as a learned insult of middle weight.
THREAT_WEIGHT = 2.0


@dataclass
class Lexicon:
    words: dict[str, float]
    stems: dict[str, float]

    def weight(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in STEM_LENGTHS:
            if len(word) > n:
                found = max(found, self.stems.get(word[:n], 0.0))
        return found


class ClauseScorer:
    """Runs the grammar over the clauses that hold a hit."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.left, self.right = grammar()
        self.known: dict[str, float] = {}

    def _hit(self, word: str) -> float:
        known = self.known
        if word not in known:
            if len(known) > 200_000:
                known.clear()
            known[word] = 1.0 if word in THREATS else self.lexicon.weight(word)
        return known[word]

    def clauses(self, text: str) -> tuple[list[float], int]:
        """Scores of the matched clauses, and the number of words."""
        tokens = _TOKEN.findall(text.lower())
        hit = self._hit
        at = [i for i, token in enumerate(tokens) if hit(token)]
        scores: list[float] = []
        done = -1
        for i in at:
            if i <= done:
                continue
            begin = i
            while begin and tokens[begin - 1][0] not in _END:
                begin -= 1
            done = i
            while done + 1 < len(tokens) and tokens[done + 1][0] not in _END:
                done += 1
            scores.append(self._clause(tokens[begin : done + 1]))
        return [s for s in scores if s > 0], len(tokens)

    def _clause(self, words: list[str]) -> float:
        state, arcs, read = self.left.start, self.left.arcs, []
        for word in words:
            symbol = "T" if word in THREATS else "I" if self._hit(word) else "N" if word in NEGATIONS else "G" if word in TARGETS else "R" if word in REPORTS else "o"
            state, out, _ = arcs[state][symbol]
            read.append(out)
        state, arcs, total = self.right.start, self.right.arcs, 0.0
        for word, symbol in zip(reversed(words), reversed(read), strict=True):
            state, out, log_factor = arcs[state][symbol]
            if out[0] in "IJ":
                total += self._hit(word) * math.exp(log_factor)
            elif out[0] == "H":
                total += THREAT_WEIGHT * math.exp(log_factor)
        return total

    def features(self, text: str) -> list[float]:
        scores, words = self.clauses(text)
        total = sum(scores)
        return [1.0, min(max(scores, default=0.0), 30.0), math.log1p(total), math.log1p(len(scores)), math.log1p(100 * total / max(words, 20))]


def _candidates(batch: pa.RecordBatch) -> dict:
    """Documents of either label by word and stem, added up within the batch."""
    toxic, clean = Counter(), Counter()
    for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
        (toxic if label else clean).update(_keys(set(_TOKEN.findall(text.lower()))))
    keys = list(toxic.keys() | clean.keys())
    return {"key": keys, "toxic": [toxic[k] for k in keys], "clean": [clean[k] for k in keys]}


def _keys(words: set[str]) -> set[str]:
    found = {w for w in words if w[0] not in _END}
    return found | {w[:n] + "*" for w in found for n in STEM_LENGTHS if len(w) > n}


def learn_lexicon(sample: DataFrame, least: int = 5) -> Lexicon:
    """Insults from (text, label) rows; the rows are a bounded sample, and so is what comes back.

    A key stays if its contexts in toxic texts are far more than chance gives
    (likelihood ratio against the size of the vocabulary) and at least 30 times
    as likely as in clean ones.
    """
    counted = arrow_map(sample, _candidates, "key string, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sizes = sample.agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).first()
    if not sizes.n or not sizes.toxic or sizes.toxic == sizes.n:
        return Lexicon({}, {})
    share = sizes.toxic / sizes.n
    rare = (F.col("clean") + 0.5) / (1 - share) * 15 < (F.col("toxic") + 0.5) / share
    chosen = {r.key for r in counted.where((F.col("toxic") >= least) & rare).select("key").collect()}

    def contexts(batch: pa.RecordBatch) -> dict:
        rows = set()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            tokens = _TOKEN.findall(text.lower())
            for i, word in enumerate(tokens):
                if word[0] in _END:
                    continue
                for key in (word, *(word[:n] + "*" for n in STEM_LENGTHS if len(word) > n)):
                    if key in chosen:
                        rows.add((key, label, f"{tokens[i - 1] if i else ''} {tokens[i + 1] if i + 1 < len(tokens) else ''}", word))
        return dict(zip(("key", "label", "context", "word"), map(list, zip(*rows, strict=True)), strict=True)) if rows else {"key": [], "label": [], "context": [], "word": []}

    seen = arrow_map(sample, contexts, "key string, label int, context string, word string").groupBy("key").agg(
        F.count_distinct(F.when(F.col("label") == 1, F.col("context"))).alias("toxic"), F.count_distinct(F.when(F.col("label") == 0, F.col("context"))).alias("clean"), F.count_distinct("word").alias("forms")
    )
    limit = 2 * math.log(max(len(chosen), 2) * 100) + 4
    words, stems = {}, {}
    for row in seen.collect():
        t, c = row.toxic, row.clean
        if not t:
            continue
        ratio = 2 * (t * math.log(t / ((t + c) * share)) + (c * math.log(c / ((t + c) * (1 - share))) if c else 0))
        odds = math.log((t + 0.5) / share) - math.log((c + 0.5) / (1 - share))
        if t >= least and ratio > limit and odds > math.log(30):
            if row.key.endswith("*"):
                if row.forms > 2:
                    stems[row.key[:-1]] = odds / 2
            else:
                words[row.key] = odds / 2
    return Lexicon(words, stems)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Newton steps with a ridge on all but the constant."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, found: list[list[float]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.array(found).reshape(-1, 5) @ self.weights, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, held: int = 2, folds: int = 4) -> ToxicityModel:
    """Learn from at most ``most`` labelled documents outside the held fold.

    A lexicon from two thirds of them feeds the logistic fit on the rest; the
    lexicon that is used comes from all.  Without labels every score is one half.
    """
    sample = stored(labelled_sample(docs, labels, "toxic", most, crc_mod("doc_id", folds) != held), "toxic-sample")
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3))
    scorer = ClauseScorer(learn_lexicon(sample.where(part != 0)))

    def run(batch: pa.RecordBatch) -> dict:
        columns = zip(*(scorer.features(t) for t in batch.column("text").to_pylist()), strict=True)
        return {f"x{i}": list(c) for i, c in enumerate(columns)} | {"label": batch.column("label")}

    rows = arrow_map(sample.where(part == 0), run, "x0 double, x1 double, x2 double, x3 double, x4 double, label int").toPandas()
    x, y = rows[[f"x{i}" for i in range(5)]].to_numpy(float).reshape(-1, 5), rows["label"].to_numpy(float)
    model = ToxicityModel(learn_lexicon(sample), logistic(x, y) if len(y) else np.zeros(5))
    discard(sample)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = FIT_ROWS, held: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, score, predicted and n_clauses (matched) of every whole text, other columns left out.

    Only labels of rows outside fold ``held`` (crc32 of the id) are learned
    from.  Null and empty texts match no clause and get the score that clean
    texts get.  Null ids belong to no fold; repeated rows get one result each.
    """
    model = train(docs, labels, most, held, folds)
    scorer = ClauseScorer(model.lexicon)

    def run(batch: pa.RecordBatch) -> dict:
        found = [scorer.features(t) for t in batch.column("text").to_pylist()]
        score = model.score(found)
        return {"doc_id": batch.column("doc_id"), "score": score, "predicted": (score >= threshold).astype(int), "n_clauses": [round(math.expm1(f[3])) for f in found]}

    scored = arrow_map(texts(docs), run, "doc_id long, score double, predicted int, n_clauses long")
    return scored.select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), "score", "predicted", "n_clauses")


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns kept.

    Null and empty texts match no clause and stay; each of repeated rows is
    judged alike; an empty table stays empty, and without labels nothing is
    known and all rows stay.  Long texts are taken in slices of bounded bytes.
    """
    model = train(docs, labels)
    if not model.weights.any():
        return docs
    scorer = ClauseScorer(model.lexicon)

    def run(part: pa.RecordBatch, found: list[str | None]) -> pa.RecordBatch:
        return part.filter(pa.array(model.score([scorer.features(t or "") for t in found]) < threshold))

    return arrow_rows(docs, run)
