"""Toxicity by a weighted finite-state grammar of clauses.

Words become symbols: insult, violent verb, intent, target, negation, speech, other.  Small weighted
transducers rewrite the symbols of a clause one after the other: threats need an intent before the
verb, negations reach over the next words, a verb of speech covers the rest of its clause, and at
the end of the clause the target decides how the core is addressed.  Their composition is one
machine; what it gives for a clause is a kind of clause and a weight, and a document is scored by its
clauses, not by single words.

Insults are a short list of words plus words and word beginnings that labelled documents show; the
weights of the kinds of clauses are fitted on the same documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.frames import only
from codecorpus.session import stored

#: Labelled documents of each class that the fit uses, as expected by a hash of their ids.
FIT_DOCUMENTS = 20_000
#: Word beginnings of toxic documents that are looked up in clean ones.
CANDIDATES = 20_000
LEXICON = 2_000
SHORTEST, LONGEST = 4, 8
THRESHOLD = 0.3

# Words of the grammar in English, German, French and Spanish.
INSULTS = """idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile dumbass
bastard vermin filth dummkopf arschloch abschaum idioten versager connard imbécile ordure crétin
imbécil estúpido basura escoria idiota""".split()
VIOLENT = """kill hurt destroy shoot stab strangle burn crush töten umbringen erschießen vernichten
tuer frapper écraser détruire matar destruir golpear disparar""".split()
INTENTS = """will gonna going shall should must werde werden wirst soll sollte vais va allons devrait
voy va vamos debe""".split()
TARGETS = """you your yours yourself u they them those these immigrants women men people du dich dir
euch ihr dein deine tu toi te vous ton ta votre vos tú ti usted ustedes vosotros""".split()
NEGATIONS = """not never no isn aren wasn don doesn didn nicht nie kein keine niemals ne pas jamais
aucun no nunca jamás tampoco ningún""".split()
SPEECH = """said says say told tells wrote writes called calls quoted quote claimed claims sagte sagt
schrieb nannte zitierte behauptete dit disait écrit appelé cité dijo dice escribió llamó citó""".split()

# Symbols of words, and of what the transducers make of them.
OTHER, INSULT, VERB, INTENT, TARGET, NEGATION, REPORT, END = range(8)
THREAT, MILD_INSULT, MILD_THREAT, TOLD_INSULT, TOLD_THREAT = range(8, 13)
SYMBOLS = 13
KINDS = ["insult", "threat", "negated", "reported"]
#: A clause of kind k is symbol CLAUSE + 2 * k, plus one if it has a target; 0 kinds: no core.
CLAUSE = 20
CLASSES = [f"{kind}{end}" for kind in KINDS for end in ("", " of a target")]
PRIOR = np.array([3.0, 3.5, 3.0, 3.5, 0.5, 0.8, 0.5, 0.8])
PRIOR_BIAS = -3.0
MOST = 4.0  # weight of a class of clauses beyond which more of it changes nothing
SCOPE = 3  # words that a negation or an intent reaches over


class Transducer:
    """A weighted transducer that gives one symbol for each it reads; state 0 is the start.

    ``arcs`` maps (state, symbol) to (next state, symbol out, weight); what it does not list goes
    to the state ``rest`` gives for the state, unchanged and without weight.
    """

    def __init__(self, arcs: dict, rest=lambda state: state):
        self.arcs, self.rest = arcs, rest

    def step(self, state, symbol: int):
        if (state, symbol) in self.arcs:
            return self.arcs[state, symbol]
        return self.rest(state), symbol, 0.0


class Composed(Transducer):
    """Reads with ``first`` and gives what ``second`` makes of its symbols; weights add up."""

    def __init__(self, first: Transducer, second: Transducer):
        self.first, self.second = first, second

    def step(self, state, symbol: int):
        a, b = state or (0, 0)
        a, between, one = self.first.step(a, symbol)
        b, out, two = self.second.step(b, between)
        return (0 if (a, b) == (0, 0) else (a, b)), out, one + two


def _reach(opens: int, rewrites: dict[int, tuple[int, float]], fails: dict | None = None) -> Transducer:
    """After ``opens``, symbols within the next SCOPE words are rewritten; else as ``fails`` says."""
    arcs = {}
    for left in range(SCOPE + 1):
        arcs[left, opens] = (SCOPE, opens, 0.0)
        arcs[left, END] = (0, END, 0.0)
        for symbol, (out, weight) in (rewrites if left else fails or {}).items():
            arcs[left, symbol] = (max(left - 1, 0), out, weight)
    return Transducer(arcs, lambda left: max(left - 1, 0))


def threats() -> Transducer:
    """A violent verb after an intent is a threat; without one it is any other word."""
    return _reach(INTENT, {VERB: (THREAT, 0.5)}, {VERB: (OTHER, 0.0)})


def negations() -> Transducer:
    return _reach(NEGATION, {INSULT: (MILD_INSULT, 0.0), THREAT: (MILD_THREAT, 0.0)})


def reported() -> Transducer:
    """From a verb of speech to the end of the clause, cores are someone else's words."""
    told = {INSULT: TOLD_INSULT, THREAT: TOLD_THREAT}
    arcs = {(0, REPORT): (1, REPORT, 0.0), (1, END): (0, END, 0.0)}
    arcs |= {(1, core): (1, out, 0.0) for core, out in told.items()}
    return Transducer(arcs)


def targets() -> Transducer:
    """Gives the kind of a clause at its end: its strongest core and whether a target is in it."""
    core_of = {
        INSULT: 0, THREAT: 1, MILD_INSULT: 2, MILD_THREAT: 2, TOLD_INSULT: 3, TOLD_THREAT: 3,
    }
    strength = {None: 0, 3: 1, 2: 2, 0: 3, 1: 4}
    names = {
        (core, target): 0 if (core, target) == (None, 0) else (core, target)
        for core in strength
        for target in (0, 1)
    }
    arcs = {}
    for (core, target), state in names.items():
        arcs[state, TARGET] = (names[core, 1], TARGET, 0.0)
        for symbol, other in core_of.items():
            strongest = max((core, other), key=strength.__getitem__)
            arcs[state, symbol] = (names[strongest, target], symbol, 0.0)
        out = END if core is None else CLAUSE + 2 * core + target
        arcs[state, END] = (0, out, 0.0)
    return Transducer(arcs)


def compiled(machine: Transducer) -> tuple[list[list[int]], list[list[int]], list[list[float]]]:
    """Tables next[state][symbol], out and weight of the states that words can reach."""
    numbers, todo = {0: 0}, [0]
    nexts, outs, weights = [], [], []
    while len(nexts) < len(todo):
        steps = [machine.step(todo[len(nexts)], symbol) for symbol in range(END + 1)]
        for state, _, _ in steps:
            if state not in numbers:
                numbers[state] = len(todo)
                todo.append(state)
        nexts.append([numbers[state] for state, _, _ in steps])
        outs.append([out for _, out, _ in steps])
        weights.append([weight for _, _, weight in steps])
    return nexts, outs, weights


def grammar():
    """The composition of all transducers as tables."""
    return compiled(reduce(Composed, [threats(), negations(), reported(), targets()]))


WORD = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;\n]")


@dataclass
class Model:
    """``stems`` maps a word beginning (whole words end in ``=``) to the weight of an insult."""

    stems: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    bias: float = PRIOR_BIAS

    def score(self, sums: np.ndarray) -> np.ndarray:
        z = self.bias + np.minimum(sums, MOST) @ self.weights
        return 1 / (1 + np.exp(-z))


class Matcher:
    """Finds the clauses with a core in a text."""

    def __init__(self, stems: dict[str, float]):
        self.tables = grammar()
        self.stems = stems
        self.cues = {}
        lists = (VERB, VIOLENT), (INTENT, INTENTS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, SPEECH)
        for symbol, words in lists:
            self.cues |= dict.fromkeys(words, symbol)
        self.lengths = sorted({len(s) for s in stems if not s.endswith("=")}, reverse=True)
        self.cores = ahocorasick.Automaton()
        for text in {s.rstrip("=") for s in stems} | set(VIOLENT):
            self.cores.add_word(text, len(text))
        self.cores.make_automaton()

    def insult(self, word: str) -> float:
        """The weight of a word as an insult: as a whole word, else by its longest beginning."""
        whole = self.stems.get(word + "=")
        if whole is not None:
            return whole
        for length in self.lengths:
            if length <= len(word) and word[:length] in self.stems:
                return self.stems[word[:length]]
        return 0.0

    def clauses(self, text: str) -> Iterator[tuple[int, int, int, float]]:
        """(start, end, class, weight) of clauses with a core, in code points."""
        folded = text.lower()
        if len(folded) != len(text):  # a few capitals grow when folded; keep the places
            folded = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        done = 0
        for last, length in self.cores.iter(folded):
            start = last - length + 1
            if start < done or (start and WORD.match(folded[start - 1])):
                continue
            begin = done
            for sign in CLAUSE_END.finditer(folded, done, start):
                begin = sign.end()
            sign = CLAUSE_END.search(folded, start)
            end = sign.start() if sign else len(folded)
            found = self.read(folded[begin:end])
            if found:
                yield begin, end, *found
            done = end

    def read(self, clause: str) -> tuple[int, float] | None:
        """Class and weight of one clause."""
        nexts, outs, weights = self.tables
        state, total = 0, 0.0
        for word in WORD.findall(clause):
            insult = self.insult(word)
            symbol = INSULT if insult > 0 else self.cues.get(word, OTHER)
            total += insult + weights[state][symbol]
            state = nexts[state][symbol]
        out = outs[state][END]
        # A threat weighs as an insult does, plus what its transducer adds.
        if out < CLAUSE:
            return None
        return out - CLAUSE, total + (1.0 if (out - CLAUSE) // 2 == 1 else 0.0)

    def sums(self, text: str | None) -> np.ndarray:
        """Weight per class of clauses."""
        result = np.zeros(len(CLASSES))
        for _, _, kind, weight in self.clauses(text or ""):
            result[kind] += weight
        return result


def held_out(ident: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is 2 modulo 4."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % 4 == 2


def labelled(documents: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, most: int) -> DataFrame:
    """(text, toxic, weight) of labelled documents that may be learned from.

    About ``most`` of each class by a hash of the id, so the size does not grow with the corpus;
    ``weight`` is the inverse of the sampled share.  Of contradicting labels the toxic one counts.
    """
    marks = only(labels, _id=id_column, toxic=label_column)
    marks = stored(
        marks.where(F.col("_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("_id")))
        .groupBy("_id")
        .agg((F.max("toxic") == 1).alias("toxic"))
    )
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {toxic: min(1.0, most / n) for toxic, n in sizes.items()}
    limit = F.when(F.col("toxic"), share.get(True, 1.0)).otherwise(share.get(False, 1.0))
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / float(1 << 30)
    sampled = marks.where(place < limit).withColumn("weight", 1 / limit)
    docs = only(documents, _id=id_column, text=text_column).where(F.col("text").isNotNull())
    joined = docs.join(F.broadcast(sampled), "_id")  # bounded by `most`
    return stored(joined.select("text", "toxic", "weight"))


def features_of(word: str) -> Iterable[str]:
    """The word itself and its beginnings."""
    yield word + "="
    for length in range(SHORTEST, min(LONGEST, len(word)) + 1):
        yield word[:length]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (feature, word before, word after)."""
    for batch in batches:
        found = set()
        for text in batch.column(0).to_pylist():
            words = ["", *WORD.findall(text.lower()), ""]
            for before, word, after in zip(words, words[1:], words[2:]):
                if len(word) < SHORTEST:
                    continue
                context = hash_of(f"{before} {word} {after}")
                found.update((feature, context) for feature in features_of(word))
        names, contexts = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(contexts, pa.int64())], ["feature", "context"]
        )


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def learned_stems(rows: DataFrame, candidates: int = CANDIDATES, most: int = LEXICON) -> dict[str, float]:
    """Word beginnings that mark toxic documents, with weights.

    How common a feature is in toxic documents is counted in distinct contexts (the words around
    it), so that copies of a document do not make its chance words look like insults.  Features that
    clean documents hold nearly as often are no insults.  Then features are chosen one by one, each
    for the toxic documents that no earlier one explains; chance words of documents that a known
    insult explains are left out in this way.
    """
    toxic = rows.where("toxic").select("text")
    common = (
        toxic.mapInArrow(_contexts, "feature string, context long")
        .groupBy("feature")
        .agg(F.countDistinct("context").alias("contexts"))
        .where("contexts >= 2")
        .orderBy(F.desc("contexts"), "feature")
        .limit(candidates)
        .collect()
    )
    seeds = {word + "=" for word in INSULTS}
    contexts = {r["feature"]: r["contexts"] for r in common}
    known = set(contexts) | seeds

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(feature, toxic, documents with it) added up per batch."""
        for batch in batches:
            counts: dict = {}
            for text, is_toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(WORD.findall(text.lower()))
                for feature in {f for w in words for f in features_of(w) if f in known}:
                    counts[feature, is_toxic] = counts.get((feature, is_toxic), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f for f, _ in counts], pa.string()),
                    pa.array([t for _, t in counts], pa.bool_()),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                ["feature", "toxic", "n"],
            )

    held = (
        rows.select("text", "toxic")
        .mapInArrow(holding, "feature string, toxic boolean, n long")
        .groupBy("feature", "toxic")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    holds = {(r["feature"], r["toxic"]): r["n"] for r in held}
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}

    def odds(feature: str) -> float:
        """Log of how much more common the feature is in toxic documents."""
        shares = [
            (holds.get((feature, t), 0) + 0.5) / (sizes.get(t, 0) + 1) for t in (True, False)
        ]
        return float(np.log(shares[0] / shares[1]))

    def weight(feature: str) -> float:
        seen = holds.get((feature, True), 0) + holds.get((feature, False), 0)
        return 1.0 if seen < 5 else float(np.clip(odds(feature) / 3, 0.05, 1.5))

    stems = {seed: weight(seed) for seed in seeds}
    precise = {
        f: n for f, n in contexts.items()
        # At most one clean document for every fifty that the same share of toxic ones would give.
        if odds(f) >= 2.5 and 50 * holds.get((f, False), 0) <= holds.get((f, True), 0)
    }

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best few features of each toxic document."""
        for batch in batches:
            best = []
            for text in batch.column(0).to_pylist():
                words = set(WORD.findall(text.lower()))
                if any(stems.get(word + "=", 0) >= 0.5 for word in words):
                    best.append([])
                    continue
                mine = {f for w in words for f in features_of(w) if f in precise}
                best.append(sorted(mine, key=lambda f: (-precise[f], -len(f), f))[:8])
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.list_(pa.string()))], ["best"])

    open_documents = [
        set(r["best"]) for r in toxic.mapInArrow(telling, "best array<string>").where("size(best) > 0").collect()
    ]
    while open_documents and len(stems) < most:
        gains: dict = {}
        for best in open_documents:
            for feature in best:
                gains[feature] = gains.get(feature, 0) + 1
        # Of features that explain the same documents, the longest beginning says most.
        feature = max(gains, key=lambda f: (min(gains[f], precise[f]), len(f), f))
        if min(gains[feature], precise[feature]) < 2:
            break
        stems[feature] = max(weight(feature), 0.5)
        open_documents = [best for best in open_documents if feature not in best]
    return stems


def fitted(sums: np.ndarray, toxic: np.ndarray, weight: np.ndarray, pull: float = 2.0) -> tuple[np.ndarray, float]:
    """Logistic weights per class of clauses, pulled to the prior and never negative."""
    x = np.hstack([np.minimum(sums, MOST), np.ones((len(sums), 1))])
    prior = np.append(PRIOR, PRIOR_BIAS)
    beta = prior.copy()
    if len(x) and toxic.any() and not toxic.all():
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ beta))
            slope = x.T @ (weight * (p - toxic)) + pull * (beta - prior)
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(beta))
            step = np.linalg.solve(curve, slope)
            beta = beta - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
            beta[:-1] = np.maximum(beta[:-1], 0.0)
            if np.abs(step).max() < 1e-8:
                break
    return beta[:-1], float(beta[-1])


def fit(
    documents: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    most: int = FIT_DOCUMENTS,
) -> Model:
    """Learns insults and the weights of clauses from documents that are not held out.

    At most about ``most`` documents of each class are used, so what reaches the driver is bounded:
    ``CANDIDATES`` counted features, eight features for each unexplained toxic document and eight sums per
    document.  Without labels of both classes the built-in words and weights stay.
    """
    rows = labelled(documents, labels, id_column, text_column, label_column, most)
    stems = learned_stems(rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(stems)
        for batch in batches:
            sums = [matcher.sums(text).tolist() for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sums, pa.list_(pa.float64())), batch.column(1), batch.column(2)],
                ["sums", "toxic", "weight"],
            )

    measured = rows.mapInArrow(measure, "sums array<double>, toxic boolean, weight double").collect()
    # In one order, so that reruns agree to the last digit.
    measured = sorted((r["sums"], r["toxic"], r["weight"]) for r in measured)
    sums = np.array([m[0] for m in measured], float).reshape(-1, len(CLASSES))
    toxic = np.array([m[1] for m in measured], float)
    weight = np.array([m[2] for m in measured], float)
    return Model(stems, *fitted(sums, toxic, weight))


def score(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(_id, held_out, score, clauses), one row per document row, row-local over whole texts.

    ``clauses`` lists what was matched: start and end in code points, the kind, and its weight.  A
    text that is null, empty or without a matched clause gets the score of no clause.  Repeated rows
    get equal scores; other columns are ignored.
    """
    docs = only(documents, _id=id_column, _text=text_column)
    docs = docs.select("_id", held_out(F.col("_id")).alias("held_out"), "_text")
    ident = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.stems)
        clause = pa.list_(
            pa.struct(
                [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("weight", pa.float64())]
            )
        )
        for batch in batches:
            found = []
            sums = np.zeros((batch.num_rows, len(CLASSES)))
            for i, text in enumerate(batch.column(2)):
                mine = list(matcher.clauses(text.as_py() or ""))
                for _, _, kind, weight in mine:
                    sums[i, kind] += weight
                found.append(
                    [{"start": s, "end": e, "kind": CLASSES[k], "weight": w} for s, e, k, w in mine]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(model.score(sums), pa.float64()),
                    pa.array(found, clause),
                ],
                ["_id", "held_out", "score", "clauses"],
            )

    return docs.mapInArrow(
        run,
        f"_id {ident}, held_out boolean, score double, "
        "clauses array<struct<start:int,end:int,kind:string,weight:double>>",
    )


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fits on labels and scores all documents; ``predicted`` is 1 from ``threshold`` on."""
    rows = score(documents, fit(documents, labels))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
