"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become classes: insult (with a weight), threat, target, negation, reported speech, or none. Small transducers read
the classes of a clause: negation reaches a few words on, the others remember that their class occurred. Their transitions
and the states that they end in have weights. Composed (states are tuples, weights are products) they make two machines: one
gives what the insults of a clause are worth, one what its threat is worth. A text's score comes from its clauses' weights
by a logistic link.

Insults are seeds, plus words and word beginnings that labelled texts show to be toxic.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import LONG, batch, crc_mod, documents, labels, slices, tidy, words, written
from quire.llm.fit import lasso_logistic
from quire.llm.quality import label_sample

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
#: Labelled rows to learn from, and entries of the learned lexicon, at most.
SAMPLE, LEXICON = 20_000, 20_000
#: Lengths of word beginnings that may become entries, and how much surer than chance an entry must be.
STEMS, SURE = (4, 5, 6), 2.5
NONE, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

SEEDS = {
    INSULT: "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown imbecile dumb vermin crétin salaud ordure minable arschloch dummkopf abschaum widerlich estúpido estúpida basura asqueroso",
    THREAT: "kill murder hurt destroy beat crush tuer détruire frapper töten umbringen vernichten schlagen matar destruir golpear",
    TARGET: "you your yours they them he him she her people tu toi vous ils du dich dir ihr euch sie usted ustedes tú ellos",
    NEGATION: "not never no isn't aren't don't won't pas jamais aucun nicht nie kein keine nunca jamás tampoco",
    REPORT: "said says saying wrote called quoted claimed reported dit écrit sagte schrieb meinte dijo escribió",
}
STRIP = b".,;:!?\"'()[]{}<>|*#$%&-_/\\"
ENDS = (b".", b",", b";", b":", b"!", b"?")
#: Words after a negation that it still reaches.
REACH = 3
#: Features of mentions, the weakest first: negated, reported, plain, targeted.
STRENGTH = (3, 4, 0, 1)
FEATURES = ("plain", "targeted", "threats", "negated", "reported", "strongest", "density")
ROWS = pa.schema([("doc_id", pa.int64())] + [(f, pa.float64()) for f in FEATURES])
TERMS = pa.schema([("term", pa.binary()), ("toxic", pa.int64()), ("clean", pa.int64())])


class Part:
    """One transducer over word classes: its state starts at 0, a step has a weight, and so has the state that a clause ends in.

    As it stands it reads whether a class has occurred, and `ends` are the weights of no and yes.
    """

    def __init__(self, kind: int, ends: tuple[float, float] = (1.0, 1.0)):
        self.kind, self.ends = kind, ends

    def step(self, state: int, kind: int) -> tuple[int, float]:
        return (1 if kind == self.kind else state), 1.0

    def end(self, state: int) -> float:
        return self.ends[state]


class Negation(Part):
    """Its state is how many words the last negation still reaches; an insult within reach is worth `inside`."""

    def __init__(self, inside: float):
        super().__init__(NEGATION)
        self.inside = inside

    def step(self, state: int, kind: int) -> tuple[int, float]:
        return (REACH if kind == NEGATION else max(0, state - 1)), self.inside if kind == INSULT and state else 1.0

    def end(self, state: int) -> float:
        return 1.0


class Machine:
    """Transducers composed: its state is the tuple of theirs, its weights are the products of theirs. States and transitions
    are made as they are met, and kept."""

    def __init__(self, *parts: Part):
        self.parts, self.states, self.known, self.moves, self.ends = parts, [], {}, [], []
        self._state((0,) * len(parts))

    def _state(self, state: tuple[int, ...]) -> int:
        if state not in self.known:
            self.known[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            weight = 1.0
            for part, s in zip(self.parts, state, strict=True):
                weight *= part.end(s)
            self.ends.append(weight)
        return self.known[state]

    def step(self, state: int, kind: int) -> tuple[int, float]:
        found = self.moves[state].get(kind)
        if found is None:
            to, weight = [], 1.0
            for part, s in zip(self.parts, self.states[state], strict=True):
                s, w = part.step(s, kind)
                to.append(s)
                weight *= w
            found = self.moves[state][kind] = self._state(tuple(to)), weight
        return found


#: What a negated insult is worth, one in a clause with a target, in reported speech; and a threat at a target.
DENIED, AIMED, RETOLD, THREATENED = 0.3, 1.25, 0.5, 0.5


class Grammar:
    """Two composed machines, of insults and of threats, and the classes of words."""

    def __init__(self, weights: dict[bytes, float]):
        self.weights = weights
        self.fixed = {w.encode(): k for k, ws in SEEDS.items() if k != INSULT for w in ws.split()}
        self.known: dict[bytes, tuple[int, float]] = {}
        self.insults = Machine(Negation(DENIED), Part(TARGET, (1.0, AIMED)), Part(REPORT, (1.0, RETOLD)))
        self.threats = Machine(Part(THREAT, (0.0, THREATENED)), Part(TARGET, (0.0, 1.0)), Part(REPORT, (1.0, 0.0)))

    def kind(self, word: bytes) -> tuple[int, float]:
        """A word's class and weight; the strongest of the word and its listed beginnings counts."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            core = word.strip(STRIP)
            weight = max([self.weights.get(core, 0.0)] + [self.weights.get(s, 0.0) for s in stems(core)])
            found = (INSULT, weight) if weight > 0 else (self.fixed.get(core, NONE), 0.0)
            if len(word) <= LONG:
                self.known[word] = found
        return found

    def features(self, text: str | None) -> tuple[float, ...]:
        """What the clauses of a whole text say; all 0 where no clause holds an insult or a threat."""
        found = words(text)
        kinds = self.known
        hits = [i for i, w in enumerate(found) if (kinds.get(w) or self.kind(w))[0] in (INSULT, THREAT)]
        out, last, heard = [0.0] * len(FEATURES), -1, {}
        for i in hits:
            if i <= last:
                continue
            first = i
            while first > 0 and not found[first - 1].endswith(ENDS):
                first -= 1
            last = i
            while last < len(found) - 1 and not found[last].endswith(ENDS):
                last += 1
            self._clause(found[first : last + 1], out, heard)
        for rank, weight in heard.values():
            out[STRENGTH[rank]] += weight
        out[6] = (out[0] + out[1] + out[3] + out[4]) / (1 + len(found)) ** 0.5
        return tuple(out)

    def _clause(self, clause: list[bytes], out: list[float], heard: dict[bytes, tuple[int, float]]) -> None:
        """Adds a clause: its threat, its weight if none is stronger, and its insults. An insult counts once in a text, as what
        its strongest mention makes it, so neither the order of clauses nor another mention matters."""
        state = threat = 0
        said = []
        for w in clause:
            kind, weight = self.kind(w)
            before = self.insults.states[state]
            state, share = self.insults.step(state, kind)
            threat, _ = self.threats.step(threat, kind)
            if kind == INSULT:
                said.append((w.strip(STRIP), weight, share, before[0] > 0))
        _, target, report = self.insults.states[state]
        whole = {}
        for core, weight, share, denied in said:
            rank = 0 if denied else 1 if report else 3 if target else 2
            heard[core] = max(heard.get(core, (0, 0.0)), (rank, weight))
            whole[core] = max(whole.get(core, 0.0), weight * share)
        threatened = self.threats.ends[threat]
        out[2] += threatened > 0
        out[5] = max(out[5], sum(whole.values()) * self.insults.ends[state] + threatened)


def stems(core: bytes) -> list[bytes]:
    """Beginnings of a word as lexicon entries, marked so that they differ from whole words."""
    try:
        text = core.decode("utf-8")
    except UnicodeDecodeError:
        return []
    return [text[:n].encode() + b"*" for n in STEMS if len(text) >= n]


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, toxic, clean): labelled texts of either kind that hold a word or a beginning, counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()

        def drain() -> pa.RecordBatch:
            terms = list(seen[0].keys() | seen[1].keys())
            made = batch(TERMS, term=terms, toxic=[seen[1][t] for t in terms], clean=[seen[0][t] for t in terms])
            seen[0].clear()
            seen[1].clear()
            return made

        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cores = {w.strip(STRIP) for w in words(text)}
                seen[int(y)].update(cores.union(*map(stems, cores)))
                if len(seen[0]) + len(seen[1]) > 400_000:
                    yield drain()
        yield drain()

    return sample.select("text", "y").mapInArrow(tidy(run), "term binary, toxic long, clean long").where("term != X''").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon(sample: DataFrame, most: int = LEXICON) -> dict[bytes, float]:
    """Weights of insults: smoothed log-odds of toxic against clean texts that hold the term, scaled to (0, 1]."""
    kinds = {int(r["y"]): r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = kinds.get(1, 0), kinds.get(0, 0)
    out = {w.encode(): 1.0 for w in SEEDS[INSULT].split()}
    if bad and good:
        # odds with half a text added on either side, less one standard error
        odds = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) - F.log(F.lit((bad + 0.5) / (good + 0.5)))
        sure = odds - F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
        listed = term_counts(sample).where("toxic >= 3 AND toxic > clean").withColumn("sure", sure).where(F.col("sure") > SURE)
        for r in listed.orderBy(F.desc("sure"), "term").limit(most).collect():
            out[bytes(r["term"])] = min(1.0, max(out.get(bytes(r["term"]), 0.0), r["sure"] / 6))
    return out


def link_inputs(x: np.ndarray) -> np.ndarray:
    return np.log1p(x)


def learn(sample: DataFrame) -> tuple[dict[bytes, float], np.ndarray, float]:
    """The lexicon, and the weights and intercept of the link; weights can't be negative, so a worse clause never helps."""
    weights = lexicon(sample)
    rows = with_features(sample, weights, "y").toPandas().sort_values(["doc_id", "y"])  # `SAMPLE` labels at most
    coef, bias = lasso_logistic(link_inputs(rows[list(FEATURES)].to_numpy(float)), rows["y"].to_numpy(float), 1e-4, least=0.0)
    return weights, coef, bias


def with_features(docs: DataFrame, weights: dict[bytes, float], *more: str) -> DataFrame:
    schema = pa.schema([*ROWS, *[(c, pa.float64()) for c in more]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(weights)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, k in slices(texts):
                cols = zip(*map(grammar.features, texts[i:k]), strict=True)
                extra = {c: b.column(2 + n).slice(i, k - i) for n, c in enumerate(more)}
                yield batch(schema, doc_id=b.column(0).slice(i, k - i), **dict(zip(FEATURES, map(list, cols), strict=True)), **extra)

    kind = "doc_id long, " + ", ".join(f"{c} double" for c in (*FEATURES, *more))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more).mapInArrow(tidy(run), kind)


def fitted(docs: DataFrame, labelled: DataFrame, sample: int) -> tuple[dict[bytes, float], np.ndarray, float]:
    ids = F.broadcast(label_sample(labelled, "toxic", FOLDS, HELD_OUT, sample))  # bounded by `sample`
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id")
    # of rows of one id the largest text counts, so there are no more texts than labels
    weights, coef, bias = learn(written(met.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y")), "toxic"))
    if not coef.any():
        coef, bias = np.array([1.0, 2.0, 2.0, 0.0, 0.5, 3.0, 0.0]), bias - 2.0
    return weights, coef, bias


def linked(coef: np.ndarray, bias: float, prefix: str = "") -> Column:
    z = F.lit(bias)
    for f, w in zip(FEATURES, coef, strict=True):
        z = z + F.lit(float(w)) * F.log1p(F.col(prefix + f))
    return 1 / (1 + F.exp(-z))


def clean(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that aren't predicted toxic, with all their columns; texts stay where they are.

    Null and empty texts say nothing and stay, unless nearly all labels are toxic; null ids are judged like others; repeated
    rows stay or go together; an empty table stays empty; any other columns are carried, whatever their names.
    """
    weights, coef, bias = fitted(docs, labelled, sample)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(weights)
        for texts in batches:
            yield pd.DataFrame([grammar.features(t) for t in texts], columns=list(FEATURES))

    @F.pandas_udf(", ".join(f"{f} double" for f in FEATURES))
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(run)(batches)

    held = "_quire_clauses"
    return docs.withColumn(held, features(F.col("text").cast("string"))).where(linked(coef, bias, f"{held}.") < THRESHOLD).drop(held)


def score_toxicity(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, and the clause weights) of every row, learned from `sample` labels at most.

    Null and empty texts have no clause and get the score of a text that says nothing; null ids are carried and never
    learned from; repeated rows are scored alike; with no labels the seeds alone decide, from an even prior.
    """
    weights, coef, bias = fitted(docs, labelled, sample)
    scored = with_features(docs, weights).withColumn("score", linked(coef, bias)).withColumn("held_out", crc_mod("doc_id", FOLDS) == HELD_OUT)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *FEATURES)


def op1_clause_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))
