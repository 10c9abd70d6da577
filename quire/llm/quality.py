"""Quality classifier: a sparse ensemble of rules from tree paths, compiled into Spark column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import batch, crc_mod, documents, labels, slices, tidy, written
from quire.llm.fit import lasso_logistic

#: Statistics of a text; shares are of its words, lines or bytes, 0 where there are none.
STATS = ("words", "word_bytes", "different", "repeated", "symbols", "upper", "digits", "bangs", "pipes", "line_words", "line_repeats", "closed", "wide", "blanks")
#: Labelled rows to learn from, at most; trees, their depth, and cuts tried for each statistic.
SAMPLE, TREES, DEPTH, CUTS, PENALTY = 20_000, 24, 3, 24, 1e-3
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
ROWS = pa.schema([("doc_id", pa.int64())] + [(s, pa.float64()) for s in STATS])


def _less(data: bytes, drop: bytes) -> int:
    return len(data) - len(data.translate(None, drop))


def statistics(text: str | None) -> tuple[float, ...]:
    data = text.encode("utf-8", "surrogatepass") if text else b""
    w, size = data.split(), max(1, len(data))
    n, lines = max(1, len(w)), [x for x in data.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    letters = _less(data, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return (
        float(len(w)),
        sum(map(len, w)) / n,
        len(set(w)) / n,
        sum(map(eq, w, w[1:])) / n,
        _less(data, b"#*$%&<>@^~=_{}[]\\") / size,
        _less(data, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / max(1, letters),
        _less(data, b"0123456789") / size,
        _less(data, b"!?") / size,
        _less(data, b"|") / size,
        len(w) / m,
        1 - len(set(lines)) / m if lines else 0.0,
        sum(x.rstrip().endswith((b".", b"!", b"?", b":", b'"')) for x in lines) / m,
        (len(data) - len(text or "")) / size,
        (len(data) - sum(map(len, w))) / size,
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for i, k in slices(texts):
                cols = zip(*map(statistics, texts[i:k]), strict=True)
                yield batch(ROWS, doc_id=keys.slice(i, k - i), **dict(zip(STATS, map(list, cols), strict=True)))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, cut): above means > cut, else <= cut."""

    tests: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, cut in self.tests:
            out &= (x[:, k] > cut) == above
        return out

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for k, above, cut in self.tests:
            value = F.col(prefix + STATS[k])
            out = out & ((value > cut) if above else (value <= cut))
        return out


def grow(x: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, features: np.ndarray, depth: int, tests: tuple, out: list[tuple[Rule, float]], fitted: np.ndarray) -> None:
    """A regression tree on residuals; every path below its root becomes a rule."""
    value = residual[rows].mean()
    if tests:
        out.append((Rule(tests), value))
    best = (1e-9, -1, 0.0)
    if depth and len(rows) >= 40:
        for k in features:
            if not len(cuts[k]):
                continue
            at = np.searchsorted(cuts[k], x[rows, k], side="left")  # x <= cuts[at]
            n = np.bincount(at, minlength=len(cuts[k]) + 1).cumsum()[:-1]
            s = np.bincount(at, residual[rows], minlength=len(cuts[k]) + 1).cumsum()[:-1]
            m, total = len(rows) - n, value * len(rows)
            good = (n >= 10) & (m >= 10)
            gain = np.where(good, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(m, 1) - total**2 / len(rows), 0)
            if gain.max() > best[0]:
                best = (gain.max(), k, cuts[k][gain.argmax()])
    _, k, cut = best
    if k < 0:
        fitted[rows] = value
        return
    low = x[rows, k] <= cut
    grow(x, cuts, residual, rows[low], features, depth - 1, (*tests, (int(k), False, float(cut))), out, fitted)
    grow(x, cuts, residual, rows[~low], features, depth - 1, (*tests, (int(k), True, float(cut))), out, fitted)


def learn(x: np.ndarray, y: np.ndarray) -> tuple[list[tuple[Rule, float]], float]:
    """Rules with lasso weights, and the intercept. Trees are boosted, each on half of the rows and statistics."""
    rnd = np.random.default_rng(7)
    found: list[tuple[Rule, float]] = []
    if len(y) and y.min() != y.max():
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.002, 0.998, CUTS))) for k in range(x.shape[1])]
        score = np.zeros(len(y))
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            rows = np.flatnonzero(rnd.random(len(y)) < 0.5)
            features = rnd.permutation(x.shape[1])[: x.shape[1] // 2]
            if not len(rows):
                continue
            fitted, here = np.zeros(len(y)), []
            grow(x, cuts, y - p, rows, features, DEPTH, (), here, fitted)
            found += here
            for rule, value in here:
                if len(rule.tests) == max(len(r.tests) for r, _ in here):
                    score += 1.0 * value * rule.holds(x)
    rules = list(dict.fromkeys(Rule(tuple(sorted(r.tests))) for r, _ in found))
    if not rules:
        return [], lasso_logistic(np.zeros((len(y), 0)), y, PENALTY)[1]
    held = np.column_stack([r.holds(x) for r in rules]).astype(float)
    weights, bias = lasso_logistic(held, y, PENALTY)
    return [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6], bias


def label_sample(labelled: DataFrame, column: str, folds: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, y) of at most `most` labelled rows outside the held-out fold, the same rows in each run.

    A null id or label is no label; of labels that contradict each other the larger one counts.
    """
    rows = labelled.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (crc_mod("doc_id", folds) != held_out))
    return rows.groupBy("doc_id").agg(F.max(column).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def compiled(rules: list[tuple[Rule, float]], bias: float, prefix: str = "") -> Column:
    """The ensemble as one column expression over the statistics."""
    z = F.lit(bias)
    for rule, weight in rules:
        z = z + F.when(rule.column(prefix), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def fitted(stats: DataFrame, labelled: DataFrame, sample: int) -> tuple[list[tuple[Rule, float]], float]:
    train = stats.join(F.broadcast(label_sample(labelled, "quality", FOLDS, HELD_OUT, sample)), "doc_id").orderBy("doc_id", *STATS).limit(2 * sample)
    pdf = train.toPandas()
    return learn(pdf[list(STATS)].to_numpy(float), pdf["y"].to_numpy(float))


def accepted(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that the classifier accepts, with all their columns; texts stay where they are.

    Null and empty texts have all statistics 0 and are judged by them; null ids are judged like others and never learned from;
    repeated rows stay or go together; without labels the score is 0.5, so nothing stays; an empty table stays empty.
    """
    ids = F.broadcast(label_sample(labelled, "quality", FOLDS, HELD_OUT, sample).select("doc_id"))  # bounded by `sample`
    rules, bias = fitted(written(with_statistics(docs.join(ids, "doc_id", "left_semi")), "quality"), labelled, sample)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([statistics(t) for t in texts], columns=list(STATS))

    @F.pandas_udf(", ".join(f"{s} double" for s in STATS))
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(run)(batches)

    held = "_quire_stats"
    return docs.withColumn(held, stats(F.col("text").cast("string"))).where(compiled(rules, bias, f"{held}.") >= THRESHOLD).drop(held)


def classify(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; rules are learned from `sample` labelled rows at most.

    Each text is read once, for its statistics. Null and empty texts have all statistics 0 and are scored like others;
    null ids are carried and never learned from; repeated rows are scored alike; with no labels the score is 0.5.
    """
    stats = written(with_statistics(docs), "quality")
    rules, bias = fitted(stats, labelled, sample)
    scored = stats.withColumn("score", compiled(rules, bias)).withColumn("held_out", crc_mod("doc_id", FOLDS) == HELD_OUT)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *STATS)


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), labels(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")
