"""Language-model scores of texts by a log-bilinear model, trained by noise-contrastive estimation.

Words are counted by Spark over all training texts. Each word that occurs often enough is a symbol of its own; how often
that is grows with the root of the corpus, so that the vocabulary grows too and still fits a task. The others share a
symbol by their endings, so such a word is a symbol, and its share of the symbol's words. Symbols are dealt to classes
by frequency. The model gives the next symbol from the two before: their vectors, each turned by the matrix of its place,
are added up, times the vector of the next symbol's class and of the next symbol, plus biases.

It learns from all training texts as they stream through the tasks, which tell each class and each symbol from sampled
noise; the tasks' moves are then added up where a symbol is rare and averaged where it is frequent. The number of tasks
that learn side by side grows with the root of the corpus, as each passes on what it has moved. In scoring, matrix products
give all classes' scores after each context, and those of all symbols of the next symbol's class; both are normalised, so
the probabilities of all symbols add up to one. Words too rare to be sent to every task are joined to their counts.

Texts are read twice, to count their words and to write their symbols; learning and scoring read the symbols.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import LONG, batch, crc_mod, documents, slices, tidy, words, written

FOLDS, HELD_OUT = 10, 0
SMOOTH = 0.1
#: A word has a symbol of its own from LEAST occurrences, or from the root of all over ROOTS if that is more; symbols that
#: the others share. The end of a text is the last symbol.
LEAST, ROOTS, SHARED = 100, 10, 256
#: Words whose counts go to every task.
FREQUENT = 100_000
#: Size of a vector, symbols before the next one; symbols, noise words and noise classes of a step, and its length.
WIDTH, CONTEXT, PAIRS, SAMPLED, CLASSES, RATE = 16, 2, 1024, 32, 16, 0.3
#: Tokens scored at a time, and scores made at a time, which a core's cache holds; bytes of symbols that work arrays are made for.
AT_ONCE, SCORES, LAID = 1 << 16, 1 << 17, 1 << 18
#: How often a task meets a symbol, up to which the tasks' moves are added up.
FEW = 30
#: Tasks that learn side by side, as a share of the root of the tokens; below ENOUGH tokens texts are read again, for ROUNDS at most.
SIDE, ENOUGH, ROUNDS = 0.002, 20_000_000, 6
END = b""
COUNTED = 400_000
ROWS = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("base", pa.float64()), ("shares", pa.float64()), ("symbols", pa.binary()), ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int32())),
])


def ending(word: bytes) -> int:
    return crc32(word[-3:]) % SHARED


def training(docs: DataFrame) -> DataFrame:
    return docs.where(crc_mod("doc_id", FOLDS) != HELD_OUT).select(F.col("text").cast("string"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of the training texts; the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def drain() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "c"])
            seen.clear()
            return out

        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(words(text))
                seen[END] += 1
                if len(seen) > COUNTED:
                    yield drain()
        yield drain()

    return training(docs).mapInArrow(tidy(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Symbols(dict):
    """Words to symbols, kept as they are met."""

    def __init__(self, own: dict[bytes, int], first: int):
        super().__init__(own)
        self.own, self.first = own, first

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000 + len(self.own):
            self.clear()
            self.update(self.own)
        s = self.first + ending(word)
        if len(word) <= LONG:
            self[word] = s
        return s


def most_frequent(counts: DataFrame, most: int = FREQUENT) -> list[tuple[bytes, int]]:
    """The most frequent words and their counts, `most` at most: all above a step of the scale of counts, found from how
    many words each step has, so that no task or driver sorts the vocabulary."""
    step = F.floor(F.log2("c") * 16)
    room, low = most, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # 16 steps a doubling
        room -= r["n"]
        if room < 0:
            break
        low = r["step"]
    if low is None:
        return []
    found = counts.where(step >= low).toArrow().to_pydict()
    return sorted(zip(found["word"], found["c"], strict=True), key=lambda x: (-x[1], x[0]))


def own_words(counts: DataFrame, total: int) -> list[tuple[bytes, int]]:
    """All words that occur often enough, and their counts; at most ROOTS times the root of `total`."""
    found = counts.where(F.col("c") >= max(LEAST, total**0.5 / ROOTS)).toArrow().to_pydict()
    return sorted(zip(found["word"], found["c"], strict=True), key=lambda x: (-x[1], x[0]))


def own_symbols(often: list[tuple[bytes, int]]) -> dict[bytes, int]:
    """Words to symbols; symbols that others share come after them, and the end of a text last."""
    out = {w: k for k, (w, _) in enumerate(x for x in often if x[0] != END)}
    return out | {END: len(out) + SHARED}


def contexts(symbols: np.ndarray, starts: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols before, nearest first; next symbols) of texts laid end to end; a text starts after ends."""
    before = np.empty((len(symbols), CONTEXT), np.int64)
    for k in range(CONTEXT):
        before[k + 1 :, k] = symbols[: len(symbols) - k - 1]
        for ahead in range(k + 1):
            at = starts + ahead
            before[at[at < len(symbols)], k] = last
    return before, symbols


def stored(n: int) -> str:
    """How symbols below `n` are written."""
    return "<u2" if n <= 1 << 16 else "<u4"


def laid(texts: list[bytes], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(symbols, starts) of texts' written symbols laid end to end, some texts at a time."""
    size = np.dtype(kind).itemsize
    for i, k in slices(texts, LAID):
        ends = np.cumsum([len(t) // size for t in texts[i:k]])
        yield np.frombuffer(b"".join(texts[i:k]), kind).astype(np.int64), np.append(0, ends[:-1])


def rare_words(line: list[bytes], places: np.ndarray, ends: np.ndarray) -> list[Counter[bytes]]:
    """The words at some places of texts laid end to end, counted for each text."""
    cuts = np.searchsorted(places, ends)
    names = [line[x] for x in places.tolist()]
    return [Counter(names[a:b]) for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]


class LogBilinear:
    """score(next, before) = next vector . sum of (before vector @ matrix of its place) + bias, for symbols and their classes.

    Classes are rows behind those of the symbols. A class holds symbols of like frequency; each has about the same sum of
    roots of frequencies, so frequent symbols lie in small classes. The width is even.
    """

    def __init__(self, unigram: np.ndarray, width: int = WIDTH, seed: int = 3):
        rnd, n = np.random.default_rng(seed), len(unigram)
        self.order = np.argsort(-unigram, kind="stable")
        roots = np.sqrt(unigram[self.order])
        spread = np.minimum(((np.cumsum(roots) - roots) / roots.sum() * max(1, round(n**0.5))).astype(np.int64), n - 1)
        _, of = np.unique(spread, return_inverse=True)  # without classes that no symbol is in
        self.starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        self.of, self.place = np.empty(n, np.int64), np.empty(n, np.int64)
        self.of[self.order], self.place[self.order] = of, np.arange(n) - self.starts[of]
        self.n, self.unigram = n, np.concatenate([unigram, np.add.reduceat(unigram[self.order], self.starts)])
        self.before = rnd.normal(0, 0.3, (n, width)).astype(np.float32)
        self.turn = np.stack([np.eye(width, dtype=np.float32) / (1 + k) for k in range(CONTEXT)])
        self.next = np.zeros((len(self.unigram), width), np.float32)
        self.bias = np.log(self.unigram).astype(np.float32)

    def start(self, seed: int, tokens: int) -> None:
        """Makes ready to learn in a task. Sums of squared slopes start with their share of what all tokens will add, or
        rare symbols, whose noise comes seldom and in lumps, would rise too far before it."""
        self.rnd = np.random.default_rng(seed)
        self.levels = [(0, np.cumsum(self.unigram[: self.n]), SAMPLED), (self.n, np.cumsum(self.unigram[self.n :]), CLASSES)]
        drawn = np.repeat([SAMPLED, CLASSES], [self.n, len(self.unigram) - self.n])
        self.noise = np.log(drawn * self.unigram).astype(np.float32)
        times = tokens * self.unigram
        due = 0.3 * times * (1 + drawn * PAIRS / (drawn + 1) ** 2)
        self.squares = [x.astype(np.float32) for x in (0.05 + 0.01 * times[: self.n], 1 + 0.2 * due, 1 + due)] + [np.full_like(self.turn, 1.0)]
        self.met = np.zeros(len(self.unigram), bool)

    def _move(self, rows: np.ndarray, *moves: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Moves rows of (table, squares) against their slopes, the steps shortened by what has been moved before."""
        order = _sorted(rows, len(self.unigram))
        at = rows.take(order)
        edge = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        at = at.take(edge)
        for slopes, table, squares in moves:
            if slopes.ndim == 1:
                g = np.add.reduceat(slopes.take(order), edge)
                held = squares.take(at) + g**2
                table[at] = table.take(at) - RATE / np.sqrt(held) * g
            else:
                # sums of pairs of floats as of complex numbers: the same sums in half the calls
                g = np.add.reduceat(slopes.take(order, 0).view(np.complex64), edge, axis=0).view(np.float32)
                held = squares.take(at) + np.einsum("ij,ij->i", g, g) / g.shape[1]
                g *= (RATE / np.sqrt(held))[:, None]
                table[at] = table.take(at, 0) - g
            squares[at] = held

    def learn(self, before: np.ndarray, following: np.ndarray) -> None:
        """Tells the symbols of each step, and their classes, from noise drawn for it by frequency."""
        width, shape = self.before.shape[1], self.turn.shape
        for i in range(0, len(following), PAIRS):
            c, t = before[i : i + PAIRS].ravel(), following[i : i + PAIRS]
            r = self.before.take(c, 0).reshape(len(t), -1)  # the vectors of a context side by side
            turn = self.turn.reshape(-1, width)
            q = r @ turn
            gq, rows, slopes, lift = 0, [], [], []
            for (first, ladder, drawn), own in zip(self.levels, (t, self.n + self.of.take(t)), strict=True):
                n = first + np.minimum(np.searchsorted(ladder, self.rnd.random(drawn) * ladder[-1]), len(ladder) - 1)
                true, other = self.next.take(own, 0), self.next.take(n, 0)
                gt = _sigmoid(0.5 * (np.einsum("ij,ij->i", q, true) + self.bias.take(own) - self.noise.take(own))) - 1
                gn = q @ (0.5 * other).T
                gn += 0.5 * (self.bias[n] - self.noise[n])
                gn = _sigmoid(gn)
                true *= gt[:, None]
                true += gn @ other
                gq = gq + true
                rows += [own, n]
                slopes += [gt[:, None] * q, gn.T @ q]
                lift += [gt, np.ones(len(t), np.float32) @ gn]
            back, g = gq @ turn.T, (r.T @ gq).reshape(shape)
            self.squares[3] += g**2
            at = np.concatenate(rows)
            self.met[at] = True
            self.met[c] = True
            self._move(at, (np.concatenate(slopes), self.next, self.squares[1]), (np.concatenate(lift), self.bias, self.squares[2]))
            self._move(c, (back.reshape(-1, width), self.before, self.squares[0]))
            self.turn -= RATE / 2 * g / np.sqrt(self.squares[3])

    def rows(self) -> np.ndarray:
        """All vectors and biases, a row a symbol or class; classes have no vector as context."""
        before = np.vstack([self.before, np.zeros((len(self.next) - self.n, self.before.shape[1]), np.float32)])
        return np.hstack([before, self.next, self.bias[:, None]])

    def add(self, at: np.ndarray, moves: np.ndarray) -> None:
        width, own = self.before.shape[1], at < self.n
        self.before[at[own]] += moves[own, :width]
        self.next[at] += moves[:, width : 2 * width]
        self.bias[at] += moves[:, -1]

    def log10(self, before: np.ndarray, following: np.ndarray) -> np.ndarray:
        """log10 probabilities of next symbols: of the class among classes, times of the symbol among those of its class."""
        out, ends = np.empty(len(following)), np.append(self.starts[1:], self.n)
        turned = [self.before @ m for m in self.turn]
        rows = np.hstack([self.next, self.bias[:, None]])  # times a vector and 1
        classes, members = rows[self.n :], rows.take(self.order, 0)
        for i in range(0, len(out), AT_ONCE):
            c, t = before[i : i + AT_ONCE], following[i : i + AT_ONCE]
            kind = self.of.take(t)
            order = _sorted(kind, len(classes))
            t, kind = t.take(order), kind.take(order)
            q = np.ones((len(t), rows.shape[1]), np.float32)
            q[:, :-1] = sum(x.take(c[:, k].take(order), 0) for k, x in enumerate(turned))
            made = _chosen(q, classes, kind)
            edge = np.flatnonzero(np.append(True, np.diff(kind) != 0))
            place = self.place.take(t)
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(t)], strict=True):
                k = kind[a]
                if ends[k] - self.starts[k] > 1:
                    made[a:b] += _chosen(q[a:b], members[self.starts[k] : ends[k]], place[a:b])
            out[i + order] = made
        return out / np.log(10)


def _sorted(x: np.ndarray, n: int) -> np.ndarray:
    """The order of numbers below `n`; 16 bits are sorted by their digits, which is faster."""
    return np.argsort(x.astype(np.uint16), kind="stable") if n <= 1 << 16 else np.argsort(x, kind="stable")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-2 * x)), in place, without overflow."""
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _chosen(q: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log of one row's share of the exponentials of all rows' products with each of `q`."""
    out, n = np.empty(len(at)), len(rows)
    step, ones, turned = max(64, SCORES // n), np.ones(n, np.float32), np.ascontiguousarray(rows.T)
    for i in range(0, len(at), step):
        some = at[i : i + step]
        scores = q[i : i + step] @ turned
        if scores.max() > 40:  # learned scores are logs of shares already, and lie far below
            scores -= scores.max(axis=1, keepdims=True)
        own = scores.ravel().take(np.arange(0, len(some) * n, n) + some)
        out[i : i + step] = own - np.log(np.exp(scores, out=scores) @ ones)
    return out


def trained(texts: DataFrame, unigram: np.ndarray, tokens: int) -> LogBilinear:
    """The model after the written symbols of all training texts have streamed through it, once, or in some rounds if they are few."""
    model, last, written_as = LogBilinear(unigram), len(unigram) - 1, stored(len(unigram))
    if not tokens:
        return model
    side = max(2, round(SIDE * tokens**0.5))

    def shard(at: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([r.astype("<f4").tobytes() for r in rows], pa.binary())], names=["id", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.start(1000 * TaskContext.get().partitionId() + turn, tokens)
        first, matrices = model.rows(), model.turn.copy()
        for b in batches:
            for symbols, starts in laid(b.column(0).to_pylist(), written_as):
                model.learn(*contexts(symbols, starts, last))
        at = np.flatnonzero(model.met)
        if len(at):
            moved = model.rows() - first
            for i in range(0, len(at), 8192):
                yield shard(at[i : i + 8192], moved[at[i : i + 8192]])
            yield shard(np.array([-1]), np.append((model.turn - matrices).ravel(), 1)[None, :])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for key, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(row, "<f4")
                total[key] = total[key] + x if key in total else x
        keys = list(total)
        for i in range(0, len(keys), 8192):
            yield shard(np.array(keys[i : i + 8192]), [total[k] for k in keys[i : i + 8192]])

    kind = "id long, row binary"
    for turn in range(max(1, min(ROUNDS, -(-ENOUGH // tokens)))):
        found = texts.coalesce(side).mapInArrow(tidy(run), kind).repartition("id").mapInArrow(tidy(added), kind).toArrow().to_pydict()  # a row a symbol
        moves = dict(zip(found["id"], found["row"], strict=True))
        matrices = np.frombuffer(moves.pop(-1), "<f4")
        tasks = matrices[-1]
        model.turn = model.turn + matrices[:-1].reshape(model.turn.shape) / tasks
        at = np.fromiter(moves.keys(), np.int64, len(moves))
        model.add(at, np.stack([np.frombuffer(r, "<f4") for r in moves.values()]) / np.clip(tokens * model.unigram[at] / tasks / FEW, 1, tasks)[:, None].astype(np.float32))
    return model


def class_masses(counts: DataFrame, own: dict[bytes, int]) -> np.ndarray:
    """Smoothed counts of the words that share each symbol, with one unseen word each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, n = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
        for b in batches:
            found = b.column(0).to_pylist()
            at = np.fromiter((SHARED if w in own else ending(w) for w in found), np.int64, len(found))
            c = b.column(1).to_numpy(zero_copy_only=False)
            mass += np.bincount(at, c, SHARED + 1)[:SHARED].astype(np.int64)
            n += np.bincount(at, minlength=SHARED + 1)[:SHARED]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHARED)), pa.array(mass), pa.array(n)], names=["k", "c", "n"])

    out = np.full(SHARED, SMOOTH)
    for r in counts.mapInArrow(tidy(run), "k long, c long, n long").groupBy("k").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect():
        out[r["k"]] = r["c"] + SMOOTH * (r["n"] + 1)
    return out


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Null and empty texts are the end alone. Null ids count as the id of empty text when folds are dealt, and are
    carried. Repeated rows train and are scored one by one. Without training texts, known words are none and symbols
    are equally likely.
    """
    counts = written(word_counts(docs), "words")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    frequent, often = most_frequent(counts), own_words(counts, total["n"])
    ends = counts.where(F.col("word") == F.lit(bytearray(END))).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()["n"]
    frequent = max(frequent, often, key=len)  # both are the words above some count
    own = own_symbols(often)
    masses, alone = class_masses(counts, own), len(own) - 1
    weights = np.concatenate([[c for w, c in often if w != END], masses, [ends + SMOOTH]]).astype(float)
    unigram, share = weights / weights.sum(), np.log10(masses)
    whole = np.log10(total["n"] + SMOOTH * (total["v"] + 1))
    listed = [(w, c) for w, c in frequent if w != END]
    # words by their places in arrays of symbols and of logs; the text end is the last, other words' shared symbols stand behind it
    end, last, written_as = len(listed), alone + SHARED, stored(len(unigram))
    place = {w: k for k, (w, _) in enumerate(listed)} | {END: end}
    symbols = np.array([own.get(w, alone + ending(w)) for w, _ in listed] + [last, *range(alone, last)], np.int64)
    counted = np.append(np.log10(np.array([c for _, c in listed] + [ends], float) + SMOOTH), np.zeros(SHARED))  # the others' are joined later
    if not ends:
        counted[end] = 0.0
    tail = (symbols >= alone) & (symbols < last)
    parts = np.where(tail, counted - share[np.where(tail, symbols - alone, 0)], 0.0)  # of a word in its symbol

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, row = Symbols(place, end + 1), TaskContext.get().partitionId() << 40
        for b in batches:
            keys, texts, out = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            for i, k in slices(texts):
                line, ends_ = [], []
                for text in texts[i:k]:
                    line += words(text)
                    line.append(END)
                    ends_.append(len(line))
                at = np.fromiter(map(found.__getitem__, line), np.int64, len(line))
                gaps, ends_ = np.flatnonzero(at > end), np.array(ends_)
                starts = np.append(0, ends_[:-1])
                rare = rare_words(line, gaps if ends else np.union1d(gaps, ends_ - 1), ends_)
                sizes, laid_out = ends_ - starts, symbols.take(at).astype(written_as)
                yield batch(
                    ROWS, row=np.arange(row, row + k - i), doc_id=keys[i:k], held_out=out[i:k], n_tokens=sizes, n_known=sizes - [x.total() for x in rare],
                    base=np.add.reduceat(counted.take(at), starts) - sizes * whole, shares=np.add.reduceat(parts.take(at), starts),
                    symbols=[laid_out[a:b].tobytes() for a, b in zip(starts.tolist(), ends_.tolist(), strict=True)], rare=[list(x.keys()) for x in rare], times=[list(x.values()) for x in rare],
                )
                row += k - i

    kind = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, shares double, symbols binary, rare array<binary>, times array<int>"
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"))
    texts = written(source.mapInArrow(tidy(run), kind), "symbols")
    net = trained(texts.where(~F.col("held_out")).select("symbols"), unigram, total["n"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [np.add.reduceat(net.log10(*contexts(line, starts, last)), starts) for line, starts in laid(b.column("symbols").to_pylist(), written_as)]
            yield b.drop_columns(["symbols"]).append_column("model", pa.array(np.concatenate([np.empty(0), *made])))

    kind = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, shares double, model double"
    rows = written(texts.drop("rare", "times").mapInArrow(tidy(scored), kind), "scored")
    rare = texts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    more = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + SMOOTH)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"))
    out = rows.join(more, "row", "left").withColumn("more", F.coalesce("more", F.lit(0.0)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(total["n"])).cast("long").alias("train_tokens"), (F.col("base") + F.col("more")).alias("base_score"), (F.col("model") + F.col("shares") + F.col("more")).alias("score"))


def op6_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))
