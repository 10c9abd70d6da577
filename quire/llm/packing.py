"""Packing documents into windows by best-fit decreasing, exact over all documents at any size.

Overlong documents are cut into full windows; what remains is at most a window long, so the remainders of all documents
are a histogram of at most 1024 lengths. Best-fit decreasing treats equal lengths alike, so it runs over the histogram:
the driver holds counts and ranges of windows, whose number depends on the window's size and not on the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import batch, crc, documents, slices, tidy, written
from quire.llm.encode import KEPT, encoder

VOCABULARY, END, WINDOW = "byte_bpe_50k.json", 0, 1024
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])
PLACED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class CapacityTree:
    """A segment tree over remaining capacities that counts open windows; first() finds the tightest that fits."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = self.leaves + capacity
        while at:
            self.count[at] += n
            at >>= 1

    def first(self, least: int) -> int | None:
        """The smallest capacity of at least `least` that an open window has."""
        at = self.leaves + least
        while not self.count[at]:
            while at & 1:  # a right child: its parent holds nothing beyond it
                at >>= 1
            if at == 0:
                return None
            at += 1
            if at & (at - 1) == 0:  # past the last node of its level
                return None
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.leaves


class Plan:
    """Where the nth piece of each length goes: runs of (length, nth, windows), sorted for a binary search."""

    def __init__(self, counts: dict[int, int], size: int = WINDOW):
        self.windows, self.size = 0, size
        self.runs: list[tuple[int, int, int, int]] = []
        tree, open_ = CapacityTree(size), [[] for _ in range(size + 1)]

        def put(length: int, nth: int, ranges: list[tuple[int, int]], offset: int) -> int:
            for first, n in ranges:
                self.runs.append((length, nth, first, offset))
                nth += n
            return nth

        for length in range(size, 0, -1):
            left, nth = counts.get(length, 0), 0
            while left:
                capacity = tree.first(length)
                each = (size if capacity is None else capacity) // length
                n = left // each if capacity is None else min(left // each, tree.count[tree.leaves + capacity])
                if n == 0:  # fewer than one window holds
                    each, n = left, 1
                if capacity is None:
                    ranges, capacity = [(self.windows, n)], size
                    self.windows += n
                else:
                    ranges, need = [], n
                    while need:
                        first, m = open_[capacity].pop()
                        if m > need:
                            open_[capacity].append((first + need, m - need))
                            m = need
                        ranges.append((first, m))
                        need -= m
                    tree.add(capacity, -n)
                for k in range(each):
                    nth = put(length, nth, ranges, size - capacity + k * length)
                left -= each * n
                rest = capacity - each * length
                if rest:
                    open_[rest] += ranges
                    tree.add(rest, n)
        self.runs.sort()
        runs = np.array(self.runs, np.int64).reshape(-1, 4)
        self.starts, self.to, self.offsets = runs[:, 0] * (1 << 50) + runs[:, 1], runs[:, 2], runs[:, 3]

    def place(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.starts, length * (1 << 50) + nth, side="right") - 1
        return self.to[at] + (nth - (self.starts[at] & ((1 << 50) - 1))), self.offsets[at]


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, size: int = WINDOW, kept: int = KEPT) -> DataFrame:
    """Full windows and the remainder of each document, numbered within its task by length; texts are encoded once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, tokens = TaskContext.get().partitionId(), [0] * (size + 1), encoder(vocabulary, kept)
        stop = np.uint32(end).astype("<u4").tobytes()
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, k in slices(texts):
                rows = []
                for key, ids in zip(keys[i:k], tokens.encode(texts[i:k]), strict=True):
                    ids += stop
                    n = len(ids) // 4
                    for a in range(0, n, size):
                        m = min(size, n - a)
                        rows.append((key, a, m, crc(ids[4 * a : 4 * (a + m)]), n, part, seen[m]))
                        seen[m] += 1
                yield batch(PIECES, **dict(zip(PIECES.names, map(list, zip(*rows, strict=True)), strict=True)))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(cut, "encoders"), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, size: int = WINDOW, kept: int = KEPT) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row a piece.

    A null text is the empty one; it and the empty text are the end id alone. Repeated rows, also with equal ids, are
    packed one by one; null ids are carried. An empty table gives no piece. Workers keep pieces between blanks and their ids in
    `kept` bytes; fewer cost time and change no result.
    """
    cut = written(pieces(docs, vocabulary, end, size, kept), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))), "lengths")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `size` rows at most
    plan = Plan(totals, size)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, nth = b.column("length").to_numpy(), b.column("nth").to_numpy(zero_copy_only=False)
            sequence, offset = plan.place(length, nth)
            yield batch(PLACED, sequence_id=sequence, offset=offset, **{c: b.column(c) for c in PLACED.names[:5]})

    # the counts grow with the number of tasks, so they are never broadcast
    ranked = cut.join(counts.drop("n").hint("merge"), ["part", "length"]).withColumn("nth", F.col("nth") + F.col("ahead"))
    return ranked.select(*PLACED.names[:5], "nth").mapInArrow(tidy(assign), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
