"""Token-id shards: raw ids in document order, found by key through a minimal perfect hash with stored fingerprints.

A shard holds, after a header of fixed size, the ids of its documents one after another (16 bits each where the
vocabulary allows, else 32), the documents' ends, their keys in order, and the index: levels of bits that give each
key its own slot, and for each slot a 32-bit fingerprint and the document's place. A lookup costs a few bit tests and
one read, whatever the shard's size.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import batch, crc, documents, scratch, slices, splitmix, tidy, written
from quire.llm.encode import encoder
from quire.sources.shared import file_system

VOCABULARY, END = "word_bpe_49k.json", 2
MAGIC = b"QUIREID1"
#: magic, bytes an id, documents, documents without a key, ids, different keys, levels, then the place of each section
HEADER = struct.Struct("<8s6Q7Q")
#: Bits a key has on each level.
SPREAD = 2
LEVELS = 64
META = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32())])


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return splitmix(keys.astype(np.int64).view(np.uint64) ^ splitmix(np.array([seed], np.uint64))[0])


class PerfectHash:
    """Each of n different 64-bit keys to a number below n, in about 3 bits a key.

    On each level a key that alone wants its bit gets it; the others go on. A slot is the count of set bits ahead.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes.astype(np.int64), bits
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        counts = np.bitwise_count(bits).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(counts)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, levels = keys.astype(np.int64), [], []
        while len(left):
            if len(sizes) >= LEVELS:
                raise ValueError("equal keys have no perfect hash")
            size = max(64, -(-len(left) * SPREAD // 64) * 64)
            at = (_hash(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1; a key that was never given may get any slot."""
        keys = keys.astype(np.int64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = self.starts[k] + (_hash(keys[open_], k) % np.uint64(size)).astype(np.int64)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.ranks[at >> 6] + below)[hit]
            open_ = open_[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1 << 32) >> np.uint64(32)).astype(np.uint32)


class ShardWriter:
    """Documents in ascending key order into one file, which appears under its name only when it is whole."""

    def __init__(self, folder: str, name: str, unique: str, width: int):
        self.system, root = file_system(folder)
        self.system.create_dir(root, recursive=True)
        self.path, self.part, self.width, self.kind = f"{root}/{name}", f"{root}/.{name}.{unique}", width, np.dtype(f"<u{width}")
        self.out = self.system.open_output_stream(self.part)
        self.out.write(bytes(HEADER.size))
        self.at, self.ends, self.keys, self.unkeyed, self.n_ids = HEADER.size, [], [], 0, 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        data = ids.astype(self.kind).tobytes()
        self.out.write(data)
        self.at += len(data)
        self.n_ids += len(ids)
        self.ends.append(self.n_ids)
        if key is None:
            self.unkeyed += 1  # null ids sort first
        else:
            self.keys.append(key)

    def close(self) -> None:
        keys = np.array(self.keys, np.int64)
        different, first = np.unique(keys, return_index=True)
        index = PerfectHash.build(different)
        slots = index.slots(different)
        prints, places = np.zeros(len(different), np.uint32), np.zeros(len(different), np.uint32)
        prints[slots], places[slots] = fingerprints(different), first + self.unkeyed
        sections = []
        for a in (np.array(self.ends, "<u8"), keys.astype("<i8"), index.sizes.astype("<i8"), index.bits.astype("<u8"), prints.astype("<u4"), places.astype("<u4")):
            sections.append(self.at)
            self.out.write(a.tobytes())
            self.at += a.nbytes
        self.out.write(tail := HEADER.pack(MAGIC, self.width, len(self.ends), self.unkeyed, self.n_ids, len(different), len(index.sizes), *sections, self.at))
        self.at += len(tail)
        self.out.close()
        self.system.move(self.part, self.path)


class Shard:
    """A shard opened for keyed reads; holds the index and the ends, and reads payloads as they are asked for."""

    def __init__(self, folder: str, name: str):
        system, root = file_system(folder)
        self.file = system.open_input_file(f"{root}/{name}")
        size = self.file.size()
        magic, self.width, self.n_docs, self.unkeyed, self.n_ids, n_keys, n_levels, *at = HEADER.unpack(self.file.read_at(HEADER.size, size - HEADER.size))
        if magic != MAGIC:
            raise ValueError(f"{folder}/{name} is not a token-id shard")
        part = lambda k, kind: np.frombuffer(self.file.read_at(at[k + 1] - at[k], at[k]), kind)
        self.ends = np.concatenate([[0], part(0, "<u8")]).astype(np.int64)
        self.keys = part(1, "<i8")
        self.index = PerfectHash(part(2, "<i8"), part(3, "<u8"))
        self.prints, self.places = part(4, "<u4"), part(5, "<u4")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key's (first) document, or -1: its slot's fingerprint must agree."""
        keys = np.asarray(keys, np.int64)
        if not len(self.prints):
            return np.full(len(keys), -1, np.int64)
        slots = self.index.slots(keys)
        good = (slots >= 0) & (self.prints[slots] == fingerprints(keys))
        return np.where(good, self.places[slots].astype(np.int64), -1)

    def ids(self, place: int, count: int = 1) -> np.ndarray:
        """The ids of the documents from a place on."""
        a, b = int(self.ends[place]), int(self.ends[place + count])
        return np.frombuffer(self.file.read_at((b - a) * self.width, HEADER.size + a * self.width), f"<u{self.width}").astype("<u4")

    def runs(self, places: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
        """Ranges of places that follow each other, of about `most` ids each, so that one read serves many documents."""
        i = 0
        while i < len(places):
            k = i + 1
            while k < len(places) and places[k] == places[k - 1] + 1 and self.ends[places[k] + 1] - self.ends[places[i]] <= most:
                k += 1
            yield i, k
            i = k

    def get(self, key: int) -> np.ndarray | None:
        at = self.find(np.array([key]))[0]
        return None if at < 0 else self.ids(at)


def write_shards(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """Encodes every text and writes the shards; returns (shard, path, n_docs, n_ids, start), shards in key order.

    A null text is the empty one and has the end id alone. Null ids come first and have no key; of equal ids the
    first is found by key, and all are stored. A task that runs again writes the same shard anew and renames it into
    place, so a lost executor leaves no half shard. Empty tables give no shard.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, writer = TaskContext.get(), None
        name = f"shard-{context.partitionId():07d}.ids"
        tokens, stop = encoder(vocabulary), np.uint32(end).astype("<u4").tobytes()
        width = 2 if max(tokens.library.get_vocab_size(with_added_tokens=True), end + 1) <= 1 << 16 else 4
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, k in slices(texts):
                for key, ids in zip(keys[i:k], tokens.encode(texts[i:k]), strict=True):
                    writer = writer or ShardWriter(folder, name, str(context.taskAttemptId()), width)
                    writer.add(key, np.frombuffer(ids + stop, "<u4"))
        if writer:
            writer.close()
            yield batch(META, shard=[context.partitionId()], path=[name], n_docs=[len(writer.ends)], n_ids=[writer.n_ids])

    # rows of one id, or of none, may be many, so a hash of the text parts them
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc())
    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    meta = written(dealt.mapInArrow(tidy(write, "encoders"), "shard int, path string, n_docs long, n_ids long"), "shards")
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return meta.withColumn("start", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)))


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of all documents; those with an id are looked up by it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(folder, row["path"])
                places = shard.find(shard.keys)
                if (places < 0).any():
                    raise ValueError(f"{row['path']}: a key is missing from its index")
                if len(places):  # equal ids follow their first one
                    places = places + (np.arange(len(places)) - np.searchsorted(shard.keys, shard.keys))
                places = np.concatenate([np.arange(shard.unkeyed), places])
                keys = [None] * shard.unkeyed + shard.keys.tolist()
                for i, k in shard.runs(places):
                    some = places[i:k]
                    a, b = shard.ends[some], shard.ends[some + 1]
                    ids, first = shard.ids(int(some[0]), k - i), int(a[0])
                    sums = [crc(ids[x:y].tobytes()) for x, y in zip((a - first).tolist(), (b - first).tolist(), strict=True)]
                    yield batch(ROWS, doc_id=keys[i:k], start=row["start"] + a, n_tokens=b - a, ids_crc32=sums, shard=[row["shard"]] * len(some))

    n = max(1, shards.count())
    return shards.repartition(n).mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "ids")
    return read_shards(write_shards(documents(spark, sf_dir), folder), folder)
