"""Near duplicates by MinHash with tensored banding, verified on full shingle sets.

A document has two collections of small sketches. A table key is a pair with one sketch from each, so m + m sketches
give m * m keys, and about a square root of the usual number of minhashes is computed. Texts with equal sets are one
node from the start. A node whose left sketch no other node has gives no keys for it.

The first node of a bucket of equal keys is its hub. Nodes are compared with the hubs of their buckets, so there is a pair
for each hub of a node, not for each two nodes of a bucket. Two nodes of a bucket have its hub in common; so once these
links have made components, the nodes around each hub that are still apart are compared as well, by their differences
from the hub's set, and only links that join two components are written. No link between nodes that share a key is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import LONG, batch, documents, forget, kept, slices, splitmix, tidy, words, written
from quire.llm.graph import components

#: Words in a shingle for the query, and in the pipeline; links need 100 * intersection >= SHARE * union.
SHINGLE, STAGE_SHINGLE, SHARE = 2, 5, 80
#: Sketches in each of the two collections, and minhashes in a sketch. At a similarity of 0.8 a pair shares a key but for 5 in 100,000.
SKETCHES, DEPTH = 20, 4
#: Members that are compared with one copy of their hub's set, and bits of the filter for documents that are asked for.
FAN, FILTER_BITS = 64, 1 << 23
#: Nodes around a hub that one task holds while others are held against them, and shingles of theirs.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 22
WORDS_KEPT = 150_000
SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))])
SETS = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG:
            self[word] = h
        return h


_hashes = WordHashes()
kept("hashes", _hashes)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The different shingles of a whole text as sorted 64-bit hashes; a text of fewer words is one shingle of them all."""
    if len(_hashes) > WORDS_KEPT:
        _hashes.clear()
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = splitmix(out * np.uint64(0x9E3779B97F4A7C15) ^ h[k : k + len(out)])
    return np.unique(out)


def _multipliers() -> np.ndarray:
    return splitmix(np.arange(1, 2 * SKETCHES * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of 2 * SKETCHES sketches for non-empty sets."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    every = np.concatenate(sets)
    least = np.empty((len(sets), 2 * SKETCHES * DEPTH), np.uint64)
    for k, a in enumerate(_multipliers()):
        least[:, k] = np.minimum.reduceat(every * a, starts)
    out = np.zeros((len(sets), 2 * SKETCHES), np.uint64)
    for k in range(DEPTH):
        out = splitmix(out ^ least[:, k::DEPTH])
    return out.view(np.int64)


def signed(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, digest, left, right) of every row, from whole texts; an empty set has no digest and no sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, k in slices(texts):
                sets = [shingle_set(t, size) for t in texts[i:k]]
                full = [n for n, s in enumerate(sets) if len(s)]
                left: list[list[int] | None] = [None] * len(sets)
                right = list(left)
                digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                if full:
                    for n, row in zip(full, sketches([sets[n] for n in full]).tolist(), strict=True):
                        left[n], right[n] = row[:SKETCHES], row[SKETCHES:]
                yield batch(SIGNED, doc_id=keys[i:k], n_shingles=[len(s) for s in sets], digest=digest, left=left, right=right)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run, "hashes"), "doc_id long, n_shingles long, digest binary, left array<long>, right array<long>")


def near_enough(a, b, most):
    """Whether sets of sizes a and b with at most `most` common shingles can be linked."""
    return 100 * most >= SHARE * (a + b - most)


def _place(ids: Column) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(FILTER_BITS))


def wanted_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, shingles) of the documents whose `id` is in ids, and of some others.

    The ids go to the tasks as a bitmap of fixed size, and a join behind it keeps the exact ones. So only the texts
    asked for are shuffled, and if ever so many are, the bitmap grows no larger but lets more pass.
    """
    place = _place(F.col("id"))
    # bitmap functions number positions from 1: bit p - 1 lies in bucket (p - 1) // 32768 + 1
    rows = ids.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()  # FILTER_BITS at most
    bits = np.zeros(FILTER_BITS, np.uint8)
    for r in rows:
        part = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        bits[(r["k"] - 1) * 32768 : (r["k"] - 1) * 32768 + len(part)] = part
    packed = np.packbits(bits).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.unpackbits(np.frombuffer(packed, np.uint8))
        for b in batches:
            at = b.column(2).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(asked[at])
            if len(hit):
                texts = b.column(1).take(pa.array(hit)).to_pylist()
                yield batch(SETS, id=b.column(0).take(pa.array(hit)), shingles=[shingle_set(t, size).astype("<u8").tobytes() for t in texts])

    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).where("id IS NOT NULL")
    return source.withColumn("at", place).mapInArrow(tidy(run, "hashes"), "id long, shingles binary")


def common(a: np.ndarray, b: np.ndarray) -> int:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum()) if len(large) else 0


def verified(docs: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose full sets are linked. Many pairs of one `a` are dealt out with a copy of its set for each part."""
    pairs = written(pairs.select("a", "b"), "pairs")
    fans = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("fan"))
    members = pairs.join(fans, "a").select("a", F.pmod(F.xxhash64("b"), F.col("fan")).alias("part"), F.lit(1).alias("kind"), F.col("b").alias("id"))
    hubs = fans.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fan") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("a").alias("id"))
    asked = hubs.unionByName(members)
    sets = wanted_sets(docs, asked.select("id"), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine = None, []
        for b in batches:
            found = []
            for a, part, kind, one, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (a, part) != now:
                    now, mine = (a, part), []
                s = np.frombuffer(data, "<u8")
                if kind == 0:
                    mine.append(s)
                    continue
                for h in mine:
                    n = common(h, s)
                    if 100 * n >= SHARE * (len(h) + len(s) - n):
                        found.append((a, one))
                        break
            yield batch(LINKS, a=[x for x, _ in found], b=[x for _, x in found])

    met = asked.join(sets, "id").select("a", "part", "kind", "id", "shingles")
    out = written(met.repartition("a", "part").sortWithinPartitions("a", "part", "kind").mapInArrow(tidy(run), "a long, b long"), "links")
    forget(pairs)
    return out


def stars(nodes: DataFrame) -> DataFrame:
    """(hub, id): each node beside the smallest node of every bucket that it lies in, once.

    Left sketches are counted first: keys are only made of those that two nodes have.
    """
    lefts = nodes.select("id", F.posexplode("left").alias("i", "l"))
    shared = lefts.groupBy("i", "l").agg(F.count("*").alias("c")).where("c > 1").select("i", "l")
    alive = lefts.join(shared, ["i", "l"]).select("id", "i", "l").join(nodes.select("id", "right"), "id")
    keys = alive.select("id", "i", "l", F.posexplode("right").alias("j", "r")).select(F.xxhash64("i", "l", "j", "r").alias("key"), "id")
    keys = written(keys, "keys")
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("c")).where("c > 1").select("key", "hub")
    out = written(keys.join(hubs, "key").where("id != hub").select("hub", "id").distinct(), "stars")
    forget(keys)
    return out


def grouped(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Null and empty texts, and texts of blanks, have no shingle and are linked with nothing; a null id is linked with
    nothing either, has no component and is kept. Rows of one id are one node, linked by any of its texts. Of a
    component the smallest id is kept, and all its rows.
    """
    sig = written(signed(docs, size), "signed")
    nodes = sig.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"))
    nodes = written(nodes, "nodes")
    around = stars(nodes)
    sizes = nodes.groupBy("id").agg(F.min("n").alias("least"), F.max("n").alias("most"))  # one id may have several texts
    first = around.join(sizes, "id").join(sizes.select(F.col("id").alias("hub"), F.col("least").alias("low"), F.col("most").alias("high")), "hub")
    near = near_enough(F.col("least"), F.col("low"), F.least("most", "high"))
    # rows of one id with different texts are one node already
    same = sig.where("doc_id IS NOT NULL AND n_shingles > 0").join(nodes.select("digest", "id"), "digest").where("doc_id != id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    several = sig.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(F.countDistinct("digest").alias("texts")).where("texts > 1").select(F.col("doc_id").alias("b"))
    checked = verified(docs, first.where(near).select(F.col("hub").alias("a"), F.col("id").alias("b")), size)
    found = written(components(checked.unionByName(same.join(several, "b", "left_semi").select("a", "b"))), "components")
    more = apart(docs, around, sizes, found, size)
    if not more.isEmpty():
        star = found.where("id != component").select(F.col("component").alias("a"), F.col("id").alias("b"))
        last = written(components(star.unionByName(more)), "components")
        forget(found)
        found = last
    forget(checked, more, around)
    of = nodes.select("digest", "id").join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("of_set"))
    out = sig.select("doc_id", "n_shingles", "digest").join(of, "digest", "left").withColumn("component_id", F.coalesce("of_set", "doc_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


class Held:
    """The nodes around a hub that a task holds, by their differences from the hub's set.

    Sets a and b have |a| + |b| - 2 * common shingles that aren't common, and these are what their differences from any
    third set don't share. Near copies differ from their hub in few shingles, so few are held and counted.
    """

    def __init__(self, hub: np.ndarray):
        self.hub, self.rows, self.parts = hub, [], []

    def add(self, id_: int, component: int, main: bool, shingles: np.ndarray) -> None:
        self.rows.append((id_, component, main, len(shingles)))
        self.parts.append(np.setxor1d(shingles, self.hub, assume_unique=True))

    def close(self) -> None:
        ids, components_, main, n = zip(*self.rows, strict=True) if self.rows else ((), (), (), ())
        self.ids, self.main, self.n = np.array(ids, np.int64), np.array(main, bool), np.array(n, np.int64)
        self.labels: dict[int, int] = {}
        self.parent: list[int] = []
        self.root = np.array([self._label(c) for c in components_], np.int64)
        self.far = np.array(list(map(len, self.parts)), np.int64)
        every = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.owner = np.repeat(np.arange(len(self.parts)), self.far)[order]
        every = every[order]
        self.starts = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        self.shingles, self.starts = every[self.starts], np.append(self.starts, len(every))
        self.parts = []

    def _label(self, component: int) -> int:
        at = self.labels.setdefault(component, len(self.parent))
        if at == len(self.parent):
            self.parent.append(at)
        while self.parent[at] != at:
            at = self.parent[at]
        return at

    def links(self, id_: int, component: int, shingles: np.ndarray) -> list[tuple[int, int]]:
        """Links of a node with held ones, as far as they join two components. Of two nodes outside the hub's largest
        component, each is held somewhere and asks everywhere, and the smaller id's question counts."""
        mine, n = self._label(component), len(shingles)
        open_ = (self.root != mine) & (self.main | (self.ids > id_))
        if not open_.any():
            return []
        own = np.setxor1d(shingles, self.hub, assume_unique=True)
        at = np.minimum(np.searchsorted(self.shingles, own), max(len(self.shingles) - 1, 0))
        at = at[self.shingles[at] == own] if len(self.shingles) else at[:0]
        sizes = self.starts[at + 1] - self.starts[at]
        places = np.repeat(self.starts[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        shared = np.bincount(self.owner[places], minlength=len(self.ids))
        different = len(own) + self.far - 2 * shared
        out = []
        for k in np.flatnonzero(open_ & near_enough(self.n, n, (self.n + n - different) // 2)).tolist():
            if self.root[k] != mine:
                out.append((id_, int(self.ids[k])))
                old = self.root[k]
                self.parent[old] = mine
                self.root[self.root == old] = mine
        return out


def apart(docs: DataFrame, around: DataFrame, sizes: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """Links (a, b) between nodes around one hub that lie in different components, as far as they join components.

    Nodes around a hub are dealt to blocks, bounded by their number and their shingles. A node outside the largest
    component among them asks in every block; those inside it are held in one block each and don't ask.
    """
    placed = around.join(found, "id", "left").join(sizes.select("id", "most"), "id").select("hub", "id", "most", F.coalesce("component", "id").alias("component"))
    placed = written(placed, "placed")
    kinds = placed.groupBy("hub", "component").agg(F.count("*").alias("nodes"), F.sum("most").alias("most"))
    open_ = kinds.groupBy("hub").agg(F.max(F.struct("nodes", "component"))["component"].alias("main"), F.sum("nodes").alias("nodes"), F.sum("most").alias("most"), F.count("*").alias("kinds"))
    blocks = F.ceil(F.greatest(F.col("nodes") / BLOCK, F.col("most") / BLOCK_SHINGLES))
    open_ = written(open_.where("kinds > 1").select("hub", "main", blocks.alias("blocks")), "open")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    members = placed.join(open_, "hub").withColumn("main", F.col("component") == F.col("main"))
    row = ("hub", "block", "kind", "id", "component", "main")
    hubs = open_.select("hub", every.alias("block"), F.lit(0).alias("kind"), F.col("hub").alias("id"), F.col("hub").alias("component"), F.lit(False).alias("main"))
    held = members.select("hub", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.lit(1).alias("kind"), "id", "component", "main")
    asking = members.where("NOT main").select("hub", every.alias("block"), F.lit(2).alias("kind"), "id", "component", "main")
    asked = hubs.unionByName(held).unionByName(asking)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, ready, found = None, None, False, []
        for b in batches:
            for hub, block, kind, one, component, main, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = np.frombuffer(data, "<u8")
                if (hub, block) != now:
                    now, group, ready = (hub, block), None, False
                if kind == 0:  # of a hub with several texts, any will do
                    group = group or Held(s)
                elif kind == 1:
                    group.add(one, component, main, s)
                else:
                    if not ready:
                        group.close()
                        ready = True
                    found += group.links(one, component, s)
            yield batch(LINKS, a=[x for x, _ in found], b=[x for _, x in found])
            found = []

    met = asked.join(wanted_sets(docs, asked.select("id").distinct(), size), "id").select(*row, "shingles")
    out = written(met.repartition("hub", "block").sortWithinPartitions("hub", "block", "kind").mapInArrow(tidy(run), "a long, b long"), "links")
    forget(placed, open_)
    return out


def op10_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(documents(spark, sf_dir), SHINGLE)


def representatives(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its group, with all their columns; rows with a null id stay."""
    gone = written(grouped(docs, size).where("NOT kept").select(F.col("doc_id").alias("_quire_id")).distinct(), "gone")
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_quire_id"), "left_anti")
