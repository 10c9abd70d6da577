import pickle
import random
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import common, packing, tokencount, tokenfile
from quire.llm.common import LONG, scratch, tokenizer_path
from quire.llm.encode import EACH, PieceEncoder

PIECES = [" ", " ", "  ", "\n", "\n\n", "\t", "a", "B", "é", "'s", "'re", "'", "r", "l", "e", "v", "ll", "|", "<|endoftext|>", "1", "２", " ", "́", "\x1c", "日本", "İ", "Σ", "\r", "!", "　", "​", "\x85", "²", "ing", "the"]


def strings(seed: int, n: int = 3000) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def library(name: str) -> Tokenizer:
    return Tokenizer.from_file(tokenizer_path(name))


def ids(name: str, text: str | None, end: int) -> np.ndarray:
    return np.array([*library(name).encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("kept", [50, 10**6])
def test_piecewise_encoding_is_the_librarys(name, kept):
    texts = strings(1) + [None, "plain words, and more words " * 40]
    want = library(name).encode_batch([t or "" for t in texts], add_special_tokens=False)
    got = PieceEncoder(name, kept).encode(texts)
    assert all(np.array(w.ids, "<u4").tobytes() == g for w, g in zip(want, got, strict=True))


def test_counts_are_the_librarys():
    texts = strings(2) + [None, "", "x" * 3000, " " * 2000, "'" * 700 + "s" * 700]
    want = [len(e.ids) for e in library("byte_bpe_50k.json").encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert tokencount.count_tokens(texts).tolist() == want


def test_stores_are_bounded(monkeypatch):
    """Stores that are emptied all the time, and pieces too long to keep, change no result."""
    texts = strings(5, 400) + ["x" * 500 + " " + "y" * 500, "word " * 300] * 2
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        small = PieceEncoder(name, 2000)
        assert small.encode(texts) == PieceEncoder(name).encode(texts)
        assert small.held == sum(EACH + len(p) + len(x) for p, x in small.store.items())
    want = tokencount.count_tokens(texts).tolist()
    for bound in ("PIECES_KEPT", "STATES_KEPT", "PAIRS_KEPT"):
        monkeypatch.setattr(tokencount, bound, 3)
    assert tokencount.count_tokens(texts).tolist() == want
    assert max(map(len, tokencount.machines("byte_bpe_50k.json")[2])) <= LONG


def test_tasks_drop_what_others_keep():
    held = {1: 2}
    common.kept("test", held)
    assert list(common.tidy(lambda batches: (len(held) for _ in batches), "test")(iter([0]))) == [1]
    assert list(common.tidy(lambda batches: (len(held) for _ in batches))(iter([0]))) == [0]


def test_tasks_drop_what_others_keep_in_a_worker():
    """A worker gets a copy of a task's function; that must drop the worker's own stores."""
    task = pickle.loads(cloudpickle.dumps(common.tidy(lambda batches: batches)))
    held = {1: 2}
    common.kept("test", held)
    list(task(iter([0])))
    assert not held


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_are_encoded_once(name, monkeypatch):
    """A word that is kept isn't encoded again for other marks, letters' cases that the vocabulary folds, or after the store was changed."""
    tokens, seen = PieceEncoder(name), []
    bare = tokens._bare
    monkeypatch.setattr(tokens, "_bare", lambda words: bare(seen.append(words) or words))
    texts = ["x thblean thblean, y", "x thblean&&& thblean%%% thblean.###", "x THBLEAN É thblean!"]
    got = [tokens.encode([t])[0] for t in texts]
    tokens.store, tokens.old, tokens.held = {}, tokens.store, 0
    got += tokens.encode(texts)
    want = [np.array(e.ids, "<u4").tobytes() for e in library(name).encode_batch(texts, add_special_tokens=False)]
    assert got == want * 2
    assert sum(w.lstrip(tokens.lead) == "thblean" for words in seen for w in words) == 1


def test_plain_words_do_without_the_patterns(monkeypatch):
    """Words with marks, at the beginning of lines too, go to the model; only other pieces go through the vocabulary's patterns."""
    tokens, seen = PieceEncoder("byte_bpe_50k.json"), []
    marked = tokens._marked
    monkeypatch.setattr(tokens, "_marked", lambda library, mark, texts: marked(library, mark, (seen.extend(texts if library is tokens.library else []), texts)[1]))
    texts = ["one\nThblean, oreinth*** Ouç&&&\nereti\")", "two 32bb\n4"]
    assert tokens.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in library("byte_bpe_50k.json").encode_batch(texts, add_special_tokens=False)]
    assert sorted(seen) == [" 32bb", "4"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_of_letters_and_marks(name):
    rnd = random.Random(6)
    some = ["A", "b", "é", "É", "ÿ", "ß", "ª", "µ", "İ", "Σ", "th", "ing", "ING", "<|ENDOFTEXT|>", "|", "\n", " ", " ", "  ", "\n ", ",", "###", "<", "'S", "'s", "\")", "9", "日", "e\u0301", "=\u0338", "<\u0338"]
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in library(name).encode_batch(texts, add_special_tokens=False)]
    assert PieceEncoder(name).encode(texts) == want
    assert PieceEncoder(name, 5000).encode(texts) == want


def test_state_maps_compose():
    rnd = np.random.default_rng(0)
    maps = rnd.integers(0, tokencount.STATES, (37, tokencount.STATES)).astype(np.int8)
    for start in range(tokencount.STATES):
        state, seen = start, []
        for m in maps:
            state = int(m[state])
            seen.append(state)
        assert tokencount.scan(maps)[:, start].tolist() == seen


def test_count_table(odd, empty):
    rows = tokencount.with_counts(odd).collect()
    assert len(rows) == odd.count() and tokencount.with_counts(empty).count() == 0
    lib = library("byte_bpe_50k.json")
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows) and any(r.over_limit for r in rows)


def test_perfect_hash():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20000):
        keys = np.unique(rnd.integers(-(2**62), 2**62, n))
        index = tokenfile.PerfectHash.build(keys)
        assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        tokenfile.PerfectHash.build(np.array([5, 5]))


def test_shards(spark, odd, empty):
    folder = scratch(spark, "test")
    shards = tokenfile.write_shards(odd, folder)
    rows = tokenfile.read_shards(shards, folder).orderBy("start").collect()
    order = odd.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text").collect()
    at = 0
    assert [r.doc_id for r in rows] == [r.doc_id for r in order]
    for r, o in zip(rows, order, strict=True):
        want = ids("word_bpe_49k.json", o.text, 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    for s in shards.collect():
        shard = tokenfile.Shard(folder, s.path)
        for key in shard.keys.tolist():
            assert shard.get(key).tobytes() == ids("word_bpe_49k.json", next(o.text for o in order if o.doc_id == key), 2).tobytes()
        absent = np.arange(10**6, 10**6 + 2000)
        assert (shard.find(absent) >= 0).sum() <= 1
    other = scratch(spark, "test")
    assert tokenfile.read_shards(tokenfile.write_shards(empty, other), other).count() == 0


def best_fit(lengths: list[int], size: int) -> list[int]:
    """Best-fit decreasing, a piece at a time."""
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(size - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_best_fit(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([rnd.randint(1, 64), 5, 31, 33]) for _ in range(rnd.randint(0, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan, used, cells = packing.Plan(counts, 64), {}, set()
    for n, k in counts.items():
        to, at = plan.place(np.full(k, n), np.arange(k))
        for w, a in zip(to.tolist(), at.tolist(), strict=True):
            spot = {(w, x) for x in range(a, a + n)}
            assert not spot & cells and a + n <= 64
            cells |= spot
            used[w] = used.get(w, 0) + n
    assert sorted(64 - u for u in used.values()) == best_fit(lengths, 64) and plan.windows == len(used)


def test_capacity_tree():
    tree, held = packing.CapacityTree(37), {}
    rnd = random.Random(3)
    for _ in range(500):
        c = rnd.randint(0, 37)
        n = rnd.choice([1, -min(1, held.get(c, 0))])
        tree.add(c, n)
        held[c] = held.get(c, 0) + n
        least = rnd.randint(0, 37)
        assert tree.first(least) == min((k for k, v in held.items() if v and k >= least), default=None)


def test_packing(odd, empty):
    rows = packing.pack(odd).collect()
    assert packing.pack(empty).count() == 0
    want = sorted((o.doc_id is None, o.doc_id or 0, len(ids("byte_bpe_50k.json", o.text, 0))) for o in odd.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens) for r in rows if r.start == 0) == want
    windows: dict[int, list] = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id in (8, 9):
            text = next(o.text for o in odd.collect() if o.doc_id == r.doc_id)
            assert r.ids_crc32 == zlib.crc32(ids("byte_bpe_50k.json", text, 0)[r.start : r.start + r.length].tobytes())
    assert sorted(windows) == list(range(len(windows)))
    for spots in windows.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.length for r in rows) == sum(n for _, _, n in want)
