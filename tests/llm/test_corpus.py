import hashlib
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from quire.llm import graph, mixing, neardup, registry
from tests.llm.conftest import SCHEMA, sentence, texts_of


def slow_groups(rows, size):
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in keys}


@pytest.mark.parametrize("size", [2, 5])
def test_groups(spark, size):
    rnd = random.Random(size)
    base = [sentence(rnd.randint(30, 90), k).split() for k in range(6)]
    rows = []
    for i in range(160):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5, 8])):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(400)}"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "one"), (203, "One"), (204, "two")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.grouped(docs, size).collect()}
    assert got == slow_groups(rows, size)
    kept = neardup.representatives(docs, size)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in got.items() if i == c)


def test_groups_in_many_blocks(spark, monkeypatch):
    """Groups that their hubs don't join, dealt over blocks and fans; a filter so small that all documents pass it."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "FAN", 2)
    monkeypatch.setattr(neardup, "FILTER_BITS", 1 << 15)
    rnd = random.Random(11)
    rows = []
    for g in range(3):
        base = sentence(60, g + 20).split()
        variants = []
        for _ in range(4):  # variants lie a little too far from the base and from each other
            w = list(base)
            for k in rnd.sample(range(60), 7):
                w[k] = f"v{rnd.randrange(10**6)}"
            variants.append(w)
        rows.append((1000 * g, " ".join(base)))
        for i in range(40):
            w = list(variants[i % 4])
            for _ in range(rnd.choice([0, 1, 2])):
                w[rnd.randrange(60)] = f"x{rnd.randrange(10**6)}"
            rows.append((1000 * g + 1 + i, " ".join(w)))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    want = slow_groups(rows, 2)
    assert len({c for _, c in want.values()}) > 3
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.grouped(docs).collect()} == want
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 150)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.grouped(docs).collect()} == want


def test_recall_of_sketches(capsys):
    """Pairs of a similarity just above 0.8 that share no key: the scheme says 5 in 100,000."""
    rnd = np.random.default_rng(5)
    made = []
    for _ in range(3000):
        n = int(rnd.integers(20, 200))
        both, apart = rnd.integers(0, 2**63, n, dtype=np.uint64), int(n * 0.25)
        left = int(rnd.integers(0, apart + 1))
        a, b = (np.unique(np.concatenate([both, rnd.integers(0, 2**63, k, dtype=np.uint64)])) for k in (left, apart - left))
        assert 100 * neardup.common(a, b) >= 80 * (len(a) + len(b) - neardup.common(a, b))
        made += [a, b]
    s, m = neardup.sketches(made), neardup.SKETCHES
    same = s[0::2] == s[1::2]
    missed = int((~(same[:, :m].any(axis=1) & same[:, m:].any(axis=1))).sum())
    with capsys.disabled():
        print(f" {missed} of 3000 pairs share no key")
    assert missed <= 3


def test_groups_odd(odd, empty):
    assert neardup.grouped(empty).count() == 0 and neardup.representatives(empty).count() == 0
    rows = neardup.grouped(odd).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: r.component_id for r in rows}
    assert got[1] == got[2] == got[3] == got[12] == 1 and got[4] == 4 and got[5] == 5 and got[6] == 6 and got[None] is None
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    kept = neardup.representatives(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IS NULL").count() == 2


def test_one_id_with_two_texts(spark):
    a, b = sentence(40, 1), sentence(40, 2)
    docs = spark.createDataFrame([(1, a, "", "", 1), (2, a, "", "", 1), (2, b, "", "", 1), (3, b, "", "", 1), (4, sentence(40, 9), "", "", 1)], SCHEMA)
    assert sorted((r.doc_id, r.component_id) for r in neardup.grouped(docs).collect()) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4)]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 100), (101, 100), (300, 200)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 300: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def water_fill(sizes):
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= share * weight[s]}
        if not full:
            return out | {s: share * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mix_odd(odd, empty):
    assert mixing.schedule(empty).count() == 0 and mixing.mix(empty).count() == 0
    rows = mixing.schedule(odd).collect()
    assert len(rows) == odd.count()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    for s, t in water_fill(dict(sizes)).items():
        mine = [r for r in rows if r.source == s]
        assert all(abs(r.target - t) < 1e-6 * max(1, t) and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - t) <= 1
    again = sorted(map(str, mixing.schedule(odd).collect()))
    assert again == sorted(map(str, rows))
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert Counter(texts_of(mixed)).total() > 0


def slow_mix(rows):
    """taken by id: each source served in order of the hashes, up to its target, twice round at most."""
    size = lambda t: len((t or "").encode().split())
    of = {}
    for i, t, s in rows:
        of.setdefault(s, []).append((hashlib.md5(f"{'' if i is None else i}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest(), i is not None, i or 0, size(t)))
    goal, out = water_fill({s: sum(x[3] for x in held) for s, held in of.items()}), []
    for s, held in of.items():
        room, got = int(goal[s] + 1e-9), Counter()
        for lap in range(2):
            for k, x in enumerate(sorted(held)):
                n = min(room, x[3])
                got[k] += n
                room -= n
        out += [(x[1] and x[2] or 0, s or "", x[3], got[k]) for k, x in enumerate(sorted(held))]
    return sorted(out)


def test_mix_in_many_buckets(spark, monkeypatch):
    """Buckets of two digits, equal rows counted and numbered in runs."""
    rnd = random.Random(8)
    rows = [(rnd.randrange(900), sentence(rnd.randint(0, 30), rnd.randrange(40)), rnd.choice(["a", "a", "a", "b", "", None])) for _ in range(700)] + [(None, "same text here", "a")] * 60 + [(7, None, "b")] * 3
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], SCHEMA)
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 16)
    monkeypatch.setattr(mixing, "AT_ONCE", 7)
    got = mixing.schedule(docs).collect()
    assert sorted((r.doc_id or 0, r.source or "", r.size, r.taken) for r in got) == slow_mix(rows)
    queue = [r for r in mixing.queued(mixing.sized(docs)).collect() if r.taken]
    at = 0
    for r in sorted(queue, key=lambda r: r["at"]):  # one gapless order over all sources, by virtual finish time
        assert r["at"] == at
        at += r.taken
    finishes = [r.finish for r in sorted(queue, key=lambda r: r["at"])]
    assert finishes == sorted(finishes) and at == sum(r.taken for r in got) <= 1.5 * sum(r.size for r in got)
    mixed = mixing.mix(docs)
    want = Counter()
    for r in queue:
        want[r.doc_id] += 2 * r.taken >= r.size
    assert Counter(i for i, _ in texts_of(mixed)) == +want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables aren't here")
def test_oracles(spark):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    for name, sql in registry.ORACLES.items():
        a, b = registry.QUERIES[name](spark, folder).toPandas(), duck.sql(sql).df()
        k = sorted(a.columns)
        assert k == sorted(b.columns)
        a, b = (x[k].sort_values(k).reset_index(drop=True) for x in (a, b))
        pd.testing.assert_frame_equal(a, b, check_dtype=False, check_exact=True)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables aren't here")
def test_queries_return_every_document(spark):
    folder = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    for name, make in registry.QUERIES.items():
        ids = make(spark, folder).select("doc_id").distinct().count()
        assert ids == n, name


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables aren't here")
def test_pipeline(spark):
    import corpus_pipeline as p
    from quire.llm import packing, quality, toxicity

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    seen = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, seen, folder)
        assert out.columns == docs.columns
        before, after = Counter(texts_of(seen)), Counter(texts_of(out))
        if name == "quality":
            want = Counter({r.doc_id for r in quality.classify(seen, marks).where("predicted = 1").collect()})
        elif name == "toxicity":
            want = Counter({r.doc_id for r in toxicity.score_toxicity(seen, marks).where("predicted = 0").collect()})
        elif name == "neardup":
            want = Counter({i for i, (_, c) in slow_groups(sorted(texts_of(seen)), 5).items() if i == c})
        else:
            took = mixing.schedule(seen).collect()
            want = Counter()
            for r in took:
                first = min(r.taken, r.size) if r.taken <= r.size else r.size
                want[r.doc_id] += (2 * first >= r.size > 0) + (r.taken > r.size and 2 * (r.taken - r.size) >= r.size)
            want = +want
        assert Counter(i for i, _ in after.elements()) == want, name
        assert set(after) <= set(before)
        seen = spark.createDataFrame(out.collect(), docs.schema)
    pieces = p.STAGES[-1][1](spark, seen, folder).collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0) == sum(r.length for r in packing.pack(seen).collect())
    assert {r.doc_id for r in p.run(spark, folder).collect()} == {r.doc_id for r in pieces}


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_stages_as_a_chain(request, spark, tmp_path, which):
    """All stages over odd and over empty tables, each reading what the one ahead of it has written."""
    import corpus_pipeline as p

    docs = request.getfixturevalue(which)
    marks = request.getfixturevalue("labelled")
    folder = f"file://{tmp_path}/{which}"
    docs.write.parquet(f"{folder}/documents.parquet")
    marks.write.parquet(f"{folder}/labels.parquet")
    seen = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in p.STAGES:
        out = stage(spark, seen, folder)
        assert name == "packing" or out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        seen = spark.read.parquet(f"{folder}/{name}")
    if which == "empty":
        assert seen.count() == 0
