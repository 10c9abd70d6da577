import hashlib
import io
import math
import re
import wave
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import bilinear, media, perplexity, quality, toxicity


def auc(scores, y):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    n = y.sum()
    return (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_clauses():
    g = toxicity.Grammar({b"scum": 1.0, b"vequ*": 0.5})
    names = dict(zip(toxicity.FEATURES, range(7), strict=True))
    f = lambda t, c: g.features(t)[names[c]]
    assert f("it is scum.", "plain") == 1 and f("you are scum.", "targeted") == 1 and f("you are scum.", "plain") == 0
    assert f("you are not scum.", "negated") == 1 and f("you are not scum.", "targeted") == 0
    assert f("he said you are scum.", "reported") == 1
    assert f("we will kill you.", "threats") == 1 and f("we will kill it.", "threats") == 0
    assert f("Vequxyz! scum, scum scum", "plain") == 1.5  # a word that is said again adds nothing
    assert f("they left. it is scum", "plain") == 1  # the target is in another clause
    assert g.features(None) == g.features("") == g.features("nothing here") == (0.0,) * 7


def test_later_direct_insult_counts():
    g = toxicity.Grammar({b"scum": 1.0})
    f = lambda t: dict(zip(toxicity.FEATURES, g.features(t), strict=True))
    for first, was in (("she wrote scum.", "reported"), ("it is not scum.", "negated"), ("it is scum.", "plain")):
        both = f(f"{first} you are scum.")
        assert f(first)[was] == 1 and both["targeted"] == 1 and both[was] == 0 and both["strongest"] == f("you are scum.")["strongest"]
        again = f(f"you are scum. {first}")
        assert again["targeted"] == 1 and again[was] == 0  # a weaker mention adds nothing


def slow_features(text: str, weights: dict[str, float]) -> tuple[float, ...]:
    """The grammar by definition, over all clauses and without machines."""
    listed = {w: k for k, ws in toxicity.SEEDS.items() if k != toxicity.INSULT for w in ws.split()}
    kind = lambda w: toxicity.INSULT if w in weights else listed.get(w, toxicity.NONE)
    best, threats, strongest = {}, 0, 0.0
    for clause in text.split("."):
        w = clause.split()
        kinds = list(map(kind, w))
        target, report, threat = (k in kinds for k in (toxicity.TARGET, toxicity.REPORT, toxicity.THREAT))
        worth = {}
        for i, word in enumerate(w):
            if kinds[i] == toxicity.INSULT:
                denied = toxicity.NEGATION in kinds[max(0, i - toxicity.REACH) : i]
                best[word] = max(best.get(word, 0), 0 if denied else 1 if report else 3 if target else 2)
                worth[word] = max(worth.get(word, 0), weights[word] * (0.3 if denied else 1))
        scale = (1.25 if target else 1) * (0.5 if report else 1)
        threats += threat and target and not report
        strongest = max(strongest, sum(worth.values()) * scale + (0.5 if threat and target and not report else 0))
    held = [sum(weights[w] for w, r in best.items() if r == k) for k in range(4)]
    return held[2], held[3], float(threats), held[0], held[1], strongest, sum(held) / (1 + len(text.split())) ** 0.5


def test_grammar_by_definition():
    rnd = np.random.default_rng(1)
    weights = {"scum": 1.0, "zork": 0.5}
    g = toxicity.Grammar({k.encode(): v for k, v in weights.items()})
    for _ in range(2000):
        clauses = [" ".join(rnd.choice(["scum", "zork", "you", "not", "said", "kill", "tree", "river"], rnd.integers(1, 7))) + "." for _ in range(rnd.integers(1, 4))]
        got = g.features(" ".join(clauses))
        assert np.allclose(got, slow_features(" ".join(clauses), weights)), clauses
        assert np.allclose(got, g.features(" ".join(clauses[::-1])))  # whatever the order of clauses


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_toxicity_odd(request, labelled, no_labels, which):
    docs = request.getfixturevalue(which)
    for given in (labelled, no_labels):
        rows = toxicity.score_toxicity(docs, given).collect()
        assert len(rows) == docs.count()
        for r in rows:
            key = "" if r.doc_id is None else str(r.doc_id)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(key.encode()) % 5 == 0)
        assert set(toxicity.clean(docs, given).columns) == set(docs.columns)


def test_toxicity_learns(spark):
    words = ["tree", "river", "stone", "cloud", "house", "green", "walk", "song"]
    rnd = np.random.default_rng(0)
    rows, marks = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = " ".join(rnd.choice(words, 30)) + (f" and grumlo{i % 7} was here." if bad else ".")
        rows.append((i, text, "en", "s", 1))
        marks.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = toxicity.score_toxicity(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).where("held_out").toPandas()
    y = (out.doc_id % 5 == 0).to_numpy().astype(int)
    assert auc(out.score.to_numpy(), y) > 0.95


def test_statistics():
    s = dict(zip(quality.STATS, quality.statistics("A a a b\n1 2 |\n"), strict=True))
    assert s["words"] == 7 and s["repeated"] == 1 / 6 * 6 / 7 and s["line_words"] == 3.5 and s["pipes"] == 1 / 14
    assert quality.statistics(None) == quality.statistics("") == tuple([0.0] * len(quality.STATS))


def slow_statistics(text):
    """Statistics by definition, with regular expressions over characters."""
    text = text or ""
    size = max(1, len(text.encode()))
    cut = lambda x: [w for w in re.split("[ \t\n\v\f\r]+", x) if w]
    count = lambda chars: sum(c in chars for c in text)
    w, lines = cut(text), [x for x in text.split("\n") if cut(x)]
    n, m = max(1, len(w)), max(1, len(lines))
    letters = len(re.findall("[a-zA-Z]", text))
    return (
        len(w), sum(len(x.encode()) for x in w) / n, len(set(w)) / n, sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, count("#*$%&<>@^~=_{}[]\\") / size,
        len(re.findall("[A-Z]", text)) / max(1, letters), len(re.findall("[0-9]", text)) / size, count("!?") / size, text.count("|") / size, len(w) / m,
        1 - len(set(lines)) / m if lines else 0.0, sum(bool(re.search("[.!?:\"][ \t\n\v\f\r]*$", x)) for x in lines) / m, (len(text.encode()) - len(text)) / size,
        (len(text.encode()) - sum(len(x.encode()) for x in w)) / size,
    )


def test_statistics_by_definition(odd):
    for text in [r.text for r in odd.collect()] + ["One two? Three!\nOne two? Three!\n\n| a | b |\n#tag @x 12.5%", "é É ß. \n \"quoted\" \n", "a a a b b", "\t"]:
        assert np.allclose(quality.statistics(text), slow_statistics(text)), text


def test_rules_are_their_columns(spark):
    rnd = np.random.default_rng(1)
    x = rnd.random((800, len(quality.STATS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.4)).astype(float)
    rules, bias = quality.learn(x, y)
    assert rules and sum(len(r.tests) for r, _ in rules) > 0
    z = bias + sum(w * r.holds(x) for r, w in rules)
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], ["i", *quality.STATS])
    got = df.select("i", quality.compiled(rules, bias).alias("s")).orderBy("i").toPandas().s.to_numpy()
    assert np.allclose(got, 1 / (1 + np.exp(-z))) and auc(got, y) > 0.98


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_quality_odd(request, labelled, no_labels, which):
    docs = request.getfixturevalue(which)
    for given in (labelled, no_labels):
        rows = quality.classify(docs, given).collect()
        assert len(rows) == docs.count()
        for r in rows:
            key = "" if r.doc_id is None else str(r.doc_id)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(key.encode()) % 4 == 2)
        kept = quality.accepted(docs, given)
        assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)


def slow_base(text):
    text = text or ""
    cut = lambda t: t.encode().split()
    w = cut(text)
    lines, seen, again = text.split("\n"), set(), 0
    for x in lines:
        if cut(x):
            again += x in seen
            seen.add(x)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if runs[tuple(w[i : i + 8])] > 1:
            inside |= set(range(i, i + 8))
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), again, len(inside)


def test_base_counts(odd):
    for t in [r.text for r in odd.collect()] + ["a b c d e f g h " * 3, "a b c d e f g h", "x\n\nx\n x\nx", "#*$%&|<>"]:
        assert perplexity.base_counts(t) == slow_base(t), t


def test_kneser_ney_sums_to_one():
    rnd = np.random.default_rng(2)
    codes, n = np.unique(rnd.integers(0, 12, (4000, 3)) ** 2 % 64 @ np.array([4096, 64, 1]), return_counts=True)
    model = perplexity.KneserNey.fit(codes, n)
    for context in (int(codes[0]) >> 6, int(codes[-1]) >> 6, 63 << 6 | 62):
        p = 10 ** model.score(np.array([context << 6 | s for s in range(64)]))
        assert math.isclose(p.sum(), 1, rel_tol=1e-6) and (p > 0).all()
    assert all((np.diff(k) > 0).all() for k in model.keys)


def test_kneser_ney_by_definition():
    """Every probability as the definition has it, n-gram by n-gram, from counts in dictionaries."""
    rnd = np.random.default_rng(4)
    n = perplexity.ORDER
    line = (rnd.integers(0, 9, 3000) ** 2 % 11).tolist()
    grams = Counter(tuple(line[i : i + n]) for i in range(len(line) - n + 1))
    levels = {n: dict(grams)}
    for k in range(n - 1, 0, -1):
        levels[k] = dict(Counter(g[1:] for g in levels[k + 1]))

    def cuts(counts):
        c = Counter(counts.values())
        if min(c[k] for k in (1, 2, 3, 4)) == 0:
            return [0.0, 0.4, 0.6, 0.7]
        y = c[1] / (c[1] + 2 * c[2])
        return [0.0, *(min(k, max(0.0, k - (k + 1) * y * c[k + 1] / c[k])) for k in (1, 2, 3))]

    cut = {k: cuts(levels[k]) for k in levels}

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 64
        after = {h: c for h, c in levels[k].items() if h[:-1] == g[:-1]}
        if not after:
            return p(g[1:])
        total, c = sum(after.values()), levels[k].get(g, 0)
        spare = sum(cut[k][min(x, 3)] for x in after.values()) / total
        return (c - cut[k][min(c, 3)]) / total + spare * p(g[1:])

    code = lambda g: sum(s << 6 * (n - 1 - i) for i, s in enumerate(g))
    model = perplexity.KneserNey.fit(np.array([code(g) for g in grams]), np.array(list(grams.values())))
    asked = [*list(grams)[:60], *[tuple(rnd.integers(0, 13, n).tolist()) for _ in range(60)]]
    assert np.allclose(model.score(np.array([code(g) for g in asked])), [math.log10(p(g)) for g in asked], atol=1e-9)


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_bands_odd(request, which):
    docs = request.getfixturevalue(which)
    rows = perplexity.judged(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_bands_reject_the_odd_one(spark):
    from tests.llm.conftest import sentence

    rows = [(i, sentence(60, i), "en", "s", 1) for i in range(60)] + [(99, "zx#q %jj vvw " * 3 + " ".join(f"q{i}z%x" for i in range(40)), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.kept for r in perplexity.judged(docs).collect()}
    assert not kept[99] and sum(kept.values()) >= 58


def test_model_counts_every_text(spark):
    texts = ["plain words here", "| a | b |\n| # | $ |", "#*$%&|<>", "<p>&amp;</p>", "plain words here", "", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    want = Counter()
    for t in filter(None, texts):
        want.update((perplexity.fold(t) << perplexity.ORDER * perplexity.BITS | perplexity.ngrams(t)).tolist())
    assert {r.code: r.n for r in perplexity.ngram_counts(docs).collect()} == dict(want)
    codes, n = (np.array(list(x)) for x in (want.keys(), want.values()))
    mask = (1 << perplexity.ORDER * perplexity.BITS) - 1
    for k, model in enumerate(perplexity.KneserNey.held_out(codes, n)):
        others = np.array([c & mask for c in want if c >> perplexity.ORDER * perplexity.BITS != k])
        assert set(model.keys[-1].tolist()) == set(perplexity.hashed(others, perplexity.ORDER).tolist())


def test_bands_keep_common_symbols(spark):
    from tests.llm.conftest import sentence

    # tables as common as prose are as likely as prose, and prose of strange letters is rejected without any symbol
    rows = [(i, sentence(60, i).replace(" ", " | ") if i % 2 else sentence(60, i), "de" if i % 2 else "en", "s", 1) for i in range(120)]
    rows.append((999, " ".join(f"xq{'zjvw'[i % 4]}{'hkqx'[i % 3]}jq" * 2 for i in range(60)), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.kept for r in perplexity.judged(docs).collect()}
    assert not kept.pop(999) and sum(kept[i] for i in range(1, 120, 2)) >= 54 and sum(kept[i] for i in range(0, 120, 2)) >= 54


def test_spelling_is_one_to_one():
    points = [c for c in range(0x110000) if chr(c) not in " \t\n\v\f\r"]
    alone = "abcdefghijklmnopqrstuvwxyz0123456789.,;:!?'\"-()#*$%&|<>@/"

    def read(s):
        at = iter(s)
        for x in at:
            if x < 59:
                yield 32 if x == 1 else ord(alone[x - 2])
            elif x == 59:
                yield ord(alone[next(at) - 2]) - 32
            else:
                c = 0
                for _ in range(x - 59):
                    c = c << 6 | next(at)
                yield c | 0xC0 if x == 60 else c

    s, n = perplexity.symbols("".join(map(chr, points)))
    edge = perplexity.ORDER - 1
    assert n == len(points) + 1 and s.min() >= 0 and s.max() < 64
    assert s[:edge].tolist() == [1] * edge and list(read(s[edge:].tolist())) == [*points, 32]
    for text, want in (("  aÉ\n\tZ文 \u0001😀  ", "aÉ Z文 \u0001😀 "), ("x", "x "), (" \n", ""), ("\ud800A", "\ud800A ")):
        s, n = perplexity.symbols(text)
        assert "".join(map(chr, read(s[edge:].tolist()))) == want and n == len(want), text


def test_bands_tell_characters_apart(spark):
    from tests.llm.conftest import sentence

    # of other scripts and in capitals, texts are judged by their own letters: 13 or 26 code points on is another text
    moved = lambda t, by: "".join(chr(0x430 + ord(c) - ord("a") + by) if c != " " else c for c in t)
    rows = [(i, moved(sentence(60, i), 0), "ru", "s", 1) for i in range(60)] + [(100 + i, sentence(60, i), "en", "s", 1) for i in range(60)]
    rows += [(998, moved(sentence(60, 70), 13 * 40), "ru", "s", 1), (999, sentence(60, 70).upper(), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.kept for r in perplexity.judged(docs).collect()}
    assert not kept.pop(998) and not kept.pop(999) and sum(kept.values()) >= 114


def test_language_model(odd, empty):
    from tests.llm.conftest import texts_of

    rows = bilinear.score_texts(odd).collect()
    assert len(rows) == odd.count() and bilinear.score_texts(empty).count() == 0
    toks = lambda t: [*(t or "").encode().lower().split(), b""]
    key = lambda d: "" if d is None else str(d)
    every = texts_of(odd)
    c = Counter(w for d, t in every if zlib.crc32(key(d).encode()) % 10 for w in toks(t))
    total, whole = c.total(), math.log10(c.total() + 0.1 * (len(c) + 1))
    want = sorted((key(d), len(toks(t)), sum(w in c for w in toks(t)), round(sum(math.log10(c[w] + 0.1) - whole for w in toks(t)), 6)) for d, t in every)
    assert sorted((key(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert all(r.train_tokens == total and r.score < 0 and r.held_out == (zlib.crc32(key(r.doc_id).encode()) % 10 == 0) for r in rows)


def test_vocabulary_grows_and_rare_contexts_count(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    stem = lambda i: f"w{i}x"
    # 1500 words, each of which is mostly followed by a partner of its own; all endings are alike
    texts = [" ".join(f"{stem(i)} {stem(i ^ 1)}" for i in rnd.integers(0, 1500, 300)) for _ in range(500)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = bilinear.word_counts(docs)
    often = bilinear.own_words(counts, 300_000)
    assert len(often) == counts.where(f"c >= {bilinear.LEAST}").count() > 1400
    own = bilinear.own_symbols(often)
    assert sorted(set(own.values()) - {own[b""]}) == list(range(len(own) - 1)) and own[b""] == len(own) - 1 + bilinear.SHARED
    monkeypatch.setattr(bilinear, "ENOUGH", 3_000_000)
    out = bilinear.score_texts(docs).where("held_out").toPandas()
    assert (out.score.sum() - out.base_score.sum()) / out.n_tokens.sum() > 0.3


def test_texts_are_read_twice(spark):
    """To count words and to write symbols; the rounds of learning, and scoring, read those."""
    read = spark.sparkContext.accumulator(0)

    def texts(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(i, f"a b c{i % 7} " * 40) for i in range(50) if zlib.crc32(str(i).encode()) % 10]
    docs = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(texts, "doc_id long, text string")
    assert bilinear.score_texts(docs).count() == len(rows) and read.value == 2 * len(rows)


def test_symbols_are_read_as_written():
    for n, kind in ((1 << 16, "<u2"), ((1 << 16) + 1, "<u4")):
        assert bilinear.stored(n) == kind
        texts = [np.array(t, kind).tobytes() for t in ([n - 1], [3, 0, n - 1], [n - 1])]
        ((symbols, starts),) = bilinear.laid(texts, kind)
        assert symbols.tolist() == [n - 1, 3, 0, n - 1, n - 1] and starts.tolist() == [0, 1, 4]
    assert [s.tolist() for s, _ in bilinear.laid([bytes(bilinear.LAID), b"\1\0"], "<u2")] == [[0] * (bilinear.LAID // 2), [1]]


def test_contexts_stay_in_a_text():
    before, following = bilinear.contexts(np.array([4, 5, 9, 9, 6, 9]), np.array([0, 3, 4]), 9)
    assert following.tolist() == [4, 5, 9, 9, 6, 9]
    assert before.tolist() == [[9, 9], [4, 9], [5, 4], [9, 9], [9, 9], [6, 9]]


def test_model_is_normalised_and_learns():
    rnd = np.random.default_rng(3)
    line = [0]
    for _ in range(6000):
        line.append((line[-1] + int(rnd.integers(0, 3))) % 30)
    before, following = bilinear.contexts(np.array([*line, 30]), np.array([0]), 30)
    unigram = np.bincount(following, minlength=31) / len(following)
    model = bilinear.LogBilinear(unigram, 12)
    assert 1 < len(model.starts) < 31
    plain = np.log10(unigram[following]).mean()
    assert abs(model.log10(before, following).mean() - plain) < 0.05  # nothing learned yet
    model.start(1, len(following))
    for _ in range(20):
        model.learn(before, following)
    assert model.log10(before, following).mean() > plain + 0.5

    def slow(c, t):
        """By definition, one context and one symbol at a time."""
        q = sum(model.before[x].astype(float) @ model.turn[k] for k, x in enumerate(c))
        score = [float(q @ model.next[j]) + float(model.bias[j]) for j in range(len(model.next))]
        top, own = score[31:], [score[j] for j in range(31) if model.of[j] == model.of[t]]
        return (top[model.of[t]] - math.log(sum(map(math.exp, top))) + score[t] - math.log(sum(map(math.exp, own)))) / math.log(10)

    for c in before[rnd.integers(0, len(before), 20)]:
        every = model.log10(np.tile(c, (31, 1)), np.arange(31))
        assert abs((10**every).sum() - 1) < 1e-5
        assert np.allclose(every, [slow(c, t) for t in range(31)], atol=1e-4)


def test_one_text_of_many_words(spark):
    """The count of the text end is right when more words than are sent to tasks occur once."""
    text = " ".join(f"w{i}" for i in range(bilinear.FREQUENT + 500))
    doc = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10)
    row = bilinear.score_texts(spark.createDataFrame([(doc, text)], "doc_id long, text string")).first()
    n = bilinear.FREQUENT + 501
    assert row.n_known == row.n_tokens == row.train_tokens == n
    assert math.isclose(row.base_score, n * math.log10(1.1 / (n + 0.1 * (n + 1))), abs_tol=1e-4)


def test_media(odd, empty):
    assert media.media_columns(empty).count() == 0
    rows = media.media_columns(odd).collect()
    want = Counter((r.doc_id, r.text) for r in odd.collect())
    assert len(rows) == want.total()
    by_text = {}
    for r in rows:
        data = bytes(r.media)
        with wave.open(io.BytesIO(data)) as w:
            back = w.readframes(w.getnframes())
        assert len(back) % 576 == 0 and len(back) == r.payload_bytes > 0 and r.n_bytes <= len(back) < r.n_bytes + 577
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        text = back[: r.n_bytes].decode()
        assert any((r.doc_id, t) in want for t in {text, text or None}) and set(back[r.n_bytes :]) <= {255}
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint


def test_fingerprint_finds_tones():
    t = np.arange(media.RATE)
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * t / media.RATE)).astype(np.uint8)
    assert set(media.peaks(tone)[:, 2]) == {1000 * media.FRAME // media.RATE}
    codes = media.fingerprint(tone)
    assert (np.diff(codes) >= 0).all() and set((codes & 255).tolist()) == set(media.AHEAD)
    assert media.fingerprint(tone[: media.FRAME]).tolist() == []


def test_peaks_by_definition():
    """The transform as a sum over samples, bin by bin."""
    data = np.frombuffer("".join(chr(97 + k * 7 % 26) + " " * (k % 5 == 0) for k in range(500)).encode(), np.uint8)
    found, n = media.peaks(data), media.FRAME
    x = np.concatenate([data.astype(float) - 128, np.zeros(-(len(data) - n) % media.HOP)])
    window = [0.54 - 0.46 * math.cos(2 * math.pi * k / (n - 1)) for k in range(n)]
    assert len(found) == (len(x) - n) // media.HOP + 1
    for f in range(len(found)):
        frame = [a * b for a, b in zip(window, x[f * media.HOP : f * media.HOP + n], strict=True)]
        for k, (low, high) in enumerate(media.BANDS):
            power = [abs(sum(v * complex(math.cos(2 * math.pi * b * i / n), -math.sin(2 * math.pi * b * i / n)) for i, v in enumerate(frame))) for b in range(low, high)]
            assert abs(max(power) - power[found[f, k] - low]) < 1e-5


def test_short_texts_have_fingerprints():
    rnd = np.random.default_rng(5)
    texts = ["", "one", "two words"] + ["".join(rnd.choice(list("abcdefg hij"), n)) for n in (60, 300, 575, 576)]
    marks = [media.fingerprint(np.frombuffer(media.payload(t)[1], np.uint8)).tolist() for t in texts]
    assert all(marks) and len(set(map(tuple, marks))) == len(texts)


def test_last_samples_are_read():
    n = np.arange(4 * media.FRAME)
    low = (128 + 3 * np.sin(2 * np.pi * 1000 * n / media.RATE)).astype(np.uint8)
    for more in (media.HOP // 2, media.HOP - 1):
        tail = low[: len(n) - media.HOP + more].copy()
        assert len(media.peaks(tail)) == (len(tail) - media.FRAME + media.HOP - 1) // media.HOP + 1
        other = tail.copy()
        other[-more:] = np.random.default_rng(4).integers(0, 256, more)
        assert media.fingerprint(tail).tolist() != media.fingerprint(other).tolist()
    for blocks in (1, 2, 3):
        size = blocks * media.BLOCK
        assert (len(media.peaks(np.zeros(size, np.uint8))) - 1) * media.HOP + media.FRAME >= size
