"""Token counts by a compiled finite-state tokenizer, without encoding.

Two deterministic transducers follow each other. The first reads classes of characters and finds where the vocabulary's
split pattern starts a new piece. Its states are few, so texts are cut into chunks of fixed length, each chunk is turned
into a map from every entry state to its exit state, maps are composed by a parallel prefix scan, and a second sweep
over all chunks at once, each from its own entry state, writes the starts. The second reads a piece's bytes. Its
transitions carry how many tokens more the prefix has; states are made the first time they are met and are kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import LONG, batch, documents, kept, slices, tidy, tokenizer_path

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024
CHUNK = 256
#: What a worker keeps; beyond it the store is emptied and filled anew.
PIECES_KEPT, STATES_KEPT, PAIRS_KEPT = 800_000, 200_000, 2_000_000
ROWS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

# classes of characters: letters that end a contraction stand apart
SPACE, WHITE, DIGIT, OTHER, QUOTE, LETTER, STMD, R, V, L, E_, BREAK = range(12)
CLASSES = 12
# states: what the piece at hand is; a quote that began a piece may open a contraction
FRESH, IN_LETTER, IN_DIGIT, IN_OTHER, ONE_SPACE, ONE_WHITE, IN_SPACE, IN_WHITE, HAS_QUOTE, HAS_R, HAS_V, HAS_L, DONE = range(13)
STATES = 13


def _split_machine() -> tuple[np.ndarray, np.ndarray]:
    """Transitions, and what each emits: 0 nothing, 1 a start here, 2 a start one character back, 3 both of them.

    's 't 're 've 'm 'll 'd; then letters, digits or others, each with one blank ahead; then white space, of which the
    last character is left to a visible one that follows. 'r, 'v and 'l are undecided until the next character.
    """
    go, emit = np.zeros((STATES, CLASSES), np.int8), np.zeros((STATES, CLASSES), np.int8)
    letters = (LETTER, STMD, R, V, L, E_)
    opens = {SPACE: ONE_SPACE, WHITE: ONE_WHITE, DIGIT: IN_DIGIT, OTHER: IN_OTHER, QUOTE: HAS_QUOTE, BREAK: FRESH} | dict.fromkeys(letters, IN_LETTER)
    for s in range(STATES):
        for c in range(CLASSES):
            go[s, c], emit[s, c] = opens[c], 1
    for c in letters:
        go[IN_LETTER, c], emit[IN_LETTER, c] = IN_LETTER, 0
        go[ONE_SPACE, c], emit[ONE_SPACE, c] = IN_LETTER, 0
        go[IN_SPACE, c], emit[IN_SPACE, c] = IN_LETTER, 2
        go[IN_WHITE, c], emit[IN_WHITE, c] = IN_LETTER, 3
    for s, joins in ((IN_DIGIT, (DIGIT,)), (IN_OTHER, (OTHER, QUOTE)), (HAS_QUOTE, (OTHER, QUOTE))):
        for c in joins:
            go[s, c], emit[s, c] = IN_DIGIT if c == DIGIT else IN_OTHER, 0
    for c, to in ((DIGIT, IN_DIGIT), (OTHER, IN_OTHER), (QUOTE, IN_OTHER)):
        go[ONE_SPACE, c], emit[ONE_SPACE, c] = to, 0
        go[IN_SPACE, c], emit[IN_SPACE, c] = to, 2
        go[IN_WHITE, c], emit[IN_WHITE, c] = HAS_QUOTE if c == QUOTE else to, 3
    for s in (ONE_SPACE, ONE_WHITE, IN_SPACE, IN_WHITE):
        for c, to in ((SPACE, IN_SPACE), (WHITE, IN_WHITE)):
            go[s, c], emit[s, c] = to, 0
    for c in letters:  # a contraction; or else the quote stands alone and the letter starts a piece
        go[HAS_QUOTE, c], emit[HAS_QUOTE, c] = {STMD: DONE, R: HAS_R, V: HAS_V, L: HAS_L}.get(c, IN_LETTER), 1 if c in (LETTER, E_) else 0
    for s, second in ((HAS_R, E_), (HAS_V, E_), (HAS_L, L)):
        for c in range(CLASSES):
            emit[s, c] = 2 if c in letters else 3
            if c in letters:
                go[s, c] = IN_LETTER
        go[s, second], emit[s, second] = DONE, 0
    return go, emit


GO, EMIT = _split_machine()


def _class_table() -> np.ndarray:
    """The class of every code point, from the same Unicode properties that the split pattern names."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (WHITE, r"[\p{White_Space}]+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            if a < 0xD800 <= b:
                out[a:0xD800] = out[0xE000 : b + 1] = kind
            else:
                out[a : b + 1] = kind
    for chars, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E_)):
        out[[ord(c) for c in chars]] = kind
    return out


class SplitTransducer:
    def __init__(self):
        self.table = _class_table()

    def starts(self, codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """Where pieces start, over texts laid end to end; `breaks` are characters that stand between texts."""
        n = len(codes)
        rows = -(-n // CHUNK)
        kinds = np.full(rows * CHUNK, BREAK, np.uint8)
        kinds[:n] = self.table[codes]
        kinds[breaks] = BREAK
        columns = np.ascontiguousarray(kinds.reshape(rows, CHUNK).T)
        flat_go, flat_emit = GO.ravel(), EMIT.ravel()
        maps = np.tile(np.arange(STATES, dtype=np.int8), (rows, 1))
        for c in columns:  # every entry state of every chunk, a character at a time
            at = maps.astype(np.int16) * CLASSES
            at += c[:, None]
            maps = flat_go[at]
        entry = np.concatenate([[FRESH], scan(maps)[:-1, FRESH]]).astype(np.int16)
        out = np.zeros((CHUNK, rows), np.int8)
        for k, c in enumerate(columns):
            at = entry * CLASSES + c
            out[k] = flat_emit[at]
            entry = flat_go[at].astype(np.int16)
        emitted = out.T.ravel()[:n]
        here = emitted & 1 == 1
        here[:-1] |= emitted[1:] >= 2
        return here


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps, in a logarithmic number of whole-array steps."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.intp), axis=1)
        step *= 2
    return out


def byte_letters() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable ones as they are, others from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeTransducer:
    """Bytes of a piece to its number of tokens.

    A prefix of a piece has one last token in its encoding, and what lies ahead of that token is the encoding of a
    shorter prefix. A state therefore holds, for each start whose bytes so far begin some token, how far into the
    vocabulary's trie it is, the last token ahead of it, and how many tokens are ahead, relative to the whole prefix.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        letters = byte_letters()
        self.special = [t["content"] for t in made["added_tokens"]]
        model = made["model"]
        special = set(self.special)
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items() if t not in special}
        self.ids = {b: i for i, b in self.bytes.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {}
        for rank, (a, b) in enumerate(pairs):
            left, right = bytes(letters[c] for c in a), bytes(letters[c] for c in b)
            self.ranks.setdefault((self.ids[left], self.ids[right]), (rank, self.ids[left + right]))
        self.children: list[dict[int, int]] = [{}]
        self.token = [-1]
        for b, i in self.ids.items():
            node = 0
            for x in b:
                nxt = self.children[node].get(x)
                if nxt is None:
                    nxt = self.children[node][x] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = i
        self.beside: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states, self.known, self.moves = [((0, -1, 0),)], {((0, -1, 0),): 0}, [{}]

    def merge(self, data: bytes) -> list[int]:
        """The encoding by definition: merge the lowest-ranked pair, leftmost first, until none is left."""
        out = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(out) > 1:
            best = min(((self.ranks.get(p, (1 << 60, 0)), i) for i, p in enumerate(zip(out, out[1:], strict=False))), key=lambda x: (x[0][0], x[1]))
            if best[0][0] == 1 << 60:
                break
            out[best[1] : best[1] + 2] = [best[0][1]]
        return out

    def _may_follow(self, a: int, b: int) -> bool:
        found = self.beside.get((a, b))
        if found is None:
            if len(self.beside) > PAIRS_KEPT:
                self.beside.clear()
            found = self.beside[a, b] = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return found

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        kept, last, ahead = [], -1, 0
        for node, before, count in self.states[state]:  # the longest start first
            nxt = self.children[node].get(byte)
            if nxt is None:
                continue
            kept.append((nxt, before, count))
            token = self.token[nxt]
            if last < 0 and token >= 0 and (before < 0 or self._may_follow(before, token)):
                last, ahead = token, count + 1
        new = tuple((node, before, count - ahead) for node, before, count in kept) + ((0, last, 0),)
        to = self.known.get(new)
        if to is None:
            to = self.known[new] = len(self.states)
            self.states.append(new)
            self.moves.append({})
        self.moves[state][byte] = (to, ahead)
        return to, ahead

    def count(self, data: bytes) -> int:
        if len(self.states) > STATES_KEPT:
            self.clear()
        state = total = 0
        moves = self.moves
        for byte in data:
            found = moves[state].get(byte)
            state, more = found if found is not None else self._move(state, byte)
            total += more
        return total


class Counter(dict):
    """Tokens of a piece, counted once for as long as it is kept."""

    def __init__(self, machine: MergeTransducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, piece: str) -> int:
        n = self.machine.count(piece.encode("utf-8"))
        if len(piece) <= LONG:
            self[piece] = n
        return n


_machines: dict[str, tuple[SplitTransducer, MergeTransducer, Counter]] = {}
kept("machines", _machines)


def machines(vocabulary: str) -> tuple[SplitTransducer, MergeTransducer, Counter]:
    if vocabulary not in _machines:
        merge = MergeTransducer(tokenizer_path(vocabulary))
        _machines[vocabulary] = SplitTransducer(), merge, Counter(merge)
    return _machines[vocabulary]


def count_tokens(texts: list[str | None], vocabulary: str = VOCABULARY) -> np.ndarray:
    """Tokens of each whole text; null is the empty text. A special token's string inside a text is one token."""
    split, merge, counted = machines(vocabulary)
    special = re.compile("|".join(map(re.escape, merge.special)))
    out = np.zeros(len(texts), np.int64)
    for a, b in slices(texts):
        if len(counted) > PIECES_KEPT:
            counted.clear()
        parts, owner = [], []
        for i in range(a, b):
            if t := texts[i]:
                found = special.split(t) if any(s in t for s in merge.special) else [t]
                out[i] += len(found) - 1
                parts += found
                owner += [i] * len(found)
        if not parts:
            continue
        text = "\n".join(parts) + "\n"
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        breaks = np.cumsum(lengths + 1) - 1
        here = split.starts(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), breaks)
        here[breaks] = True
        at = np.flatnonzero(here)
        places = at.tolist()
        cuts = [text[x:y] for x, y in zip(places, places[1:], strict=False)] + ["\n"]
        n = np.fromiter(map(counted.__getitem__, cuts), np.int64, len(cuts))
        ends = np.searchsorted(at, breaks)
        n[ends] = 0  # what stands between texts isn't theirs
        total = np.concatenate([[0], np.cumsum(n)])
        per = total[ends] - total[np.concatenate([[0], ends[:-1]])]
        np.add.at(out, np.array(owner), per)
    return out


def with_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of `docs`; null and empty texts have 0 of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            n = count_tokens(texts, vocabulary)
            sizes = [len(t.encode("utf-8")) if t else 0 for t in texts]
            yield batch(ROWS, doc_id=b.column(0), n_bytes=sizes, n_tokens=n, over_limit=n > limit)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run, "machines"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_state_machine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_counts(documents(spark, sf_dir))
