"""Whole texts to token ids by the tokenizers library, each different piece between blanks encoded once.

A byte-level vocabulary starts a new pre-token at every blank or line end that has a visible character beside it, and
the word vocabulary drops white space, so pieces between blanks are encoded alone and their ids are joined. Pieces that are
a word and marks go to the library's model without its patterns, others with them, many in one call each; a word that is
kept isn't encoded again for other marks. Texts in
which that could differ (runs of three white spaces, two at the end, special tokens) go to the library as they are.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np

from quire.llm.common import LONG, kept, slices, tokenizer_path
from quire.llm.tokencount import byte_letters

#: Bytes of pieces and ids that a worker keeps.
KEPT = 240 << 20
#: What a piece takes beside its characters and ids: two objects and a place in the store.
EACH = 180
UNSAFE = re.compile(r"\s[ \n]\s|\s[ \n]\Z")
#: What any unsafe text holds, and few others do; it is found faster.
DOUBLE = re.compile(r"[ \n](?:\s|\Z)")
SPACE = re.compile(r"\s")
PER_CALL = 256
#: Characters whose pieces are looked up before those that aren't kept are encoded.
AT_ONCE = 1 << 18
#: Marks that may stand behind a word of Latin letters: the vocabularies' patterns cut between the two, whatever stands beside them.
MARKS = ".,;:!?\")#*$%&|<>"
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


_encoders: dict[str, "PieceEncoder"] = {}
kept("encoders", _encoders)


def encoder(name: str, most: int = KEPT) -> PieceEncoder:
    """The worker's encoder, loaded once; it keeps pieces of `most` bytes."""
    if name not in _encoders:
        _encoders[name] = PieceEncoder(name)
    _encoders[name].kept = most
    return _encoders[name]


class PieceEncoder:
    """encode() gives each text's ids as little-endian unsigned 32-bit integers; null is the empty text.

    Pieces are kept in two stores of half of `kept` bytes. When the newer is full it becomes the older, whose pieces are taken
    over as they are met; those that aren't go with it and are encoded again, which costs time and changes no result.
    """

    def __init__(self, name: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.library = Tokenizer.from_file(tokenizer_path(name))
        self.library.no_padding()
        self.library.no_truncation()
        self.byte_level = self._ids("\n") != b""
        self.kept, self.held, self.store, self.old = kept, 0, {}, {}
        self.marks = {"": b""}
        self.bare = Tokenizer(self.library.model)  # words as its vocabulary writes them, cut at blanks
        self.bare.pre_tokenizer = WhitespaceSplit()
        letters = {b: c for c, b in byte_letters().items()}
        self.letters = {b: letters[b] for b in range(256)}  # bytes as byte-level vocabularies write them
        self.lead = self.letters[32] if self.byte_level else ""
        edge = str.startswith if self.byte_level else str.endswith
        at = [i for t, i in self.library.get_vocab().items() if edge(t, self.lead or self.library.model.end_of_word_suffix or "")]
        self.edges = np.zeros(self.library.get_vocab_size() + 1, bool)  # ids that begin a word with its blank, or end one
        self.edges[at] = True
        added = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.special = list(added if self.byte_level else added | {x.lower() for x in added})
        self.line = self._ids("\n")
        self.mark = "\n" if self.byte_level else " | "

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _marked(self, library: "Tokenizer", mark: str, texts: list[str]) -> Iterator[bytes]:
        """The ids of texts that hold no mark: many of them in one call, cut at the mark's id."""
        (cut,) = library.encode(mark, add_special_tokens=False).ids
        return self._cut(library, mark, texts, lambda ids: ((at := np.flatnonzero(ids == cut)), at + 1))

    def _bare(self, words: list[str]) -> Iterator[bytes]:
        """The ids of words as the vocabulary writes them, cut where its ids begin or end a word."""
        if self.byte_level:
            return self._cut(self.bare, " ", words, lambda ids: ((at := np.flatnonzero(self.edges[ids])[1:]), at))
        return self._cut(self.bare, " ", words, lambda ids: ((at := np.flatnonzero(self.edges[ids])[:-1] + 1), at))

    def _cut(self, library: "Tokenizer", mark: str, texts: list[str], found: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Iterator[bytes]:
        """The ids of texts, joined by the mark; `found` gives where in the ids one ends and where the next begins."""
        for i in range(0, len(texts), PER_CALL * 16):
            calls = [texts[k : k + PER_CALL] for k in range(i, min(i + PER_CALL * 16, len(texts)), PER_CALL)]
            for c, e in zip(calls, library.encode_batch_fast([mark.join(c) for c in calls], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends, starts = found(ids)
                if len(ends) != len(c) - 1:
                    yield from (np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in c)
                    continue
                data = ids.tobytes()
                yield from [data[x:y] for x, y in zip([0, *(starts * 4).tolist()], [*(ends * 4).tolist(), len(data)], strict=True)]

    def _plain(self, pieces: set[str]) -> dict[str, bytes]:
        """Those of the pieces that are a word and marks: the words as the vocabulary writes them, straight from its model."""
        found = [(p, w) for p in pieces if (w := p.rstrip(MARKS)).isalpha() and (w.isascii() or LATIN.fullmatch(w))]
        met = {w for _, w in found}
        made = {w: ids for w in met.difference(pieces) if (ids := self.store.get(w) or self.old.get(w))}
        new = list(met.difference(made))
        words = new if self.byte_level else [w.lower() for w in new]
        words = [self.lead + (w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)) for w in words]
        made.update(zip(new, self._bare(words), strict=True))
        return {p: made[w] if p is w else made[w] + self._end(p[len(w) :]) for p, w in found}

    def _end(self, marks: str) -> bytes:
        """The ids of the marks behind a word."""
        ids = self.marks.get(marks)
        if ids is None:
            ids = self._ids(marks)
            if len(self.marks) < 10_000 and len(marks) <= LONG:
                self.marks[marks] = ids
        return ids

    def _encoded(self, pieces: set[str]) -> dict[str, bytes]:
        """Different pieces with their ids."""
        out = self._plain(pieces)
        pieces = pieces.difference(out)
        if not self.byte_level:
            some = [p for p in pieces if p and "|" not in p and not SPACE.search(p)]
            out.update(zip(some, self._marked(self.library, self.mark, some), strict=True))
        else:
            some = [p for p in pieces if p and not SPACE.search(p)]
            out.update(zip(some, self._marked(self.library, self.mark, [" " + p for p in some]), strict=True))
            lines = {p: p[1:].rstrip(MARKS) for p in pieces if len(p) > 1 and p[0] == "\n"}
            some = [p for p, w in lines.items() if w.isascii() and w.isalpha()]
            out |= {p: self.line + ids + self._end(p[1 + len(lines[p]) :]) for p, ids in zip(some, self._marked(self.bare, " | ", [lines[p] for p in some]), strict=True)}
            some = [p for p in lines.keys() - out.keys() if not SPACE.search(p, 1)]
            out.update(zip(some, (self.line + ids for ids in self._marked(self.library, self.mark, [p[1:] for p in some])), strict=True))
        for p in pieces.difference(out):
            out[p] = self._ids(p if p[:1] == "\n" or not self.byte_level else " " + p)
        return out

    def _learn(self, new: set[str]) -> None:
        """Keeps the ids of these pieces, none of which is in the newer store."""
        if self.held > self.kept // 2:
            self.old, self.store, self.held = self.store, {}, 0
        made = {p: self.old[p] for p in new if p in self.old}
        made |= self._encoded(new.difference(made))
        self.store.update(made)
        self.held += size(made)

    def _lower(self, text: str) -> str:
        """The text, lower-cased if the vocabulary does that anyway and all agree on how: no letter of Latin-1 depends on those beside it."""
        if self.byte_level:
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    def _pieces(self, text: str) -> list[str]:
        return text.replace("\n", " \n" if self.byte_level else " ").split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for a, b in slices(texts, AT_ONCE):
            rows: list[tuple[bytes, list[bytes | None]]] = []
            gaps: list[tuple[list[bytes | None], int, str]] = []
            get = self.store.get
            for t in texts[a:b]:
                low = self._lower(t or "")
                if not t:
                    rows.append((b"", []))
                elif self.byte_level and DOUBLE.search(t) and UNSAFE.search(t) or any(x in low for x in self.special):
                    rows.append((self._ids(t), []))
                else:
                    pieces, first = self._pieces(low), b""
                    if self.byte_level:  # the first has no blank ahead
                        first = self._ids(pieces[0]) if pieces[0] else b""
                        del pieces[0]
                    ids = list(map(get, pieces))
                    gaps += [(ids, i, pieces[i]) for i, x in enumerate(ids) if x is None]
                    rows.append((first, ids))
            if gaps:
                self._learn({p for _, _, p in gaps})
                for ids, i, p in gaps:
                    ids[i] = self.store[p]
            out += [first + b"".join(ids) if ids else first for first, ids in rows]
        return out


def size(pieces: dict[str, bytes]) -> int:
    return EACH * len(pieces) + sum(map(len, pieces)) + sum(map(len, pieces.values()))
