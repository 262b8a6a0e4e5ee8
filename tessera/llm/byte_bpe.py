"""Ids of the public byte-level BPE, exactly those of the tokenizers library.

Texts of Latin letters, digits, ASCII and common marks are cut into words by array
operations over many texts at once: each character has a class (letter, digit, white
space, other), and a word begins where the class changes, but that a space belongs to
the word behind it, that of a run of white space the last character stands alone, and
that an apostrophe takes s, t, m, d, re, ve or ll with it. Words are looked up by a
64-bit polynomial hash in a bounded table of their ids; new ones are encoded by
tiktoken, which has the same vocabulary as ranks. Texts with other characters go to
tiktoken as they are; texts with the special token's string, and with runs of over a
thousand characters, go to the tokenizers library. Tests hold the three against each
other. Long texts are cut in front of white space, where a word always begins, so
memory is that of ``CHARACTERS`` characters, or of a longer run without white space.
"""

from __future__ import annotations

import base64
import re

import numpy as np

from .common import set_threads

#: Letters that this module knows: ASCII, Latin-1, Latin Extended-A.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
#: Other characters that are neither letters, numbers nor white space.
_MARKS = "¡-©«¬®-±´¶-¸»¿×÷‐-‧€"
_LETTER, _DIGIT, _SPACE, _OTHER = 1, 2, 3, 4
_LONG = 1000
_RUN = re.compile(r"\S{1000}|\s{1000}")
_BREAK = re.compile(r"(?<=\S)[ \t-\r]")
_REMEMBER, _BITS = 300_000, 20
CHARACTERS = 1 << 20
_FACTOR = 0x9E3779B97F4A7C15


def _classes() -> np.ndarray:
    out = np.zeros(1 << 14, np.uint8)
    for kind, pattern in ((_LETTER, _LETTERS), (_DIGIT, "0-9"), (_SPACE, " \t-\r"), (_OTHER, _MARKS)):
        out[[ord(c) for c in map(chr, range(1 << 14)) if re.match(f"[{pattern}]", c)]] = kind
    rest = np.arange(0x21, 0x7F)
    out[rest[out[rest] == 0]] = _OTHER
    return out


class _Table:
    """Words by their hash: open addressing over arrays, never more than half full."""

    def __init__(self):
        self.keys, self.of = np.zeros(1 << _BITS, np.uint64), np.zeros(1 << _BITS, np.int32)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(_FACTOR)) >> np.uint64(64 - _BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the words, -1 for new ones."""
        slot = self._slots(h)
        key = self.keys[slot]
        out = np.where(key == h, self.of[slot], np.int32(-1))
        todo = np.flatnonzero((key != h) & (key != 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << _BITS) - 1)
            key, want = self.keys[slot], h[todo]
            same = key == want
            out[todo[same]] = self.of[slot[same]]
            on = ~same & (key != 0)
            todo, slot = todo[on], slot[on]
        return out

    def put(self, h: np.ndarray, number: np.ndarray) -> None:
        """h: different hashes that are not there."""
        slot = self._slots(h)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            won = self.keys[slot] == h
            self.of[slot[won]] = number[won]
            h, number, slot = h[~won], number[~won], (slot[~won] + 1) & ((1 << _BITS) - 1)


class Encoder:
    def __init__(self, path: str | None = None, ranks_path: str | None = None):
        """path: the tokenizers file; ranks_path: the same vocabulary as tiktoken ranks."""
        set_threads()
        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path or P.path("byte_bpe_50k.json"))
        with open(ranks_path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [str(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.classes = _classes()
        self.powers = np.full(CHARACTERS + 1, _FACTOR, np.uint64)
        self.powers[0] = 1
        self.powers = np.cumprod(self.powers, dtype=np.uint64)
        self.inverses = np.full(CHARACTERS + 1, pow(_FACTOR, -1, 1 << 64), np.uint64)
        self.inverses[0] = 1
        self.inverses = np.cumprod(self.inverses, dtype=np.uint64)
        self.table, self.ids, self.first = _Table(), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _by_library(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _piece(self, word: str) -> list[int]:
        if len(word) > _LONG:  # the ranks' merge loop is quadratic in a word
            return self.whole.encode(word, add_special_tokens=False).ids
        return self.ranks._core_bpe.encode_single_piece(word.encode())

    def _other(self, text: str) -> np.ndarray:
        """The ids of a text with characters that this module does not know."""
        if _RUN.search(text):
            return self._by_library(text)
        return np.array(self.ranks.encode_ordinary(text), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list = [None] * len(texts)
        held, size = [], 0
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i] = self._by_library(text)
            elif len(text) > CHARACTERS:
                out[i] = self._long(text)
            else:
                if size + len(text) > CHARACTERS:
                    self._into(out, held, texts)
                    held, size = [], 0
                held.append(i)
                size += len(text)
        self._into(out, held, texts)
        return out

    def _long(self, text: str) -> np.ndarray:
        parts, at = [], 0
        while at < len(text):
            m = _BREAK.search(text, at + CHARACTERS // 2)
            end = m.start() if m else len(text)
            if end - at > CHARACTERS:  # no white space near: cut at no place at all
                return self._other(text)
            parts.append(text[at:end])
            at = end
        known = self._known(parts)
        return self._other(text) if any(x is None for x in known) else np.concatenate(known)

    def _into(self, out: list, held: list[int], texts: list[str]) -> None:
        if held:
            for i, ids in zip(held, self._known([texts[i] for i in held]), strict=True):
                out[i] = self._other(texts[i]) if ids is None else ids

    def _known(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of each text, None where a character is unknown."""
        out = []
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHARACTERS):
                size, hi = size + len(texts[hi]), hi + 1
            out += self._known_part(texts[lo:hi])
            lo = hi
        return out

    def _known_part(self, texts: list[str]) -> list[np.ndarray | None]:
        joined = "".join(texts)
        n = len(joined)
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        if not n:
            return [np.zeros(0, np.uint32)] * len(texts)
        c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.classes[np.minimum(c, len(self.classes) - 1)]
        kind[c >= len(self.classes)] = 0
        begin = np.zeros(n + 1, bool)
        begin[ends - lengths] = True
        starts = self._starts(c, kind, begin)
        at = np.flatnonzero(starts)
        to = np.r_[at[1:], n]
        # The hash of a word: its characters times powers of the factor, from its start.
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((c + np.uint32(1)) * self.powers[:n], out=sums[1:])
        h = (sums[to] - sums[at]) * self.inverses[at]
        h[h == 0] = 1
        number = self.table.find(h)
        new = np.flatnonzero(number < 0)
        ids, first = self.ids, self.first
        if len(new):
            _, one, which = np.unique(h[new], return_index=True, return_inverse=True)
            some = new[one]
            pieces = [self._piece(joined[a:b]) for a, b in zip(at[some].tolist(), to[some].tolist(), strict=True)]
            number[new] = len(first) - 1 + which
            ids = np.r_[ids, np.array([x for p in pieces for x in p], np.uint32)]
            first = np.r_[first, first[-1] + np.cumsum([len(p) for p in pieces])]
            if len(first) <= _REMEMBER:
                self.table.put(h[some], np.arange(len(self.first) - 1, len(first) - 1, dtype=np.int32))
                self.ids, self.first = ids, first
        a, k = first[number], first[number + 1] - first[number]
        done = np.cumsum(k)
        flat = ids[np.repeat(a - (done - k), k) + np.arange(int(done[-1]))]
        # Words before the end of each text give its place in the ids.
        words = np.searchsorted(at, ends)
        stop = np.where(words > 0, done[np.maximum(words - 1, 0)], 0)
        bad = np.zeros(len(texts), bool)
        unknown = np.flatnonzero(kind == 0)
        if len(unknown):
            bad[np.searchsorted(ends, unknown, "right")] = True
        lo = np.r_[0, stop[:-1]]
        return [None if x else flat[p:q] for x, p, q in zip(bad.tolist(), lo.tolist(), stop.tolist(), strict=True)]

    @staticmethod
    def _starts(c: np.ndarray, kind: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Where words begin; begin: where texts begin, one longer than c."""
        n = len(c)
        space = kind == _SPACE
        starts = begin[:n].copy()
        change = (kind[1:] != kind[:-1]) | begin[1:n]
        blank = (c[:-1] == 32) & space[:-1] & ~begin[1:n]
        # A change of class begins a word, unless a space before it belongs to it.
        starts[1:] |= change & ~(blank & ~space[1:])
        # The last of several white spaces before a word stands alone, or goes with the word.
        inner = np.flatnonzero(space[1:] & space[:-1] & ~begin[1:n]) + 1
        inner = inner[(inner + 1 < n)]
        starts[inner[~space[inner + 1] & ~begin[inner + 1]]] = True
        # An apostrophe by itself, not behind a space, takes some letters with it.
        at = np.flatnonzero(c == 39)
        at = at[starts[at] & (at + 1 < n)]
        at = at[(kind[at + 1] == _LETTER) & ~begin[at + 1]]
        if len(at):
            x = c[at + 1]
            inside = (at + 2 < n) & ~begin[np.minimum(at + 2, n)]
            y = np.where(inside, c[np.minimum(at + 2, n - 1)], 0)
            e = ord("e")
            two = ((x == ord("r")) & (y == e)) | ((x == ord("v")) & (y == e)) | ((x == ord("l")) & (y == ord("l")))
            one = np.isin(x, [ord(k) for k in "stmd"])
            taken, size = at[one | two], np.where(two, 3, 2)[one | two]
            starts[taken + 1] = False
            after = taken + size
            after = after[(after < n)]
            starts[after[kind[after] == _LETTER]] = True
        return starts


_encoder: Encoder | None = None


def encoder() -> Encoder:
    """One encoder a worker."""
    global _encoder
    if _encoder is None:
        _encoder = Encoder()
    return _encoder
