"""Exact byte-level BPE for whole corpora, by backtracking over longest matches.

The encoder never runs merge loops.  An Aho-Corasick automaton over the
(reversed) vocabulary gives, for every byte of a word, the longest token that
starts there.  A word's encoding is the one sequence of tokens whose adjacent
pairs are all *compatible* (merging both tokens' bytes together would again
give exactly these two); the encoder takes longest tokens, checks each against
its left neighbour in a memoised pair-compatibility table, shortens a token
that does not fit and steps back where nothing fits.  Each byte position is
given up at most once, so the time is linear in the length of a word.

Everything around that is vectorised with numpy over a batch of texts: the
split into words works on arrays of code-point classes, equal words are found
by a rolling hash (and compared byte for byte, so a collision cannot change a
result) and only words never seen before reach the encoder.

Defined cases: null and empty text give no ids; strings that look like special
tokens are plain text; text is never normalised or cut.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The code points with the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LAST_LETTER = 0x34000
#: Bytes of text that are held as arrays at a time, and words that a process remembers.
CHUNK_BYTES = 2 << 20
CACHE_WORDS = 1_500_000


def default_vocabulary() -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.json"


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _class_table() -> np.ndarray:
    """Class of each code point; from LAST_LETTER on there are no letters or numbers."""
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    table[:LAST_LETTER] = [kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(LAST_LETTER)]
    table[WHITE_SPACE] = SPACE
    return table


class ByteBPE:
    """A vocabulary with its automaton, split table and the words seen so far."""

    def __init__(self, vocabulary: str):
        import ahocorasick

        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        self.tokens: list[bytes] = [b""] * (1 + max(model["vocab"].values()))
        for text, k in model["vocab"].items():
            if all(c in letters for c in text):
                self.tokens[k] = bytes(letters[c] for c in text)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab = model["vocab"]
        #: The special token is in the vocabulary, but no merge makes it: text never gives it.
        made = [vocab[a + b] for a, b in merges]
        single = {self.tokens[vocab[c]]: vocab[c] for c in letters if c in vocab}
        self.rank = {k: r for r, k in enumerate(made)}
        self.halves = {k: (vocab[a], vocab[b]) for k, (a, b) in zip(made, merges)}
        self.merged = {(vocab[a], vocab[b]): k for k, (a, b) in zip(made, merges)}
        usable = [*single.values(), *made]
        self.size = np.zeros(len(self.tokens), np.int32)
        self.size[usable] = [len(self.tokens[k]) for k in usable]
        by_bytes = {self.tokens[k]: k for k in usable}
        #: The longest token that is a proper start of a token; -1 for single bytes.
        self.shorter = [-1] * len(self.tokens)
        for k in usable:
            t = self.tokens[k]
            self.shorter[k] = next((by_bytes[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_bytes), -1)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, k in by_bytes.items():
            self.automaton.add_word(t[::-1].decode("latin-1"), k)
        self.automaton.make_automaton()
        self.lengths = self.size.tolist()
        self.classes = _class_table()
        #: Bytes and places of all tokens, to decode.
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.place = np.concatenate([[0], np.cumsum([len(t) for t in self.tokens])]).astype(np.int64)
        self.power = self.inverse = np.ones(1, np.uint64)
        self.forget()

    # -- words seen before -------------------------------------------------
    def forget(self) -> None:
        #: Pairs of tokens and whether they may stand side by side.
        self.fits: dict[int, bool] = {}
        self.known: dict[int, int] = {}
        self.word_bytes = np.zeros(0, np.uint8)
        self.word_place = np.zeros(1, np.int64)
        self.word_ids = np.zeros(0, np.int32)
        self.word_start = np.zeros(1, np.int64)

    # -- pairs ---------------------------------------------------------------
    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together are encoded as just these two.

        Undo both tokens' merges from the last to the first.  While doing so, the pieces that touch must not have
        a merge that would have come before the one just undone.
        """
        key = left << 20 | right
        known = self.fits.get(key)
        if known is not None:
            return known
        rank, merged, halves = self.rank, self.merged, self.halves
        a, b, bound, fine = left, right, 1 << 60, True
        while True:
            together = merged.get((a, b))
            if together is not None and rank[together] < bound:
                fine = False
                break
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            # On equal rank (the same token twice) the left one was made first, so the right one is undone first.
            if ra > rb:
                bound, a = ra, halves[a][1]
            else:
                bound, b = rb + 1, halves[b][0]
        self.fits[key] = fine
        return fine

    def backtrack(self, longest: list[int], begin: int, end: int) -> list[int]:
        """Ids of the word at begin:end, given the longest token from each position."""
        lengths, shorter, fits = self.lengths, self.shorter, self.fits
        token = longest[begin]
        if begin + lengths[token] == end:
            return [token]
        out: list[int] = []
        dead: set[int] = set()
        at = begin
        while at < end:
            last = out[-1] if out else -1
            while token >= 0:
                to = at + lengths[token]
                if to not in dead:
                    if last < 0:
                        break
                    fine = fits.get(last << 20 | token)
                    if fine or (fine is None and self.compatible(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = to
                token = longest[at] if at < end else -1
            else:
                dead.add(at)
                token = out.pop()
                at -= lengths[token]
        return out

    def learn(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, keys: list[int]) -> None:
        """Encode words that are new and remember them under their keys."""
        size = end - begin
        place = np.concatenate([[0], np.cumsum(size)])
        own = data[_ranges(begin, size)]
        # One text of all words, each followed by a letter that no token has, read from its end.
        gapped = np.full(len(own) + len(size), 256, np.uint16)
        gapped[np.arange(len(own)) + np.repeat(np.arange(len(size)), size)] = own
        text = gapped[::-1].tobytes().decode("utf-16-le")
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        at, first = np.unique(found[:, 0], return_index=True)  # the first at a place is the longest
        longest = np.full(len(gapped), -1, np.int64)
        longest[len(gapped) - 1 - at] = found[first, 1]
        longest = longest.tolist()
        starts = (place[:-1] + np.arange(len(size))).tolist()
        ids = [self.backtrack(longest, s, s + n) for s, n in zip(starts, size.tolist())]
        base = len(self.word_place) - 1
        self.known.update(zip(keys, range(base, base + len(keys))))
        self.word_bytes = np.concatenate([self.word_bytes, own])
        self.word_place = np.concatenate([self.word_place, self.word_place[-1] + place[1:]])
        self.word_ids = np.concatenate([self.word_ids, np.fromiter(chain.from_iterable(ids), np.int32)])
        self.word_start = np.concatenate([self.word_start, self.word_start[-1] + np.cumsum([len(x) for x in ids])])

    # -- split into words ------------------------------------------------------
    def words(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Byte at which each word begins, for texts at edges[k]:edges[k+1] of UTF-8 data; then the code points, their byte places and which of them begin a word.

        The split is that of the usual byte-level pattern: contractions; runs of letters, of numbers and of other
        signs, each with one blank before it; white space, whose last sign stands alone before a visible one.
        """
        none = np.zeros(0, np.int64)
        if not len(data):
            return none, none, none, np.zeros(0, bool)
        byte = np.flatnonzero((data & 0xC0) != 0x80)
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = self.classes[cp]
        n = len(cp)
        text_start = np.zeros(n + 1, bool)
        text_start[np.searchsorted(byte, edges)] = True  # empty texts share the place of the next one
        start = text_start[:n].copy()
        start[0] = True
        start[1:] |= kind[1:] != kind[:-1]
        blank = cp == 32
        # b: first visible sign after white space of the same text
        b = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~text_start[1:n]) + 1
        start[b - 1] = True
        start[b[blank[b - 1]]] = False
        # contractions
        q = np.flatnonzero((cp == 39) & start)
        q = q[q + 1 < n]
        if len(q):
            following = np.append(cp, [0, 0])
            one, two = following[q + 1], following[q + 2]
            cut = np.append(text_start, True)
            inside1 = ~cut[q + 1]
            inside2 = inside1 & ~cut[q + 2]
            short = inside1 & np.isin(one, [ord(c) for c in "stmd"])
            long = inside2 & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
            for hit, size in ((short, 2), (long, 3)):
                to = q[hit] + size
                start[q[hit] + 1] = False
                start[to[to < n]] = True
        # the letters after a contraction's apostrophe no longer begin a word; what follows it does
        return byte[start], cp, byte, start

    # -- equal words -------------------------------------------------------------
    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, CHUNK_BYTES + 4096)
            base, back = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, base)]))
                self.inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, back)]))

    def lookup(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of each word among those remembered, learning the new ones."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        self._powers(len(data) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * self.power[: len(data)], dtype=np.uint64)])
            key = (total[end] - total[begin]) * self.inverse[begin]
            key ^= (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        code, distinct = pd.factorize(key)
        keys = distinct.tolist()
        number = np.fromiter((self.known.get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(number < 0)
        if len(new):
            sample = np.empty(len(keys), np.int64)
            sample[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            first = len(self.word_place) - 1
            self.learn(data, begin[sample[new]], end[sample[new]], [keys[k] for k in new])
            number[new] = np.arange(first, first + len(new))
        word = number[code]
        # A shared key is no proof: compare the bytes.
        size = end - begin
        same = np.diff(self.word_place)[word] == size
        if same.all():
            differ = data[begin[0] : end[-1]] != self.word_bytes[_ranges(self.word_place[word], size)] if len(word) else np.zeros(0, bool)
            if not differ.any():
                return word
            same = np.ones(len(word), bool)
            same[np.searchsorted(begin - begin[0], np.flatnonzero(differ), "right") - 1] = False
        else:
            for k in np.flatnonzero(same):
                s = self.word_place[word[k]]
                same[k] = np.array_equal(data[begin[k] : end[k]], self.word_bytes[s : s + size[k]])
        for k in np.flatnonzero(~same):  # a true collision: remembered without a key
            word[k] = len(self.word_place) - 1
            self.learn(data, begin[k : k + 1], end[k : k + 1], [])
        return word

    # -- batches -----------------------------------------------------------------
    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places (one more than texts) and flat ids of an Arrow array of strings."""
        data, edges = text_bytes(texts)
        counts, parts = np.zeros(len(edges) - 1, np.int64), []
        for first, last, begin, end in chunks(data, edges):
            own = np.clip(edges[first : last + 1], begin, end) - begin
            part = data[begin:end]
            starts, *_ = self.words(part, own)
            if not len(starts):
                continue
            word = self.lookup(part, starts, np.append(starts[1:], len(part)))
            size = np.diff(self.word_start)[word]
            parts.append(self.word_ids[_ranges(self.word_start[word], size)])
            total = np.concatenate([[0], np.cumsum(size)])
            counts[first:last] += np.diff(total[np.searchsorted(starts, own)])
        return np.concatenate([[0], np.cumsum(counts)]), np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        data, edges = text_bytes(texts)
        counts = np.zeros(len(edges) - 1, np.int64)
        for first, last, begin, end in chunks(data, edges):
            own = np.clip(edges[first : last + 1], begin, end) - begin
            part = data[begin:end]
            starts, *_ = self.words(part, own)
            if len(starts):
                word = self.lookup(part, starts, np.append(starts[1:], len(part)))
                total = np.concatenate([[0], np.cumsum(np.diff(self.word_start)[word])])
                counts[first:last] += np.diff(total[np.searchsorted(starts, own)])
        return counts

    def decode(self, places: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """Bytes of each list of ids, from the table of the tokens' places."""
        ids = np.asarray(ids, np.int64)
        size = np.diff(self.place)[ids]
        flat = self.blob[_ranges(self.place[ids], size)].tobytes()
        edge = np.concatenate([[0], np.cumsum(size)])[places].tolist()
        return [flat[a:b] for a, b in zip(edge, edge[1:])]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0]..start[0]+size[0]-1, start[1].., joined."""
    total = int(size.sum())
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(total)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array of strings and the edges between its texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[edges[0] : edges[-1]], edges - edges[0]


#: A lone blank between signs, not before what may be a fence.
_SAFE = re.compile(rb"[!-~] (?=[!-_a-}])")


def chunks(data: np.ndarray, edges: np.ndarray):
    """(first text, last text + 1, first byte, end byte) of parts of about CHUNK_BYTES; a longer text is cut before a lone blank, where a word begins in any case."""
    k, n = 0, len(edges) - 1
    while k < n:
        last = max(k + 1, int(np.searchsorted(edges, edges[k] + CHUNK_BYTES, "right")) - 1)
        begin, end = int(edges[k]), int(edges[last])
        while end - begin > 2 * CHUNK_BYTES:
            cut = _SAFE.search(data[begin + CHUNK_BYTES : min(end, begin + 2 * CHUNK_BYTES)].tobytes())
            if not cut:
                break
            to = begin + CHUNK_BYTES + cut.start() + 1
            yield k, last, begin, to
            begin = to
        yield k, last, begin, end
        k = last


_open: dict[str, ByteBPE] = {}


def vocabulary(path: str | None = None) -> ByteBPE:
    """The vocabulary at a path; a process reads it once."""
    path = path or default_vocabulary()
    path = os.path.abspath(path)
    if path not in _open:
        _open[path] = ByteBPE(path)
    return _open[path]
