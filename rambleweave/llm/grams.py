"""Sets of character n-grams, their frequencies, and the signatures by which similar ones meet.

A text's grams are ordered from rare to frequent. Two sets of Jaccard similarity t share all but (1 - t) of each one's
grams at most, so they must meet among the first of them. A gram that is rare in the corpus is indexed by itself. For
a frequent one that would join far too many texts: frequent grams are dealt into groups by hash, and what is indexed
are the combinations of k grams of one group. If two sets share no such combination, then of c grams of a group at
least c - (k - 1) are missing in the other set; so the prefix is extended until what the groups would have to miss
together, Σ max(0, c - (k - 1)), exceeds what a similar set can miss. Nothing is lost by this.

Signatures are made once per text. Those of a text as the smaller set of a pair are the first of those it has as the
larger set, since a larger partner must share more; how far each reaches is kept with it. The number of groups
follows the size of the sets, by classes of sizes, and a pair meets in the class of its larger set: a set near the
upper edge of its class visits the next one as the smaller set of a pair.

Everything here works on blocks of texts at once, sorted by packed 64-bit keys.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import ceil, floor, log2

import numpy as np

#: A gram is a hash of so many bits.
GRAM_BITS = 40
#: Up to so many texts a gram is indexed alone, up to the next bound in pairs, above in triples.
BOUNDS, TAKEN = (16, 1500), (1, 2, 3)
#: Sets of smaller classes are indexed gram by gram.
LEAST_CLASS = 5
#: Part of the threshold that the groups of a class may leave uncounted, and part that a pair must share as signatures. What is left of 1 is for rounding.
UNCOUNTED, SHARED = 6 / 7, 0.07
LEAST_THRESHOLD = 0.4
#: Slots of the table of frequencies, as powers of two: it grows with the number of distinct grams between these bounds (1 to 64 MB). Grams that share a slot count together, which only makes them seem more frequent.
LEAST_SLOTS, MOST_SLOTS = 20, 26
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hashes(text: str, n: int) -> np.ndarray:
    """A hash for each place of a text, of the n characters from it on; the last n - 1 places reach beyond the end and mean nothing."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(max(0, len(cp) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * _MULTIPLIER + cp[k : len(cp) - n + 1 + k] + np.uint64(1)
    return mix(h)


def grams(text: str, n: int = 5) -> np.ndarray:
    """64-bit hashes of the distinct substrings of n characters, sorted."""
    return np.unique(_hashes(text, n))


def gram_block(texts: list[str], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Grams of several texts, in the order of their places and with repetitions, and the number of the text of each."""
    size = np.array([len(t) for t in texts], np.int64)
    h = _hashes("".join(texts), n) >> _U(64 - GRAM_BITS)
    of = np.repeat(np.arange(len(texts)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(of))
    keep = np.flatnonzero(left[: len(h)] >= n)
    return h[keep], of[keep]


def slots_for(distinct: int) -> int:
    """Slots for so many distinct grams: at least four for each, within the bounds."""
    return 1 << min(MOST_SLOTS, max(LEAST_SLOTS, (4 * max(1, distinct)).bit_length()))


def slot(g: np.ndarray, slots: int) -> np.ndarray:
    return (g & _U(slots - 1)).astype(np.int64)


def quantised(n: np.ndarray) -> np.ndarray:
    """Frequencies as bytes: exact up to 30, then in steps of a twelfth of a doubling."""
    n = np.asarray(n, np.float64)
    return np.where(n <= 30, n, np.minimum(255, 30 + np.round(12 * np.log2(np.maximum(n, 30) / 30)))).astype(np.uint8)


@lru_cache(None)
def _choose(c: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(c), k)), np.int64)


def size_class(size: int) -> int:
    return floor(log2(max(1, size)))


def shared_needed(scheme: int, threshold: float) -> int:
    """Signatures that a similar pair shares at least, by the size class of its larger set.

    A pair of class c shares at least t * 2^c grams; the groups leave at most UNCOUNTED of those uncounted.
    """
    return max(1, int(SHARED * threshold * 2**scheme)) if scheme >= LEAST_CLASS else 1


def groups_of(scheme: int, threshold: float) -> tuple[int, int]:
    """Groups of grams that are indexed in pairs and in triples: they leave one and two grams each uncounted."""
    each = max(1, int(UNCOUNTED * threshold / 3 * 2**scheme))
    return each, each


@dataclass
class Postings:
    """Signatures of a block of texts: sig, the text's number in the block, reach (the greatest size of a partner for which it is within the prefix), and whether the text only visits the class, as the smaller set of a pair. size: grams of each text."""

    sig: np.ndarray
    of: np.ndarray
    reach: np.ndarray
    visitor: np.ndarray
    size: np.ndarray


def signatures(g: np.ndarray, of: np.ndarray, count: int, table: np.ndarray, threshold: float, from_class: int = 0) -> Postings:
    """Signatures of count texts (at most 256), whose grams g are given with their texts of. table: quantised frequencies per slot.

    The more alike two sizes are, the more a similar pair must share: what a set may miss falls with its partner's
    size, and with it the prefix. So a signature that comes late counts for small partners only. Classes below from_class
    are left out.
    """
    if not LEAST_THRESHOLD <= threshold <= 1:
        raise ValueError(f"the threshold must be at least {LEAST_THRESHOLD} and at most 1")
    if count > 256:
        raise ValueError("a block has at most 256 texts")
    # by text, then from rare to frequent: an order that is the same in all texts
    key = np.sort((of.astype(np.uint64) << _U(56)) | (table[slot(g, len(table))].astype(np.uint64) << _U(GRAM_BITS + 8)) | g << _U(8))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    doc = (key >> _U(56)).astype(np.int64)
    df = ((key >> _U(GRAM_BITS + 8)) & _U(255)).astype(np.int64)
    g = (key >> _U(8)) & _U((1 << GRAM_BITS) - 1)
    n = np.bincount(doc, minlength=count)
    start = np.cumsum(n) - n
    place = np.arange(len(doc)) - start[doc]
    kinds = np.searchsorted(quantised(np.array(BOUNDS)), np.arange(256), "left")  # 0 alone, 1 pairs, 2 triples
    mixed = mix(g)
    own = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    part_of = threshold / (1 + threshold)
    out: list[tuple[np.ndarray, ...]] = []
    for above in range(ceil(log2(1 / threshold)) + 1):
        visitor = above > 0
        takes_part = (n > 0) & (n / threshold + 1 >= 2.0 ** (own + above) if visitor else n > 0)
        scheme = own + above
        takes_part &= scheme >= from_class
        each = np.array([groups_of(s, threshold)[0] for s in range(int(scheme.max(initial=0)) + 1)])
        need = np.array([shared_needed(s, threshold) for s in range(len(each))])
        # what a set may lack as the larger one of a pair; a visitor, of a partner of the class's least size. One more for two grams of the same hash.
        lacks = np.where(visitor, n - np.ceil(part_of * (n + 2.0**scheme) - 1e-9), n - np.ceil(threshold * n - 1e-9)).astype(np.int64) + 1
        most = lacks + need[scheme] + np.where(scheme >= LEAST_CLASS, 3 * each[scheme], 0) + 1
        at = np.flatnonzero(takes_part[doc] & (place < most[doc]))
        if not len(at):
            continue
        d, p, gm = doc[at], place[at], mixed[at]
        s = scheme[d]
        kind = np.where(s >= LEAST_CLASS, kinds[df[at]], 0)
        taken = np.array(TAKEN)[kind]
        # number of each gram within its group, in the order of the prefix
        tag = mix(s.astype(np.uint64) + _U(77))
        many = each[s]
        group = ((gm ^ tag) >> _U(34)).astype(np.int64) % many
        where = np.where(kind == 0, 0, group + np.where(kind == 2, many, 0) + 1)
        grouped = np.sort((d.astype(np.uint64) << _U(56)) | (where.astype(np.uint64) << _U(28)) | np.arange(len(at), dtype=np.uint64))
        by = (grouped & _U((1 << 28) - 1)).astype(np.int64)
        bucket = grouped >> _U(28)
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        width = np.diff(np.append(edge, len(by)))
        within = np.empty(len(at), np.int64)
        within[by] = np.arange(len(by)) - np.repeat(edge, width)
        counts = (kind == 0) | (within >= taken - 1)
        total = np.cumsum(counts)
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        before = np.repeat(total[first] - counts[first], np.diff(np.append(first, len(d))))
        missed = total - before
        # A gram is within the prefix while the grams before it do not yet make up for what may be missing.
        size = n[d]
        reach = np.floor((size - (missed - counts - need[s]) + 1e-6) / part_of - size).astype(np.int64)
        inside = reach >= np.where(visitor, 2.0**s, np.ceil(threshold * size - 1e-9))
        with np.errstate(over="ignore"):
            alone = np.flatnonzero(inside & (kind == 0) & (df[at] > 1))
            out.append((mix(gm[alone] ^ tag[alone]), d[alone], reach[alone], np.full(len(alone), visitor)))
            # The members of a group that are within the prefix are its first ones: their order is that of all texts.
            of_group = inside[by] & (kind[by] > 0)
            members = by[of_group]
            if not len(members):
                continue
            bucket = bucket[of_group]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            width = np.diff(np.append(edge, len(members)))
            k_of = taken[members[edge]]
            for k in (2, 3):
                for c in np.unique(width[(k_of == k) & (width >= k)]).tolist():
                    begin = edge[(k_of == k) & (width == c)]
                    pick = _choose(c, k)
                    h = np.zeros((len(begin), len(pick)), np.uint64)
                    for j in range(k):
                        last = members[begin[:, None] + pick[:, j]]
                        h = h * _MULTIPLIER + gm[last]
                    last = last.ravel()
                    out.append((mix(h.ravel() ^ (tag[last] + _U(k))), d[last], reach[last], np.full(len(last), visitor)))
    if not out:
        none = np.zeros(0, np.int64)
        return Postings(none.astype(np.uint64), none, none, none.astype(bool), n)
    return Postings(*(np.concatenate(x) for x in zip(*out)), n)
