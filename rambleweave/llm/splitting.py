"""Cutting texts that are too long at natural boundaries, all cuts of all texts at once.

Every place where a text may be cut is a boundary with a level: 1 the edge of a paragraph or code block, 2 a line,
3 a sentence, 4 white space, 5 another edge of a word, 6 the edge of a token in a word without any better place.
Each boundary, taken as the begin of a piece, is joined to its farthest legal end: of the boundaries at least half
the limit and at most the limit away, the last one of the best level there is. From the end, the begin of the next
piece goes back by at most the overlap. This gives each boundary one successor. The cuts of a text are what its
first boundary reaches; they are found for all texts together by squaring the table of successors (1, 2, 4, ...
steps), so the number of rounds is the logarithm of the number of pieces.

Sizes are tokens of the whole text. Encoding a piece by itself never needs more of them: inside a word a stretch of
tokens is its own encoding, and the white space before a cut can only merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPACE, ByteBPE, _ranges, chunks, text_bytes, vocabulary

LEVELS = ["end", "paragraph", "line", "sentence", "word", "sign", "token"]
#: Signs that end a sentence, those of them that need a blank after them, and what may close after them.
ENDS = [ord(c) for c in ".!?…。！？؟।"]
ENDS_BEFORE_BLANK = [ord(c) for c in ".!?"]
CLOSERS = [ord(c) for c in "\"')]”’»」』）】"]
#: Words of more tokens may be cut inside.
LONG_WORD = 32


def boundaries(bpe: ByteBPE, data: np.ndarray, edges: np.ndarray, block: list[bool] | None = None) -> tuple[np.ndarray, ...]:
    """Byte, code point, tokens before and level of each boundary of the texts at edges; the end of a text is the begin of the next. block, for a single text: whether the data begin inside a code block; afterwards, whether they end inside one."""
    in_block = bool(block and block[0])
    starts, cp, byte, begins = bpe.words(data, edges)
    word = bpe.lookup(data, starts, np.append(starts[1:], len(data)))
    size = np.diff(bpe.word_start)[word]
    before = np.cumsum(size) - size
    at = np.flatnonzero(begins)  # code point of each word
    space = bpe.classes[cp] == SPACE
    n = len(cp)
    line_end = cp == 10
    line_end[:-1] |= (cp[:-1] == 13) & (cp[1:] != 10)
    lines = np.concatenate([[0], np.cumsum(line_end)])
    # the last visible code point before a place, and the first one from it on
    seen = np.where(space, -1, np.arange(n))
    last = np.concatenate([[-1], np.maximum.accumulate(seen)])
    seen = np.where(space, n, np.arange(n))
    following = np.append(np.minimum.accumulate(seen[::-1])[::-1], n)
    text_at = np.searchsorted(byte, edges)  # code point where each text begins
    own_start = text_at[np.searchsorted(text_at, at, "right") - 1]
    prev, nxt = last[at], following[at]
    has = prev >= own_start
    between = nxt - prev > 1  # white space around the place
    reaches = (at == nxt) | (at + 1 == nxt) & (cp[np.minimum(at, n - 1)] == 32)  # the place is where the visible part begins
    level = np.full(len(at), 5, np.int8)
    level[between & reaches] = 4
    p = np.maximum(prev, 0)
    p2 = np.maximum(prev - 1, 0)
    closes = np.isin(cp[p], CLOSERS) & (prev - 1 >= own_start)
    end_sign = np.where(closes, cp[p2], cp[p])
    sentence = has & np.isin(end_sign, ENDS) & (between | ~np.isin(end_sign, ENDS_BEFORE_BLANK)) & reaches & ~np.isin(cp[np.minimum(nxt, n - 1)], CLOSERS + ENDS)
    level[sentence] = 3
    breaks = np.where(has & reaches, lines[np.minimum(nxt, n)] - lines[prev + 1], 0)
    level[breaks == 1] = 2
    level[breaks >= 2] = 1
    # code blocks: lines of a text that begin with a fence
    three = (cp[:-2] == cp[1:-1]) & (cp[1:-1] == cp[2:]) & ((cp[:-2] == 96) | (cp[:-2] == 126)) if n > 2 else np.zeros(0, bool)
    fence = np.flatnonzero(three)
    if len(fence):
        first_visible = last[fence]
        own = text_at[np.searchsorted(text_at, fence, "right") - 1]
        fence = fence[(first_visible < own) | (lines[fence] - lines[first_visible + 1] > 0)]
    if len(fence):
        count = np.searchsorted(fence, nxt, "left") - np.searchsorted(fence, own_start, "left") + in_block
        inside = count % 2 == 1
        level[inside & (level == 1)] = 2
        opens = np.isin(nxt, fence) & (count % 2 == 0)
        level[opens] = 1
        # the line after a closing fence
        closed = np.searchsorted(fence, at, "right") - 1
        f = fence[np.maximum(closed, 0)]
        same_text = (closed >= 0) & (f >= own_start)
        after = same_text & (count % 2 == 0) & (count > 0) & (breaks >= 1) & (lines[at] - lines[f] == 1)
        level[after] = 1
    elif in_block:
        level[level == 1] = 2
    if block is not None:
        block[0] = (len(fence) + in_block) % 2 == 1
    point, tokens, place = at, before, starts
    long = np.flatnonzero(size > LONG_WORD)
    if len(long):
        inner = _ranges(bpe.word_start[word[long]], size[long])
        width = bpe.size[bpe.word_ids[inner]].astype(np.int64)
        total = np.cumsum(width) - width
        first = np.cumsum(size[long]) - size[long]
        offset = total - np.repeat(total[first], size[long]) + np.repeat(starts[long], size[long])
        number = np.arange(len(inner)) - np.repeat(first, size[long])
        keep = (number > 0) & ((data[offset] & 0xC0) != 0x80)
        place = np.concatenate([starts, offset[keep]])
        tokens = np.concatenate([before, (np.repeat(before[long], size[long]) + number)[keep]])
        level = np.concatenate([level, np.full(int(keep.sum()), 6, np.int8)])
        point = np.searchsorted(byte, place)
        order = np.argsort(place, kind="stable")
        place, tokens, level, point = place[order], tokens[order], level[order], point[order]
    level[np.isin(place, edges)] = 0
    total = int(size.sum())
    return np.append(place, len(data)), np.append(point, n), np.append(tokens, total), np.append(level, 0)


def seam_level(data: np.ndarray, at: int) -> int:
    """Level of the lone blank between signs at which a long text was cut into chunks: 3 after a sentence, otherwise 4."""
    closes = data[at - 1] in CLOSERS
    return 3 if data[at - 1 - closes] in ENDS_BEFORE_BLANK and data[at + 1] not in CLOSERS + ENDS else 4


def long_boundaries(bpe: ByteBPE, data: np.ndarray, edges: list[int]) -> tuple[np.ndarray, ...]:
    """Boundaries of one long text, found chunk by chunk (between edges) and joined: the cuts know nothing of the chunks."""
    parts: list[tuple[np.ndarray, ...]] = []
    points = total = 0
    block = [False]
    for begin, stop in zip(edges, edges[1:]):
        place, point, tokens, level = boundaries(bpe, data[begin:stop], np.array([0, stop - begin]), block)
        if begin:
            level[0] = seam_level(data, begin)
        rest = slice(None, None if stop == edges[-1] else -1)
        parts.append((place[rest] + begin, point[rest] + points, tokens[rest] + total, level[rest]))
        points, total = points + int(point[-1]), total + int(tokens[-1])
    return tuple(np.concatenate(x) for x in zip(*parts))


def pieces(place: np.ndarray, tokens: np.ndarray, level: np.ndarray, first: np.ndarray, end: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (as numbers of boundaries) of all pieces of the texts whose boundaries are first[k]..end[k]."""
    n = len(tokens)
    ahead = np.arange(n)
    own_end = np.zeros(n, np.int64)
    text = np.searchsorted(first, ahead, "right") - 1
    own_end = end[np.maximum(text, 0)]
    far = np.minimum(np.searchsorted(tokens, tokens + limit, "right") - 1, own_end)
    near = np.maximum(np.searchsorted(tokens, tokens + (limit + 1) // 2, "left"), ahead + 1)
    to = np.maximum(far, np.minimum(ahead + 1, own_end))
    open_ = far < own_end
    chosen = np.zeros(n, bool)
    for best in range(1, len(LEVELS)):
        last = np.maximum.accumulate(np.where(level <= best, ahead, -1))[far]
        hit = open_ & ~chosen & (last >= near)
        to[hit] = last[hit]
        chosen |= hit
    # the next piece begins up to `overlap` tokens before this one's end
    back = np.maximum(np.searchsorted(tokens, tokens[to] - overlap, "left"), ahead + 1)
    then = to.copy()
    chosen = np.zeros(n, bool)
    for best in (3, 4, 5):
        nearest = np.minimum.accumulate(np.where(level <= best, ahead, n)[::-1])[::-1][np.minimum(back, n - 1)]
        hit = open_ & ~chosen & (nearest < to)
        then[hit] = nearest[hit]
        chosen |= hit
    then[~open_] = own_end[~open_]
    reached = np.zeros(n, bool)
    reached[first] = True
    step = then
    while True:
        grown = reached.copy()
        grown[step[np.flatnonzero(reached)]] = True
        if np.array_equal(grown, reached):
            break
        reached, step = grown, step[step]
    reached[end] = False
    reached[first[first < end]] = True
    begin = np.flatnonzero(reached)
    return begin, to[begin]


def split_batch(bpe: ByteBPE, texts: pa.Array, limit: int, overlap: int) -> dict[str, np.ndarray]:
    """Arrays: row of the batch, number of the piece, begin and end as code points, tokens, tokens shared with the piece before, level of the end, begin and end as bytes of the batch."""
    data, edges = text_bytes(texts)
    out: list[tuple] = []
    seams: list[int] = []
    for k, last, begin, stop in chunks(data, edges):
        own = np.clip(edges[k : last + 1], begin, stop) - begin
        part = data[begin:stop]
        if not len(part):
            continue
        if begin > edges[k] or stop < edges[last]:
            # one text in several chunks
            seams = [*(seams or [0]), stop - int(edges[k])]
            if stop < edges[last]:
                continue
            rows, starts = np.array([k]), np.array([0, stop - int(edges[k])])
            place, point, tokens, level = long_boundaries(bpe, data[edges[k] : stop], seams)
            seams = []
        else:
            # only texts beyond the limit: a token has at least a byte
            rows = np.arange(k, last)[np.diff(own) > limit]
            if not len(rows):
                continue
            if len(rows) < last - k:
                size = np.diff(own)[rows - k]
                part = part[_ranges(own[rows - k], size)]
                starts = np.concatenate([[0], np.cumsum(size)])
            else:
                starts = own
            place, point, tokens, level = boundaries(bpe, part, starts)
        edge = np.searchsorted(place, starts)
        many = np.diff(tokens[edge]) > limit
        if not many.any():
            continue
        # tables are built over all boundaries; texts within the limit are not entered
        b, e = pieces(place, tokens, level, edge[:-1], edge[1:], limit, overlap)
        text = np.searchsorted(edge[:-1], b, "right") - 1
        keep = many[text]
        b, e, text = b[keep], e[keep], text[keep]
        row = rows[text]
        base = point[edge[:-1]][text]
        prior = np.where(np.concatenate([[False], text[1:] == text[:-1]]), np.concatenate([[0], e[:-1]]), b)
        at = edges[row] - starts[text]
        out.append((row, point[b] - base, point[e] - base, tokens[e] - tokens[b], tokens[prior] - tokens[b], level[e], place[b] + at, place[e] + at))
    names = ["row", "begin", "end", "tokens", "shared", "level", "from", "to"]
    got = {n: np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i, n in enumerate(names)}
    row = got["row"]
    fresh = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    starts = np.flatnonzero(fresh)
    got["piece"] = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
    got["data"] = data
    return got


def split_oversized(df: DataFrame, limit: int = 512, overlap: int = 64, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """The pieces of each text of more than limit tokens: key, piece (from 0), begin, end (code points of the text), n_tokens, shared (tokens in common with the piece before), cut (what the piece ends at), text.

    Pieces cover the text in order, none has more than limit tokens, and the next one begins at most overlap tokens
    before the end of the one before, never before its begin. Null, empty and shorter texts give no rows; a repeated
    row is cut as often as it comes; an empty table gives none; other columns are not read.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            got = split_batch(bpe, batch.column(1), limit, overlap)
            if not len(got["row"]):
                continue
            for s in range(0, len(got["row"]), 20_000):
                g = {k: v[s : s + 20_000] for k, v in got.items() if k != "data"}
                size = g["to"] - g["from"]
                flat = got["data"][_ranges(g["from"], size)]
                texts = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())).cast(pa.string())
                i32 = lambda k: pa.array(g[k].astype(np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(g["row"])), i32("piece"), i32("begin"), i32("end"), i32("tokens"), i32("shared"), pa.array(np.array(LEVELS, object)[g["level"]], pa.string()), texts],
                    names=["key", "piece", "begin", "end", "n_tokens", "shared", "cut", "text"],
                )

    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    # A text of no more bytes than the limit cannot have more tokens: the scan leaves it out.
    narrow = narrow.where(F.octet_length("text") > limit)
    return narrow.mapInArrow(run, f"key {kind}, piece int, begin int, end int, n_tokens int, shared int, cut string, text string").withColumnRenamed("key", key)
