"""Meeting of sets by signatures: how postings travel, which pairs of them count, and what becomes of hot signatures.

Signatures travel in arrays, by buckets of their hashes; a bucket is a partition, and their number follows the size of
the corpus. A task meets the sets of its bucket by sorting, and looks only at partners within the sizes that a
posting's reach allows. A signature that very many sets have is not met there, but in blocks, any two of them in a
task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import Postings, quantised, shared_needed, slots_for

#: Slots that are packed into one row of the table of frequencies.
_PACK = 4096
#: Signatures that a task holds before it passes them on, and postings that it takes of its bucket before it looks for hot ones.
SIGNATURES_HELD, POSTINGS_HELD = 2_000_000, 6_000_000
#: Pairs made at a time.
PAIRS_HELD = 4_000_000
#: A signature of more sets is hot.
HOT = 4096
POSTINGS = "bucket int, sig binary, reach binary, many binary, d binary, size binary"
_MET = "l long, s long, n long, need long, sig long"
_U = np.uint64


def frequency_table(counted: DataFrame) -> np.ndarray:
    """Of how many sets each gram (columns g, n; read twice) is, as one byte per slot; the driver gets only these, at most 64 MB."""

    def pack(table: pa.Table) -> pa.Table:
        at = table.column("slot").to_numpy()
        out = np.zeros(_PACK, np.uint8)
        out[at % _PACK] = quantised(table.column("n").to_numpy())
        return pa.table({"part": pa.array([int(at[0]) // _PACK], pa.int32()), "bytes": pa.array([out.tobytes()], pa.binary())})

    slots = slots_for(counted.count())
    by_slot = counted.groupBy(F.col("g").bitwiseAND(slots - 1).cast("int").alias("slot")).agg(F.sum("n").alias("n"))
    packed = by_slot.groupBy(F.expr(f"slot div {_PACK}").alias("pack")).applyInArrow(pack, "part int, bytes binary")
    table = np.zeros(slots, np.uint8)
    for part, values in packed.collect():
        table[part * _PACK : (part + 1) * _PACK] = np.frombuffer(values, np.uint8)
    return table


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def posting_rows(blocks: Iterator[tuple[np.ndarray, Postings]], threshold: float, buckets: int) -> Iterator[pa.RecordBatch]:
    """Postings of blocks (numbers d of the sets, and their postings) as rows POSTINGS. Per bucket and some sets: signatures (32 bits within the bucket), how far each reaches (a part of what its set's size allows, rounded up), and of each set its number, how many signatures it has there, and its size, negative if it only visits."""
    sigs, of, reach, d, size = [], [], [], [], []
    held = entries = 0

    def rows() -> pa.RecordBatch:
        sig, entry, far = np.concatenate(sigs), np.concatenate(of), np.concatenate(reach)
        ids, sizes = np.concatenate(d), np.concatenate(size)
        bucket = ((sig >> _U(32)) % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket << 32 | entry)
        sig, entry, far, bucket = (sig[order] & _U(0xFFFFFFFF)).astype(np.uint32), entry[order], far[order], bucket[order]
        pair = bucket << 32 | entry
        edge = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        many = np.diff(np.append(edge, len(pair))).astype(np.int32)
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        first = np.searchsorted(edge, start)
        e = entry[edge]

        def cells(a: np.ndarray, at: np.ndarray) -> pa.Array:
            offsets = np.append(at, len(a)).astype(np.int32) * a.itemsize
            return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(a.tobytes())])

        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[start].astype(np.int32)), cells(sig, start), cells(far, start), cells(many, first), cells(ids[e], first), cells(sizes[e], first)],
            names=["bucket", "sig", "reach", "many", "d", "size"],
        )

    for ids, p in blocks:
        own = p.size[p.of]
        part = np.ceil((np.minimum(p.reach, own / threshold) - threshold * own) / (own * (1 / threshold - threshold) + 1e-9) * 255)
        sigs.append(p.sig)
        reach.append(np.clip(part, 0, 255).astype(np.uint8))
        of.append(p.of * 2 + p.visitor + entries)
        d.append(np.repeat(ids, 2))
        size.append(np.stack([p.size, -p.size], 1).ravel().astype(np.int32))
        entries += 2 * len(ids)
        held += len(p.sig)
        if held > SIGNATURES_HELD:
            yield rows()
            sigs, of, reach, d, size, held, entries = [], [], [], [], [], 0, 0
    if held:
        yield rows()


def meet(postings: DataFrame, threshold: float, hot: int, two_sided: bool = False) -> DataFrame:
    """The pairs that meet in each bucket: l and s (numbers of the larger and the smaller set), n (signatures that they share there) and need (that they must share in all). Postings of hot signatures come as they are: sig, l (the set), s (its size), n (its reach). two_sided: only sets with an even and an odd number are a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, reaches, entry, ids, sizes = [], [], [], [], []
        held = entries = bucket = 0
        check = POSTINGS_HELD

        def rows(l: np.ndarray, s: np.ndarray, n: np.ndarray, need: np.ndarray, sig: np.ndarray | None = None) -> pa.RecordBatch:  # noqa: E741
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (l, s, n, need)] + [pa.nulls(len(l), pa.int64()) if sig is None else pa.array(sig)], names=["l", "s", "n", "need", "sig"])

        def decoded(reach: np.ndarray, size: np.ndarray) -> np.ndarray:
            size = np.abs(size).astype(np.float64)
            return np.floor(threshold * size + reach / 255 * size * (1 / threshold - threshold) + 1e-6).astype(np.int64)

        def set_hot_aside() -> pa.RecordBatch | None:
            """Takes the postings of hot signatures out of what is held, also of those that were hot before."""
            nonlocal sigs, reaches, entry, ids, sizes, known
            sig, reach, e = np.concatenate(sigs), np.concatenate(reaches), np.concatenate(entry)
            ids, sizes = [np.concatenate(ids)], [np.concatenate(sizes)]
            order = np.sort(sig)
            edge = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]])) if len(order) else np.zeros(0, np.int64)
            known = np.union1d(known, order[edge[np.diff(np.append(edge, len(order))) > hot]])
            out = np.isin(sig, known) if len(known) else np.zeros(len(sig), bool)
            sigs, reaches, entry = [sig[~out]], [reach[~out]], [e[~out]]
            if not out.any():
                return None
            size = sizes[0][e[out]]
            return rows(ids[0][e[out]], size, decoded(reach[out], size), np.zeros(int(out.sum())), sig[out].astype(np.int64) | np.int64(bucket) << 32)

        def pairs(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            pair = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
            if not len(pair):
                return
            first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            l, s = pair[first] >> 24, pair[first] & 0xFFFFFF  # noqa: E741
            need = classes[np.floor(np.log2(np.abs(sizes[l]))).astype(np.int64)]
            n = np.diff(np.append(first, len(pair)))
            for k in range(0, len(l), 500_000):
                c = slice(k, k + 500_000)
                yield rows(ids[l[c]], ids[s[c]], n[c], need[c])

        classes = needs(threshold)
        known = np.zeros(0, np.uint32)
        for batch in batches:
            for b, sig, reach, many, d, size in zip(*(c.to_pylist() for c in batch.columns)):
                bucket = b
                sigs.append(np.frombuffer(sig, np.uint32))
                reaches.append(np.frombuffer(reach, np.uint8))
                ids.append(np.frombuffer(d, np.int64))
                sizes.append(np.frombuffer(size, np.int32))
                entry.append(np.repeat(np.arange(len(ids[-1])) + entries, np.frombuffer(many, np.int32)))
                entries += len(ids[-1])
                held += len(sigs[-1])
                if held > check:
                    if (aside := set_hot_aside()) is not None:
                        yield aside
                    held = len(sigs[0])
                    check = max(POSTINGS_HELD, 2 * held)
        if not held:
            return
        if (aside := set_hot_aside()) is not None:
            yield aside
        sig, reach, e, ids, sizes = sigs[0], reaches[0], entry[0], ids[0], sizes[0]
        # one number per posting: signature, rank of its text by size, reach
        by_size = np.argsort(np.abs(sizes).astype(np.int64) << 32 | np.arange(len(sizes)))
        rank = np.empty(len(by_size), np.int64)
        rank[by_size] = np.arange(len(by_size))
        ids, sizes = ids[by_size], sizes[by_size]
        if len(ids) >= 1 << 24:
            raise RuntimeError("a bucket holds too many texts")
        key = np.sort(sig.astype(np.uint64) << _U(32) | rank[e].astype(np.uint64) << _U(8) | reach)
        sig = key >> _U(32)
        same = sig[1:] == sig[:-1]
        key = key[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        if not len(key):
            return
        at = (key >> _U(8) & _U(0xFFFFFF)).astype(np.int64)
        visitor, size = sizes[at] < 0, np.abs(sizes[at]).astype(np.int64)
        far = decoded((key & _U(255)).astype(np.int64), size)
        # the larger partners of a posting follow it: those up to the size that it allows
        most = np.minimum(far, np.floor(size / threshold + 1e-9).astype(np.int64))
        beyond = (key >> _U(32) << _U(32)) + (np.searchsorted(np.abs(sizes), most, "right").astype(np.uint64) << _U(8))
        one = np.arange(len(key))
        odd = (ids[at] & 1).astype(bool)
        found = []
        for smaller, larger in [(one[~odd], one[odd]), (one[odd], one[~odd])] if two_sided else [(one, one)]:
            first = np.searchsorted(key[larger], key[smaller], "right")
            count = np.maximum(np.searchsorted(key[larger], beyond[smaller]) - first, 0)
            total = np.cumsum(count)
            begin = 0
            while begin < len(smaller):
                end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS_HELD, "right")))
                c = slice(begin, end)
                s, l = np.repeat(smaller[c], count[c]), larger[_ranges(first[c], count[c])]  # noqa: E741
                ok = ~visitor[l] & (far[l] >= size[s]) & (ids[at[l]] != ids[at[s]])
                found.append(np.sort(at[l[ok]] << 24 | at[s[ok]]))
                begin = end
                if sum(map(len, found)) > PAIRS_HELD:
                    yield from pairs(found)
                    found = []
        yield from pairs(found)

    return postings.mapInArrow(run, _MET)


def needs(threshold: float) -> np.ndarray:
    return np.array([shared_needed(c, threshold) for c in range(40)])


def meet_hot(hot: DataFrame, threshold: float, block: int) -> DataFrame:
    """Like meet, for postings of hot signatures with a group g: only sets of different groups are a pair.

    A signature whose sets are all of one group has none. Of the others, the largest group and the rest are dealt into
    blocks; a block of the one meets a block of the other, or two blocks of the rest each other, in a task. So the
    largest group, which may hold most of the sets, is sent on as often as the rest has blocks.
    """
    sizes = hot.groupBy("sig", "g").count().groupBy("sig").agg(F.sum("count").alias("m"), F.max(F.struct("count", "g")).alias("top")).where(F.col("m") > F.col("top.count"))
    sizes = sizes.select("sig", F.col("top.g").alias("main"), F.ceil(F.col("top.count") / block).cast("int").alias("main_blocks"), F.ceil((F.col("m") - F.col("top.count")) / block).cast("int").alias("blocks"))
    dealt = hot.select("sig", "l", "s", "n", "g").hint("merge").join(sizes, "sig")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("l"), F.col(n)).cast("int")
    # a cell: whether it has the largest group, and two blocks
    cell = lambda main, x, y: F.struct(F.lit(main).alias("main"), x.alias("x"), y.alias("y"))
    of_main = F.transform(every("blocks"), lambda y: cell(True, own("main_blocks"), y))
    with_main = F.transform(every("main_blocks"), lambda x: cell(True, x, own("blocks")))
    of_rest = F.transform(every("blocks"), lambda y: cell(False, F.least(own("blocks"), y), F.greatest(own("blocks"), y)))
    is_main = F.col("g") == F.col("main")
    cells = dealt.select("sig", "l", "s", "n", "g", is_main.alias("first"), own("blocks").alias("b"), F.explode(F.when(is_main, of_main).otherwise(F.concat(with_main, of_rest))).alias("cell"))
    cells = cells.select("sig", "l", "s", "n", "g", "first", "b", "cell.*")
    classes = needs(threshold)

    def cross(table: pa.Table) -> pa.Table:
        main, x, y, first, b, d, size, far, g = (table.column(c).to_numpy() for c in ("main", "x", "y", "first", "b", "l", "s", "n", "g"))
        order = np.argsort(g, kind="stable")
        first, b, d, size, far, g = first[order], b[order], d[order], size[order], far[order], g[order]
        within = not main[0] and x[0] == y[0]
        if within:
            one = two = np.arange(len(d))
        elif main[0]:
            one, two = np.flatnonzero(first), np.flatnonzero(~first)
        else:
            one, two = np.flatnonzero(b == x[0]), np.flatnonzero(b == y[0])
        # of two, what follows the own group; of another block also what is before it
        low, high = np.searchsorted(g[two], g[one], "left"), np.searchsorted(g[two], g[one], "right")
        larger, smaller = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # a cell may lack rows of one block
        for k in range(0, len(one), 512):
            c = slice(k, k + 512)
            after, before = len(two) - high[c], np.zeros_like(low[c]) if within else low[c]
            i = np.concatenate([np.repeat(one[c], after), np.repeat(one[c], before)])
            j = two[np.concatenate([_ranges(high[c], after), _ranges(np.zeros_like(before), before)])]
            swap = (np.abs(size[i]) > np.abs(size[j])) | (np.abs(size[i]) == np.abs(size[j])) & (d[i] > d[j])
            s, l = np.where(swap, j, i), np.where(swap, i, j)  # noqa: E741
            ok = (size[l] > 0) & (np.abs(size[s]) >= threshold * size[l] - 1e-9) & (far[s] >= size[l]) & (far[l] >= np.abs(size[s])) & (d[s] != d[l])
            larger.append(l[ok])
            smaller.append(s[ok])
        l, s = np.concatenate(larger), np.concatenate(smaller)  # noqa: E741
        need = classes[np.floor(np.log2(np.maximum(size[l], 1))).astype(np.int64)]
        return pa.table({"l": d[l], "s": d[s], "n": np.ones(len(l), np.int64), "need": need})

    return cells.groupBy("sig", "main", "x", "y").applyInArrow(cross, "l long, s long, n long, need long")
