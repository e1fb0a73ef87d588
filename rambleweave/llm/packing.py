"""Filling containers of fixed capacity by a grouping genetic algorithm on islands.

The items are spread over shards of a bounded number of items. Each shard starts with best fit decreasing; a shard
that thereby needs no more containers than its total size does is solved. The others are given to several islands,
each a task with its own population, in which a solution is a list of containers (the groups, not the items, are the
genes): crossover injects whole, well-filled containers of one parent into the other, drops the containers that would
hold an item twice, and the displaced items first replace smaller items where that fills a container better, then go
in by best fit. After an epoch the best solutions of each island migrate to the next island. The worst-filled
container of every shard is emptied at the end; those items form new, fewer shards, until there is one shard.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import cut
from .tokens import token_counts

SHARD_ITEMS, ISLANDS, EPOCHS, GENERATIONS, POPULATION, ELITE = 4000, 4, 3, 15, 8, 2


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that are needed in any case: by the total, or by the items of more than half."""
    return max(-(-int(sizes.sum()) // capacity), int((sizes * 2 > capacity).sum()))


class Packing:
    """Containers (lists of items) of one solution."""

    __slots__ = ("bins", "room")

    def __init__(self, bins: list[list[int]], room: list[int]):
        self.bins, self.room = bins, room

    @staticmethod
    def of(assigned: np.ndarray, sizes: list[int], capacity: int) -> Packing:
        bins: list[list[int]] = [[] for _ in range(int(assigned.max()) + 1)] if len(assigned) else []
        for i, b in enumerate(assigned.tolist()):
            bins[b].append(i)
        bins = [b for b in bins if b]
        return Packing(bins, [capacity - sum(sizes[i] for i in b) for b in bins])

    def assigned(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int32)
        for k, b in enumerate(self.bins):
            out[b] = k
        return out

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer containers first, then containers filled as unevenly as possible."""
        return -len(self.bins), sum((1 - r / capacity) ** 2 for r in self.room) / max(1, len(self.room))

    def best_fit(self, items: list[int], sizes: list[int], capacity: int) -> None:
        """Put items, largest first, where the least room stays; open containers as needed."""
        rooms = sorted((r, k) for k, r in enumerate(self.room))
        for i in sorted(items, key=sizes.__getitem__, reverse=True):
            s = sizes[i]
            p = bisect_left(rooms, (s, -1))
            if p < len(rooms):
                r, k = rooms.pop(p)
                self.bins[k].append(i)
            else:
                r, k = capacity, len(self.bins)
                self.bins.append([i])
                self.room.append(0)
            self.room[k] = r - s
            insort(rooms, (r - s, k))

    def replace(self, items: list[int], sizes: list[int]) -> list[int]:
        """Swap a displaced item for a smaller one of a container that it fills better; gives the items left over."""
        left = sorted(items, key=sizes.__getitem__, reverse=True)
        for k, b in enumerate(self.bins):
            room = self.room[k]
            if not room or not left:
                continue
            gain = None
            for x, inside in enumerate(b[-6:]):
                fit = sizes[inside] + room
                p = next((p for p, i in enumerate(left[:64]) if sizes[i] <= fit), None)
                if p is not None and (d := sizes[left[p]] - sizes[inside]) > 0 and (gain is None or d > gain[0]):
                    gain = d, len(b) - min(6, len(b)) + x, p
            if gain:
                d, x, p = gain
                b[x], left[p] = left[p], b[x]
                self.room[k] -= d
                left.sort(key=sizes.__getitem__, reverse=True)
        return left


def cross(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """A child of a with well-filled containers of b."""
    order = sorted(range(len(b.bins)), key=lambda k: b.room[k] * (0.5 + rng.random()))
    chosen = order[: rng.randint(1, max(1, len(order) // 2))]
    injected = {i for k in chosen for i in b.bins[k]}
    bins, room, displaced = [list(b.bins[k]) for k in chosen], [b.room[k] for k in chosen], []
    for k, own in enumerate(a.bins):
        if injected.isdisjoint(own):
            bins.append(list(own))
            room.append(a.room[k])
        else:
            displaced += [i for i in own if i not in injected]
    child = Packing(bins, room)
    child.best_fit(child.replace(displaced, sizes), sizes, capacity)
    return child


def mutate(a: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Empty the worst container and a few others and put their items in again."""
    n = len(a.bins)
    out = {max(range(n), key=a.room.__getitem__), *(rng.randrange(n) for _ in range(min(3, n)))}
    child = Packing([list(b) for k, b in enumerate(a.bins) if k not in out], [r for k, r in enumerate(a.room) if k not in out])
    child.best_fit(child.replace([i for k in out for i in a.bins[k]], sizes), sizes, capacity)
    return child


def first_solution(sizes: np.ndarray, capacity: int) -> Packing:
    p = Packing([], [])
    p.best_fit(list(range(len(sizes))), sizes.tolist(), capacity)
    return p


def evolve(sizes: np.ndarray, capacity: int, seeds: list[np.ndarray], rng: random.Random, generations: int, population: int) -> list[Packing]:
    """The population after some generations, best first; it ends early where no better solution can exist."""
    s = sizes.tolist()
    bound = lower_bound(sizes, capacity)
    pool = [Packing.of(x, s, capacity) for x in seeds] or [first_solution(sizes, capacity)]
    while len(pool) < population:
        pool.append(mutate(pool[rng.randrange(len(pool))], s, capacity, rng))
    rate = lambda p: p.fitness(capacity)
    for _ in range(generations):
        pool.sort(key=rate, reverse=True)
        if len(pool[0].bins) <= bound:
            break
        half = max(1, population // 2)
        children = []
        for _ in range(population - half):
            a, b = rng.sample(pool[:half], 2) if half > 1 else (pool[0], pool[0])
            child = cross(a, b, s, capacity, rng)
            children.append(mutate(child, s, capacity, rng) if rng.random() < 0.3 else child)
        pool = pool[:half] + children
    return sorted(pool, key=rate, reverse=True)


_STATE = "shard long, island int, place int, n_bins int, bound int, assigned array<int>"


def _solve(items: DataFrame, capacity: int, seed: int, islands: int, epochs: int, generations: int, population: int, elite: int) -> DataFrame:
    """Columns shard, item, piece, size, bin: the items of each shard (key, piece, size, shard) in their containers. A shard is one task's; its size is bounded by how shards are made."""

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(["size", "key", "piece"], ascending=[False, True, True], kind="stable")

    def rows(shard: int, island: int, pool: list[Packing], sizes: np.ndarray) -> pd.DataFrame:
        bound = lower_bound(sizes, capacity)
        return pd.DataFrame({"shard": shard, "island": island, "place": range(len(pool)), "n_bins": [len(p.bins) for p in pool], "bound": bound, "assigned": [p.assigned(len(sizes)) for p in pool]})

    def begin(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = table(pdf)["size"].to_numpy(np.int64)
        return rows(key[0], 0, [first_solution(sizes, capacity)], sizes)

    best = cut(items.groupBy("shard").applyInPandas(begin, _STATE))
    open_ = best.where("n_bins > bound").select("shard")
    if not open_.isEmpty():
        state = best.join(open_, "shard", "left_semi")

        def evolving(epoch: int):  # noqa: ANN202
            def run(key: tuple, pdf: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
                sizes = table(pdf)["size"].to_numpy(np.int64)
                rng = random.Random(f"{seed}/{key}/{epoch}")
                pool = evolve(sizes, capacity, [np.asarray(x) for x in seeds.sort_values(["n_bins", "place"])["assigned"]], rng, generations, population)
                return rows(key[0], key[1], pool[: 2 * elite], sizes)

            return run

        for epoch in range(epochs):
            numbers = F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))
            if epoch == 0:
                seeds = state.drop("island").withColumn("island", numbers)
            else:  # every island keeps its best, and its elite moves on to the next one
                moved = state.where(F.col("place") < elite).withColumn("island", (F.col("island") + 1) % islands)
                seeds = state.unionByName(moved)
            work = items.join(open_, "shard", "left_semi").withColumn("island", numbers)
            state = cut(work.groupBy("shard", "island").cogroup(seeds.groupBy("shard", "island")).applyInPandas(evolving(epoch), _STATE))
            open_ = state.groupBy("shard").agg(F.min(F.col("n_bins") - F.col("bound")).alias("over")).where("over > 0").select("shard")
            best = best.unionByName(state)
            if epoch + 1 < epochs:
                if open_.isEmpty():
                    break
                state = state.join(open_, "shard", "left_semi")
    order = Window.partitionBy("shard").orderBy("n_bins", "island", "place")
    best = best.withColumn("n", F.row_number().over(order)).where("n = 1").select("shard", "assigned")

    def give(key: tuple, pdf: pd.DataFrame, solution: pd.DataFrame) -> pd.DataFrame:
        out = table(pdf)[["shard", "key", "piece", "size"]].copy()
        out["bin"] = np.asarray(solution["assigned"].iloc[0], np.int32)
        return out

    kind = items.schema["key"].dataType.simpleString()
    return items.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(give, f"shard long, key {kind}, piece int, size int, bin int")


def pack(sized: DataFrame, capacity: int = 2048, key: str = "doc_id", size: str = "n_tokens", seed: int = 7, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION, elite: int = ELITE) -> DataFrame:
    """Put items into containers: key, piece, start, size, bin (string).

    An item of at most the capacity is in one container, as piece 0. A larger one fills containers of its own, cut
    at multiples of the capacity; its rest is packed like an item. Items whose size is null or not above 0 give no
    rows; a key that comes several times counts once, with its largest size; a null key is no item; an empty table
    gives no rows; other columns are not read. The result depends on the items and the seed only.
    """
    items = sized.select(F.col(key).alias("key"), F.col(size).cast("int").alias("size")).where("key is not null and size > 0")
    items = cut(items.groupBy("key").agg(F.max("size").alias("size")))
    full = items.where(F.col("size") >= capacity).select("key", F.explode(F.expr(f"sequence(0, cast(size div {capacity} as int) - 1)")).alias("piece"))
    done = [full.select("key", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).alias("size"), F.concat_ws(".", F.lit("own"), F.col("key").cast("string"), F.col("piece")).alias("bin"))]
    rest = items.select("key", F.expr(f"cast(size div {capacity} as int)").alias("piece"), F.expr(f"size % {capacity}").cast("int").alias("size")).where("size > 0")
    n, level = rest.count(), 0
    while n:
        shards = max(1, -(-n // shard_items))
        hashed = rest.withColumn("shard", F.pmod(F.xxhash64("key", "piece", F.lit(level)), F.lit(shards)))
        placed = cut(_solve(hashed, capacity, seed + level, islands, epochs, generations, population, elite))
        named = lambda d, level=level: d.select("key", "piece", (F.col("piece") * capacity).alias("start"), "size", F.concat_ws(".", F.lit(f"l{level}"), "shard", "bin").alias("bin"))
        if shards == 1:
            done.append(named(placed))
            break
        fill = placed.groupBy("shard", "bin").agg(F.sum("size").alias("fill"), F.count("*").alias("items"))
        worst = fill.groupBy("shard").agg(F.min_by("bin", F.struct("fill", "bin")).alias("bin"))
        done.append(named(placed.join(worst, ["shard", "bin"], "left_anti")))
        rest = cut(placed.join(worst, ["shard", "bin"], "left_semi").select("key", "piece", "size"))
        more = rest.count()
        if more >= n:  # as many containers as shards: nothing left to gain
            done[-1] = named(placed)
            break
        n, level = more, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnRenamed("key", key)


def pack_documents(df: DataFrame, capacity: int = 2048, key: str = "doc_id", text: str = "text", path: str | None = None, **options: int) -> DataFrame:
    """pack, with sizes in tokens of the texts. Null and empty texts come out in no container."""
    return pack(token_counts(df.where(F.octet_length(text) > 0), key, text, path), capacity, key, **options).withColumnRenamed("size", "n_tokens")
