"""Parent-child rows of unknown depth: root, depth, path and descendants of each node, and cycles.

Each partition contracts its own parent chains by pointer doubling: a node either reaches a local root or a local
cycle, or leaves the partition at an exit, the id of its first ancestor elsewhere. Only the distinct exits go on: they
are the nodes of a smaller quotient forest, whose edges carry the number of steps they stand for. The quotient is
solved in the same way, until it is small enough for one task; then the fragments are expanded: what is known of an
exit holds, shifted by the steps to it, for all nodes that leave there. Exits are joined by partition and exit, so a
parent that holds a third of all rows is spread over all partitions. A chain that returns to itself within a
partition is a local cycle; one through several partitions shows as a cycle of the quotient and is walked back into
the fragments, so that its nodes become the ends of a second, cycle-free contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import cut, shuffle_partitions

#: States of a node within a fragment.
EXIT, TREE, MISSING, CYCLIC = 0, 1, 2, 3
FRAGMENT_ROWS, SOLVE_ROWS = 250_000, 500_000
#: Elements of paths that a task holds at a time.
PATH_ELEMENTS = 2_000_000

_NODE = "id long, parent long, w long, smin long, last long, state int, root long, depth long, on boolean, seg array<long>"
_FRAGMENT = "id long, parent long, state int, root long, depth long, on boolean, exit long, steps long, xmin long, xlast long, pid int, seg array<long>"


def _column(table: pa.Table, name: str, null: int = 0) -> np.ndarray:
    c = table.column(name).combine_chunks()
    return c.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def contract(table: pa.Table, pid: int, with_path: bool) -> Iterator[pa.RecordBatch]:
    """Fragment rows of the level rows of one partition."""
    table = table.sort_by("id")
    ids = _column(table, "id")
    n = len(ids)
    if not n:
        return
    state, on = _column(table, "state"), _column(table, "on").astype(bool)
    root, depth, w, last, smin = (_column(table, c) for c in ("root", "depth", "w", "last", "smin"))
    parent = _column(table, "parent")
    inner = state == EXIT
    at = np.minimum(np.searchsorted(ids, parent), n - 1)
    local = inner & (ids[at] == parent)
    up = np.where(local, at, -1)
    here = np.arange(n)
    to, dist, least, before = np.where(local, at, here), np.where(local, w, 0), smin.copy(), last.copy()
    for _ in range(max(1, int(n).bit_length()) + 1):
        moving = np.flatnonzero(up[to] >= 0)
        if not len(moving):
            break
        mid = to[moving]
        t, d = to[mid], dist[mid]
        least_m, before_m = np.minimum(least[moving], least[mid]), before[mid]
        to[moving], least[moving], before[moving] = t, least_m, before_m
        dist[moving] += d
    cyclic = up[to] >= 0
    if cyclic.any():
        # After as many steps as there are nodes, all that still move are on a cycle, and each has seen all of it.
        on_cycle = np.zeros(n, bool)
        on_cycle[to[cyclic]] = True
        step = np.where(on_cycle, up, here)
        low = smin.copy()
        for _ in range(int(on_cycle.sum()).bit_length() + 1):
            low = np.minimum(low, low[step])
            step = step[step]
    f = to
    leaves = ~cyclic & (state[f] == EXIT)
    tree, missing, known_cycle = (~cyclic & (state[f] == s) for s in (TREE, MISSING, CYCLIC))
    moved = f != here
    out_state = np.select([cyclic | known_cycle, leaves, missing & ~moved], [CYCLIC, EXIT, MISSING], TREE)
    out_root, out_depth, out_on = np.where(missing, before, root[f]), dist + np.where(missing, -1, depth[f]), on & ~moved
    if cyclic.any():
        out_root = np.where(cyclic, low[to], out_root)
        out_on |= on_cycle
    known = out_state != EXIT
    path_rows = np.flatnonzero(~cyclic & ~known_cycle) if with_path else None

    def batch(rows: np.ndarray, seg: pa.Array) -> pa.RecordBatch:
        take = lambda a, mask=None: pa.array(a[rows], pa.int64(), mask=None if mask is None else mask[rows])
        g = f[rows]
        exits = ~known[rows]
        number = lambda a: pa.array(a, pa.int64(), mask=~exits)
        return pa.RecordBatch.from_arrays(
            [take(ids), take(parent, ~inner), pa.array(out_state[rows].astype(np.int32)), take(out_root, ~known), take(out_depth, ~known), pa.array(out_on[rows]),
             number(parent[g]), number(dist[rows] + w[g]), number(np.minimum(least[rows], smin[g])), number(last[g]), pa.array(np.full(len(rows), pid, np.int32)), seg],
            names=["id", "parent", "state", "root", "depth", "on", "exit", "steps", "xmin", "xlast", "pid", "seg"],
        )

    if not with_path:
        for k in range(0, n, 500_000):
            rows = np.arange(k, min(n, k + 500_000))
            yield batch(rows, pa.nulls(len(rows), pa.list_(pa.int64())))
        return
    segments = table.column("seg").combine_chunks()
    seg_size = np.diff(segments.offsets.to_numpy())
    values = segments.values.to_numpy()
    seg_start = segments.offsets.to_numpy()[:-1].astype(np.int64)
    # length of each node's chain, by doubling again
    length, jump = seg_size.astype(np.int64), np.where(up >= 0, up, -1)
    hops = np.ones(n, np.int64)
    ok = np.zeros(n, bool)
    ok[path_rows] = True
    while (go := np.flatnonzero(ok & (jump >= 0))).size:
        j = jump[go]
        length[go], hops[go], jump[go] = length[go] + length[j], hops[go] + hops[j], jump[j]
    length[~ok] = 0
    hops[~ok] = 0
    edge = np.cumsum(length + hops)
    begin = 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(edge, (edge[begin - 1] if begin else 0) + PATH_ELEMENTS, "right")))
        rows = np.arange(begin, min(end, n))
        of, node, number = [], [], []
        x, cur, k = rows[ok[rows]], rows[ok[rows]], 0
        while len(x):
            of.append(x)
            node.append(cur)
            number.append(np.full(len(x), k))
            nxt = up[cur]
            x, cur, k = x[nxt >= 0], nxt[nxt >= 0], k + 1
        if of:
            of_, node_ = np.concatenate(of), np.concatenate(node)
            order = np.argsort(of_, kind="stable")
            node_ = node_[order]
            size = seg_size[node_].astype(np.int64)
            first = np.cumsum(size) - size
            flat = values[np.repeat(seg_start[node_] - first, size) + np.arange(int(size.sum()))]
        else:
            flat = np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(length[rows])]).astype(np.int32)
        yield batch(rows, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64())))
        begin = int(rows[-1]) + 1


def _contract(level: DataFrame, with_path: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            yield from contract(pa.Table.from_batches(got), TaskContext.get().partitionId(), with_path)

    return level.mapInArrow(run, _FRAGMENT)


def _solve(level: DataFrame, with_path: bool, depth: int, fragment_rows: int, solve_rows: int) -> DataFrame:
    """Columns id, state, root, depth, on, seg for each row of a level whose partitions each hold whole ids."""
    frag = cut(_contract(level, with_path))
    leaving = frag.where("exit is not null")
    exits = leaving.select("exit").distinct()
    quotient = exits.join(frag.withColumnRenamed("exit", "next"), exits["exit"] == F.col("id"), "left").select(
        F.col("exit").alias("id"),
        F.col("next").alias("parent"),
        F.coalesce("steps", F.lit(0)).alias("w"),
        F.coalesce("xmin", "exit").alias("smin"),
        F.coalesce("xlast", "exit").alias("last"),
        F.coalesce("state", F.lit(MISSING)).alias("state"),
        "root",
        "depth",
        F.coalesce("on", F.lit(False)).alias("on"),
        F.coalesce("seg", F.array().cast("array<long>")).alias("seg") if with_path else F.lit(None).cast("array<long>").alias("seg"),
    )
    quotient = cut(quotient)
    size = quotient.count()
    settled = frag.where("exit is null").select("id", "state", "root", "depth", "on", "seg")
    if not size:
        return settled
    if size <= solve_rows:
        # one task holds all nodes that any chain of the quotient leads to: nothing leaves it
        solved = cut(_contract(quotient.coalesce(1), with_path).select("id", "state", "root", "depth", "on", "seg"))
    else:
        # One child per parent may move to its parent's partition, by the toss of a coin: chains shrink, hot parents stay spread.
        coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(depth)), F.lit(2))
        moving = quotient.where(F.col("parent").isNotNull() & (coin("id") == 0) & (coin("parent") == 1)).groupBy("parent").agg(F.min("id").alias("id")).select("id", F.col("parent").alias("home"))
        keyed = quotient.join(moving, "id", "left").withColumn("home", F.coalesce("home", "id"))
        placed = keyed.repartition(-(-size // fragment_rows), "home").drop("home")
        solved = cut(_solve(placed, with_path, depth + 1, fragment_rows, solve_rows))
    known = solved.select(F.col("id").alias("exit"), F.col("state").alias("e_state"), F.col("root").alias("e_root"), F.col("depth").alias("e_depth"), F.col("seg").alias("e_seg"))
    need = leaving.select("pid", "exit").distinct().join(known, "exit")
    opened = leaving.drop("state", "root", "depth", "on").join(need, ["pid", "exit"]).select(
        "id",
        "parent",
        "pid",
        F.when(F.col("e_state") == CYCLIC, CYCLIC).otherwise(TREE).alias("state"),
        F.when(F.col("e_state") == MISSING, F.col("xlast")).otherwise(F.col("e_root")).alias("root"),
        F.when(F.col("e_state") == MISSING, F.col("steps") - 1).when(F.col("e_state") == TREE, F.col("steps") + F.col("e_depth")).alias("depth"),
        (F.concat("seg", F.coalesce("e_seg", F.array().cast("array<long>"))) if with_path else F.lit(None).cast("array<long>")).alias("seg"),
    )
    on = solved.where("`on`").select("id")
    if on.isEmpty():
        return settled.unionByName(opened.select("id", "state", "root", "depth", F.lit(False).alias("on"), "seg"))
    # Walk from each entry of a cycle through its fragment: what lies on the way is on the cycle as well.
    entries = frag.join(on, "id", "left_semi").select(F.col("id").alias("entry"), F.col("pid").alias("fragment"))

    def walk(rows: pa.Table, entry: pa.Table) -> pa.Table:
        ids = _column(rows, "id")
        order = np.argsort(ids)
        ids, parent = ids[order], _column(rows, "parent", -(1 << 62))[order]
        found: set[int] = set()
        place = dict(zip(ids.tolist(), parent.tolist()))
        for x in _column(entry, "entry").tolist():
            while x in place and x not in found:
                found.add(x)
                x = place[x]
        return pa.table({"id": pa.array(sorted(found), pa.int64())})

    met = opened.where(F.col("state") == CYCLIC).select(F.col("id").alias("id"), F.col("parent").alias("parent"), F.col("pid").alias("fragment"))
    marked = met.groupBy("fragment").cogroup(entries.groupBy("fragment")).applyInArrow(walk, "id long").withColumn("on", F.lit(True))
    opened = opened.join(marked, "id", "left").select("id", "state", "root", "depth", F.coalesce("on", F.lit(False)).alias("on"), "seg")
    return settled.unionByName(opened)


def hierarchy(df: DataFrame, key: str = "id", parent: str = "parent", with_path: bool = False, fragment_rows: int = FRAGMENT_ROWS, solve_rows: int = SOLVE_ROWS, below_cycles: bool = False, one_task: int = 0) -> DataFrame:
    """One row per distinct id: id, root_id, depth, kind and, if asked for, path (ids from the root to the node).

    A root is a row whose parent is null or no id of the table. kind is 'tree' (depth: steps to the root), 'cycle' (the
    node is its own ancestor; root_id is the smallest id of the cycle, depth 0) or 'below_cycle' (the chain runs into
    a cycle; depth: steps to it). path is null for the latter two,
    unless below_cycles asks for it: then it leads from the cycle's node to the node, and is the node alone on a cycle. Null ids are no nodes; repeated rows count once; of
    several parents of an id the smallest holds; an empty table gives no rows; other columns are not read.
    one_task: up to so many rows all are one fragment, for callers whose tables are small beside what jobs cost.
    """
    spark = df.sparkSession
    nodes = df.select(F.col(key).cast("long").alias("id"), F.col(parent).cast("long").alias("parent")).where("id is not null")
    # A partition is a fragment and is held by its task: more partitions than usual where the rows ask for them.
    size = nodes.count()
    if -(-size // fragment_rows) > shuffle_partitions(spark):
        nodes = nodes.repartition(-(-size // fragment_rows), "id")
    nodes = nodes.groupBy("id").agg(F.min("parent").alias("parent"))
    if size <= one_task:
        known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
        nodes = nodes.join(known, "parent", "left").select("id", F.when(F.col("there"), F.col("parent")).alias("parent"))

    def solve(rows: DataFrame, paths: bool) -> DataFrame:
        if size <= one_task:
            return _contract(rows.coalesce(1), paths).select("id", "state", "root", "depth", "on", "seg")
        return _solve(rows, paths, 0, fragment_rows, solve_rows)

    def level(rows: DataFrame, end: str, root: str) -> DataFrame:
        return rows.select(
            "id",
            F.expr(f"if({end}, null, parent)").alias("parent"),
            F.lit(1).cast("long").alias("w"),
            F.col("id").alias("smin"),
            F.col("id").alias("last"),
            F.expr(f"if({end}, {TREE}, {EXIT})").alias("state"),
            F.expr(f"if({end}, {root}, null)").alias("root"),
            F.expr(f"if({end}, 0L, null)").alias("depth"),
            F.lit(False).alias("on"),
            F.array("id").alias("seg") if with_path else F.lit(None).cast("array<long>").alias("seg"),
        )

    # depth stands in the way of null: terminals of a level have it, others don't read it
    solved = cut(solve(level(nodes, "parent is null", "id"), with_path))
    trees = solved.where(F.col("state") == TREE).select("id", F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), F.lit("tree").alias("kind"), F.reverse("seg").alias("path"))
    cyclic = solved.where(F.col("state") == CYCLIC)
    if not cyclic.isEmpty():
        rows = nodes.join(cyclic.select("id", "root", "on"), "id").withColumnRenamed("root", "cycle")
        ends = rows.select("id", F.expr("if(`on`, null, parent)").alias("parent"), "cycle", "on")
        paths = with_path and below_cycles
        again = level(ends, "`on`", "cycle")
        again = again if paths else again.withColumn("seg", F.lit(None).cast("array<long>"))
        again = solve(again.repartition("id"), paths)
        again = again.select("id", F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), F.when(F.col("depth") == 0, "cycle").otherwise("below_cycle").alias("kind"), F.reverse("seg").alias("path"))
        trees = trees.unionByName(again)
    return trees if with_path else trees.drop("path")


def descendants(placed: DataFrame) -> DataFrame:
    """All pairs of a node and one below it, with the steps between them: id, descendant, distance. placed: hierarchy's rows with path."""
    up = placed.select(F.col("id").alias("descendant"), F.posexplode(F.expr("reverse(slice(path, 1, depth))")).alias("distance", "id"))
    return up.select("id", "descendant", (F.col("distance") + 1).alias("distance"))


def _climb(table: pa.Table, given: pa.Table | None) -> tuple[np.ndarray, ...]:
    """Sums of a fragment's trees from below: ids, up (place of the parent here, or -1), n, height, and for each the id where its chain leaves and the steps to it. given: n_more and h_more that hang at places (at) from other fragments."""
    table = table.sort_by("id")
    ids, parent, w, n, height = (_column(table, c, -(1 << 62)) for c in ("id", "parent", "w", "n", "height"))
    if given is not None and given.num_rows:
        at = np.searchsorted(ids, _column(given, "at"))
        n, height = n.copy(), height.copy()
        n[at] += _column(given, "n_more")
        height[at] = np.maximum(height[at], _column(given, "h_more"))
    place = np.minimum(np.searchsorted(ids, parent), max(0, len(ids) - 1))
    up = np.where((ids[place] == parent) & (parent > -(1 << 62)), place, -1) if len(ids) else place
    # deepest first: by the number of steps within the fragment, found by doubling
    steps, jump = (up >= 0).astype(np.int64), up.copy()
    while (go := np.flatnonzero(jump >= 0)).size:
        steps[go], jump[go] = steps[go] + np.where(jump[go] >= 0, steps[jump[go]], 0), jump[jump[go]]
    order = np.argsort(-steps, kind="stable").tolist()
    up_, w_, n_, height_ = up.tolist(), w.tolist(), n.tolist(), height.tolist()
    for v in order:
        if (p := up_[v]) >= 0:
            n_[p] += n_[v]
            if height_[v] + w_[v] > height_[p]:
                height_[p] = height_[v] + w_[v]
    leaves, dist = parent.copy(), w.copy()
    for v in reversed(order):
        if (p := up_[v]) >= 0:
            leaves[v], dist[v] = leaves[p], dist[p] + w_[v]
    return ids, up, np.array(n_, np.int64), np.array(height_, np.int64), leaves, dist


_SUMS = "id long, n long, height long"


def _sums(level: DataFrame, depth: int, fragment_rows: int, solve_rows: int) -> DataFrame:
    """id, n, height of each row of a forest (id, parent, w: steps to it, n and height of its own): sums and greatest heights over whole subtrees.

    Fragments are summed by themselves; what their tops bring hangs at ids of other fragments. Those ids are the nodes
    of a smaller forest, which is solved in the same way; then every fragment is summed again with what hangs at its nodes.
    """
    level = cut(level)
    size = level.count()
    if size <= solve_rows:
        def whole(table: pa.Table) -> pa.Table:
            ids, _, n, height, *_ = _climb(table, None)
            return pa.table({"id": ids, "n": n, "height": height})

        return level.groupBy().applyInArrow(whole, _SUMS)
    coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(depth)), F.lit(2))
    moving = level.where(F.col("parent").isNotNull() & (coin("id") == 0) & (coin("parent") == 1)).groupBy("parent").agg(F.min("id").alias("id")).select("id", F.col("parent").alias("home"))
    home = F.pmod(F.xxhash64(F.coalesce("home", "id")), F.lit(-(-size // fragment_rows)))
    placed = cut(level.join(moving, "id", "left").withColumn("part", home).drop("home"))

    def tops(table: pa.Table) -> pa.Table:
        ids, up, n, height, leaves, dist = _climb(table, None)
        known = leaves > -(1 << 62)
        # kind 0: what a top brings to the id where it leaves; kind 1: of each node where its chain leaves and the steps
        top = np.flatnonzero((up < 0) & known)
        node = np.flatnonzero(known)
        w = _column(table.sort_by("id"), "w")
        at = lambda k, v: np.full(len(v), k)
        return pa.table({"kind": np.concatenate([at(0, top), at(1, node)]), "id": np.concatenate([leaves[top], ids[node]]), "parent": np.concatenate([leaves[top], leaves[node]]), "w": np.concatenate([w[top], dist[node]]),
                         "n": np.concatenate([n[top], at(0, node)]), "height": np.concatenate([height[top] + w[top], at(0, node)])})

    found = cut(placed.groupBy("part").applyInArrow(tops, "kind long, id long, parent long, w long, n long, height long"))
    hang = found.where("kind = 0").groupBy("id").agg(F.sum("n").alias("n"), F.max("height").alias("height"))
    onward = found.where("kind = 1").select("id", "parent", "w")
    quotient = hang.join(onward, "id", "left").select("id", "parent", F.coalesce("w", F.lit(0)).alias("w"), "n", "height")
    solved = _sums(quotient, depth + 1, fragment_rows, solve_rows)
    given = placed.select(F.col("id").alias("hook"), F.col("part").alias("fragment")).join(solved, F.col("hook") == F.col("id")).select(F.col("hook").alias("at"), "fragment", F.col("n").alias("n_more"), F.col("height").alias("h_more"))

    def again(table: pa.Table, more: pa.Table) -> pa.Table:
        ids, _, n, height, *_ = _climb(table, more)
        return pa.table({"id": ids, "n": n, "height": height})

    return placed.groupBy("part").cogroup(given.groupBy("fragment")).applyInArrow(again, _SUMS)


def subtree_sizes(df: DataFrame, placed: DataFrame, key: str = "id", parent: str = "parent", fragment_rows: int = FRAGMENT_ROWS, solve_rows: int = SOLVE_ROWS) -> DataFrame:
    """Number of descendants and height of each distinct id: id, n_descendants, height; leaves have 0. placed: hierarchy's rows of df, without paths.

    Sums are taken from below over the fragments of the forest, so a chain of depth d costs d, not d². A node on a cycle
    has only what hangs below it off the cycle; cycle_sizes() adds what is reached around it.
    """
    nodes = df.select(F.col(key).cast("long").alias("id"), F.col(parent).cast("long").alias("parent")).where("id is not null").groupBy("id").agg(F.min("parent").alias("parent"))
    above = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    rows = nodes.join(above, "parent", "left").join(placed.select("id", "kind"), "id")
    forest = rows.select("id", F.when(F.col("there") & (F.col("kind") != "cycle"), F.col("parent")).alias("parent"), F.lit(1).cast("long").alias("w"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("height"))
    return _sums(forest, 0, fragment_rows, solve_rows).select("id", (F.col("n") - 1).alias("n_descendants"), F.col("height").cast("int").alias("height"))


def cycle_places(df: DataFrame, placed: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """root_id, id, pos, size for each node on a cycle: pos is the number of steps from it to the cycle's smallest id, size the cycle's length. placed: hierarchy's rows of df."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(parent).cast("long").alias("parent")).where("id is not null").groupBy("id").agg(F.min("parent").alias("parent"))
    on = rows.join(placed.where("kind = 'cycle'").select("id", "root_id"), "id")
    pos = hierarchy(on.select("id", F.when(F.col("id") != F.col("root_id"), F.col("parent")).alias("parent"))).select("root_id", "id", F.col("depth").alias("pos"))
    return pos.join(pos.groupBy("root_id").agg(F.count("*").cast("int").alias("size")), "root_id")


def around_cycles(placed: DataFrame, places: DataFrame) -> DataFrame:
    """The pairs that descendants() has not: a node on a cycle is above all others of the cycle, and above all that hangs below any of them, by the least number of steps; not above itself. placed: with paths below cycles."""
    below = placed.where("kind <> 'tree'").select("root_id", F.col("id").alias("descendant"), "depth", F.col("path")[0].alias("entry"))
    entry = places.select("root_id", F.col("id").alias("entry"), F.col("pos").alias("entry_pos"))
    pairs = below.join(entry, ["root_id", "entry"]).join(places, "root_id").where("id <> entry")
    return pairs.select("id", "descendant", (F.col("depth") + F.pmod(F.col("entry_pos") - F.col("pos"), F.col("size"))).alias("distance"))


def cycle_sizes(sizes: DataFrame, places: DataFrame) -> DataFrame:
    """id, n_descendants, height of nodes on cycles by the pairs of around_cycles, without making them: what hangs at a place is farthest from itself, or, around the cycle, from the places above it. sizes: subtree_sizes' rows; a cycle is one window, its length is not bounded otherwise."""
    at = places.join(sizes, "id").select("id", "root_id", "pos", "size", (F.col("height") + F.col("pos")).alias("reach"), (F.col("n_descendants") + 1).alias("here"))
    cycle = Window.partitionBy("root_id")
    line = cycle.orderBy("pos")
    ahead = F.max("reach").over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    behind = F.max("reach").over(line.rowsBetween(Window.unboundedPreceding, -1)) + F.col("size")
    return at.select("id", (F.sum("here").over(cycle) - 1).alias("n_descendants"), (F.greatest(ahead, behind) - F.col("pos")).cast("int").alias("height"))
