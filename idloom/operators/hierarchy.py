"""Parent-child rows of unknown depth: circles, levels, paths and descendants.

Leaves are peeled from the bottom: an edge whose child has no edges left goes,
and with it a message to the parent (the child's descendants).  Going back
through the peel order from the top assigns root, depth and path.  What cannot
be peeled contains circles.

A round is one distributed step.  Real containment has a few huge levels and
then thin long chains, so once at most ``local_edges`` edges are left they are
finished in one task; while more are left, rounds go on, however many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idloom.operators.joins import spread_join
from idloom.session import Scratch, count_rows, partitions

#: Edges that one task takes; about 100 bytes each there.
LOCAL_EDGES = 400_000
JOIN = "!/"


def edges_of(members: DataFrame) -> DataFrame:
    """Different (parent, child, path) with both ends given; a null path counts as empty."""
    return (
        members.where("parent_file_id is not null and child_file_id is not null")
        .select(F.col("parent_file_id").cast("long").alias("parent"), F.col("child_file_id").cast("long").alias("child"), F.coalesce(F.col("archive_path").cast("string"), F.lit("")).alias("path"))
        .distinct()
    )


def links_of(members: DataFrame) -> DataFrame:
    """Different (parent, child) with both ends given; paths are not read."""
    return members.where("parent_file_id is not null and child_file_id is not null").select(F.col("parent_file_id").cast("long").alias("parent"), F.col("child_file_id").cast("long").alias("child")).distinct()


def _held(batches: Iterator[pa.RecordBatch], fn: Callable) -> Iterator[pa.RecordBatch]:
    """``fn(table)`` over all rows of a task; only for inputs of a checked size."""
    held = list(batches)
    if held:
        yield from fn(pa.Table.from_batches(held))


def _in_one_task(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return df.coalesce(1).mapInArrow(lambda batches: _held(batches, fn), schema)


# -- circles ---------------------------------------------------------------------


def _trim(scratch: Scratch, alive: DataFrame, near: str, far: str, local_edges: int) -> tuple[DataFrame, int]:
    """Peel from one side until nothing goes or the rest is small: drops edges
    whose ``near`` end is no ``far`` end of another edge."""
    n = count_rows(alive)
    while n > local_edges:
        ends = alive.select(F.col(far).alias(near)).distinct()
        rest = scratch.save(alive.join(ends, near, "left_semi").select("parent", "child"), "trim")
        m = count_rows(rest)
        if m == n:
            scratch.drop(rest)
            break
        scratch.drop(alive)
        alive, n = rest, m
    return alive, n


def _local_circles(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Components of more than one node, or with a loop, named by their least id."""
    p, c = t.column("parent").to_numpy(), t.column("child").to_numpy()
    while len(p):
        keep = np.isin(c, p) & np.isin(p, c)
        if keep.all():
            break
        p, c = p[keep], c[keep]
    ids = np.unique(np.concatenate([p, c]))
    a, b = np.searchsorted(ids, p), np.searchsorted(ids, c)
    order = np.argsort(a, kind="stable")
    start = np.searchsorted(a[order], np.arange(len(ids) + 1)).tolist()
    to = b[order].tolist()
    index, low, on = [-1] * len(ids), [0] * len(ids), [False] * len(ids)
    at, stack, clock = list(start[:-1]), [], 0
    comp = np.full(len(ids), -1, np.int64)
    loops = set(a[a == b].tolist())
    for root in range(len(ids)):
        if index[root] >= 0:
            continue
        trail = [root]
        while trail:
            v = trail[-1]
            if index[v] < 0:
                index[v] = low[v] = clock
                clock += 1
                stack.append(v)
                on[v] = True
            if at[v] < start[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if index[w] < 0:
                    trail.append(w)
                elif on[w]:
                    low[v] = min(low[v], index[w])
                continue
            trail.pop()
            if trail:
                low[trail[-1]] = min(low[trail[-1]], low[v])
            if low[v] == index[v]:
                members = []
                while True:
                    w = stack.pop()
                    on[w] = False
                    members.append(w)
                    if w == v:
                        break
                if len(members) > 1 or v in loops:
                    comp[members] = min(members)
    hit = np.flatnonzero(comp >= 0)
    yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[comp[hit]])], names=["node", "circle"])


def _spread(scratch: Scratch, values: DataFrame, edges: DataFrame) -> DataFrame:
    """Greatest value along edges (src, dst) until it settles."""
    while True:
        sent = edges.join(values.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), F.col("value").alias("got")).groupBy("node").agg(F.max("got").alias("got"))
        joined = values.join(sent, "node", "left")
        nxt = scratch.save(joined.select("node", F.greatest("value", F.coalesce("got", "value")).alias("value"), (F.col("got") > F.col("value")).alias("new")), "spread")
        changed = nxt.where("new").limit(1).count()
        scratch.drop(values)
        values = nxt.drop("new")
        values._idloom_path = nxt._idloom_path
        if not changed:
            return values


def _wide_circles(scratch: Scratch, core: DataFrame) -> DataFrame:
    """Components by colouring, for cores too large for a task: every node takes
    the greatest id that reaches it; nodes that reach the owner of their colour
    inside it form its component; these go and the rest starts again."""
    found, edges = [], core
    while count_rows(edges):
        nodes = scratch.save(edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct(), "nodes")
        colour = _spread(scratch, scratch.save(nodes.select("node", F.col("node").alias("value")), "colour"), edges.select(F.col("parent").alias("src"), F.col("child").alias("dst")))
        left = colour.select(F.col("node").alias("parent"), F.col("value").alias("a"))
        right = colour.select(F.col("node").alias("child"), F.col("value").alias("b"))
        inside = scratch.save(edges.join(left, "parent").join(right, "child").where("a = b").select(F.col("child").alias("src"), F.col("parent").alias("dst")), "inside")
        start = scratch.save(colour.select("node", (F.col("node") == F.col("value")).cast("long").alias("value")), "start")
        back = _spread(scratch, start, inside)
        hit = scratch.save(back.where("value = 1").select("node").join(colour, "node").select("node", F.col("value").alias("circle")), "hit")
        loops = edges.where("parent = child").select(F.col("parent").alias("circle")).distinct()
        real = hit.groupBy("circle").count().where("count > 1").select("circle").union(loops).distinct()
        found.append(scratch.save(hit.join(real, "circle", "left_semi").select("node", "circle"), "found"))
        gone = hit.select("node")
        rest = edges.join(gone.withColumnRenamed("node", "parent"), "parent", "left_anti").join(gone.withColumnRenamed("node", "child"), "child", "left_anti").select("parent", "child")
        rest = scratch.save(rest, "rest")
        rest, _ = _trim(scratch, rest, "child", "parent", 0)
        edges, _ = _trim(scratch, rest, "parent", "child", 0)
    if not found:
        return core.sparkSession.createDataFrame([], "node long, circle long")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    least = out.groupBy("circle").agg(F.min("node").alias("least"))
    return out.join(least, "circle").select("node", F.col("least").alias("circle"))


def circles(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, circle): nodes that reach themselves, with the least id of all that
    reach each other.  A node that holds itself is a circle of one.  ``edges``
    are those of ``links_of`` or ``edges_of``.

    Peeling from the bottom leaves circles and what lies above them, peeling
    from the top then circles and what lies between them; the exact check of
    that rest splits it into components.
    """
    scratch = Scratch(edges.sparkSession)
    rest = scratch.save(edges.select("parent", "child").distinct() if "path" in edges.columns else edges, "links")
    rest, _ = _trim(scratch, rest, "child", "parent", local_edges)
    rest, n = _trim(scratch, rest, "parent", "child", local_edges)
    if n > local_edges:
        return _wide_circles(scratch, rest)
    return scratch.save(_in_one_task(rest, _local_circles, "node long, circle long"), "circles")


# -- peeling ---------------------------------------------------------------------


@dataclass
class Peel:
    """Edges by the round they went in (bottom first) and the rest, small and acyclic."""

    rounds: list[DataFrame] = field(default_factory=list)
    rest: DataFrame | None = None


def peel(scratch: Scratch, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> Peel:
    """Peel edges without circles; other columns of ``edges`` stay with them."""
    out, alive = Peel(), scratch.save(edges, "alive")
    cols = edges.columns
    while count_rows(alive) > local_edges:
        inner = alive.select(F.col("parent").alias("child"), F.lit(True).alias("inner")).distinct()
        marked = scratch.save(alive.join(inner, "child", "left").select(*cols, "inner"), "round")
        scratch.drop(alive)
        out.rounds.append(marked.where("inner is null").select(*cols))
        alive = scratch.save(marked.where("inner").select(*cols), "alive")
    out.rest = alive
    return out


# -- descendants -----------------------------------------------------------------


def _local_components(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Edges with the component they belong to, whatever way they point."""
    p, c = t.column("parent").to_numpy(), t.column("child").to_numpy()
    ids, at = np.unique(np.concatenate([p, c]), return_inverse=True)
    up = list(range(len(ids)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in zip(at[: len(p)].tolist(), at[len(p) :].tolist()):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    part = ids[[top(x) for x in at[: len(p)].tolist()]] if len(p) else p
    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(c), pa.array(part)], names=["parent", "child", "component"])


def _local_reach(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """(ancestor, via): every node of a small acyclic graph with all it reaches and itself."""
    p, c = t.column("parent").to_numpy(), t.column("child").to_numpy()
    ids = np.unique(np.concatenate([p, c]))
    a, b = np.searchsorted(ids, p), np.searchsorted(ids, c)
    kids, waiting, above = [[] for _ in ids], np.bincount(a, minlength=len(ids)), [[] for _ in ids]
    for x, y in zip(a.tolist(), b.tolist()):
        kids[x].append(y)
        above[y].append(x)
    uses = [len(x) for x in above]
    waiting = waiting.tolist()
    reach: dict[int, np.ndarray] = {}
    ready = [i for i, w in enumerate(waiting) if not w]
    held, rows = [], 0
    while ready:
        v = ready.pop()
        mine = np.unique(np.concatenate([[v], *[reach[k] for k in kids[v]]])).astype(np.int64) if kids[v] else np.array([v], np.int64)
        for k in kids[v]:
            uses[k] -= 1
            if not uses[k]:
                reach.pop(k)
        if uses[v]:
            reach[v] = mine
        held.append((np.full(len(mine), ids[v]), ids[mine]))
        rows += len(mine)
        for u in above[v]:
            waiting[u] -= 1
            if not waiting[u]:
                ready.append(u)
        if rows > 200_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=["ancestor", "via"])
            held, rows = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=["ancestor", "via"])


@dataclass
class Closure:
    """What lies below each class of files: a circle is one class, named by its least
    file, any other file is its own."""

    ring: DataFrame
    parts: list[DataFrame]

    def pairs(self) -> DataFrame:
        """(file_id, member_id) between different classes, each once."""
        out = self.parts[0]
        for x in self.parts[1:]:
            out = out.unionByName(x)
        return out.select(F.col("node").alias("file_id"), F.col("member").alias("member_id"))

    def circles(self) -> DataFrame:
        """(circle, n_files)"""
        return self.ring.groupBy("circle").agg(F.count(F.lit(1)).alias("n_files"))

    def sizes(self) -> DataFrame:
        """(file_id, n_members): different files below each that has any; files of a
        circle are below each other and below themselves.

        A class's list is whole when it is peeled, so its size is one count, in
        the round that sends it up; a circle below counts by its files.
        """
        rings = self.circles()
        each = None
        for x in self.parts:
            more = x.join(rings, F.col("member") == F.col("circle")).select("node", (F.col("n_files") - 1).alias("n"))
            n = x.select("node", F.lit(1).cast("long").alias("n")).unionByName(more).groupBy("node").agg(F.sum("n").alias("n"))
            each = n if each is None else each.unionByName(n)
        whole = each.unionByName(rings.select(F.col("circle").alias("node"), F.col("n_files").alias("n"))).groupBy("node").agg(F.sum("n").alias("n"))
        holders = self.ring.select(F.col("circle").alias("node"), F.col("node").alias("holder"))
        return whole.join(holders, "node", "left").select(F.coalesce("holder", "node").alias("file_id"), F.col("n").alias("n_members"))


def closure(members: DataFrame, local_edges: int = LOCAL_EDGES) -> Closure:
    """Peel from the bottom; leaves send their lists of descendants up, as rows and
    never as one array, so one huge archive is no huge row.

    Repeated edges count once; null ends are left out; empty input, empty result.
    """
    spark = members.sparkSession
    scratch = Scratch(spark)
    edges = scratch.save(links_of(members), "edges")
    ring = circles(edges, local_edges)
    name = lambda side: ring.select(F.col("node").alias(side), F.col("circle").alias(f"{side}_of"))
    joined = edges.join(name("parent"), "parent", "left").join(name("child"), "child", "left")
    dag = joined.select(F.coalesce("parent_of", "parent").alias("parent"), F.coalesce("child_of", "child").alias("child")).where("parent <> child").distinct()
    order = peel(scratch, dag, local_edges)
    pending = spark.createDataFrame([], "node long, member long")
    done: list[DataFrame] = []
    for leaves in order.rounds:
        gone = leaves.select(F.col("child").alias("node")).distinct().withColumn("gone", F.lit(True))
        split = scratch.save(pending.join(gone, "node", "left"), "split")
        full = split.where("gone").select("node", "member")
        done.append(full)
        below = full.union(gone.select("node", F.col("node").alias("member"))).withColumnRenamed("node", "child")
        # a child with many parents and a long list is hot on both sides
        told = spread_join(leaves, below, ["child"]).select(F.col("parent").alias("node"), "member")
        pending = scratch.save(split.where("gone is null").select("node", "member").union(told).distinct(), "pending")
    # the rest is small; its components are closed each in one task
    parts = scratch.save(_in_one_task(order.rest, _local_components, "parent long, child long, component long"), "components")
    tasks = max(1, min(partitions(spark), count_rows(parts) // 2_000))
    reach = parts.repartition(tasks, "component").mapInArrow(lambda batches: _held(batches, _local_reach), "ancestor long, via long")
    reach = scratch.save(reach, "reach")
    through = reach.join(pending.withColumnRenamed("node", "via"), "via").select(F.col("ancestor").alias("node"), "member")
    own = reach.where("ancestor <> via").select(F.col("ancestor").alias("node"), F.col("via").alias("member"))
    return Closure(ring, [*done, pending.union(through).union(own).distinct()])


def descendants(members: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(file_id, member_id): every file with all files below it, at any depth.

    The files of a circle stand as one, named by its least file, on either side:
    who is in which circle is told by ``circles``, and a ring is not opened into
    all its pairs.
    """
    return closure(members, local_edges).pairs()


def subtree_sizes(members: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(file_id, n_members) of every file that holds any; see ``Closure.sizes``."""
    return closure(members, local_edges).sizes()


# -- paths -----------------------------------------------------------------------


def _local_paths(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Depth, root and path of all nodes of a small acyclic graph, from the top.

    Only the way up is kept for each node; paths are put together on output.
    """
    p, c, path = t.column("parent").to_numpy(), t.column("child").to_numpy(), t.column("path").to_pylist()
    ids = np.unique(np.concatenate([p, c]))
    a, b = np.searchsorted(ids, p).tolist(), np.searchsorted(ids, c).tolist()
    out, waiting = [[] for _ in ids], [0] * len(ids)
    for e, (x, y) in enumerate(zip(a, b)):
        out[x].append(e)
        waiting[y] += 1
    best: list[tuple | None] = [None] * len(ids)
    up: list[int] = [-1] * len(ids)
    full = lambda v: JOIN.join(reversed(list(_way(v))))

    def _way(v: int):
        while up[v] >= 0:
            yield path[up[v]]
            v = a[up[v]]

    ready = [i for i, w in enumerate(waiting) if not w]
    for r in ready:
        best[r] = (0, r)
    while ready:
        v = ready.pop()
        depth, root = best[v]
        for e in out[v]:
            w = b[e]
            mine = (depth + 1, root)
            if best[w] is None or mine < best[w]:
                best[w], up[w] = mine, e
            elif mine == best[w]:
                old = full(w)
                keep, up[w] = up[w], e
                if full(w) >= old:
                    up[w] = keep
            waiting[w] -= 1
            if not waiting[w]:
                ready.append(w)
    for s in range(0, len(ids), 5000):
        part = range(s, min(s + 5000, len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[s : s + 5000]), pa.array([best[v][0] for v in part], pa.int32()), pa.array([int(ids[best[v][1]]) for v in part], pa.int64()), pa.array([full(v) for v in part], pa.string())], names=["node", "depth", "root", "full_path"])


PLACED = "node long, depth int, root long, full_path string"


def hierarchy(members: DataFrame, local_edges: int = LOCAL_EDGES, hot_share: float = 1 / 64) -> DataFrame:
    """One row for each file that holds or is held: file_id, in_circle, depth,
    root_file_id, full_path.

    Of several ways from a root the shortest counts, then the least root, then
    the least path (by code point).  Depth of a root is 0 and its path empty; a
    path joins the members' paths from the root on by ``!/``.  A file of a
    circle has no way from a root that means anything: depth, root and path are
    null, and files below it start from it as from a root.
    """
    spark = members.sparkSession
    scratch = Scratch(spark)
    edges = scratch.save(edges_of(members), "edges")
    ring = circles(edges, local_edges).select(F.col("node").alias("child"))
    order = peel(scratch, edges.join(ring, "child", "left_anti").select("parent", "child", "path"), local_edges)
    lows = [r.select(F.col("child").alias("node")) for r in order.rounds]
    nodes = edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()
    placed = scratch.save(_in_one_task(order.rest, _local_paths, PLACED), "placed")
    below = order.rest.select(F.col("child").alias("node"))
    for x in lows:
        below = below.union(x)
    tops = nodes.join(below.distinct(), "node", "left_anti").join(placed.select("node"), "node", "left_anti")
    parts = [placed, scratch.save(tops.select("node", F.lit(0).alias("depth"), F.col("node").alias("root"), F.lit("").alias("full_path")), "tops")]
    total = max(1, count_rows(edges))
    # at most 1 / hot_share ids
    hot = [r[0] for r in edges.groupBy("parent").count().where(F.col("count") > total * hot_share).select("parent").collect()]
    for leaves in reversed(order.rounds):
        known = parts[0]
        for x in parts[1:]:
            known = known.union(x)
        known = known.withColumnRenamed("node", "parent")
        is_hot = F.col("parent").isin(hot) if hot else F.lit(False)
        joined = leaves.where(~is_hot).join(known, "parent")
        if hot:
            joined = joined.unionByName(leaves.where(is_hot).join(F.broadcast(known.where(is_hot)), "parent"))
        way = F.struct((F.col("depth") + 1).alias("depth"), F.col("root"), F.when(F.col("depth") == 0, F.col("path")).otherwise(F.concat_ws(JOIN, "full_path", "path")).alias("full_path"))
        parts.append(scratch.save(joined.groupBy(F.col("child").alias("node")).agg(F.min(way).alias("w")).select("node", "w.depth", "w.root", "w.full_path"), "placed"))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    flagged = out.join(ring.select(F.col("child").alias("node"), F.lit(True).alias("c")), "node", "left")
    gone = F.col("c").isNotNull()
    return flagged.select(F.col("node").alias("file_id"), gone.alias("in_circle"), F.when(~gone, F.col("depth")).alias("depth"), F.when(~gone, F.col("root")).alias("root_file_id"), F.when(~gone, F.col("full_path")).alias("full_path"))
