import random
from functools import cache

import pytest

from idloom.operators import hierarchy as h

SCHEMA = "id long, parent_file_id long, child_file_id long, archive_path string, node long, depth int"


def _df(spark, edges):
    return spark.createDataFrame([(i, *e, 9, 9) for i, e in enumerate(edges)], SCHEMA)


def _reach(edges):
    kids = {}
    for p, c, _ in edges:
        if p is not None and c is not None:
            kids.setdefault(p, set()).add(c)
    out = {}
    for n in {x for p, c, _ in edges if p is not None and c is not None for x in (p, c)}:
        seen, todo = set(), list(kids.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += kids.get(x, ())
        out[n] = seen
    return out


def _paths(edges):
    ring = {n for n, r in _reach(edges).items() if n in r}
    ups = {}
    nodes = set()
    for p, c, path in edges:
        if p is None or c is None:
            continue
        nodes |= {p, c}
        if c not in ring:
            ups.setdefault(c, set()).add((p, path or ""))

    @cache
    def best(n):
        if n not in ups:
            return (0, n, "")
        ways = []
        for p, path in ups[n]:
            d, r, s = best(p)
            ways.append((d + 1, r, path if d == 0 else f"{s}!/{path}"))
        return min(ways)

    return {n: (n in ring, *((None,) * 3 if n in ring else best(n))) for n in nodes}


def _random(seed, n=24, rings=True):
    r = random.Random(seed)
    edges = []
    for c in range(1, n):
        for _ in range(r.choice([1, 1, 2])):
            edges.append((r.randrange(c), c, r.choice(["a", "a b", "b/c", "ü", None, ""])))
    edges += [(1000 + i, 1001 + i, f"deep{i}") for i in range(6)]
    if rings:
        edges += [(n // 2, n // 4, "back"), (5, 5, "self"), (2000, 2001, "x"), (2001, 2002, "y"), (2002, 2000, "z"), (2002, 2003, "below"), (2010, 2000, "above")]
    edges += [(3, None, "dir"), (None, 4, "lost"), edges[0], edges[0]]
    return edges


@pytest.mark.parametrize("local", [0, 10**6])
def test_circles_descendants_and_paths(spark, local):
    edges = _random(3)
    df = _df(spark, edges)
    reach = _reach(edges)
    got = h.circles(h.edges_of(df), local).collect()
    assert {r.node for r in got} == {n for n, x in reach.items() if n in x}
    assert len(got) == len({r.node for r in got})
    for r in got:
        assert r.circle == min(x for x in reach[r.node] if r.node in reach[x])
    of = {r.node: r.circle for r in got}
    pairs = [tuple(r) for r in h.descendants(df, local).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(of.get(a, a), of.get(b, b)) for a, x in reach.items() for b in x if of.get(a, a) != of.get(b, b)}
    sizes = [tuple(r) for r in h.subtree_sizes(df, local).collect()]
    assert sorted(sizes) == sorted((a, len(x)) for a, x in reach.items() if x)
    rows = {r.file_id: (r.in_circle, r.depth, r.root_file_id, r.full_path) for r in h.hierarchy(df, local).collect()}
    assert rows == _paths(edges)


def test_hot_parent_without_circles(spark):
    edges = [(0, i, f"m{i}") for i in range(1, 400)] + [(i, 1000 + i, "x") for i in range(1, 50)]
    df = _df(spark, edges)
    rows = {r.file_id: (r.in_circle, r.depth, r.root_file_id, r.full_path) for r in h.hierarchy(df, 20).collect()}
    assert rows == _paths(edges)
    assert h.circles(h.edges_of(df), 20).count() == 0


def test_a_ring_is_not_opened(spark):
    n = 400
    df = _df(spark, [(i, (i + 1) % n, "r") for i in range(n)] + [(3, 1000, "below"), (2000, 5, "above")])
    assert {tuple(r) for r in h.descendants(df).collect()} == {(0, 1000), (2000, 0), (2000, 1000)}
    sizes = dict(map(tuple, h.subtree_sizes(df).collect()))
    assert sizes[2000] == n + 1 and {sizes[i] for i in range(n)} == {n + 1} and len(sizes) == n + 1


def test_a_child_with_many_parents_and_many_members(spark):
    edges = [(i, 0, "in") for i in range(5000, 5200)] + [(0, i, "m") for i in range(1, 3000)]
    for local in (0, 10**6):
        pairs = h.descendants(_df(spark, edges), local)
        assert pairs.count() == 2999 + 200 * 3000 and pairs.distinct().count() == pairs.count()


def test_empty_and_null_only(spark):
    for edges in ([], [(1, None, "a"), (None, 2, None)]):
        df = _df(spark, edges)
        assert h.circles(h.edges_of(df)).collect() == []
        assert h.descendants(df).collect() == []
        assert h.hierarchy(df).collect() == []


def test_very_long_path(spark):
    edges = [(1, 2, "x" * 100_000), (2, 3, "y")]
    rows = {r.file_id: r.full_path for r in h.hierarchy(_df(spark, edges)).collect()}
    assert rows[3] == "x" * 100_000 + "!/y"
