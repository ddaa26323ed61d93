"""Micro graphs with known answers, and both paths (in tasks, by joins) against plain Python."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from graphlens.operators import algorithms as alg
from graphlens.operators import traverse as tr
from graphlens.operators.components import connected_components
from graphlens.operators.rank import entrypoints

E = "src_id long, dst_id long, kind string"


def graph(spark, pairs, kind="calls"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], E)


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def as_dict(df, k, v):
    return {r[k]: r[v] for r in df.collect()}


def random_pairs(seed, n=40, m=90):
    r = random.Random(seed)
    return sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})


def plain_bfs(pairs, start, cap=None):
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    seen, q = {start: 0}, deque([start])
    while q:
        v = q.popleft()
        if cap is not None and seen[v] >= cap:
            continue
        for w in out.get(v, ()):
            if w not in seen:
                seen[w] = seen[v] + 1
                q.append(w)
    return seen


@pytest.mark.parametrize("max_edges", [tr.MAX_EDGES, 0])
def test_bfs_both_paths(spark, max_edges):
    pairs = random_pairs(1, 20, 35)
    starts = spark.createDataFrame([(s, s) for s in (0, 1, 5)], "origin long, node long")
    got = {(r.origin, r.node): r.dist for r in tr.bfs(starts, graph(spark, pairs), 3, max_edges).collect()}
    assert got == {(s, n): d for s in (0, 1, 5) for n, d in plain_bfs(pairs, s, 3).items()}


def test_trace_and_errors(spark):
    e = graph(spark, [(1, 2), (2, 3), (3, 1), (4, 1)])
    got = {(r.id, r.depth, r.direction) for r in tr.trace_calls(nodes(spark, [1]), e, "both", 1).collect()}
    assert got == {(1, 0, "self"), (2, 1, "outbound"), (3, 1, "inbound"), (4, 1, "inbound")}
    with pytest.raises(ValueError):
        tr.trace_calls(nodes(spark, [1]), e, "up")
    with pytest.raises(ValueError):
        tr.trace_calls(nodes(spark, [1]), e, "both", -1)
    assert tr.trace_calls(nodes(spark, []), e).collect() == []


def test_blast_radius(spark):
    e = graph(spark, [(2, 1), (3, 2)]).union(graph(spark, [(2, 1)], "imports")).union(graph(spark, [(9, 1)], "test_covers"))
    assert {(r.id, r.distance, r.via) for r in tr.blast_radius(nodes(spark, [1]), e).collect()} == {(2, 1, "calls"), (3, 2, "calls")}


def test_exec_path(spark):
    e = graph(spark, [(1, 2), (2, 3), (5, 6), (6, 5)]).union(graph(spark, [(100, 1), (100, 2), (100, 3), (101, 5), (101, 6)], "test_covers"))
    got = {(r.test_id, r.id): r.layer for r in tr.exec_path(nodes(spark, [100, 101]), e).collect()}
    assert got == {(100, 1): 0, (100, 2): 1, (100, 3): 2, (101, 5): 0, (101, 6): 0}


@pytest.mark.parametrize("max_edges", [tr.MAX_EDGES, 0])
def test_strong_components(spark, max_edges):
    pairs = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 3), (6, 6)]
    got = as_dict(alg.strong_components(nodes(spark, range(1, 8)), graph(spark, pairs), max_edges), "id", "comp")
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7}


@pytest.mark.parametrize("max_edges", [tr.MAX_EDGES, 0])
def test_strong_components_random(spark, max_edges):
    size = 40 if max_edges else 12
    pairs = random_pairs(3, size, 2 * size)
    reach = {v: set(plain_bfs(pairs, v)) for v in range(size)}
    want = {v: min(w for w in reach[v] if v in reach[w]) for v in range(size)}
    assert as_dict(alg.strong_components(nodes(spark, range(size)), graph(spark, pairs), max_edges), "id", "comp") == want


def test_cycle_flags_and_spine(spark):
    n = nodes(spark, [1, 2, 3, 4])
    spine = lambda pairs: {r.id: (r.layer, r.in_cycle) for r in alg.main_spine(nodes(spark, [1]), n, graph(spark, pairs)).collect()}
    assert spine([(1, 2), (2, 3), (3, 4)]) == {1: (0, False), 2: (1, False), 3: (2, False), 4: (3, False)}
    assert spine([(1, 2), (1, 3), (3, 4)]) == {1: (0, False), 3: (1, False), 4: (2, False)}
    assert spine([(1, 2), (2, 3), (3, 2)]) == {1: (0, False), 2: (1, True), 3: (1, True)}
    assert spine([(1, 1)]) == {1: (0, True)}
    assert alg.main_spine(nodes(spark, [99]), n, graph(spark, [(1, 2)])).collect() == []


def brandes(pairs, ids):
    out, score = {}, dict.fromkeys(ids, 0.0)
    for a, b in pairs:
        if a != b:
            out.setdefault(a, []).append(b)
    for s in ids:
        d = plain_bfs([p for p in pairs if p[0] != p[1]], s)
        count = {s: 1}
        for v in sorted(d, key=d.get):
            for w in out.get(v, ()):
                if d[w] == d[v] + 1:
                    count[w] = count.get(w, 0) + count[v]
        dep = dict.fromkeys(d, 0.0)
        for w in sorted(d, key=d.get, reverse=True):
            for v in d:
                if d[v] == d[w] - 1 and w in out.get(v, ()):
                    dep[v] += count[v] / count[w] * (1 + dep[w])
            if w != s:
                score[w] += dep[w]
    return score


@pytest.mark.parametrize("max_edges", [tr.MAX_EDGES, 0])
def test_betweenness(spark, max_edges):
    pairs = random_pairs(5, 14, 30)
    got = as_dict(alg.betweenness(nodes(spark, range(14)), graph(spark, pairs), max_edges), "id", "betweenness")
    assert got == pytest.approx(brandes(pairs, range(14)))


def test_chokepoint(spark):
    got = as_dict(alg.betweenness(nodes(spark, [1, 2, 3, 4]), graph(spark, [(1, 3), (2, 3), (3, 4)])), "id", "betweenness")
    assert got == {1: 0, 2: 0, 3: 2, 4: 0}


def test_dominators(spark):
    n = nodes(spark, range(1, 6))
    dom = lambda roots, pairs: as_dict(alg.dominated_counts(nodes(spark, roots), n, graph(spark, pairs)), "id", "dominates")
    assert dom([1], [(1, 2), (2, 3), (2, 4)]) == {1: 3, 2: 2, 3: 0, 4: 0, 5: 0}
    assert dom([1], [(1, 2), (1, 3), (2, 4), (3, 4)]) == {1: 3, 2: 0, 3: 0, 4: 0, 5: 0}


@pytest.mark.parametrize("max_edges", [tr.MAX_EDGES, 0])
def test_dominators_random(spark, max_edges):
    size = 25 if max_edges else 12
    pairs = [p for p in random_pairs(8, size, 2 * size) if p[0] != p[1]]
    roots = [0, 1]
    reach = lambda drop: {v for r in roots if r != drop for v in plain_bfs([p for p in pairs if drop not in p], r)}
    full = reach(None)
    want = {v: len(full) - 1 - len(reach(v)) if v in full else 0 for v in range(size)}
    assert as_dict(alg.dominated_counts(nodes(spark, roots), nodes(spark, range(size)), graph(spark, pairs), max_edges), "id", "dominates") == want


def test_longest_depths_by_joins(spark):
    dag = graph(spark, [(1, 2), (1, 3), (3, 4), (2, 4), (4, 5)]).select(F.col("src_id").alias("src_comp"), F.col("dst_id").alias("dst_comp"))
    roots = spark.createDataFrame([(1,)], "comp long")
    want = {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    assert as_dict(alg.longest_depths(roots, dag), "comp", "depth") == want
    assert as_dict(alg.longest_depths(roots, dag, max_edges=0), "comp", "depth") == want


def test_connected_components(spark):
    pairs = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5)] + [(100 + i, 101 + i) for i in range(30)]
    for bound in (1000, 0):  # in one task, by rounds
        got = as_dict(connected_components(spark.createDataFrame(pairs, "a long, b long"), max_edges=bound), "node", "component")
        assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(31)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_entrypoints(spark):
    rows = [(1, "main", "function", "a.py"), (2, "gate", "function", "a.py"), (3, "_x", "function", "a.py"), (4, "y", "function", "a.py")]
    located = spark.createDataFrame([(i, 1, n, k, i * 10, i * 10 + 5, p) for i, n, k, p in rows], "id long, file_id long, name string, kind string, line_start long, line_end long, path string")
    calls = graph(spark, [(1, 2), (2, 3), (2, 4)])
    marked = entrypoints(located, calls, spark.createDataFrame([(1, "main", 0)], "id long, marker string, step int")).collect()
    assert [(r.name, r.primary, r.marker, r.is_library, r.reach) for r in marked] == [("main", True, "main", False, 3)]
    plain = entrypoints(located, calls, spark.createDataFrame([], "id long, marker string, step int")).orderBy("rank").collect()
    assert [r.name for r in plain] == ["gate", "main", "y"] and plain[0].is_library


def test_call_graph_queries(spark, monkeypatch):
    """The queries on the whole call graph against plain Python; edges from a larger to a smaller id and between functions count."""
    from graphlens.plans import graph as plans

    ids = list(range(1, 15))
    pairs = {(a, b) for a, b in random_pairs(5, 14, 22) if a in ids and b in ids} | {(9, 3), (3, 9)}
    frame = graph(spark, sorted(pairs))
    monkeypatch.setattr(plans, "Graph", lambda s, d: None)
    monkeypatch.setattr(plans, "_calls_among", lambda g: (nodes(spark, ids), frame))
    out = {v: {b for a, b in pairs if a == v and b != v} for v in ids}

    def reach(starts, without=None):
        seen, todo = set(), [v for v in starts if v != without]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += [w for w in out[v] if w != without]
        return seen

    to = {v: reach([v]) for v in ids}
    comp = {v: min(w for w in to[v] if v in to[w]) for v in ids}
    ask = lambda q, k, v: as_dict(plans.QUERIES[q](spark, ""), k, v)
    assert ask("scc", "id", "comp") == comp
    into = {c: {comp[a] for a, b in pairs if comp[b] == c != comp[a]} for c in comp.values()}
    depth = lambda c: max((depth(x) + 1 for x in into[c]), default=0)
    assert ask("longest_path", "comp", "depth") == {c: depth(c) for c in into}
    roots = [c for c in into if not into[c]]
    assert ask("dominates_count", "id", "dominates") == {v: len(reach(roots)) - 1 - len(reach(roots, v)) for v in ids}

    def paths(s, t):
        front, level = [[s]], []
        while front and not level:
            level = [p for p in front if p[-1] == t]
            front = [p + [w] for p in front for w in out[p[-1]] if w not in p]
        return level

    score = dict.fromkeys(ids, 0.0)
    for s in ids:
        for t in to[s] - {s}:
            ps = paths(s, t)
            for p in ps:
                for v in p[1:-1]:
                    score[v] += 1 / len(ps)
    assert ask("betweenness", "id", "betweenness") == pytest.approx(score, abs=1e-4)


@pytest.mark.parametrize("max_edges", [tr.MAX_EDGES, 0])
def test_reach_sizes(spark, max_edges):
    pairs = random_pairs(9, 20, 30)
    got = as_dict(tr.reach_sizes(nodes(spark, range(22)), graph(spark, pairs), max_edges, 8), "id", "reach")
    assert got == {v: len(plain_bfs(pairs, v)) - 1 for v in range(22)}


def test_spine_by_joins(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (1, 3), (4, 3)]
    n = nodes(spark, range(1, 5))
    both = [{(r.id, r.layer, r.in_cycle) for r in alg.main_spine(nodes(spark, [1]), n, graph(spark, pairs), m).collect()} for m in (tr.MAX_EDGES, 0)]
    assert both[0] == both[1] == {(1, 0, False), (2, 1, False), (3, 2, True), (4, 2, True)}


def test_empty_graph(spark):
    n, e = nodes(spark, [1, 2]), graph(spark, [])
    for m in (tr.MAX_EDGES, 0):
        assert as_dict(alg.strong_components(n, e, m), "id", "comp") == {1: 1, 2: 2}
        assert as_dict(alg.betweenness(n, e, m), "id", "betweenness") == {1: 0, 2: 0}
        assert as_dict(alg.dominated_counts(nodes(spark, [1]), n, e, m), "id", "dominates") == {1: 0, 2: 0}
        assert as_dict(tr.reach_sizes(n, e, m), "id", "reach") == {1: 0, 2: 0}


def test_centrality_and_targets_walk_no_paths(spark, monkeypatch):
    """Neither query gives betweenness, so neither counts paths from every source."""
    import graphlens.operators.rank as rk
    from graphlens.plans.graph import QUERIES

    def fails(*_):
        raise AssertionError("betweenness")

    monkeypatch.setattr(rk, "betweenness", fails)
    assert QUERIES["centrality"](spark, "/root/testdata/sf0.001").columns == ["id", "name", "path", "dominates", "degree"]
    assert QUERIES["test_targets"](spark, "/root/testdata/sf0.001").columns == ["id", "name", "path", "score", "reason"]


def test_reach_counts_split_at_pivots(monkeypatch):
    """A long cycle with ways in and out is counted at its pivot, not once from every node; small graphs against plain walks."""
    import random

    import numpy as np

    calls = []
    one_by_one = tr._counts_one_by_one
    monkeypatch.setattr(tr, "_counts_one_by_one", lambda g, live, s: calls.append(len(s)) or one_by_one(g, live, s))
    monkeypatch.setattr(tr, "PAIRS", 5000)
    n = 2000
    pairs = [(i, (i + 1) % n) for i in range(n)] + [(n + i, i) for i in range(50)] + [(i, 2 * n + i) for i in range(50)]
    g = tr.Adjacency(*(np.array(x, np.int64) for x in zip(*pairs)))
    got = dict(zip(g.ids.tolist(), tr.reach_counts(g, np.arange(len(g.ids))).tolist()))
    assert got == {**dict.fromkeys(range(n), n + 50), **dict.fromkeys(range(n, n + 50), n + 51), **dict.fromkeys(range(2 * n, 2 * n + 50), 1)} and not calls
    r = random.Random(5)
    for _ in range(60):
        k = r.randint(2, 30)
        pairs = [(r.randrange(k), r.randrange(k)) for _ in range(r.randint(1, 70))]
        g = tr.Adjacency(*(np.array(x, np.int64) for x in zip(*pairs)))
        s = np.arange(len(g.ids))
        assert (tr.reach_counts(g, s) == one_by_one(g, np.ones(len(s), bool), s)).all()


def _brute_roots(pairs, ids):
    reach = {v: set(plain_bfs(pairs, v)) for v in ids}
    return {v for v in ids if all(v not in reach[u] or u in reach[v] for u in ids)}


def _parts(seed):
    """Unconnected random graphs, one of them a copy of another, with edges from a node to itself, and nodes without edges."""
    first = random_pairs(seed, 30, 50)
    return [*first, *[(a + 100, b + 100) for a, b in first], *[(a + 200, b + 200) for a, b in random_pairs(seed + 50, 12, 40)], (300, 300), (301, 302)], [*range(0, 30), *range(100, 130), *range(200, 212), *range(300, 306)]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("max_edges,max_nodes", [(tr.MAX_EDGES, tr.MAX_NODES), (40, tr.MAX_NODES), (40, 3)])
def test_reach_and_roots_of_parts(spark, seed, max_edges, max_nodes):
    pairs, ids = _parts(seed)
    n, e = nodes(spark, ids), graph(spark, pairs)
    assert as_dict(tr.reach_sizes(n, e, max_edges, max_nodes=max_nodes), "id", "reach") == {v: len(plain_bfs(pairs, v)) - 1 for v in ids}
    rows = alg.root_members(n, e, max_edges, max_nodes=max_nodes).collect()
    assert len(rows) == len({r.id for r in rows}) and {r.id for r in rows} == _brute_roots(pairs, ids)


def test_entrypoints_of_large_graphs_are_not_walked_by_joins(spark, monkeypatch):
    pairs, ids = _parts(4)
    located = spark.createDataFrame([(i, f"f{i}", "function", 1, 2, 1, "a.py") for i in ids], "id long, name string, kind string, line_start int, line_end int, file_id long, path string")
    marks = spark.createDataFrame([(205, "main", 0)], "id long, marker string, step int")
    monkeypatch.setattr(tr, "bfs", lambda *a, **k: pytest.fail("walked hop by hop"))
    monkeypatch.setattr(alg, "bfs", tr.bfs)
    rows = entrypoints(located, graph(spark, pairs), marks, max_edges=len(pairs) - 1).orderBy("rank").collect()
    want = {v: len(plain_bfs(pairs, v)) - 1 for v in _brute_roots(pairs, ids) | {205}}
    assert {r.id: r.reach for r in rows} == want and rows[0].id == 205 and [r.rank for r in rows] == list(range(1, len(want) + 1))


def test_pivots_of_no_edges_or_too_many_nodes(spark):
    from graphlens.operators.pivots import find_pivots

    assert find_pivots(graph(spark, []).select("src_id", "dst_id")) is None
    assert find_pivots(graph(spark, [(1, 2), (2, 3)]).select("src_id", "dst_id"), 2) is None
    p = find_pivots(graph(spark, [(1, 2), (2, 3), (3, 2), (3, 4), (7, 8)]).select("src_id", "dst_id"), 6)
    got = {r.id: (r.ahead, r.behind, r.n if r.ahead or r.behind else None, r.alone) for r in p.marked(nodes(spark, [1, 2, 3, 4, 5])).collect()}
    assert [got[i][:3] for i in (1, 2, 3, 4, 5)] == [(False, True, 3), (True, True, 3), (True, True, 3), (True, False, 3), (False, False, None)]
    assert not got[2][3]


@pytest.mark.parametrize("seed", [5, 6])
@pytest.mark.parametrize("max_edges,task_edges", [(40, 40), (40, None), (20, None)])
def test_reach_and_roots_beyond_the_bound(spark, seed, max_edges, task_edges):
    pairs, ids = _parts(seed)
    n, e = nodes(spark, ids), graph(spark, pairs)
    for pivots in (2, 0):
        assert as_dict(tr.reach_sizes(n, e, max_edges, pivots=pivots, task_edges=task_edges), "id", "reach") == {v: len(plain_bfs(pairs, v)) - 1 for v in ids}
    assert {r.id for r in alg.root_members(n, e, max_edges, task_edges=task_edges).collect()} == _brute_roots(pairs, ids)


def test_one_task_walks_what_max_edges_does_not_hold(spark, monkeypatch):
    """Components, their heads, reach and dominators of a graph of up to six times max_edges take no loop of joins and no pivots over broadcasts."""
    pairs, ids = _parts(7)
    n, e = nodes(spark, ids), graph(spark, pairs)
    want = as_dict(alg.strong_components(n, e), "id", "comp")
    heads = as_dict(alg.root_heads(n, e), "id", "id")
    dominated = as_dict(alg.dominated_counts(nodes(spark, heads), n, e), "id", "dominates")
    assert set(heads) == {min(v for v in ids if want[v] == want[r]) for r in _brute_roots(pairs, ids)}
    for module, name in ((tr, "bfs"), (alg, "bfs"), (tr, "find_pivots"), (alg, "find_pivots"), (alg, "_dominated_by_joins"), (alg, "condensed")):
        monkeypatch.setattr(module, name, lambda *a, **k: pytest.fail("walked by joins or broadcast pivots"))
    few = len(pairs) // 3
    assert as_dict(alg.strong_components(n, e, few), "id", "comp") == want
    assert as_dict(alg.root_heads(n, e, few), "id", "id") == heads
    assert as_dict(alg.dominated_counts(nodes(spark, heads), n, e, few), "id", "dominates") == dominated
    assert as_dict(tr.reach_sizes(n, e, few), "id", "reach") == {v: len(plain_bfs(pairs, v)) - 1 for v in ids}
