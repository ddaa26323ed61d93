"""Whole-graph algorithms: components, longest paths, betweenness, dominators.

As in the traversals, a graph of at most max_edges edges (counted first) is worked on in tasks that hold
its edges as arrays; larger graphs go through DataFrame loops. Both give the same rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.operators.heavy_keys import skew_join
from graphlens.operators.pivots import AHEAD, MAX_NODES, TASK_FACTOR, find_pivots, in_one_task, in_slices
from graphlens.operators.traverse import MAX_EDGES, Adjacency, bfs, bounded, induced, reversed_, simple_edges
from graphlens.session import cut

TRIMS = 3  # rounds of taking off nodes that lie on no cycle before components are coloured


def tarjan(nodes: Iterable[int], out: list[list[int]]) -> list[int]:
    """Component of each of the nodes 0.., named by its smallest member; iterative."""
    index, low, comp = [-1] * len(out), [0] * len(out), [-1] * len(out)
    stack: list[int] = []
    count = 0
    for root in nodes:
        if index[root] >= 0:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        while work:
            v, it = work[-1]
            for w in it:
                if index[w] < 0:
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    work.append((w, iter(out[w])))
                    break
                if comp[w] < 0:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = [stack.pop()]
                    while members[-1] != v:
                        members.append(stack.pop())
                    name = min(members)
                    for w in members:
                        comp[w] = name
    return comp


def _one_task(shared, work, schema: str, spark) -> DataFrame:
    """Rows of work(src, dst), run in one task on the edges of a bounded graph (see traverse.bounded)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in frames:
            yield work(*shared.value)

    return spark.range(0, 1, 1, 1).mapInPandas(run, schema)


def strong_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each node 0..n-1 the smallest node of its strongly connected component, given the edges' positions.

    The component of the most central node is found by walking both ways; what is left without nodes that have no way in or
    out goes through the depth-first search, whose lists are made node by node.
    """
    comp = np.arange(n, dtype=np.int32)
    if not len(a):
        return comp
    pivot = np.array([np.argmax(np.minimum(np.bincount(a, minlength=n), np.bincount(b, minlength=n)))])
    core = np.ones(n, bool)
    for x, y in ((a, b), (b, a)):
        seen = np.zeros(n, bool)
        seen[Adjacency.of(comp, x, y).walk(pivot, None, np.full(n, -1, np.int32))] = True
        core &= seen
    comp[core] = np.flatnonzero(core)[0]
    live = ~core
    while True:
        keep = live[a] & live[b] & (a != b)
        a, b = a[keep], b[keep]
        both = np.zeros(n, bool)
        both[a] = True
        into = np.zeros(n, bool)
        into[b] = True
        both &= into
        if (both == live).all():
            break
        live = both
    at = np.flatnonzero(live)
    if len(at):
        rest = np.array(tarjan(range(len(at)), Adjacency.of(at, np.searchsorted(at, a), np.searchsorted(at, b))), np.int64)
        comp[at] = at[rest]
    return comp


def _entered_in_task(ids: np.ndarray, a: np.ndarray, b: np.ndarray):
    """(id, comp, entered) of the nodes that are not the smallest of their component, or in one that another leads to."""
    comp = strong_labels(len(ids), a, b)
    entered = np.zeros(len(ids), bool)
    over = comp[a] != comp[b]
    entered[comp[b[over]]] = True
    entered = entered[comp]
    at = np.flatnonzero(entered | (comp != np.arange(len(ids))))
    yield from in_slices({"id": ids[at], "comp": ids[comp[at]], "entered": entered[at]})


def _entered(e: DataFrame) -> DataFrame:
    return cut(in_one_task(e, _entered_in_task, "id long, comp long, entered boolean"))


def _among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges between nodes (id), without those from a node to itself."""
    return simple_edges(induced(edges.select("src_id", "dst_id").where("src_id <> dst_id"), nodes))


def strong_components(nodes: DataFrame, edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(id, comp): comp is the smallest id of the strongly connected component; a lone node is its own. Ends of edges are nodes."""
    spark = nodes.sparkSession
    ids = nodes.select("id").where("id is not null").distinct()
    e = cut(simple_edges(edges.where("src_id <> dst_id")))
    rows = e.count()
    shared = bounded(e, max_edges) if rows <= max_edges else None
    if shared is not None:

        def work(src: np.ndarray, dst: np.ndarray) -> pd.DataFrame:
            g = Adjacency(src, dst)
            comp = tarjan(range(len(g.ids)), g.neighbours())
            moved = [(g.ids[v], g.ids[c]) for v, c in enumerate(comp) if v != c]
            return pd.DataFrame(moved, columns=["id", "comp"], dtype="int64")

        moved = _one_task(shared, work, "id long, comp long", spark)
        return ids.join(moved, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
    if 0 < rows <= TASK_FACTOR * max_edges:
        return ids.join(_entered(e).select("id", "comp"), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
    # nodes without a way in or out are components of their own; taking them off leaves the core
    for _ in range(TRIMS):
        both = e.select(F.col("src_id").alias("id")).distinct().join(e.select(F.col("dst_id").alias("id")).distinct(), "id", "left_semi")
        e = cut(induced(e, both))
    # colouring: the smallest id that reaches a node is its colour; within a colour, what reaches the colour's node back is a component
    left, done = cut(e.select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct()), None
    while not e.isEmpty():
        colour = cut(left.select("id", F.col("id").alias("colour")))
        while True:
            best = skew_join(e, colour.withColumnRenamed("id", "src_id"), "src_id", ["dst_id"], rows=rows).groupBy("dst_id").agg(F.min("colour").alias("c"))
            nxt = cut(colour.join(best, F.col("id") == F.col("dst_id"), "left").select("id", F.least("colour", F.coalesce("c", "colour")).alias("colour"), (F.col("c") < F.col("colour")).alias("moved")))
            colour = nxt.select("id", "colour")
            if nxt.where("moved").isEmpty():
                break
        a = colour.select(F.col("id").alias("src_id"), F.col("colour").alias("a"))
        b = colour.select(F.col("id").alias("dst_id"), F.col("colour").alias("b"))
        same = skew_join(skew_join(e, a, "src_id", ["dst_id"], rows=rows), b, "dst_id", ["src_id"], rows=rows).where("a = b")
        back = bfs(colour.where("id = colour").select(F.col("id").alias("origin"), F.col("id").alias("node")), reversed_(same), None, 0)
        found = cut(back.select(F.col("node").alias("id"), F.col("origin").alias("comp")))
        done = found if done is None else cut(done.unionByName(found))
        left = cut(left.join(found, "id", "left_anti"))
        e = cut(induced(e, left))
    if done is None:
        return ids.select("id", F.col("id").alias("comp"))
    return ids.join(done, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def in_cycle(nodes: DataFrame, edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(id, comp, in_cycle): in a component of several, or with an edge to itself."""
    comp = strong_components(nodes, edges, max_edges)
    sizes = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    loops = edges.where("src_id = dst_id").select(F.col("src_id").alias("id")).distinct().withColumn("loop", F.lit(True))
    return comp.join(sizes, "comp").join(loops, "id", "left").select("id", "comp", ((F.col("n") > 1) | F.coalesce("loop", F.lit(False))).alias("in_cycle"))


def condensed(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges between components."""
    a = comp.select(F.col("id").alias("src_id"), F.col("comp").alias("src_comp"))
    b = comp.select(F.col("id").alias("dst_id"), F.col("comp").alias("dst_comp"))
    e = cut(edges.select("src_id", "dst_id"))
    rows = e.count()
    ends = skew_join(skew_join(e, a, "src_id", ["dst_id"], rows=rows), b, "dst_id", ["src_id"], rows=rows)
    return ends.where("src_comp <> dst_comp").select("src_comp", "dst_comp").distinct()


def root_components(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (comp) that no other one leads to."""
    entered = condensed(comp, edges).select(F.col("dst_comp").alias("comp")).distinct()
    return comp.select("comp").distinct().join(entered, "comp", "left_anti")


def root_heads(nodes: DataFrame, edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """The smallest node (id) of every component that no other one leads to. Ends of edges are nodes."""
    e = edges.select("src_id", "dst_id").where("src_id <> dst_id")
    if max_edges < e.count() <= TASK_FACTOR * max_edges:
        return nodes.select("id").where("id is not null").distinct().join(_entered(e).select("id"), "id", "left_anti")
    comp = cut(strong_components(nodes, e, max_edges))
    return root_components(comp, e).select(F.col("comp").alias("id"))


def root_members(nodes: DataFrame, edges: DataFrame, max_edges: int = MAX_EDGES, pivots: int = 2, max_nodes: int = MAX_NODES, task_edges: int | None = None) -> DataFrame:
    """Nodes (id) in components that no other one leads to. Ends of edges are nodes.

    Up to task_edges (TASK_FACTOR times max_edges) one task finds them. Of more edges, what a pivot leads to is left out first, up to pivots times: of it, only the pivot's own component can be such
    a one, and nothing in it leads to the rest.
    """
    e = edges.select("src_id", "dst_id").where("src_id <> dst_id")
    rows = e.count()
    if max_edges < rows <= (TASK_FACTOR * max_edges if task_edges is None else task_edges):
        return nodes.select("id").where("id is not null").distinct().join(_entered(e).where("entered").select("id"), "id", "left_anti")
    split = find_pivots(e, max_nodes) if pivots and rows > max_edges else None
    if split is None:
        comp = cut(strong_components(nodes, edges, max_edges))
        return comp.join(root_components(comp, edges), "comp", "left_semi").select("id")
    rest = cut(split.marked(nodes.select("id").where("id is not null").distinct()))
    own = rest.where("ahead and behind and alone").select("id")
    return own.unionByName(root_members(rest.where("not ahead").select("id"), split.without(AHEAD), max_edges, pivots - 1, max_nodes, task_edges))


def _deepest(g: Adjacency, roots: np.ndarray) -> np.ndarray:
    """Most hops from any of the roots (positions) to each node of an acyclic graph; -1 where they do not lead."""
    seen = np.full(len(g.ids), -1, np.int32)
    g.walk(roots, None, seen)
    at = np.flatnonzero(seen >= 0)
    into = np.bincount(g.targets(at), minlength=len(g.ids))
    depth = np.full(len(g.ids), -1, np.int32)
    layer, d = at[into[at] == 0], 0
    # a node is taken off with the last of its ways in, so it is met at its greatest depth
    while len(layer):
        depth[layer] = d
        hit, n = np.unique(g.targets(layer), return_counts=True)
        into[hit] -= n
        layer, d = hit[into[hit] == 0], d + 1
    if (depth[at] < 0).any():
        raise ValueError("the graph is not acyclic")
    return depth


def longest_depths(roots: DataFrame, dag: DataFrame, max_rounds: int = 100_000, max_edges: int = MAX_EDGES) -> DataFrame:
    """(comp, depth): most hops from any root (comp) over an acyclic (src_comp, dst_comp); unreached ones are absent."""
    roots = roots.select("comp").where("comp is not null").distinct()
    e = simple_edges(dag.select(F.col("src_comp").alias("src_id"), F.col("dst_comp").alias("dst_id")))
    shared = bounded(e, max_edges)
    starts = bounded(roots.select(F.col("comp").alias("src_id"), F.col("comp").alias("dst_id")), max_edges) if shared is not None else None
    if starts is not None:

        def work(src: np.ndarray, dst: np.ndarray) -> pd.DataFrame:
            g = Adjacency(src, dst)
            known, alone = g.index(starts.value[0])
            depth = _deepest(g, known)
            at = np.flatnonzero(depth >= 0)
            return pd.DataFrame({"comp": np.concatenate([g.ids[at], alone]), "depth": np.concatenate([depth[at], np.zeros(len(alone), np.int32)])})

        return _one_task(shared, work, "comp long, depth int", roots.sparkSession)
    e = cut(e)
    rows = e.count()
    front = cut(roots.select("comp", F.lit(0).alias("depth")))
    best = front
    for hop in range(1, max_rounds):
        step = skew_join(e, front.select(F.col("comp").alias("src_id")), "src_id", ["dst_id"], rows=rows)
        front = cut(step.select(F.col("dst_id").alias("comp"), F.lit(hop).alias("depth")).distinct())
        if front.isEmpty():
            return best
        best = cut(best.join(front.select("comp"), "comp", "left_anti").unionByName(front))
    raise ValueError("the graph is not acyclic")


def main_spine(entry: DataFrame, nodes: DataFrame, edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(id, layer, in_cycle): the longest chain of components that entry (id) leads to, members expanded.

    Ties take the smallest component; an entry that is not among nodes gives no rows. The chain is found
    by doubling: with jumps of 1, 2, 4, ... steps back, every round doubles the part that is known.
    """
    inner = simple_edges(induced(edges.select("src_id", "dst_id"), nodes))
    entry = entry.select("id").distinct().join(nodes.select("id").distinct(), "id", "left_semi")
    shared = bounded(inner, max_edges)
    starts = bounded(entry.select(F.col("id").alias("src_id"), F.col("id").alias("dst_id")), max_edges) if shared is not None else None
    if starts is not None:
        return _one_task(shared, lambda src, dst: _spine_in_task(starts.value[0], src, dst), "id long, layer int, in_cycle boolean", nodes.sparkSession)
    inner = cut(inner)
    flags = cut(in_cycle(nodes, inner, max_edges))
    dag = cut(condensed(flags, inner))
    roots = flags.join(entry, "id", "left_semi").select("comp").distinct()
    depths = cut(longest_depths(roots, dag, max_edges=max_edges))
    # of the ways in from one level above, the smallest component
    above = depths.select(F.col("comp").alias("src_comp"), (F.col("depth") + 1).alias("next"))
    here = depths.select(F.col("comp").alias("dst_comp"), "depth")
    back = cut(dag.join(above, "src_comp").join(here, "dst_comp").where("next = depth").groupBy(F.col("dst_comp").alias("comp")).agg(F.min("src_comp").alias("before")))
    chain = cut(depths.orderBy(F.desc("depth"), "comp").limit(1))
    steps, longest = 1, chain.agg(F.max("depth")).first()[0] or 0
    while steps <= longest:
        further = chain.select("comp").join(back, "comp").select(F.col("before").alias("comp"))
        chain = cut(chain.unionByName(depths.join(further, "comp", "left_semi")).distinct())
        back = cut(back.join(back.select(F.col("comp").alias("before"), F.col("before").alias("far")), "before").select("comp", F.col("far").alias("before")))
        steps *= 2
    return flags.join(chain.select("comp", F.col("depth").alias("layer")), "comp").select("id", "layer", "in_cycle")


def _spine_in_task(entry: np.ndarray, src: np.ndarray, dst: np.ndarray) -> pd.DataFrame:
    g = Adjacency(np.concatenate([src, entry]), np.concatenate([dst, entry]))  # entries are nodes, also without an edge
    comp = np.array(tarjan(range(len(g.ids)), g.neighbours()), np.int64)
    a, b = comp[np.searchsorted(g.ids, src)], comp[np.searchsorted(g.ids, dst)]
    loops = np.zeros(len(g.ids), bool)
    loops[np.searchsorted(g.ids, src[src == dst])] = True
    own = comp[np.searchsorted(g.ids, entry)]
    over = a != b
    pairs = np.unique(np.stack([np.concatenate([a[over], own]), np.concatenate([b[over], np.full(len(own), -1)])], 1), axis=0)
    real = pairs[pairs[:, 1] >= 0]
    dag = Adjacency(real[:, 0], real[:, 1])
    known, alone = dag.index(np.unique(own))
    depth = _deepest(dag, known)
    at = {int(c): int(d) for c, d in zip(dag.ids, depth) if d >= 0} | {int(c): 0 for c in alone}
    if not at:
        return pd.DataFrame({"id": np.zeros(0, np.int64), "layer": np.zeros(0, np.int32), "in_cycle": np.zeros(0, bool)})
    back: dict[int, list[int]] = {}
    for x, y in real.tolist():
        back.setdefault(y, []).append(x)
    here = min(at, key=lambda c: (-at[c], c))
    chain = {here: at[here]}
    while at[here]:
        here = min(c for c in back[here] if at.get(c) == at[here] - 1)
        chain[here] = at[here]
    sizes = np.bincount(comp, minlength=len(g.ids))
    members = np.flatnonzero(np.isin(comp, list(chain)))
    return pd.DataFrame({"id": g.ids[members], "layer": np.array([chain[int(c)] for c in comp[members]], np.int32), "in_cycle": (sizes[comp[members]] > 1) | loops[members]})


def betweenness(nodes: DataFrame, edges: DataFrame, max_edges: int = MAX_EDGES, block: int = 4096) -> DataFrame:
    """(id, betweenness): directed, unweighted, not normalised, end points excluded.

    Sources are spread over tasks that hold the edges; their dependency sums are added up per node. A
    graph above max_edges goes level by level through joins, in blocks of sources, so that the (source,
    node) pairs of one block exist at a time.
    """
    ids = nodes.select("id").where("id is not null").distinct()
    e = _among(edges, ids)
    shared = bounded(e, max_edges)
    if shared is None:
        e = cut(e)
        sources = cut(e.select(F.col("src_id").alias("id")).distinct())
        blocks = max(1, -(-sources.count() // block))
        parts = [cut(_betweenness_by_joins(sources.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k), e)) for k in range(blocks)]
        partial = reduce(DataFrame.unionByName, parts)
    else:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g = Adjacency(*shared.value)
            out = g.neighbours()
            total = np.zeros(len(g.ids))
            for pdf in frames:
                for s in g.index(pdf["id"].to_numpy(np.int64))[0].tolist():
                    dist, paths, order, before = {s: 0}, {s: 1.0}, [s], {}
                    for v in order:
                        far = dist[v] + 1
                        for w in out[v]:
                            d = dist.get(w)
                            if d is None:
                                d = dist[w] = far
                                order.append(w)
                                paths[w], before[w] = 0.0, []
                            if d == far:
                                paths[w] += paths[v]
                                before[w].append(v)
                    share = dict.fromkeys(order, 0.0)
                    for w in reversed(order[1:]):
                        part = (1 + share[w]) / paths[w]
                        for v in before[w]:
                            share[v] += paths[v] * part
                        total[w] += share[w]
            at = np.flatnonzero(total)
            yield pd.DataFrame({"id": g.ids[at], "score": total[at]})

        tasks = 4 * ids.sparkSession.sparkContext.defaultParallelism
        partial = ids.repartition(tasks, "id").mapInPandas(run, "id long, score double")
    summed = partial.groupBy("id").agg(F.sum("score").alias("betweenness"))
    return ids.join(summed, "id", "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _betweenness_by_joins(sources: DataFrame, e: DataFrame) -> DataFrame:
    """(id, score) of paths from sources (id) over e."""
    rows = e.count()
    layers = [cut(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")))]
    seen = layers[0].select("s", "v")
    while True:
        step = skew_join(e, layers[-1].withColumnRenamed("v", "src_id"), "src_id", ["dst_id"], rows=rows).groupBy("s", F.col("dst_id").alias("v")).agg(F.sum("paths").alias("paths"))
        nxt = cut(step.join(seen, ["s", "v"], "left_anti"))
        if nxt.isEmpty():
            break
        layers.append(nxt)
        seen = cut(seen.unionByName(nxt.select("s", "v")))
    share, total = None, None
    for k in range(len(layers) - 1, 0, -1):  # from the farthest layer back
        far = layers[k]
        far = far.withColumn("share", F.lit(0.0)) if share is None else far.join(share, ["s", "v"], "left").select("s", "v", "paths", F.coalesce("share", F.lit(0.0)).alias("share"))
        part = far.select("v", "share")
        total = part if total is None else total.unionByName(part)
        w = far.select(F.col("s").alias("s2"), F.col("v").alias("w"), F.col("paths").alias("pw"), "share")
        near = skew_join(e, layers[k - 1].withColumnRenamed("v", "src_id"), "src_id", ["dst_id"], rows=rows).join(w, (F.col("dst_id") == F.col("w")) & (F.col("s") == F.col("s2")))
        share = cut(near.groupBy("s", F.col("src_id").alias("v")).agg(F.sum(F.col("paths") / F.col("pw") * (1 + F.col("share"))).alias("share")))
    if total is None:
        return sources.select("id", F.lit(0.0).alias("score")).limit(0)
    return total.select(F.col("v").alias("id"), F.col("share").alias("score"))


def dominated_counts(roots: DataFrame, nodes: DataFrame, edges: DataFrame, max_edges: int = MAX_EDGES, among: bool = False) -> DataFrame:
    """(id, dominates): size of each node's dominator subtree less itself, under a virtual root above roots (id).

    Unreached nodes have 0. Up to max_edges edges one task climbs the dominator tree; up to TASK_FACTOR times as many, with the roots, one
    finds it by semidominators; beyond, dominator sets are held as (node, dominator) pairs and intersected over the ways in until nothing
    changes. among: edges are known to be distinct ones among nodes.
    """
    ids = nodes.select("id").where("id is not null").distinct()
    roots = cut(roots.select("id").distinct().join(ids, "id", "left_semi"))
    e = cut(edges.select("src_id", "dst_id").where("src_id <> dst_id") if among else _among(edges, ids))
    rows = e.count()
    shared = bounded(e, max_edges) if rows <= max_edges else None
    if shared is None and 0 < rows + roots.count() <= TASK_FACTOR * max_edges:
        top = roots.select(F.col("id").alias("src_id"), F.col("id").alias("dst_id"))
        counted = in_one_task(e.unionByName(top), _dominated_positions, "id long, dominates long")
    elif shared is None:
        counted = _dominated_by_joins(roots, e)
    else:
        # the virtual root's edges are bounded like the others
        top = bounded(roots.select(F.lit(0).cast("long").alias("src_id"), F.col("id").alias("dst_id")), max_edges)
        if top is None:
            counted = _dominated_by_joins(roots, e)
        else:
            counted = _one_task(shared, lambda src, dst: _dominated_in_task(top.value[1], src, dst), "id long, dominates long", ids.sparkSession)
    return ids.join(counted, "id", "left").select("id", F.coalesce("dominates", F.lit(0).cast("long")).alias("dominates"))


def _dominated_in_task(starts: np.ndarray, src: np.ndarray, dst: np.ndarray) -> pd.DataFrame:
    ids = np.unique(np.concatenate([starts, src, dst]))
    root = len(ids)
    out: list[list[int]] = [[] for _ in range(root + 1)]
    for a, b in zip(np.searchsorted(ids, src).tolist(), np.searchsorted(ids, dst).tolist()):
        out[a].append(b)
    out[root] = np.searchsorted(ids, np.sort(starts)).tolist()
    order: list[int] = []
    seen = [False] * (root + 1)
    seen[root] = True
    work = [(root, iter(out[root]))]
    while work:
        v, it = work[-1]
        for w in it:
            if not seen[w]:
                seen[w] = True
                work.append((w, iter(out[w])))
                break
        else:
            work.pop()
            order.append(v)
    rank = [-1] * (root + 1)
    for i, v in enumerate(order):
        rank[v] = i
    into: list[list[int]] = [[] for _ in range(root + 1)]
    for v in order:
        for w in out[v]:
            into[w].append(v)
    idom = [-1] * (root + 1)
    idom[root] = root
    changed = True
    while changed:
        changed = False
        for v in reversed(order[:-1]):
            new = -1
            for p in into[v]:
                if idom[p] < 0:
                    continue
                if new < 0:
                    new = p
                    continue
                a, b = p, new
                while a != b:
                    while rank[a] < rank[b]:
                        a = idom[a]
                    while rank[b] < rank[a]:
                        b = idom[b]
                new = a
            if idom[v] != new:
                idom[v], changed = new, True
    size = [0] * (root + 1)
    for v in order[:-1]:  # children finish before their dominators
        size[idom[v]] += size[v] + 1
    got = [(ids[v], size[v]) for v in range(root) if size[v]]
    return pd.DataFrame(got, columns=["id", "dominates"], dtype="int64")


def _dominated_positions(ids: np.ndarray, a: np.ndarray, b: np.ndarray):
    """(id, dominates) where edges from a node to itself name the roots; by semidominators (Semi-NCA), in arrays of 4 bytes a node or edge."""
    n = len(ids)
    roots = a[a == b]
    g = Adjacency.of(ids, np.concatenate([a[a != b], np.full(len(roots), n, np.int32)]), np.concatenate([b[a != b], roots]))
    g.at = np.append(g.at, len(g.to)) if len(g.at) == n + 1 else g.at
    # preorder of a depth-first search; from here on nodes are named by it, 0 being the virtual root
    pre, parent, vertex = array("i", [-1]) * (n + 1), array("i", [0]), array("i", [n])
    to, at, end = array("i", g.to.tobytes()), array("q", g.at[:-1].astype(np.int64).tobytes()), g.at[1:]
    pre[n] = 0
    stack = [n]
    while stack:
        v = stack[-1]
        i, stop = at[v], int(end[v])
        while i < stop and pre[to[i]] >= 0:
            i += 1
        if i == stop:
            at[v] = i
            stack.pop()
            continue
        w = to[i]
        at[v] = i + 1
        pre[w] = len(vertex)
        parent.append(pre[v])
        vertex.append(w)
        stack.append(w)
    size = len(vertex)
    number = np.frombuffer(pre, np.int32)
    x, y = number[np.repeat(np.arange(n + 1, dtype=np.int32), np.diff(g.at))], number[g.to]
    x, y = x[x >= 0], y[x >= 0]
    # of the ways in from earlier nodes the least counts; those from later ones need the best on their path
    first = np.arange(size, dtype=np.int32)
    early = x < y
    order = np.lexsort((x[early], y[early]))
    ys, xs = y[early][order], x[early][order]
    starts = np.flatnonzero(np.r_[True, ys[1:] != ys[:-1]]) if len(ys) else np.zeros(0, np.int64)
    first[ys[starts]] = xs[starts]
    late = Adjacency.of(first, y[~early], x[~early])
    semi, best, up = array("i", first.tobytes()), array("i", range(size)), array("i", parent)
    into, ways = array("i", late.to.tobytes()), array("q", late.at.tobytes())
    for w in range(size - 1, 0, -1):
        least = semi[w]
        for i in range(ways[w], ways[w + 1]):
            u = v = into[i]
            path = []
            while up[v] > w:
                path.append(v)
                v = up[v]
            if path:
                for v in reversed(path):
                    p = up[v]
                    if best[p] < best[v]:
                        best[v] = best[p]
                    up[v] = up[p]
            if best[u] < least:
                least = best[u]
        semi[w] = best[w] = least
    above = parent
    for w in range(1, size):
        v, least = above[w], semi[w]
        while v > least:
            v = above[v]
        above[w] = v
    count = [0] * size
    for w in range(size - 1, 0, -1):
        count[above[w]] += count[w] + 1
    counts = np.array(count[1:], np.int64)
    own = np.flatnonzero(counts)
    yield from in_slices({"id": ids[np.frombuffer(vertex, np.int32)[1:][own]], "dominates": counts[own]})


def _dominated_by_joins(roots: DataFrame, e: DataFrame) -> DataFrame:
    """(id, dominates). A root has no dominator but itself; what has not been reached yet does not narrow a set."""
    dom = cut(roots.select("id", F.col("id").alias("dom")))
    inner = cut(e.join(roots.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti").select("src_id", "dst_id"))  # ways into roots change nothing
    rows = inner.count()
    while True:
        ways = skew_join(inner, dom.select("id").distinct().withColumnRenamed("id", "src_id"), "src_id", ["dst_id"], "left_semi", rows=rows)
        n = ways.groupBy("dst_id").agg(F.count(F.lit(1)).alias("ways"))
        over = skew_join(inner, dom.withColumnRenamed("id", "src_id"), "src_id", ["dst_id"], rows=rows).groupBy("dst_id", "dom").agg(F.count(F.lit(1)).alias("n"))
        shared = over.join(n, "dst_id").where("n = ways").select(F.col("dst_id").alias("id"), "dom")
        own = n.select(F.col("dst_id").alias("id"), F.col("dst_id").alias("dom"))
        nxt = cut(roots.select("id", F.col("id").alias("dom")).unionByName(shared).unionByName(own).distinct())
        if nxt.join(dom, ["id", "dom"], "left_anti").isEmpty() and dom.join(nxt, ["id", "dom"], "left_anti").isEmpty():
            break
        dom = nxt
    return dom.where("id <> dom").groupBy(F.col("dom").alias("id")).agg(F.count(F.lit(1)).alias("dominates"))
