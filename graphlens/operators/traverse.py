"""Breadth-first work on the graph.

Every traversal runs for many starts at once, as (origin, node) pairs, so a ranking over many
candidates needs one loop. Up to max_edges edges (16 bytes each) are sent to the tasks as two arrays, and
every task walks its share of the origins; more are written once to the shared folder and walked by joins, hop by hop, with an anti-join against what was visited and every hop
written to the shared checkpoint folder. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.operators.heavy_keys import skew_join
from graphlens.operators.pivots import AHEAD, BEHIND, MAX_NODES, TASK_FACTOR, Split, distinct, find_pivots, in_one_task, in_slices
from graphlens.session import cut

MAX_EDGES = 2_000_000
FOLD = 4  # hops after which what was visited is written together


class Adjacency:
    """Directed edges of a bounded graph as arrays: targets of a node lie next to each other."""

    def __init__(self, src: np.ndarray, dst: np.ndarray):
        self.ids = np.unique(np.concatenate([src, dst]))
        a, b = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        self._fill(a, b)

    def _fill(self, a: np.ndarray, b: np.ndarray) -> None:
        order = np.argsort(a, kind="stable")
        self.to = b[order].astype(np.int32)
        self.at = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(self.ids)))]).astype(np.int64)

    @classmethod
    def of(cls, ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> Adjacency:
        """Of edges that are known by their positions in ids."""
        g = cls.__new__(cls)
        g.ids = ids
        g._fill(a, b)
        return g

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, v: int) -> list[int]:
        return self.to[self.at[v]:self.at[v + 1]].tolist()

    def index(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the nodes that have an edge, the other nodes)."""
        i = np.searchsorted(self.ids, nodes)
        known = (i < len(self.ids)) & (self.ids[np.minimum(i, max(len(self.ids) - 1, 0))] == nodes) if len(self.ids) else np.zeros(len(nodes), bool)
        return i[known], nodes[~known]

    def targets(self, nodes: np.ndarray) -> np.ndarray:
        """Targets of all nodes (positions), with repetitions."""
        sizes = self.at[nodes + 1] - self.at[nodes]
        if not sizes.sum():
            return np.zeros(0, np.int32)
        ends = np.cumsum(sizes)
        return self.to[np.arange(ends[-1]) - np.repeat(ends - sizes - self.at[nodes], sizes)]

    def neighbours(self) -> list[list[int]]:
        return [self.to[a:b].tolist() for a, b in zip(self.at[:-1], self.at[1:])]

    def walk(self, nodes: np.ndarray, max_hops: int | None, dist: np.ndarray) -> np.ndarray:
        """Positions reached from nodes (positions), nearest first; dist, -1 everywhere, gets their hops."""
        layer = np.unique(nodes)
        dist[layer] = 0
        seen, d = [layer], 0
        while len(layer) and (max_hops is None or d < max_hops):
            d += 1
            nxt = self.targets(layer)
            layer = distinct(nxt[dist[nxt] < 0])
            dist[layer] = d
            seen.append(layer)
        return np.concatenate(seen)


def bounded(edges: DataFrame, max_edges: int = MAX_EDGES):
    """Broadcast (src, dst) arrays if there are at most max_edges edges, else None; no more than one edge beyond the bound is fetched."""
    if max_edges <= 0:
        return None
    t = edges.select(F.col("src_id").cast("long"), F.col("dst_id").cast("long")).limit(max_edges + 1).toArrow()
    if t.num_rows > max_edges:
        return None
    return edges.sparkSession.sparkContext.broadcast(tuple(t.column(i).to_numpy() for i in (0, 1)))


def simple_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src_id, dst_id) without nulls."""
    return edges.select("src_id", "dst_id").where("src_id is not null and dst_id is not null").distinct()


def bfs(starts: DataFrame, edges: DataFrame, max_hops: int | None = None, max_edges: int = MAX_EDGES) -> DataFrame:
    """(origin, node, dist) over edges (src_id, dst_id) from starts (origin, node); starts at distance 0."""
    starts = starts.select("origin", "node").where("node is not null").distinct()
    e = simple_edges(edges)
    shared = bounded(e, max_edges)
    if shared is not None:

        def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            graph = Adjacency(*shared.value)
            dist = np.full(len(graph.ids), -1, np.int32)
            for pdf in frames:
                for origin, nodes in pdf.groupby("origin", dropna=False)["nodes"]:
                    known, other = graph.index(np.unique(np.concatenate([np.asarray(x, np.int64) for x in nodes])))
                    seen = graph.walk(known, max_hops, dist)
                    yield pd.DataFrame({"origin": origin, "node": np.concatenate([graph.ids[seen], other]), "dist": np.concatenate([dist[seen], np.zeros(len(other), np.int32)])})
                    dist[seen] = -1

        kind = starts.schema["origin"].dataType.simpleString()
        grouped = starts.groupBy("origin").agg(F.collect_set("node").alias("nodes"))  # an origin's own starts, not its reach
        return grouped.mapInPandas(walk, f"origin {kind}, node long, dist int")
    e = cut(e)
    rows = e.count()
    frontier = cut(starts.withColumn("dist", F.lit(0)))
    parts, hop = [frontier], 0
    while (max_hops is None or hop < max_hops) and not frontier.isEmpty():
        hop += 1
        step = skew_join(e, frontier.select("origin", F.col("node").alias("src_id")), "src_id", ["dst_id"], rows=rows).select("origin", F.col("dst_id").alias("node")).distinct()
        visited = reduce(DataFrame.unionByName, parts)
        frontier = cut(step.join(visited.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("dist", F.lit(hop)))
        parts.append(frontier)
        if len(parts) > FOLD:
            parts = [cut(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts)


def reversed_(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src_id", "dst_id").unionByName(reversed_(edges))


def _from(starts: DataFrame) -> DataFrame:
    return starts.select(F.lit(0).alias("origin"), F.col("id").alias("node"))


def trace_calls(starts: DataFrame, edges: DataFrame, direction: str = "both", depth: int = 3, max_edges: int = MAX_EDGES) -> DataFrame:
    """(id, depth, direction) from starts (id) over calls; the starts themselves once, as 'self' at depth 0."""
    if direction not in ("both", "outbound", "inbound"):
        raise ValueError(f"bad direction: {direction}")
    if depth < 0:
        raise ValueError("depth must not be negative")
    calls = cut(simple_edges(edges.where("kind = 'calls'")))
    out = starts.select("id", F.lit(0).alias("depth"), F.lit("self").alias("direction")).distinct()
    for name, e in (("outbound", calls), ("inbound", reversed_(calls))):
        if direction in ("both", name):
            hits = bfs(_from(starts), e, depth, max_edges).where("dist > 0")
            out = out.unionByName(hits.select(F.col("node").alias("id"), F.col("dist").alias("depth"), F.lit(name).alias("direction")))
    return out


def blast_radius(starts: DataFrame, edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(id, distance, via): everything that reaches starts over calls, imports and inherits; via is the smallest kind of a first hop."""
    e = cut(edges.where("kind in ('calls', 'imports', 'inherits')").select("src_id", "dst_id", "kind"))
    hit = cut(bfs(_from(starts), reversed_(e), None, max_edges).select(F.col("node").alias("id"), F.col("dist").alias("distance")))
    near = hit.select(F.col("id").alias("dst_id"), (F.col("distance") + 1).alias("next_distance"))
    first = skew_join(e, near, "dst_id", ["src_id", "kind"], rows=e.count()).groupBy(F.col("src_id").alias("id"), "next_distance").agg(F.min("kind").alias("via"))
    return hit.where("distance > 0").join(first, "id").where("next_distance = distance").select("id", "distance", "via")


def neighborhood(centres: DataFrame, edges: DataFrame, depth: int = 1, max_edges: int = MAX_EDGES) -> DataFrame:
    """(id, dist) around centres, edge directions ignored; a negative depth counts as 0."""
    e = edges.where("kind in ('calls', 'imports', 'inherits')")
    return bfs(_from(centres), both_ways(e), max(depth, 0), max_edges).select(F.col("node").alias("id"), "dist")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (id); an end that many edges share is split over tasks."""
    e, n = cut(edges), nodes.select("id").distinct()
    rows = e.count()
    for side in ("src_id", "dst_id"):
        e = skew_join(e, n.withColumnRenamed("id", side), side, ["src_id", "dst_id"], "left_semi", rows=rows)
    return e.select(*edges.columns)


def flow_layers(entry: DataFrame, edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(id, layer): outbound calls from entry, by distance."""
    return bfs(_from(entry), edges.where("kind = 'calls'"), None, max_edges).select(F.col("node").alias("id"), F.col("dist").alias("layer"))


def data_flow_layers(entry: DataFrame, dataflow: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    return bfs(_from(entry), dataflow, None, max_edges).select(F.col("node").alias("id"), F.col("dist").alias("layer"))


def exec_path(tests: DataFrame, edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(test_id, id, layer) per test (id): what it covers, laid out from what no covered symbol calls.

    Where every covered symbol is called by another, all are roots; symbols no root reaches get layer 0.
    """
    covered = edges.where("kind = 'test_covers'").join(tests.select(F.col("id").alias("src_id")).distinct(), "src_id", "left_semi").select(F.col("src_id").alias("test_id"), F.col("dst_id").alias("id")).distinct()
    # nodes of different tests are kept apart by numbering the (test, symbol) pairs
    numbered = cut(covered.withColumn("node", F.monotonically_increasing_id()))
    calls = cut(simple_edges(edges.where("kind = 'calls'")))
    a = numbered.select(F.col("id").alias("src_id"), "test_id", F.col("node").alias("a"))
    b = numbered.select(F.col("id").alias("dst_id"), F.col("test_id").alias("t2"), F.col("node").alias("b"))
    inner = cut(skew_join(skew_join(calls, a, "src_id", ["dst_id"], rows=calls.count()), b, "dst_id", ["src_id", "test_id"]).where("test_id = t2").select("test_id", F.col("a").alias("src_id"), F.col("b").alias("dst_id")).distinct())
    called = inner.where("src_id <> dst_id").select(F.col("dst_id").alias("node")).distinct()
    roots = numbered.join(called, "node", "left_anti").select("test_id", "node")
    rootless = numbered.join(roots.select("test_id").distinct(), "test_id", "left_anti").select("test_id", "node")
    walked = bfs(cut(roots.unionByName(rootless)).select(F.col("test_id").alias("origin"), "node"), inner, None, max_edges)
    return numbered.join(walked.select("node", "dist"), "node", "left").groupBy("test_id", "id").agg(F.coalesce(F.min("dist"), F.lit(0)).alias("layer"))


PAIRS = 2_000_000  # (source, node) pairs that a block of sources holds before they are walked one by one
TRIES = 6  # pivots looked at before sources are walked


def _counts_one_by_one(g: Adjacency, live: np.ndarray, sources: np.ndarray) -> np.ndarray:
    dist = np.where(live, np.int32(-1), np.int32(0))
    n = np.zeros(len(sources), np.int64)
    for i, v in enumerate(sources):
        seen = g.walk(np.array([v]), None, dist)
        dist[seen] = -1
        n[i] = len(seen)
    return n


def _counts_together(g: Adjacency, live: np.ndarray, sources: np.ndarray, block: int = 4096) -> np.ndarray:
    """Live nodes that each source reaches over live ones, itself included; a block of sources is walked at once."""
    size, parts = len(g.ids), []
    for i in range(0, len(sources), block):
        own = sources[i:i + block].astype(np.int64)
        seen = front = np.arange(len(own)) * size + own
        while len(front) and len(seen) <= PAIRS:
            k, v = np.divmod(front, size)
            to = g.targets(v)
            k = np.repeat(k, g.at[v + 1] - g.at[v])
            front = np.unique((k * size + to)[live[to]])
            front = front[seen[np.minimum(np.searchsorted(seen, front), len(seen) - 1)] != front]
            seen = np.sort(np.concatenate([seen, front]), kind="stable")
        parts.append(_counts_one_by_one(g, live, own) if len(front) else np.bincount(seen // size, minlength=len(own)))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def reach_counts(g: Adjacency, sources: np.ndarray) -> np.ndarray:
    """How many nodes each source (position) reaches, itself included.

    A pivot splits the sources: what reaches it also reaches all that the pivot reaches, which is counted
    once and taken out of their graph; the others never meet what reaches the pivot, which is taken out of
    theirs. Both halves are split again while that saves more steps than it takes.
    """
    tails = np.repeat(np.arange(len(g.ids)), np.diff(g.at))
    back = Adjacency.__new__(Adjacency)
    order = np.argsort(g.to, kind="stable")
    into = np.bincount(g.to, minlength=len(g.ids))
    back.ids, back.to, back.at = g.ids, tails[order].astype(np.int32), np.concatenate([[0], np.cumsum(into)]).astype(np.int64)
    central = np.minimum(into, np.diff(g.at)) + into / (into + 1.0)
    counts = np.zeros(len(sources), np.int64)
    work = [(np.ones(len(g.ids), bool), np.arange(len(sources)), 0)]
    while work:
        live, at, base = work.pop()
        if not len(at):
            continue
        own, best, tries = sources[at], None, np.where(live, central, -1)
        for _ in range(TRIES):
            pivot = np.array([np.argmax(tries)])
            tries[pivot] = -1
            ahead, behind = (np.zeros(len(live), bool) for _ in range(2))
            ahead[g.walk(pivot, None, np.where(live, np.int32(-1), np.int32(0)))] = True
            behind[back.walk(pivot, None, np.where(live, np.int32(-1), np.int32(0)))] = True
            n = int(ahead.sum())
            if n * int(behind[own].sum()) > 4 * len(live):
                best = ahead, behind
                break
        if best is None:
            counts[at] = base + _counts_together(g, live, own)
            continue
        counts[at[behind[own] & ahead[own]]] = base + n
        work.append((live & ~ahead, at[behind[own] & ~ahead[own]], base + n))
        work.append((live & ~behind, at[~behind[own]], base))
    return counts


def pivot_sets(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) that the most central node of e leads to, and those that lead to it, by joins."""
    ways = lambda c: e.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias(c))
    top = cut(ways("src_id").join(ways("dst_id"), "id").orderBy(F.desc(F.least("src_id", "dst_id")), F.desc(F.greatest("src_id", "dst_id")), "id").limit(1).select("id"))
    ahead, behind = (cut(bfs(_from(top), x, None, 0).select(F.col("node").alias("id"))) for x in (e, reversed_(e)))
    return ahead, behind


def outside(edges: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """Edges with no end among nodes (id)."""
    for side in ("src_id", "dst_id"):
        edges = skew_join(edges, nodes.withColumnRenamed("id", side), side, ["src_id", "dst_id"], "left_anti", rows=rows)
    return cut(edges.select("src_id", "dst_id"))


def _counts_in_task(ids: np.ndarray, a: np.ndarray, b: np.ndarray):
    own = a[a == b]
    yield from in_slices({"id": ids[own], "reach": reach_counts(Adjacency.of(ids, a[a != b], b[a != b]), own) - 1})


def reach_sizes(candidates: DataFrame, edges: DataFrame, max_edges: int = MAX_EDGES, block: int = 4096, pivots: int = 2, max_nodes: int = MAX_NODES,
                task_edges: int | None = None) -> DataFrame:
    """(id, reach): how many other symbols each candidate (id) reaches over calls.

    Up to max_edges edges every task counts what its candidates reach, and only the counts leave it.
    Beyond, candidates and edges are split around pivots as in reach_counts, up to pivots times one below the other: up to task_edges
    (TASK_FACTOR times max_edges) in one task, in arrays over up to max_nodes nodes of more (see pivots), by joins over more; halves that
    are still too large are counted in one task up to task_edges, of more walked by joins in blocks, so that the (origin, node) pairs of one
    block exist at a time.
    """
    task_edges = TASK_FACTOR * max_edges if task_edges is None else task_edges
    c = candidates.select("id").where("id is not null").distinct()
    e = cut(simple_edges(edges.where("kind = 'calls'") if "kind" in edges.columns else edges))
    rows = e.count()
    shared = bounded(e, max_edges) if rows <= max_edges else None
    if shared is not None:

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids = [pdf["id"].to_numpy(np.int64) for pdf in frames]
            if ids:
                graph, ids = Adjacency(*shared.value), np.concatenate(ids)
                known, other = graph.index(ids)
                yield pd.DataFrame({"id": np.concatenate([graph.ids[known], other]), "reach": np.concatenate([reach_counts(graph, known) - 1, np.zeros(len(other), np.int64)])})

        tasks = 2 * c.sparkSession.sparkContext.defaultParallelism
        return c.repartition(tasks, "id").mapInPandas(count, "id long, reach long")
    c = cut(c)
    one_task = 0 < rows <= task_edges
    if one_task and not pivots:
        own = c.select(F.col("id").alias("src_id"), F.col("id").alias("dst_id"))
        return in_one_task(e.where("src_id <> dst_id").unionByName(own), _counts_in_task, "id long, reach long")
    split = Split(e) if one_task else find_pivots(e, max_nodes) if pivots else None
    if split is not None:
        m = cut(split.marked(c))
        over, aside = m.where("behind and not ahead"), m.where("not behind")
        inside = m.where("behind and ahead").select("id", (F.col("n") - 1).alias("reach"))
        far = reach_sizes(over, split.without(AHEAD), max_edges, block, pivots - 1, max_nodes, task_edges).join(over.select("id", "n"), "id")
        return inside.unionByName(far.select("id", (F.col("reach") + F.col("n")).alias("reach"))).unionByName(reach_sizes(aside, split.without(BEHIND), max_edges, block, pivots - 1, max_nodes, task_edges))
    if pivots and rows:
        ahead, behind = pivot_sets(e)
        n = ahead.count()
        if n:
            above, aside = cut(c.join(behind, "id", "left_semi")), c.join(behind, "id", "left_anti")
            inside = above.join(ahead, "id", "left_semi").select("id", F.lit(n - 1).cast("long").alias("reach"))
            over = reach_sizes(above.join(ahead, "id", "left_anti"), outside(e, ahead, rows), max_edges, block, pivots - 1, max_nodes, task_edges)
            return inside.unionByName(over.select("id", (F.col("reach") + n).alias("reach"))).unionByName(reach_sizes(aside, outside(e, behind, rows), max_edges, block, pivots - 1, max_nodes, task_edges))
    parts = []
    blocks = max(1, -(-c.count() // block))
    for k in range(blocks):
        own = c.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)
        pairs = bfs(own.select(F.col("id").alias("origin"), F.col("id").alias("node")), e, None, 0)
        parts.append(cut(pairs.groupBy(F.col("origin").alias("id")).agg((F.count(F.lit(1)) - 1).alias("reach"))))
    return reduce(DataFrame.unionByName, parts)
