"""What pivots of a graph lead to and what leads to them, where the edges are too many for one task but the nodes are not.

The ids of the nodes go to the tasks as one sorted array (8 bytes each; up to max_nodes, counted first). Edges are numbered
once and written to the shared folder as blocks of positions. A round sends one byte per node; every task carries these along
its own edges until nothing moves and returns them compressed, so a round is one pass over the blocks, whatever the hops.

Every weakly connected part has a pivot of its own (parts that hold none of the SEEDS most central nodes have none), so that
tables of many unconnected graphs take no more rounds than one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.session import cut

MAX_NODES = 8_000_000
BLOCK = 1 << 18  # edges of a block
TASK_FACTOR = 6  # times max_edges that one task holds as arrays where a graph is worked on in a single task, without going through the driver
SEEDS = 255
NONE = 255  # label of the parts without a pivot
AHEAD, BEHIND = 1, 2


def _blocks(numbers: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the sources and targets of all edges in a task."""
    src, dst = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for batch in numbers:
        for out, column in ((src, "src"), (dst, "dst")):
            out += [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(column)]
    return np.concatenate(src), np.concatenate(dst)


def _lower_labels(state: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """state, both ends of every edge at the smallest label that meets them."""
    while True:
        x, y = state[a], state[b]
        up, down = x > y, x < y
        if not (up.any() or down.any()):
            return state
        # of several labels for one node any smaller one is written; a label only falls, so this ends
        state[b[down]] = x[down]
        up = state[a] > state[b]
        state[a[up]] = state[b[up]]


def _carry_marks(state: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """state, AHEAD carried along the edges and BEHIND against them."""
    ahead, behind = state & AHEAD > 0, state & BEHIND > 0
    for seen, x, y in ((ahead, a, b), (behind, b, a)):
        while len(at := np.flatnonzero(seen[x] & ~seen[y])):
            seen[y[at]] = True
    return ahead * np.uint8(AHEAD) | behind * np.uint8(BEHIND)


class Pivots:
    """Nodes (ids, sorted) with the label of their part and their marks: AHEAD of its pivot, BEHIND it; the pivot is both."""

    def __init__(self, ids: np.ndarray, seeds: np.ndarray, numbered: Callable[[object], DataFrame], spark):
        self.spark = spark
        self.shared = spark.sparkContext.broadcast(ids)
        self.ids, self.blocks = ids, numbered(self.shared)
        at = np.searchsorted(ids, seeds)
        labels = np.full(len(ids), NONE, np.uint8)
        labels[at] = np.arange(len(at), dtype=np.uint8)
        self.labels = self._settled(labels, _lower_labels, np.minimum)
        own = at[self.labels[at] == np.arange(len(at))]
        marks = np.zeros(len(ids), np.uint8)
        marks[own] = AHEAD | BEHIND
        self.marks = self._settled(marks, _carry_marks, np.bitwise_or)
        self.sent = spark.sparkContext.broadcast((self.labels, self.marks))

    def _settled(self, state: np.ndarray, step, merge) -> np.ndarray:
        while True:
            sent = self.spark.sparkContext.broadcast(state)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                old = sent.value
                new = step(old.copy(), *_blocks(batches))
                if (new != old).any():
                    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(new.tobytes(), 1)], pa.binary())], names=["state"])

            found = self.blocks.mapInArrow(run, "state binary").collect()
            sent.unpersist()
            if not found:
                return state
            for row in found:
                state = merge(state, np.frombuffer(zlib.decompress(row.state), np.uint8))

    def without(self, mark: int) -> DataFrame:
        """Edges (src_id, dst_id) neither end of which has the mark."""
        ids, sent = self.shared, self.sent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            free = sent.value[1] & mark == 0
            for batch in batches:
                a, b = _blocks([batch])
                keep = free[a] & free[b]
                yield pa.RecordBatch.from_arrays([pa.array(ids.value[a[keep]]), pa.array(ids.value[b[keep]])], names=["src_id", "dst_id"])

        return cut(self.blocks.mapInArrow(run, "src_id long, dst_id long"))

    def marked(self, nodes: DataFrame) -> DataFrame:
        """(id, ahead, behind, n, alone) of nodes (id): its marks; how many nodes the pivot of its part leads to, itself included; whether only
        nodes that the pivot leads to lead to it. A node without edges has no mark."""
        ids, sent = self.shared, self.sent
        n = np.bincount(self.labels[self.marks & AHEAD > 0], minlength=NONE + 1)
        alone = np.bincount(self.labels[self.marks == BEHIND], minlength=NONE + 1) == 0

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            labels, marks = sent.value
            for pdf in frames:
                own = pdf["id"].to_numpy(np.int64)
                at = np.minimum(np.searchsorted(ids.value, own), len(ids.value) - 1)
                mark, label = np.where(ids.value[at] == own, marks[at], 0), labels[at]
                yield pd.DataFrame({"id": own, "ahead": mark & AHEAD > 0, "behind": mark & BEHIND > 0, "n": n[label], "alone": alone[label]})

        return nodes.select(F.col("id").cast("long").alias("id")).mapInPandas(run, "id long, ahead boolean, behind boolean, n long, alone boolean")


def find_pivots(e: DataFrame, max_nodes: int = MAX_NODES) -> Pivots | None:
    """Pivots of the distinct edges e (src_id, dst_id), which are read twice; None if there are more than max_nodes nodes, or no edges."""
    ends = [e.select(F.col(c).cast("long").alias("id"), F.lit(int(c == "src_id")).cast("long").alias("o"), F.lit(int(c == "dst_id")).cast("long").alias("i")) for c in ("src_id", "dst_id")]
    nodes = cut(ends[0].unionByName(ends[1]).groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i")))
    n = nodes.count()
    if not n or n > max_nodes:
        return None
    ids = np.sort(nodes.select("id").toArrow().column(0).to_numpy())
    top = nodes.orderBy(F.desc(F.least("o", "i")), F.desc(F.greatest("o", "i")), "id").limit(SEEDS).select("id").toArrow().column(0).to_numpy()

    def numbered(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            rows = 0

            def block() -> pa.RecordBatch:
                both = np.concatenate(held, axis=1)
                return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in both], names=["src", "dst"])

            for batch in batches:
                held.append(np.stack([np.searchsorted(shared.value, batch.column(i).to_numpy()) for i in (0, 1)]).astype(np.int32))
                rows += batch.num_rows
                if rows >= BLOCK:
                    yield block()
                    held, rows = [], 0
            if rows:
                yield block()

        longs = e.select(F.col("src_id").cast("long").alias("src_id"), F.col("dst_id").cast("long").alias("dst_id"))
        return cut(longs.mapInArrow(run, "src binary, dst binary"))

    return Pivots(ids, top, numbered, e.sparkSession)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is faster here than the hashing of np.unique."""
    x = np.sort(x)
    return x[np.concatenate([x[:1] == x[:1], x[1:] != x[:-1]])]


def in_one_task(edges: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows of work(ids, a, b) in one task: the sorted ids of the ends of edges (src_id, dst_id; no nulls), positions of the sources and of the targets.

    Edges should be written before (see cut), as what they are made of runs in the same task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for batch in batches:
            for k in (0, 1):
                ends[k].append(batch.column(k).to_numpy())
        own, at = [], []
        while ends:
            column = np.concatenate(ends.pop(0))
            order = np.argsort(column)
            column = column[order]
            new = np.diff(column, prepend=column[:1] - 1) != 0
            place = np.empty(len(column), np.int32)
            place[order] = np.cumsum(new) - 1
            own.append(column[new]), at.append(place)
        ids = distinct(np.concatenate(own))
        yield from work(ids, *(np.searchsorted(ids, x).astype(np.int32)[k] for x, k in zip(own, at)))

    return edges.select(F.col("src_id").cast("long").alias("src_id"), F.col("dst_id").cast("long").alias("dst_id")).coalesce(1).mapInArrow(run, schema)


def in_slices(columns: dict[str, np.ndarray], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(next(iter(columns.values()))), rows):
        yield pa.RecordBatch.from_arrays([pa.array(x[i:i + rows]) for x in columns.values()], names=list(columns))


def weak_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each node 0..n-1 the smallest node of its weakly connected part."""
    label = np.arange(n, dtype=np.int32)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        # labels are roots here; each takes a smaller one of those it meets, so no circle forms
        label[np.maximum(x, y)] = np.minimum(x, y)
        while (label[label] != label).any():
            label = label[label]


class Split:
    """As Pivots, found in one task that holds all edges; every part has a pivot, the one with most ways both in and out."""

    def __init__(self, e: DataFrame):
        from graphlens.operators.traverse import Adjacency

        def work(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            n = len(ids)
            into, out = np.bincount(b, minlength=n), np.bincount(a, minlength=n)
            label = weak_labels(n, a, b)
            order = np.lexsort((-np.maximum(into, out), -np.minimum(into, out)))
            pivots = order[np.unique(label[order], return_index=True)[1]]
            mark = np.zeros(n, np.uint8)
            for bit, x, y in ((AHEAD, a, b), (BEHIND, b, a)):
                mark[Adjacency.of(ids, x, y).walk(pivots, None, np.full(n, -1, np.int32))] |= bit
            ahead = np.bincount(label[mark & AHEAD > 0], minlength=n)
            alone = np.bincount(label[mark == BEHIND], minlength=n) == 0
            nodes = {"kind": np.zeros(n, np.int8), "id": ids, "to": ids, "mark": mark.astype(np.int8), "n": ahead[label].astype(np.int64), "alone": alone[label]}
            yield from in_slices(nodes)
            for bit in (AHEAD, BEHIND):
                at = np.flatnonzero((mark[a] & bit == 0) & (mark[b] & bit == 0))
                yield from in_slices({"kind": np.full(len(at), bit, np.int8), "id": ids[a[at]], "to": ids[b[at]], "mark": np.zeros(len(at), np.int8), "n": np.zeros(len(at), np.int64), "alone": np.zeros(len(at), bool)})

        self.rows = cut(in_one_task(e, work, "kind byte, id long, to long, mark byte, n long, alone boolean"))

    def without(self, mark: int) -> DataFrame:
        return self.rows.where(F.col("kind") == mark).select(F.col("id").alias("src_id"), F.col("to").alias("dst_id"))

    def marked(self, nodes: DataFrame) -> DataFrame:
        known = self.rows.where("kind = 0").select("id", "mark", "n", "alone")
        mark = F.coalesce(F.col("mark"), F.lit(0).cast("byte"))
        return nodes.select(F.col("id").cast("long").alias("id")).join(known, "id", "left").select(
            "id", (mark.bitwiseAND(AHEAD) > 0).alias("ahead"), (mark.bitwiseAND(BEHIND) > 0).alias("behind"), "n", "alone")
