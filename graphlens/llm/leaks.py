"""Evaluation texts leaking into training text.

The test items are the stated query set: they are taken in blocks of at most block_words words, and of
each block a suffix automaton over folded words is built, items parted by words that no text holds.
Documents stream past it; at every word the automaton knows the longest run that ends there and also
stands in an item, so one pass finds runs of any length. A run of an item is reported where it cannot
go on in that item, also if it goes on in another; the items are looked at only there. Documents are
never shuffled; only their matches are.

Defined cases: null or empty texts and items match nothing; repeated item rows count once, a repeated
document row gives the same matches; items shorter than min_words cannot leak unless a coverage limit
is set; texts may be of any length. Columns other than id and text are kept only where stated.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.words import fold, word_spans, words
from graphlens.session import parallel

_BUILT: dict = {}
KEPT = 3


class SuffixAutomaton:
    """Of several word sequences; knows for each state from floor words on which sequences hold it."""

    def __init__(self, items: list[tuple[int, list[str]]], floor: int):
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.floor = floor
        self.size = {i: len(ws) for i, ws in items}
        ends: dict[int, set[int]] = {}
        last, parting = 0, -1
        for item, ws in items:
            for w in ws:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                ends.setdefault(last, set()).add(item)
            last = self._extend(last, parting)  # a word of its own: no run crosses it
            parting -= 1
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            p = self.link[v]
            if p > 0 and v in ends and self.length[p] >= floor:
                ends.setdefault(p, set()).update(ends[v])
        self.items = {v: tuple(sorted(s)) for v, s in ends.items() if self.length[v] >= floor}
        self.dropping: dict[tuple[int, int], bool] = {}  # at most one entry per transition

    def _extend(self, last: int, c: int) -> int:
        cur = self._state({}, self.length[last] + 1, -1)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p == -1:
            self.link[cur] = 0
            return cur
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            self.link[cur] = q
            return cur
        clone = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = self.link[cur] = clone
        return cur

    def _state(self, nxt: dict[int, int], length: int, link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def runs(self, ws: list[str]) -> Iterator[tuple[int, int, int | None, int]]:
        """(end, length, next word, state) wherever a match of at least floor words does not go on to the right in all items that hold it."""
        nxt, link, length, floor, get = self.next, self.link, self.length, self.floor, self.vocabulary.get
        v = n = 0
        for i, w in enumerate(ws):
            c = get(w)
            to = None if c is None else nxt[v].get(c)
            if n >= floor and (to is None or self._drops(v, c)):
                yield i, n, c, v
            if to is not None:
                v, n = to, n + 1
                continue
            if c is None:
                v = n = 0
                continue
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            to = nxt[v].get(c)
            v, n = (to, n + 1) if to is not None else (0, 0)
        if n >= floor:
            yield len(ws), n, None, v

    def _drops(self, v: int, c: int) -> bool:
        """Does a step by c leave an item behind that holds the match, or a tail of it of at least floor words?"""
        got = self.dropping.get((v, c))
        if got is None:
            s, got = v, False
            while not got and s > 0 and self.length[s] >= self.floor:
                # what holds the longer run holds the shorter one
                got = len(self.items.get(self.next[s].get(c), ())) < len(self.items.get(s, ()))
                s = self.link[s]
            self.dropping[v, c] = got
        return got

    def matches(self, ws: list[str], min_words: int, coverage: float | None) -> tuple[dict[int, list[int]], list[tuple[int, int]]]:
        """{item: [longest run, number of runs that cannot go on to the right in the item]}, spans (first, end) in words."""
        found: dict[int, list[int]] = {}
        spans = []
        for end, n, c, v in self.runs(ws):
            kept = 0
            longer: set[int] = set()  # items that hold a longer run ending here
            while v > 0 and self.length[v] >= self.floor:
                m = min(n, self.length[v])
                items = self.items.get(v, ())
                on = self.items.get(self.next[v].get(c), ()) if c is not None else ()
                for item in set(items).difference(longer, on):
                    if m >= min_words or coverage is not None and m >= coverage * self.size[item]:
                        f = found.setdefault(item, [0, 0])
                        f[0] = max(f[0], m)
                        f[1] += 1
                        kept = max(kept, m)
                longer.update(items)
                v = self.link[v]
            if kept:
                spans.append((end - kept, end))
        return found, spans


def _automaton(key: str, items: list, floor: int) -> SuffixAutomaton:
    """Built once per worker and block; a worker that turns from block to block keeps the last few."""
    if key not in _BUILT:
        while len(_BUILT) >= KEPT:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[key] = SuffixAutomaton(items, floor)
    return _BUILT[key]


def _blocks(items: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The stated items, streamed to the driver and cut into blocks of bounded size."""
    block, size = [], 0
    rows = items.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct()
    for r in rows.orderBy("i", "t").toLocalIterator():
        ws = words(r.t)
        if not ws:
            continue
        block.append((r.i, ws))
        size += len(ws)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _floor(min_words: int, coverage: float | None, least: int) -> int:
    return min_words if coverage is None else min(min_words, least)


def leaked_items(docs: DataFrame, items: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", min_words: int = 13, coverage: float | None = None, least_words: int = 8,
                 block_words: int = 200_000) -> DataFrame:
    """(doc_id, item_id, longest_run, n_runs): documents and the items that leaked into them.

    A run counts from min_words words on or, with coverage, where it makes up that share of the item
    and has least_words words at least.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[doc_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"doc {kind}, item {item_kind}, longest_run int, n_runs int"
    rows = parallel(docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).where("text is not null"))
    floor = _floor(min_words, coverage, least_words)
    out = None
    for block in _blocks(items, item_col, item_text_col, block_words):
        key = uuid.uuid4().hex
        sent = spark.sparkContext.broadcast(block)  # at most block_words words and one item

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            auto = _automaton(key, sent.value, floor)
            for batch in batches:
                ds, its, longest, n = [], [], [], []
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for item, (most, count) in auto.matches(words(t), min_words, coverage)[0].items():
                        ds.append(d), its.append(item), longest.append(most), n.append(count)
                if ds:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ds, batch.column(0).type), pa.array(its), pa.array(longest, pa.int32()), pa.array(n, pa.int32())],
                        names=["doc", "item", "longest_run", "n_runs"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.groupBy(F.col("doc").alias(doc_col), F.col("item").alias(item_col)).agg(
        F.max("longest_run").alias("longest_run"), F.max("n_runs").alias("n_runs"))


def remove_leaks(docs: DataFrame, items: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", min_words: int = 13, coverage: float | None = 0.8, least_words: int = 8,
                 block_words: int = 200_000) -> DataFrame:
    """(doc_id, text, n_removed): every text with the leaked spans cut out; other texts as they are.

    n_removed counts the words removed. Blocks of items are applied one after the other, without a
    shuffle. Null texts stay null.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_col].dataType.simpleString()
    schema = f"doc {kind}, text string, n_removed int"
    out = parallel(docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text"), F.lit(0).alias("n_removed")))
    floor = _floor(min_words, coverage, least_words)
    for block in _blocks(items, item_col, item_text_col, block_words):
        key = uuid.uuid4().hex
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            auto = _automaton(key, sent.value, floor)
            for batch in batches:
                texts, removed = [], []
                for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    if t:
                        at = word_spans(t)
                        _, spans = auto.matches([fold(t[a:b]) for a, b in at], min_words, coverage)
                        cut = sorted({i for a, b in spans for i in range(a, b)})
                        n += len(cut)
                        for a, b in reversed(_joined(cut)):
                            t = t[:at[a][0]] + t[at[b][1]:]
                    texts.append(t), removed.append(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["doc", "text", "n_removed"])

        out = out.mapInArrow(run, schema)
    return out.select(F.col("doc").alias(doc_col), F.col("text").alias(text_col), "n_removed")


def _joined(cut: list[int]) -> list[tuple[int, int]]:
    """Sorted numbers as stretches (first, last)."""
    out: list[list[int]] = []
    for i in cut:
        if out and out[-1][1] == i - 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return [(a, b) for a, b in out]
