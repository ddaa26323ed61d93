"""Encoding of the whole corpus with a public byte-level BPE tokenizer.

Pre-tokenisation runs over numpy arrays, without a regular expression. Every code point of a batch of
texts has a symbol (letter, number, other, kinds of white space, apostrophe of a contraction); every
symbol is a function from states to states, and these few functions are closed under composition, so a
blocked prefix scan over their composition table gives the state before each code point, and with it
the places where a token may start. Only distinct slices go through pair merging; results are cached.

Defined cases: null and empty texts give no ids; texts may be of any length (merging takes n log n);
special tokens are ordinary text. Columns beside the id and the text are not read.
"""

from __future__ import annotations

import base64
import heapq
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.session import parallel

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# symbols of code points
_L, _N, _O, _APOS1, _APOS2, _JOIN, _LAST, _SPACE, _RESET = range(9)
# states: fresh, in letters, in numbers, in others, after a joining blank, in white space, one or two letters of a contraction to come
_FRESH, _IN_L, _IN_N, _IN_O, _JOINED, _IN_S, _ONE, _TWO = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, does a token start here)."""
    if symbol == _RESET:
        return _FRESH, True
    if symbol == _L:
        if state == _ONE:
            return _FRESH, False
        if state == _TWO:
            return _ONE, False
        return _IN_L, state not in (_IN_L, _JOINED)
    if symbol == _N:
        return _IN_N, state not in (_IN_N, _JOINED)
    if symbol in (_O, _APOS1, _APOS2):
        if state in (_IN_O, _JOINED):
            return _IN_O, False
        return {_O: _IN_O, _APOS1: _ONE, _APOS2: _TWO}[symbol], True
    if symbol == _JOIN:
        return _JOINED, True
    if symbol == _LAST:
        return _FRESH, True
    return _IN_S, state != _IN_S


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each symbol, composition table, value of each function at FRESH, starts by state and symbol)."""
    states = range(8)
    base = [tuple(_step(s, x)[0] for s in states) for x in range(9)]
    known = {tuple(states): 0}
    for f in base:
        known.setdefault(f, len(known))
    grown = True
    while grown:
        grown = False
        for f, g in product(list(known), base):
            h = tuple(g[f[s]] for s in states)
            if h not in known:
                known[h] = len(known)
                grown = True
    fs = sorted(known, key=known.get)
    table = np.array([[known[tuple(g[f[s]] for s in states)] for g in fs] for f in fs], np.uint8 if len(fs) < 256 else np.uint16)
    starts = np.array([[_step(s, x)[1] for x in range(9)] for s in states])
    return np.array([known[f] for f in base], table.dtype), table, np.array([f[_FRESH] for f in fs], np.uint8), starts


# Letters and numbers that Unicode 16.0 added (the standard library here has 15.1).
_LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
)
_NUMBERS_16 = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    out = np.full(sys.maxunicode + 1, _O, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = _L
        elif k == "N":
            out[c] = _N
        # White_Space of the Unicode character database (str.isspace also takes the separators 1C to 1F)
        elif chr(c).isspace() and not 0x1C <= c <= 0x1F:
            out[c] = _SPACE
    for symbol, added in ((_L, _LETTERS_16), (_N, _NUMBERS_16)):
        for a, b in added:
            out[a:b + 1] = symbol
    return out


def token_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where tokens start, in the code points of texts laid end to end; first marks each text's first code point."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, bool)
    cls = _classes()[codes]
    ends = np.append(first[1:], True)  # last code point of its text
    space = cls == _SPACE
    then_ink = np.zeros(n, bool)
    then_ink[:-1] = ~space[1:] & ~ends[:-1]
    sym = cls.copy()
    sym[space & then_ink & (codes == 32)] = _JOIN
    sym[space & then_ink & (codes != 32)] = _LAST
    at = np.flatnonzero(codes == 39)
    if len(at):
        padded = np.concatenate([codes, [0, 0]])
        a, b = padded[at + 1], padded[at + 2]
        inside1 = ~ends[at]
        inside2 = inside1 & ~np.append(ends, [True, True])[at + 1]
        one = inside1 & np.isin(a, [ord(c) for c in "stmd"])
        two = np.zeros(len(at), bool)
        for x, y in ("re", "ve", "ll"):
            two |= inside2 & (a == ord(x)) & (b == ord(y))
        sym[at[one]] = _APOS1
        sym[at[two]] = _APOS2
    fun, table, at_fresh, starts = _monoid()
    # the state before code point i is the composition of the symbols before it, from the last text start on
    f = np.empty(n, fun.dtype)
    f[0] = fun[_RESET]
    f[1:] = fun[sym[:-1]]
    f[first] = fun[_RESET]
    width = 256
    rows = -(-n // width)
    grid = np.zeros(rows * width, fun.dtype)  # 0 is the identity
    grid[:n] = f
    lanes = np.ascontiguousarray(grid.reshape(rows, width).T)
    for k in range(1, width):  # within blocks, all blocks at once
        lanes[k] = table[lanes[k - 1], lanes[k]]
    total = lanes[width - 1].copy()
    shift = 1
    while shift < rows:  # across blocks, by doubling
        total[shift:] = table[total[:-shift].copy(), total[shift:]]
        shift *= 2
    carry = np.zeros(rows, fun.dtype)
    carry[1:] = total[:-1]
    lanes = table[carry[None, :], lanes]
    state = at_fresh[lanes.T.reshape(-1)[:n]]
    out = starts[state, sym]
    out[first] = True
    return out


class BytePairs:
    """Pair merging by rank, with a bounded cache of slices."""

    def __init__(self, vocabulary: str, cache: int = 500_000):
        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.limit = cache
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, raw: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        whole = ranks.get(raw)
        if whole is not None:
            return (whole,)
        n = len(raw)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))  # end of the part that starts here; 0 when it was merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            nxt[i] = stop
            if stop < n:
                prv[stop] = i
                r = ranks.get(raw[i:end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            p = prv[i]
            if p >= 0:
                r = ranks.get(raw[p:stop])
                if r is not None:
                    heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i:end[i]]])
            i = nxt[i]
        return tuple(out)

    def ids(self, piece: str) -> tuple[int, ...]:
        got = self.known.get(piece)
        if got is None:
            got = self.merge(piece.encode())
            if len(piece) <= 64:
                if len(self.known) >= self.limit:
                    self.known.clear()
                self.known[piece] = got
        return got

    def encode_batch(self, texts: list[str | None], with_offsets: bool = False) -> tuple[list[list[int]], list[list[int]] | None]:
        """Ids of each text and, if asked for, where each pre-token starts, as (code point, index of its first id) pairs in a row."""
        held = [t for t in texts if t]
        joined = "".join(held)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter((len(t) for t in held), np.int64, len(held))
        first = np.zeros(len(codes), bool)
        begins = np.concatenate([[0], np.cumsum(lengths)])
        first[begins[:-1]] = True
        where = np.flatnonzero(token_starts(codes, first))
        cuts = np.searchsorted(where, begins).tolist()
        bounds = where.tolist() + [len(codes)]
        out, offs, k = [], [], 0
        known, ids = self.known, self.ids
        for t in texts:
            if not t:
                out.append([])
                offs.append([])
                continue
            a, b = cuts[k], cuts[k + 1]
            base = int(begins[k])
            got: list[int] = []
            mine: list[int] = []
            for i in range(a, b):
                piece = joined[bounds[i]:bounds[i + 1]]
                if with_offsets:
                    mine += (bounds[i] - base, len(got))
                got += known.get(piece) or ids(piece)
            out.append(got)
            offs.append(mine)
            k += 1
        return out, offs if with_offsets else None

    @property
    def pieces(self) -> dict[int, bytes]:
        return {v: k for k, v in self.ranks.items()}


_LOADED: dict[str, BytePairs] = {}


_SENT: set[tuple[str, str]] = set()


def _send(spark: SparkSession, vocabulary: str) -> None:
    """Hand the vocabulary to the executors, which may lack its path; once per application."""
    key = (spark.sparkContext.applicationId, vocabulary)
    if key not in _SENT:
        spark.sparkContext.addFile(vocabulary)
        _SENT.add(key)


def _pairs(vocabulary: str) -> BytePairs:
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = BytePairs(vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary)))
    return _LOADED[vocabulary]


def _chunks(texts: list[str | None], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Slices of about so many code points; a longer text has one of its own."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= chars:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                  with_offsets: bool = False) -> DataFrame:
    """(id, ids array<int>[, offsets array<int>]): one row per input row, in place, without a shuffle."""
    path = vocabulary or os.environ.get("GRAPHLENS_VOCABULARY") or DEFAULT_VOCABULARY
    kind = df.schema[id_col].dataType.simpleString()
    _send(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _pairs(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                ids, offs = bpe.encode_batch(texts[a:b], with_offsets)
                cols = [batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32()))]
                names = ["id", "ids"]
                if with_offsets:
                    cols.append(pa.array(offs, pa.list_(pa.int32())))
                    names.append("offsets")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"id {kind}, ids array<int>" + (", offsets array<int>" if with_offsets else "")
    out = parallel(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id, text): the text the ids stand for; null ids give a null text, unknown ids raise."""
    path = vocabulary or os.environ.get("GRAPHLENS_VOCABULARY") or DEFAULT_VOCABULARY
    kind = df.schema[id_col].dataType.simpleString()
    _send(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pairs(path).pieces
        for batch in batches:
            texts = [None if x is None else b"".join(map(pieces.__getitem__, x)).decode("utf-8", "replace")
                     for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    out = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)
