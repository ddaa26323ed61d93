"""Orphan references and heavy keys: definitions, nulls, repeats, empty tables, clashing columns."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphlens.operators.heavy_keys import balanced_distinct_counts, balanced_row_number, heavy_keys, skew_join
from graphlens.operators.references import code_graph_keys, orphan_counts, orphan_references, parent_lifetimes

T = [dt.datetime(2025, 1, d) for d in range(1, 29)]
SYM = "id long, written_at timestamp, name string"
TOMB = "symbol_id long, removed_at timestamp"
EDGE = "id long, src_id long, dst_id long, kind string, built_at timestamp, ref_key string, valid_from string"
TRACE = "test string, seq long, depth long, src_id long, dst_id long, called_at timestamp"


def tables(spark, sym=(), tomb=(), edge=(), trace=()):
    return (spark.createDataFrame(list(sym), SYM), spark.createDataFrame(list(tomb), TOMB), spark.createDataFrame(list(edge), EDGE),
            spark.createDataFrame(list(trace), TRACE))


def found(spark, **kw):
    sym, tomb, edge, trace = tables(spark, **kw)
    return {(r.table_name, r.field, r.row_key) for r in orphan_references(code_graph_keys(edge, trace), parent_lifetimes(sym, tomb)).collect()}


def test_cases(spark):
    sym = [(1, T[1], "a"), (1, T[5], "a"), (2, T[1], "b"), (3, T[1], "c"), (3, T[9], "c"), (4, None, "d"), (None, T[0], "e")]
    tomb = [(2, T[3]), (2, T[3]), (3, T[5]), (77, T[1]), (None, T[1])]
    edge = [
        (10, 1, 1, "calls", T[2], "x", "y"), (10, 1, 1, "calls", T[2], "x", "y"),  # sound, repeated
        (11, 1, 2, "calls", T[2], "x", "y"),  # target removed for good
        (12, 1, 3, "calls", T[2], "x", "y"),  # removed, but written anew
        (13, 1, 9, "calls", T[2], None, None),  # never there
        (14, 1, 1, "calls", T[0], None, None),  # before its symbol
        (15, 1, 1, "calls", None, None, None),  # no time
        (16, None, 4, "calls", T[9], None, None),  # null key; parent without a time
    ]
    trace = [("t", 0, 0, None, 9, T[3]), ("t", 1, 0, 9, 1, T[3])]
    e, c = "edges", "call_trace"
    assert found(spark, sym=sym, tomb=tomb, edge=edge, trace=trace) == {
        (e, "dst_id", "11"), (e, "dst_id", "13"), (e, "src_id", "14"), (e, "dst_id", "14"), (e, "src_id", "15"), (e, "dst_id", "15"), (e, "dst_id", "16"), (c, "dst_id", "t#0")}


def test_empty_tables(spark):
    assert found(spark) == set()
    assert found(spark, edge=[(1, 2, None, None, T[0], None, None)]) == {("edges", "src_id", "1")}


def test_counts_per_month(spark):
    sym, tomb, edge, trace = tables(spark, sym=[(1, T[0], "a")], edge=[(1, 1, 5, "k", T[3], None, None), (2, 1, 1, "k", None, None, None)])
    got = {(r.field, r.month): (r.n_references, r.n_orphans) for r in orphan_counts(code_graph_keys(edge, trace), parent_lifetimes(sym, tomb)).collect()}
    assert got == {("src_id", "2025-01"): (1, 0), ("dst_id", "2025-01"): (1, 1), ("src_id", None): (1, 1), ("dst_id", None): (1, 1)}


def test_against_brute_force(spark):
    r = random.Random(4)
    sym = [(r.randrange(30), T[r.randrange(28)], "n") for _ in range(40)]
    tomb = [(r.randrange(40), T[r.randrange(28)]) for _ in range(12)]
    edge = [(i, r.randrange(40), 7 if r.random() < .4 else r.randrange(40), "k", T[r.randrange(28)], None, None) for i in range(300)]
    first, last, gone = {}, {}, {}
    for i, t, _ in sym:
        first[i], last[i] = min(first.get(i, t), t), max(last.get(i, t), t)
    for i, t in tomb:
        gone[i] = max(gone.get(i, t), t)
    sound = lambda k, t: k in first and first[k] <= t and not (k in gone and gone[k] > last[k])
    want = {("edges", f, str(i)) for i, s, d, _, t, *_ in edge for f, k in (("src_id", s), ("dst_id", d)) if not sound(k, t)}
    assert found(spark, sym=sym, tomb=tomb, edge=edge) == want


@pytest.fixture(scope="module")
def skewed(spark):
    r = random.Random(1)
    rows = [(r.randrange(2000), 1 if r.random() < .5 else r.randrange(50), r.choice(["a", "b"]), i) for i in range(3000)]
    return rows + rows[:200], spark.createDataFrame(rows + rows[:200], "id long, k long, kind string, n long")


def test_heavy_keys(spark, skewed):
    rows, df = skewed
    want = defaultdict(set)
    for i, k, c, _ in rows:
        want[k, c].add(i)
    total = len({i for i, *_ in rows})
    got = {(r.k, r.kind): (r.n, r.heavy) for r in heavy_keys(df, ["k", "kind"], "id", 0.01, 7).collect()}
    assert got == {x: (len(s), len(s) >= 0.01 * total) for x, s in want.items()}
    assert {(r.k, r.kind): r.n for r in balanced_distinct_counts(df, ["k", "kind"], ["id"]).collect()} == {x: len(s) for x, s in want.items()}


def test_heavy_keys_edges(spark):
    schema = "id long, k long, n long, total long, heavy string"
    df = spark.createDataFrame([(1, None, 0, 0, "x"), (2, None, 0, 0, "x"), (None, 5, 0, 0, "x")], schema)
    assert [(r.k, r.n, r.total, r.heavy) for r in heavy_keys(df, ["k"], "id", 0.5).collect()] == [(None, 2, 2, True)]
    assert heavy_keys(df.limit(0), ["k"], "id").collect() == []


def test_row_number_across_ranges(spark, skewed):
    rows, _ = skewed
    uniq = sorted({(k, i) for i, k, _, _ in rows})
    got = balanced_row_number(spark.createDataFrame(uniq, "k long, i long"), ["k"], ["i"], partitions=9).collect()
    count = Counter()
    want = {}
    for k, i in uniq:
        count[k] += 1
        want[k, i] = count[k]
    assert {(r.k, r.i): r.position for r in got} == want


def test_skew_join(spark, skewed):
    rows, df = skewed
    dims = spark.createDataFrame([(k, f"d{k}") for k in range(0, 60, 2)] + [(None, "x")], "k long, d string")
    got = Counter((r.k, r.n, r.d) for r in skew_join(df, dims, "k", ["n", "id"], rows_per_task=100).collect())
    assert got == Counter((k, n, f"d{k}") for _, k, _, n in rows if k % 2 == 0)
    assert skew_join(df.withColumn("k", F.lit(None).cast("long")), dims, "k", ["n"]).count() == 0


def test_hot_reference_targets(spark):
    """Suspects that many rows refer to are split; the result does not change."""
    r = random.Random(6)
    edge = [(i, r.randrange(5), 9 if r.random() < .5 else r.randrange(12), "k", T[r.randrange(28)], None, None) for i in range(400)]
    s, t, e, c = tables(spark, sym=[(i, T[3 * i], "n") for i in range(6)], edge=edge)
    ask = lambda n: {tuple(x) for x in orphan_references(code_graph_keys(e, c), parent_lifetimes(s, t), n).collect()}
    assert ask(10) == ask(1_000_000) and len(ask(10)) > 200


def test_only_boundary_keys_are_stitched(spark):
    df = spark.createDataFrame([(i % 97 if i % 2 else 5, i) for i in range(4000)], "k long, i long")
    from graphlens.operators import heavy_keys as hk

    rows = hk.spread(df, ["k"], ["i"], 8).sortWithinPartitions("k", "i").mapInArrow(hk._range_states(["k"], ["i"]), "k long, n long, edge boolean")
    assert rows.where("edge").count() <= 16 and rows.agg(F.sum("n")).first()[0] == 4000


def test_nan_and_text_keys(spark):
    df = spark.createDataFrame([(float("nan"), "a", 1), (float("nan"), "a", 2), (None, None, 3), (None, None, 3), (1.0, "", 4)], "x double, s string, i long")
    got = sorted(((str(r.x), r.s, r.n) for r in balanced_distinct_counts(df, ["x", "s"], ["i"], 3).collect()), key=str)
    assert got == [("1.0", "", 1), ("None", None, 1), ("nan", "a", 2)]


def test_skew_semi_and_anti(spark):
    facts = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 100), (3, 101), (None, 102)], "k long, i long")
    dims = spark.createDataFrame([(1,), (3,)], "k long")
    assert skew_join(facts, dims, "k", ["i"], "left_semi", 10).count() == 51
    assert {r.i for r in skew_join(facts, dims, "k", ["i"], "left_anti", 10).collect()} == {100, 102}


def test_global_row_number(spark):
    df = spark.createDataFrame([(i * 7 % 101, str(i)) for i in range(101)], "x long, s string")
    assert {(r.x, r.position) for r in balanced_row_number(df, [], [F.desc("x"), "s"], partitions=6).collect()} == {(x, 101 - x) for x in range(101)}


def test_edges_with_missing_ends_by_joins(spark):
    from graphlens.operators.snapshot import current_edges

    r = random.Random(3)
    e = spark.createDataFrame([(i, r.randrange(30), 7 if r.random() < .4 else r.randrange(30), r.choice(["calls", " Calls"]), T[0], None, None) for i in range(500)] + [(900, None, 1, "calls", T[0], None, None)], EDGE)
    s = spark.createDataFrame([(i, T[0], "n") for i in range(20)], SYM)
    few, many = (sorted(map(tuple, current_edges(e, s, 50, m).collect())) for m in (100, 0))
    assert few == many and few and all(a < 20 and b < 20 for a, b, _ in few)
