"""Collapsing of runs: definitions, ties, gaps, splits over ranges."""

import datetime as dt
import random

import pytest

from graphlens.llm.runs import collapse_runs

T0 = dt.datetime(2025, 1, 1)
SCHEMA = "test string, seq long, depth long, src_id long, dst_id long, called_at timestamp, entity long, part string"


def at(s):
    return T0 + dt.timedelta(seconds=s)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    out = collapse_runs(df, "test", "seq", "dst_id", "depth", "called_at", **kw)
    return sorted((r.entity, r.first_pos, r.last_pos, r.n_events) for r in out.collect())


def plain(rows, tolerance=1, gap=None, least=1):
    seen = {}
    for t, s, d, _, v, c in rows:
        if t is None or s is None:
            continue
        k = (c is not None, c or T0, v is not None, v or 0, d is not None, d or 0)
        if (t, s) not in seen or k < seen[t, s][0]:
            seen[t, s] = (k, (d, v, c))
    out, last = [], None
    for (t, s), (_, (d, v, c)) in sorted(seen.items(), key=lambda x: x[0]):
        ok = (last is not None and last[0] == t and v is not None and last[2] == v and None not in (d, last[1]) and abs(d - last[1]) <= tolerance)
        if ok and gap is not None:
            ok = None not in (c, last[3]) and (c - last[3]).total_seconds() <= gap
        if ok:
            out[-1][2], out[-1][3] = s, out[-1][3] + 1
        else:
            out.append([t, s, s, 1])
        last = (t, d, v, c)
    return sorted(tuple(r) for r in out if r[3] >= least)


def test_definition(spark):
    rows = [("a", 0, 0, None, 5, at(0)), ("a", 3, 1, None, 5, at(1)), ("a", 3, 1, None, 5, at(1)), ("a", 4, 2, 7, 5, at(2)),  # depth may drift by one a step
            ("a", 5, 4, None, 5, at(3)), ("a", 6, 4, None, 6, at(4)), ("b", 0, 4, None, 6, at(5)), ("b", 1, 4, None, 6, at(6))]
    assert run(spark, rows, min_length=2) == [("a", 0, 4, 3), ("b", 0, 1, 2)]
    assert run(spark, rows) == plain(rows)


def test_nulls_and_empty(spark):
    rows = [("a", 0, None, None, 5, at(0)), ("a", 1, None, None, 5, at(0)), ("a", 2, 0, None, None, at(0)), ("a", 3, 0, None, None, None),
            (None, 0, 0, None, 1, at(0)), ("a", None, 0, None, 1, at(0)), ("", 0, 0, None, 1, None), ("", 1, 0, None, 1, None)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, max_gap_seconds=1) == plain(rows, gap=1)
    assert run(spark, []) == []


@pytest.mark.parametrize("seed", range(3))
def test_against_plain(spark, seed):
    r = random.Random(seed)
    rows = []
    for k in range(900):
        t = "hot" if r.random() < .7 else f"t{r.randrange(4)}"
        rows.append((t, r.randrange(700), r.randrange(3), None, r.choice([1, 1, 1, 2, None]), at(r.randrange(50))))
    rows += rows[:100]
    for kw, want in (({}, {}), ({"min_length": 2}, {"least": 2}), ({"max_gap_seconds": 3.0}, {"gap": 3}), ({"level_tolerance": 0}, {"tolerance": 0})):
        assert run(spark, rows, partitions=7, **kw) == plain(rows, **want)


def test_one_run_over_all_ranges(spark):
    rows = [("a", s, s % 2, None, 9, at(s)) for s in range(500)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    out = collapse_runs(df, "test", "seq", "dst_id", "depth", "called_at", partitions=11).collect()
    assert [(r.first_pos, r.last_pos, r.n_events, r.duration_us) for r in out] == [(0, 499, 500, 499_000_000)]


def test_stitching_keeps_the_order_of_ranges(spark):
    """Sequences whose positions run against the order of their names: the edge runs of a range must not swap."""
    rows = [(f"s{k:02d}", 1000 * (30 - k) + i, 0, None, 9, at(i)) for k in range(30) for i in range(40)]
    assert run(spark, rows, partitions=13) == plain(rows)
