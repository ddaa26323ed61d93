"""Repeated consecutive events in sequences.

Events are range partitioned on (entity, position) and sorted inside each range, so a sequence of any
length spreads over several tasks. In every range a streaming state machine holds one open run: each
event is compared with the run's anchor (the latest event taken into it), under a tolerance of the
level and, if asked for, of the time between the two. Finished runs are emitted at once. Runs that
touch the edge of a range stay open and are stitched afterwards: one or two rows per range, whatever
the data are.

Defined cases: rows without an entity or a position have no place in a sequence and are left out;
rows repeating (entity, position) count once (the one with the smallest time, value, level, nulls
first); an event whose value or level is null is like no other; with a time tolerance, neither is
one without a time. Gaps in the position do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.session import cut

_STATE = (
    "part int, head boolean, tail boolean, entity string, value long, n long, first_pos long, last_pos long, "
    "first_level long, last_level long, first_us long, last_us long"
)
_NAMES = [x.split()[0] for x in _STATE.split(", ")]


def _numbers(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.fill_null(0).to_numpy(zero_copy_only=False), col.is_null().to_numpy(zero_copy_only=False)


def _alike(v, v0, vn, vn0, lv, lv0, ln, ln0, us, us0, un, un0, tolerance, max_gap_us):
    """Does each event continue the one before it (arrays or single values; suffix 0: the earlier)?"""
    ok = (v == v0) & ~vn & ~vn0 & ~ln & ~ln0 & (np.abs(lv - lv0) <= tolerance)
    if max_gap_us is not None:
        ok = ok & ~un & ~un0 & (us - us0 <= max_gap_us)
    return ok


def _machine(level_tolerance: int, max_gap_us: int | None, min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the latest event: entity, position, value, level, time and their null flags
        held = None  # the open run
        first_run = True

        def closed(rows: list[list]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            types = [pa.int32(), pa.bool_(), pa.bool_(), pa.string()] + [pa.int64()] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=_NAMES)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            ent = batch.column("entity").to_numpy(zero_copy_only=False)
            part = batch.column("part")[0].as_py()
            pos, _ = _numbers(batch.column("pos"))
            val, vn = _numbers(batch.column("value"))
            lev, ln = _numbers(batch.column("level"))
            us, un = _numbers(batch.column("us"))
            same = np.zeros(len(pos), bool)
            same[1:] = (ent[1:] == ent[:-1]) & (pos[1:] == pos[:-1])
            if last is not None:
                same[0] = ent[0] == last[0] and pos[0] == last[1]
            keep = ~same
            if not keep.any():
                continue
            ent, pos, val, vn, lev, ln, us, un = (a[keep] for a in (ent, pos, val, vn, lev, ln, us, un))
            joined = np.zeros(len(pos), bool)
            joined[1:] = (ent[1:] == ent[:-1]) & _alike(
                val[1:], val[:-1], vn[1:], vn[:-1], lev[1:], lev[:-1], ln[1:], ln[:-1],
                us[1:], us[:-1], un[1:], un[:-1], level_tolerance, max_gap_us)
            if last is not None and ent[0] == last[0]:
                joined[0] = bool(_alike(val[0], last[2], vn[0], last[3], lev[0], last[4], ln[0], last[5],
                                        us[0], last[6], un[0], last[7], level_tolerance, max_gap_us))
            starts = np.flatnonzero(~joined)
            if len(starts) == 0 or starts[0] != 0:
                starts = np.concatenate([[0], starts])
            ends = np.concatenate([starts[1:], [len(pos)]]) - 1
            done = []
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                if i == 0 and joined[0]:
                    held[5] += b - a + 1
                    held[7], held[9], held[11] = int(pos[b]), (None if ln[b] else int(lev[b])), (None if un[b] else int(us[b]))
                    continue
                if held is not None and (held[1] or held[5] >= min_length):
                    done.append(held)
                held = [part, first_run, False, ent[a], None if vn[a] else int(val[a]), b - a + 1, int(pos[a]), int(pos[b]),
                        None if ln[a] else int(lev[a]), None if ln[b] else int(lev[b]),
                        None if un[a] else int(us[a]), None if un[b] else int(us[b])]
                first_run = False
            last = (ent[-1], pos[-1], val[-1], vn[-1], lev[-1], ln[-1], us[-1], un[-1])
            if done:
                yield closed(done)
        if held is not None:
            held[2] = True
            yield closed([held])

    return run


def _stitch(level_tolerance: int, max_gap_us: int | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in frames:
            done = []
            for row in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                gap_ok = max_gap_us is None or (
                    held is not None and row["first_us"] is not None and held["last_us"] is not None
                    and row["first_us"] - held["last_us"] <= max_gap_us)
                if (held is not None and held["tail"] and row["head"] and held["entity"] == row["entity"]
                        and None not in (held["value"], row["value"], held["last_level"], row["first_level"])
                        and held["value"] == row["value"]
                        and abs(row["first_level"] - held["last_level"]) <= level_tolerance and gap_ok):
                    held["n"] += row["n"]
                    for k in ("tail", "last_pos", "last_level", "last_us"):
                        held[k] = row[k]
                    continue
                if held is not None:
                    done.append(held)
                held = dict(row)
            if done:
                yield pd.DataFrame(done, columns=_NAMES).astype({k: "Int64" for k in _NAMES[4:]})
        if held is not None:
            yield pd.DataFrame([held], columns=_NAMES).astype({k: "Int64" for k in _NAMES[4:]})

    return run


def collapse_runs(df: DataFrame, entity: str, position: str, value: str, level: str, at: str, *, level_tolerance: int = 1,
                  max_gap_seconds: float | None = None, min_length: int = 1, partitions: int | None = None) -> DataFrame:
    """One row per run: entity, value, n_events, first_pos, last_pos, first_at, last_at, duration_us.

    min_length=1 keeps single events, so the result is the whole sequence in collapsed form.
    """
    gap = None if max_gap_seconds is None else int(round(max_gap_seconds * 1e6))
    events = df.where(F.col(entity).isNotNull() & F.col(position).isNotNull()).select(
        F.col(entity).cast("string").alias("entity"), F.col(position).cast("long").alias("pos"),
        F.col(value).cast("long").alias("value"), F.col(level).cast("long").alias("level"),
        F.unix_micros(F.col(at).cast("timestamp")).alias("us"))
    by = [F.col("entity"), F.col("pos")]
    ranged = events.repartitionByRange(partitions, *by) if partitions else events.repartitionByRange(*by)
    ordered = ranged.sortWithinPartitions("entity", "pos", "us", "value", "level").withColumn("part", F.spark_partition_id())
    # the runs are read twice, so they are kept; singles inside a range are not among them if min_length > 1
    runs = cut(ordered.mapInArrow(_machine(level_tolerance, gap, min_length), _STATE))
    edge = F.col("head") | F.col("tail")
    # at most two rows per range reach the one task that stitches
    stitched = runs.where(edge).repartition(1).sortWithinPartitions("part", "entity", "first_pos").mapInPandas(
        _stitch(level_tolerance, gap), _STATE)
    both = runs.where(~edge).unionByName(stitched).where(F.col("n") >= min_length)
    return both.select(
        "entity", "value", F.col("n").alias("n_events"), "first_pos", "last_pos",
        F.timestamp_micros("first_us").alias("first_at"), F.timestamp_micros("last_us").alias("last_at"),
        (F.col("last_us") - F.col("first_us")).alias("duration_us"))
