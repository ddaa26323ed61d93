"""Per-key results that no heavy key slows down.

Rows are range partitioned on the key and a secondary order, with quantiles that Spark samples, so a
key with a third of all rows simply spans a third of the partitions. Every range is sorted and reduced
to one state per key by a state machine over Arrow batches. Keys that begin and end inside a range are
finished there; only the first and the last key of a range can go on in another one, so at most two
states per range are shuffled and stitched, whatever the data are.

Defined cases: rows with a null key form a key of their own; rows equal in key and order count once
where distinct values are counted; an empty table gives an empty result. The secondary order decides
how far a key can be split: rows equal in both stay together, so it should be (nearly) unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.session import cut

ROWS_PER_TASK = 200_000


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def spread(df: DataFrame, keys: list[str], order: list[str | Column], partitions: int | None = None) -> DataFrame:
    """Range partition on keys and order; heavy keys are split along the order."""
    cols = [_col(c) for c in [*keys, *order]]
    return df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)


def _changes(columns: list[pa.Array], before: list | None) -> np.ndarray:
    """Where a row differs from the one before it; nulls equal nulls. before: the values ahead of the first row."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[0] = before is None or any(c[0].as_py() != b and not (c[0].as_py() != c[0].as_py() and b != b) for c, b in zip(columns, before))
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        differ = pc.not_equal(a, b)
        if pa.types.is_floating(c.type):
            differ = pc.and_(differ, pc.invert(pc.and_(pc.is_nan(a), pc.is_nan(b))))
        out[1:] |= pc.fill_null(differ, False).to_numpy(zero_copy_only=False)
        out[1:] |= pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return out


def _range_states(keys: list[str], order: list[str]):
    """Batches of one sorted range to (keys, n, edge): n distinct orders of each key; edge: the key may go on in another range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before_key, before_order = None, None, None  # held: the open key, its count, whether it is the first of the range

        def state(rows: pa.RecordBatch, n: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(n, pa.int64()), pa.array(edge, pa.bool_())], names=[*keys, "n", "edge"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            ks, os = [batch.column(k) for k in keys], [batch.column(o) for o in order]
            new_key = _changes(ks, before_key)
            new_row = new_key | _changes(os, before_order)
            before_key, before_order = [c[-1].as_py() for c in ks], [c[-1].as_py() for c in os]
            starts = np.flatnonzero(new_key)
            lead = starts[0] if len(starts) else batch.num_rows
            if held is not None:
                held[1] += int(new_row[:lead].sum())
            if len(starts) == 0:
                continue
            counts = np.add.reduceat(new_row.astype(np.int64), starts)
            at = batch.select(keys).take(pa.array(starts))
            first = held is None
            if held is not None:
                yield state(held[0], np.array([held[1]]), np.array([held[2]]))
            if len(starts) > 1:
                edge = np.zeros(len(starts) - 1, bool)
                edge[0] = first
                yield state(at.slice(0, len(starts) - 1), counts[:-1], edge)
            held = [at.slice(len(starts) - 1), int(counts[-1]), first and len(starts) == 1]
        if held is not None:
            yield state(held[0], np.array([held[1]]), np.array([True]))

    return run


def balanced_distinct_counts(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """(keys, n): distinct values of order per key."""
    rows = spread(df.select(*keys, *order), keys, order, partitions).sortWithinPartitions(*keys, *order)
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("n", T.LongType()), T.StructField("edge", T.BooleanType())])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    states = cut(rows.mapInArrow(_range_states(keys, order), schema))  # read twice below
    stitched = states.where("edge").groupBy(*keys).agg(F.sum("n").alias("n"))
    return states.where(~F.col("edge")).select(*keys, "n").unionByName(stitched)


def heavy_keys(df: DataFrame, keys: list[str], row_id: str, share: float = 0.01, partitions: int | None = None) -> DataFrame:
    """(keys, n, total, heavy) for every key: n distinct row ids, heavy if n >= share * total.

    total is the number of distinct non-null row ids of the whole table, counted apart, as an id may
    stand under several keys; rows without an id count for no key.
    """
    ids = df.where(F.col(row_id).isNotNull())
    per_key = balanced_distinct_counts(ids, keys, [row_id], partitions)
    total = ids.select(row_id).distinct().agg(F.count(F.lit(1)).alias("total"))
    # one row: its size does not depend on the data
    return per_key.join(F.broadcast(total)).withColumn("heavy", F.col("n") >= F.col("total") * F.lit(share))


def balanced_row_number(df: DataFrame, keys: list[str], order: list[str | Column], out: str = "position",
                        partitions: int | None = None) -> DataFrame:
    """Add the 1-based position of each row within its key, along order, heavy keys included.

    Each range numbers its own rows; the counts of a key's earlier ranges (one row per key and range)
    are added as an offset. Without keys it is one ranking over all rows. Rows equal in keys and order
    get consecutive positions in no fixed order.
    """
    rows = cut(spread(df, keys, order, partitions).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part", *keys).orderBy(*order)
    sizes = rows.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    # without keys this window holds one row per range
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    renamed = offsets.select(F.col("_part").alias("_p"), *[F.col(k).alias("_k_" + k) for k in keys], "_before")
    on = F.col("_part") == F.col("_p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col("_k_" + k))
    numbered = rows.withColumn("_local", F.row_number().over(local))
    joined = numbered.join(renamed, on)
    return joined.select(*df.columns, (F.col("_local") + F.col("_before")).cast("long").alias(out))


def hot_keys(counts: DataFrame, key: str, n: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(_hot, _copies) of the keys with more than rows_per_task rows: at most rows / rows_per_task entries, so it can be broadcast.

    The parts of such a key are a quarter of rows_per_task each, so that one that meets other keys in a task stays small.
    """
    return counts.where((F.col(n) > rows_per_task) & F.col(key).isNotNull()).select(
        F.col(key).alias("_hot"), F.ceil(4 * F.col(n) / rows_per_task).cast("int").alias("_copies"))


def skew_join(facts: DataFrame, dims: DataFrame, key: str, row_cols: list[str], how: str = "inner",
              rows_per_task: int = ROWS_PER_TASK, hot: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Equi-join of facts with dims (few rows per key) in which no key of facts fills a task; how: inner, left, left_semi or left_anti.

    Keys with more than rows_per_task facts are split by a hash of row_cols, and only their rows of
    dims are repeated, once per split. hot (see hot_keys) saves counting where the counts are known, and
    so does rows, a bound of the number of facts: where it is no more than rows_per_task, no key is hot.
    The list of such keys is broadcast: it has at most count(facts) / rows_per_task entries. Null keys
    match nothing.
    """
    if rows is not None and rows <= rows_per_task:
        return facts.join(dims, key, how)
    if hot is None:
        hot = hot_keys(facts.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")), key, "_rows", rows_per_task)
    splits = F.coalesce(F.col("_copies"), F.lit(1))
    f = facts.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*row_cols), splits).cast("int")).drop("_hot", "_copies")
    d = dims.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), splits - 1))).drop("_hot", "_copies")
    return f.join(d, [key, "_salt"], how).drop("_salt")
