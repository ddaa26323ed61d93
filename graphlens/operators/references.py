"""References to records that do not exist.

A foreign key is sound at time t when its parent existed by t and was not removed for good
afterwards. The search runs over distinct keys first: the keys of all child tables are reduced to
one row each (with the earliest time they are used), a left anti join keeps those that some row uses
without cover, and only these few keys are joined back to the rows.

Defined cases: a null key is no reference; a null time cannot be covered by any parent, so its row
is an orphan; repeated rows count once; parents with a null id or null written_at never cover.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.operators.heavy_keys import hot_keys, skew_join


@dataclass(frozen=True)
class ForeignKey:
    """One key column of a child table; row_key names a row, at is the row's time."""

    table_name: str
    field: str
    rows: DataFrame
    key: Column
    at: Column
    row_key: Column


def parent_lifetimes(parents: DataFrame, removals: DataFrame, id_col: str = "id", written: str = "written_at",
                     removed_id: str = "symbol_id", removed: str = "removed_at") -> DataFrame:
    """(ref_key, valid_from): parents that are not removed for good, with their first time."""
    lives = (
        parents.where(F.col(id_col).isNotNull() & F.col(written).isNotNull())
        .groupBy(F.col(id_col).alias("ref_key"))
        .agg(F.min(written).alias("valid_from"), F.max(written).alias("last_written"))
    )
    gone = (
        removals.where(F.col(removed_id).isNotNull())
        .groupBy(F.col(removed_id).alias("gone_key"))
        .agg(F.max(removed).alias("last_removed"))
    )
    dead = (F.col("ref_key") == F.col("gone_key")) & (F.col("last_removed") > F.col("last_written"))
    return lives.join(gone, dead, "left_anti").select("ref_key", "valid_from")


def reference_rows(keys: list[ForeignKey]) -> DataFrame:
    """Non-null references of all child tables: table_name, field, row_key, ref_key, ref_at; each table is scanned once for all its keys."""
    tables: list[tuple[DataFrame, list[ForeignKey]]] = []
    for k in keys:
        same = [ks for rows, ks in tables if rows is k.rows]
        if same:
            same[0].append(k)
        else:
            tables.append((k.rows, [k]))
    out = None
    for rows, ks in tables:
        refs = F.explode(F.array(*[F.struct(
            F.lit(k.table_name).alias("table_name"), F.lit(k.field).alias("field"), k.row_key.alias("row_key"), k.key.alias("ref_key"), k.at.alias("ref_at")) for k in ks]))
        part = rows.select(refs.alias("r")).select("r.*").where(F.col("ref_key").isNotNull())
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no foreign keys given")
    return out


def orphan_references(keys: list[ForeignKey], lifetimes: DataFrame, rows_per_task: int = 50_000) -> DataFrame:
    """Distinct orphan references: table_name, field, row_key, ref_key, ref_at.

    The distinct keys carry the number of their rows, so a key that more than rows_per_task rows refer
    to is known when the suspects are joined back, and its rows are spread over several tasks.
    """
    refs = reference_rows(keys)
    used = refs.groupBy("ref_key").agg(
        F.min("ref_at").alias("first_used"), F.max(F.col("ref_at").isNull()).alias("undated"), F.count(F.lit(1)).alias("n_refs"))
    live = lifetimes.select(F.col("ref_key").alias("live_key"), "valid_from")
    covered = (F.col("ref_key") == F.col("live_key")) & (F.col("valid_from") <= F.col("first_used")) & ~F.col("undated")
    suspects = used.join(live, covered, "left_anti").select("ref_key")
    # all such keys, as the rows of sound ones are shuffled for the join too
    hot = hot_keys(used, "ref_key", "n_refs", rows_per_task)
    # a suspect may still have a parent that appeared late: its rows from then on are sound
    dated = suspects.join(live, F.col("ref_key") == F.col("live_key"), "left").select("ref_key", "valid_from")
    unsound = F.col("valid_from").isNull() | F.col("ref_at").isNull() | (F.col("ref_at") < F.col("valid_from"))
    return (
        skew_join(refs, dated, "ref_key", ["table_name", "field", "row_key"], "inner", rows_per_task, hot)
        .where(unsound)
        .select("table_name", "field", "row_key", "ref_key", "ref_at")
        .distinct()
    )


def orphan_counts(keys: list[ForeignKey], lifetimes: DataFrame) -> DataFrame:
    """Per table, field and month: all references, and those to nothing.

    References are counted per distinct row_key; the month is null where the time is.
    """
    month = F.date_format("ref_at", "yyyy-MM").alias("month")
    by = ["table_name", "field", "month"]
    # one shuffle on (table, field, row) removes repeated rows before counting
    all_rows = reference_rows(keys).select("table_name", "field", "row_key", month).distinct()
    bad = orphan_references(keys, lifetimes).select("table_name", "field", "row_key", month).distinct()
    totals = all_rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_references"))
    orphans = bad.groupBy(*by).agg(F.count(F.lit(1)).alias("n_orphans"))
    o = orphans.select(*[F.col(c).alias("o_" + c) for c in by], "n_orphans")
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col("o_" + c))
    return totals.join(o, on, "left").select(*by, "n_references", F.coalesce("n_orphans", F.lit(0).cast("long")).alias("n_orphans"))


def code_graph_keys(edges: DataFrame, call_trace: DataFrame) -> list[ForeignKey]:
    edge_key = F.col("id").cast("string")
    trace_key = F.concat(F.col("test"), F.lit("#"), F.col("seq").cast("string"))
    return [
        ForeignKey("edges", "src_id", edges, F.col("src_id"), F.col("built_at"), edge_key),
        ForeignKey("edges", "dst_id", edges, F.col("dst_id"), F.col("built_at"), edge_key),
        ForeignKey("call_trace", "dst_id", call_trace, F.col("dst_id"), F.col("called_at"), trace_key),
    ]
