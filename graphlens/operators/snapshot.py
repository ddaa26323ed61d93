"""The current graph out of tables that hold repeated, late and stale rows, and how it is kept up.

The rules: of a symbol id the row written last counts; a file has its first path in order; an edge is
the triple (source, target, kind without case and outer blanks) between symbols that exist; a trace
event is its (test, seq).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.operators.heavy_keys import ROWS_PER_TASK, balanced_row_number, hot_keys, skew_join
from graphlens.session import cut, table

MAX_MISSING = 1_000_000

# in the order in which they break ties between rows of one id and time; long texts come last
SYMBOL_COLUMNS = ["file_id", "name", "kind", "line_start", "line_end", "coverage_pct", "import_module", "import_name", "docstring"]


def latest_symbols(symbols: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per id, the one written last: id, the columns asked for (all if None), written_at.

    Only the columns up to the last one asked for, in the order of SYMBOL_COLUMNS, are read: these
    decide between rows of the same time alike whatever is asked for. A max of structs combines before
    the shuffle, so an id repeated often costs one row per task.
    """
    wanted = SYMBOL_COLUMNS if columns is None else [c for c in SYMBOL_COLUMNS if c in set(columns)]
    rest = SYMBOL_COLUMNS[:max((SYMBOL_COLUMNS.index(c) for c in wanted), default=-1) + 1]
    best = symbols.where("id is not null").groupBy("id").agg(F.max(F.struct("written_at", *rest)).alias("r"))
    return best.select("id", *[F.col(f"r.{c}").alias(c) for c in [*wanted, "written_at"]])


def current_files(files: DataFrame) -> DataFrame:
    """(id, path, hash, indexed_at): hash is the one recorded last, nulls last."""
    rank = F.struct(F.col("indexed_at"), F.col("hash"))
    return files.where("id is not null and path is not null").groupBy("id").agg(
        F.min("path").alias("path"), F.max(rank).alias("r")).select("id", "path", F.col("r.hash").alias("hash"), F.col("r.indexed_at").alias("indexed_at"))


def current_edges(edges: DataFrame, symbols: DataFrame, rows_per_task: int = ROWS_PER_TASK, max_missing: int = MAX_MISSING) -> DataFrame:
    """Distinct (src_id, dst_id, kind) whose ends both exist.

    The ids that edges name are reduced to one row each and held against the symbols. Those that are
    missing are counted; up to max_missing of them (16 bytes each) are broadcast, so that the edges are
    shuffled for their distinction only. Beyond, edges are joined with them, those of an id that many
    edges name spread over tasks.
    """
    e = edges.select("src_id", "dst_id", F.lower(F.trim("kind")).alias("kind")).where("src_id is not null and dst_id is not null")
    used = e.select(F.explode(F.array("src_id", "dst_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    missing = cut(used.join(symbols.select("id").distinct(), "id", "left_anti"))
    few = missing.count() <= max_missing
    for side in ("src_id", "dst_id"):
        gone = missing.select(F.col("id").alias(side))
        if few:
            e = e.join(F.broadcast(gone), side, "left_anti")
        else:
            e = skew_join(e, gone, side, ["src_id", "dst_id", "kind"], "left_anti", rows_per_task, hot_keys(used, "id", "n", rows_per_task))
    return e.select("src_id", "dst_id", "kind").distinct()


def current_trace(call_trace: DataFrame) -> DataFrame:
    return call_trace.select("test", "seq", "depth", "src_id", "dst_id", "called_at").distinct()


class Graph:
    """Lazy views of one data directory; symbols are read with the columns that are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._edges: DataFrame | None = None

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def symbols(self, *columns: str) -> DataFrame:
        """Current symbols: id and the columns (file_id, name, kind and the lines if none are named)."""
        return latest_symbols(self.raw("symbols"), columns or SYMBOL_COLUMNS[:5]).drop("written_at")

    @property
    def files(self) -> DataFrame:
        return current_files(self.raw("files"))

    @property
    def edges(self) -> DataFrame:
        if self._edges is None:
            self._edges = current_edges(self.raw("edges"), self.raw("symbols"))
        return self._edges

    @property
    def calls(self) -> DataFrame:
        """Current edges of this kind alone; other rows are let go before their ends are looked up."""
        return current_edges(self.raw("edges").where(F.lower(F.trim("kind")) == "calls"), self.raw("symbols")) if self._edges is None else self._edges.where("kind = 'calls'")

    @property
    def trace(self) -> DataFrame:
        return current_trace(self.raw("call_trace"))

    def located(self, *columns: str) -> DataFrame:
        """Symbols (see symbols) with the path of their file."""
        f = self.files.select(F.col("id").alias("file_id"), "path")
        return self.symbols(*(columns or SYMBOL_COLUMNS[:5]), "file_id").join(f, "file_id")


def needs_reindex(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id, path, needs_reindex): no stored hash, or one that is not that of the text (file_id, content)."""
    now = texts.where("content is not null").select("file_id", F.sha2(F.col("content").cast("binary"), 256).alias("now_hash"))
    f = files.select(F.col("id").alias("file_id"), "path", "hash")
    return f.join(now, "file_id").select("file_id", "path", (~F.col("hash").eqNullSafe(F.col("now_hash"))).alias("needs_reindex"))


def mark_indexed(files: DataFrame, done: DataFrame) -> DataFrame:
    """files with the hashes of done (path, hash) written in; paths that are new get the next ids, in path order.

    Of several hashes of a path the greatest counts. indexed_at is now for the paths of done.
    """
    d = done.where("path is not null").groupBy("path").agg(F.max("hash").alias("new_hash"), F.lit(True).alias("done"))
    kept = files.join(d, "path", "left").select(
        "id", "path", F.when(F.col("done"), F.col("new_hash")).otherwise(F.col("hash")).alias("hash"),
        F.when(F.col("done"), F.current_timestamp()).otherwise(F.col("indexed_at").cast("timestamp")).alias("indexed_at"))
    last = files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    new = balanced_row_number(d.join(files.select("path"), "path", "left_anti"), [], ["path"], "n").join(F.broadcast(last))
    return kept.unionByName(new.select((F.col("last") + F.col("n")).alias("id"), "path", F.col("new_hash").alias("hash"), F.current_timestamp().alias("indexed_at")))


def snapshot_merge(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Symbols of re-read files merged into the stored ones, ids and coverage kept.

    Both have (path, name, kind, line_start, line_end, docstring, import_module, import_name); stored also
    id and coverage_pct. Within a path a row is the same symbol if name, kind, line and its rank among
    equals agree. Vanished rows of the paths that came in are dropped, paths that did not come stay. New
    symbols get the ids after the largest one, in the order of path, line, name and kind.
    """
    ident = ["path", "name", "kind", "line_start"]
    rest = ["line_end", "docstring", "import_module", "import_name"]
    w = Window.partitionBy(*ident)
    old = stored.withColumn("ordinal", F.row_number().over(w.orderBy("id")))
    new = incoming.where("kind <> 'error'").withColumn("ordinal", F.row_number().over(w.orderBy(F.col("line_end"), F.col("docstring"), F.col("import_module"), F.col("import_name"))))
    o = old.select(*[F.col(c).alias("o_" + c) for c in [*ident, "ordinal"]], "id", "coverage_pct")
    on = F.lit(True)
    for c in [*ident, "ordinal"]:
        on = on & F.col(c).eqNullSafe(F.col("o_" + c))
    met = new.select(*ident, *rest, "ordinal").join(o, on, "left").select("id", *ident, *rest, "coverage_pct", "ordinal")
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    added = balanced_row_number(met.where("id is null").drop("id"), [], ["path", "line_start", "name", "kind", "ordinal"], "n").join(F.broadcast(last))
    columns = ["id", *ident, *rest, "coverage_pct"]
    fresh = met.where("id is not null").select(*columns).unionByName(added.withColumn("id", F.col("last") + F.col("n")).select(*columns))
    untouched = stored.join(incoming.select("path").distinct(), "path", "left_anti").select(*columns)
    return untouched.unionByName(fresh)


def delete_files(files: DataFrame, symbols: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files whose path is in gone, their symbols and the edges at these are taken out; traces stay."""
    dead = files.join(gone.select("path").distinct(), "path", "left_semi").select(F.col("id").alias("file_id"))
    dead_symbols = symbols.join(dead, "file_id", "left_semi").select("id")
    left = edges.join(dead_symbols.withColumnRenamed("id", "src_id"), "src_id", "left_anti").join(dead_symbols.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti")
    return (files.join(dead.withColumnRenamed("file_id", "id"), "id", "left_anti"), symbols.join(dead, "file_id", "left_anti"), left)


def rebuild_edges(stored: DataFrame, built: DataFrame) -> DataFrame:
    """calls, imports and inherits are replaced by built; test_covers stay; triples are unique."""
    return stored.where("kind = 'test_covers'").select("src_id", "dst_id", "kind").unionByName(built.select("src_id", "dst_id", "kind")).distinct()


def new_edges(stored: DataFrame, built: DataFrame) -> DataFrame:
    """Triples of built that are not stored yet."""
    return built.select("src_id", "dst_id", "kind").distinct().join(stored, ["src_id", "dst_id", "kind"], "left_anti")


def signature(g: Graph) -> DataFrame:
    """One row: symbols:edges:sum of coverage:latest indexing."""
    n = g.symbols("coverage_pct").agg(F.count(F.lit(1)).alias("n_symbols"), F.round(F.sum("coverage_pct"), 2).alias("coverage_sum"))
    e = g.edges.agg(F.count(F.lit(1)).alias("n_edges"))
    f = g.files.agg(F.max("indexed_at").alias("last_indexed"))
    return n.join(F.broadcast(e)).join(F.broadcast(f))  # three single rows
