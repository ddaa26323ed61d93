"""From source trees and test runs to the tables of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.operators import coverage as cov
from graphlens.operators import resolve as rs
from graphlens.operators.lookup import index_summary
from graphlens.operators.snapshot import delete_files, needs_reindex, rebuild_edges
from graphlens.session import cut, ship
from graphlens.sources import reports
from graphlens.sources.extract import BY_EXTENSION, extract, fact_tables
from graphlens.sources.tree import project_root, scan_tree
from graphlens.store import Store

def _step():
    return F.when(F.col("marker") == "main", 0).when(F.col("marker") == "main_guard", 1).otherwise(2).alias("step")


def markers(facts: dict[str, DataFrame], symbols: DataFrame, files: DataFrame, scripts: DataFrame | None = None) -> DataFrame:
    """(id, marker, step) of entry points: main, guard and decorator (steps 0 to 2), console scripts (3).

    scripts has (module, function). A name called in a guard must be the only definition of the name; a
    script's function must be too, or else the only one in a file that its module names.
    """
    at = symbols.where("kind = 'function'").groupBy("file_id", "name", F.col("line_start").alias("line")).agg(F.min("id").alias("id"))
    m = facts["markers"]
    placed = m.where("marker <> 'main_guard'").join(at, ["file_id", "name", "line"]).select("id", "marker", _step())
    only = rs.definition_index(symbols, False).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
    guards = m.where("marker = 'main_guard'").join(only, "name").select("id", "marker", _step())
    out = placed.unionByName(guards)
    if scripts is not None:
        out = out.unionByName(script_targets(scripts, symbols, files).select("id", F.lit("console_script").alias("marker"), F.lit(3).alias("step")))
    return out.distinct()


def script_targets(scripts: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(module, function, id): what console scripts (module, function) start; unresolved ones are absent."""
    refs = scripts.select("module", "function").distinct().withColumn("original", F.col("function"))
    got = rs.resolve_imports(refs, rs.definition_index(symbols, False), files)
    return got.where("dst_id is not null").select("module", "function", F.col("dst_id").alias("id"))


def manifest_scripts(spark: SparkSession, root: str) -> DataFrame:
    """(source, script, module, function) of the manifests at the project's root."""
    lines = None
    for name in ("pyproject.toml", "setup.cfg"):
        try:
            raw = spark.read.text(f"{root}/{name}", wholetext=True)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        part = raw.select(F.lit(name).alias("source"), F.posexplode(F.split("value", "\r?\n")).alias("n", "text"))
        lines = part if lines is None else lines.unionByName(part)
    if lines is None:
        return spark.createDataFrame([], "source string, script string, module string, function string")
    return reports.console_scripts(lines)


def _build(store: Store, facts: dict[str, DataFrame]) -> dict[str, int]:
    """Edges and data flow of all files from their facts; counters of how calls were resolved."""
    g = store.graph
    files = g.files
    symbols = cut(g.symbols("file_id", "name", "kind", "line_start", "line_end", "import_module", "import_name"))
    calls = cut(rs.call_edges(facts["calls"], facts["assigns"], symbols, files))
    built = rs.edges_of_calls(calls).unionByName(rs.import_edges(symbols, files)[0]).unionByName(rs.inherit_edges(facts["bases"], symbols, files)).distinct()
    written = store.write_edges(rebuild_edges(g.edges, built))
    python = files.where(F.col("path").endswith(".py")).select(F.col("id").alias("file_id"))
    flows = rs.build_dataflow(facts["calls"].join(python, "file_id", "left_semi"), facts["params"], symbols, files)
    store.write("dataflow", flows)
    return {r.status: r.n for r in rs.status_counts(calls).collect()} | {"edges": written, "flows": store.read("dataflow").count()}


def _extract_all(store: Store) -> dict[str, DataFrame]:
    paths = store.graph.files.select(F.col("id").alias("file_id"), "path")
    return fact_tables(cut(extract(store.read("file_text").join(paths, "file_id"), foreign=True)))


def index_tree(spark: SparkSession, root: str, store: Store, extra_ignores: list[str] | None = None) -> dict:
    """Scan root, extract, resolve, write; a summary of counts. Bytes that are no UTF-8 are skipped and counted."""
    ship(spark)
    store.create()
    scan = cut(scan_tree(spark, root, extra_ignores=extra_ignores))
    texts = scan.where("content is not null")
    gone = store.graph.files.join(scan.select("path"), "path", "left_anti").select("path")
    if not gone.isEmpty():
        delete(store, gone)
    store.write_files(texts.select("path", "hash", "content"))
    facts = _extract_all(store)
    n = store.write_symbols(facts["symbols"])
    counters = _build(store, facts)
    g = store.graph
    symbols = g.symbols("file_id", "name", "kind", "line_start")
    store.write("markers", markers(facts, symbols, g.files, manifest_scripts(spark, root)))
    language = spark.createDataFrame(list(BY_EXTENSION.items()), "ext string, lang string")
    by_language = {r.lang: r.symbols for r in index_summary(g.files, symbols, language).collect()}
    foreign = symbols.where("kind in ('foreign_module', 'foreign_export')").count()
    return {"files": scan.count(), "symbols": n - foreign, "skipped": scan.where("content is null").count(), "foreign": foreign, "by_language": by_language} | counters


def delete(store: Store, paths: DataFrame) -> None:
    """Take out files (path), their texts and symbols, and the edges and flows at these; traces stay."""
    g = store.graph
    gone = cut(paths.select("path").distinct())
    columns = ("file_id", "name", "kind", "line_start", "line_end", "docstring", "coverage_pct", "import_module", "import_name")
    files, symbols, edges = (cut(x) for x in delete_files(g.files, store.read("symbols").join(g.symbols("file_id").select("id"), "id", "left_semi"), g.edges, gone))
    texts = cut(store.read("file_text").join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi"))
    flows = store.read("dataflow")
    for side in ("src_id", "dst_id"):
        flows = flows.join(symbols.select(F.col("id").alias(side)).distinct(), side, "left_semi")
    flows = cut(flows)
    for name, df in (("files", files), ("symbols", symbols.select("id", *columns, "written_at")), ("file_text", texts), ("dataflow", flows)):
        store.write(name, df)
    store.write_edges(edges)


def reindex(store: Store, changed: DataFrame) -> dict:
    """Take in new texts (path, content, hash) of changed files; those whose hash is known are left alone. Edges of all files follow."""
    known = store.graph.files.select("path", F.col("hash").alias("known"))
    texts = cut(changed.where("content is not null").join(known, "path", "left").where(~F.col("hash").eqNullSafe(F.col("known"))).select("path", "hash", "content"))
    n = texts.count()
    if n == 0:
        return {"files": 0}
    store.write_files(texts)
    facts = _extract_all(store)
    fresh = store.graph.files.join(texts.select("path"), "path", "left_semi").select(F.col("id").alias("file_id"))
    store.write_symbols(facts["symbols"].join(fresh, "file_id", "left_semi"))
    return {"files": n} | _build(store, facts)


def stale_files(store: Store) -> DataFrame:
    """(file_id, path) of files whose text is not the one that was indexed."""
    return needs_reindex(store.graph.files, store.read("file_text")).where("needs_reindex").select("file_id", "path")


def handle_changes(store: Store):
    """For streaming.watch: micro-batches of (path, content, hash, deleted) go into the store; the last state of a path counts."""

    def handle(batch: DataFrame, _: int) -> None:
        rows = cut(batch)
        delete(store, rows.where("deleted").select("path"))
        reindex(store, rows.where("not deleted").select("path", "content", "hash"))

    return handle


def ingest_coverage(store: Store, path: str, form: str = "lcov", reset: bool = True) -> int:
    """Write the coverage of a report onto the symbols; gives the number of files in the report."""
    lines = cut(reports.parse_coverage(store.spark, path, form))
    g = store.graph
    own = store.read("symbols").join(g.symbols("file_id").select("id"), "id", "left_semi")
    merged = cov.apply_coverage(own, cov.file_line_coverage(lines, g.files), reset)
    store.write("symbols", cut(merged))
    return lines.select("report").distinct().count()


def ingest_logic_paths(store: Store, path: str) -> int:
    """Write test_covers edges from a database of per-test contexts; gives how many are new."""
    g = store.graph
    hits = cut(reports.read_contexts(store.spark, path))
    covers = cov.map_tests(hits, g.symbols(), g.files)
    return store.write_edges(cut(g.edges.unionByName(covers).distinct()))


def ingest_trace(store: Store, path: str) -> int:
    """Write a runtime trace; tests that are in it replace their earlier events. Gives the number of events that were placed."""
    g = store.graph
    events = cut(cov.ingest_trace(reports.read_traces(store.spark, path), g.symbols(), g.files))
    store.write_trace(events)
    return events.count()


def project_name(files: DataFrame) -> str:
    """Last part of the directory that all files share; the common start of the first and the last path tells it."""
    r = files.agg(F.min("path").alias("a"), F.max("path").alias("b")).first()
    if r.a is None:
        return ""
    a, b = r.a.split("/")[:-1], r.b.split("/")[:-1]
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[n - 1] if n else ""


__all__ = ["delete", "handle_changes", "index_tree", "ingest_coverage", "ingest_logic_paths", "ingest_trace", "manifest_scripts", "markers", "project_name", "project_root", "reindex", "script_targets", "stale_files"]
