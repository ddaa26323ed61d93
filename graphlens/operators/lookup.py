"""Relational questions about symbols, files, coverage and tests.

Every function takes DataFrames of the current graph (see snapshot) and returns one; nothing found
means no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.paths import coverage_band, dirname, file_matches, is_foreign, is_test_path, lines, source_span, span_weight
from graphlens.operators.spans import innermost
from graphlens.session import cut

STRUCTURE = ("calls", "imports", "inherits")


def _ends(edges: DataFrame, located: DataFrame, far: str) -> DataFrame:
    """Edges with name, kind, line and path of one end."""
    cols = [F.col("id").alias(far), "name", F.col("kind").alias("symbol_kind"), "line_start", "path"]
    return edges.join(located.select(*cols), far)


def search_symbol(located: DataFrame, name: str) -> DataFrame:
    return located.where(F.col("name") == name).select("id", "name", "kind", "line_start", "docstring", "path")


def list_symbols(located: DataFrame, file: str | None = None, kind: str | None = None) -> DataFrame:
    out = located.where("kind in ('function', 'class')")
    if file is not None:
        out = out.where(file_matches("path", file))
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    return out.select("id", "name", "kind", "line_start", "path")


def callers(located: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    target = located.where(F.col("name") == name).select(F.col("id").alias("dst_id"))
    hit = edges.where("kind = 'calls'").join(target, "dst_id").select("src_id").distinct()
    return _ends(hit, located, "src_id").select(F.col("src_id").alias("id"), "name", "line_start", "path")


def dependencies(located: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    source = located.where(F.col("name") == name).select(F.col("id").alias("src_id"))
    hit = edges.where("kind in ('calls', 'imports')").join(source, "src_id").select("dst_id", "kind").distinct()
    return _ends(hit, located, "dst_id").select(F.col("dst_id").alias("id"), "name", "kind", "path")


def covering_tests(located: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Distinct names of tests that cover a symbol of that name."""
    target = located.where(F.col("name") == name).select(F.col("id").alias("dst_id"))
    hit = edges.where("kind = 'test_covers'").join(target, "dst_id").select("src_id").distinct()
    return _ends(hit, located, "src_id").select(F.col("name").alias("test")).distinct()


def coverage_of(symbols: DataFrame, name: str) -> DataFrame:
    """One row: coverage of the symbol with the smallest id, null where it was not measured or is unknown."""
    return symbols.where(F.col("name") == name).agg(F.min(F.struct("id", "coverage_pct")).alias("m")).select(F.col("m.coverage_pct").alias("coverage_pct"))


def uncovered(located: DataFrame) -> DataFrame:
    """Measured and never hit; what was not measured is not among them."""
    return located.where("coverage_pct = 0.0").select("id", "name", "path", "line_start")


def never_measured(located: DataFrame) -> DataFrame:
    return located.where("kind in ('function', 'class') and coverage_pct is null").where(~is_test_path("path")).select("id", "name", "path", "line_start")


def orphans(located: DataFrame, edges: DataFrame) -> DataFrame:
    """Definitions outside tests that no edge of any kind touches."""
    touched = edges.select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct()
    d = located.where("kind in ('function', 'class')").where(~is_test_path("path"))
    return d.join(touched, "id", "left_anti").select("id", "name", "path", "line_start")


def coverage_bands(located: DataFrame) -> DataFrame:
    return located.groupBy(coverage_band("coverage_pct").alias("band")).agg(F.count(F.lit(1)).alias("n"))


def outline(located: DataFrame, texts: DataFrame, fragment: str) -> DataFrame:
    """Functions and classes of the best matching file (shortest path, then first) with their signature line."""
    best = located.where(file_matches("path", fragment)).agg(F.min(F.struct(F.length("path"), F.col("path"))).alias("b")).select(F.col("b.path").alias("path"))
    rows = located.where("kind in ('function', 'class')").join(best, "path")
    src = texts.where("content is not null").select("file_id", lines("content").alias("_lines"))
    text = F.when(F.col("line_start").between(1, F.size("_lines")), F.trim(F.element_at("_lines", F.col("line_start").cast("int"))))
    return rows.join(src, "file_id", "left").select("id", "name", "kind", "line_start", "line_end", "docstring", text.alias("signature"))


def sources(located: DataFrame, texts: DataFrame, name: str | None = None) -> DataFrame:
    """(id, name, path, line_start, line_end, code) of symbols that have a line and a text."""
    rows = located.where("line_start is not null")
    if name is not None:
        rows = rows.where(F.col("name") == name)
    src = texts.where("content is not null").select("file_id", lines("content").alias("_lines"))
    end = F.coalesce("line_end", "line_start")
    return rows.join(src, "file_id").select("id", "name", "path", "line_start", end.alias("line_end"), source_span("_lines", "line_start", end).alias("code"))


def symbols_per_file(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files without a symbol count 0."""
    n = symbols.groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return files.select("id", "path").join(n, "id", "left").select("path", F.coalesce("n", F.lit(0).cast("long")).alias("symbols"))


def degrees(edges: DataFrame, kinds: tuple[str, ...] = STRUCTURE) -> DataFrame:
    """(id, degree): both ends counted, an edge to itself counts twice."""
    return edges.where(F.col("kind").isin(*kinds)).select(F.explode(F.array("src_id", "dst_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def hubs(located: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """The symbols of highest degree; ties are settled by name.

    Only symbols at or above the degree of the last place are looked up. Where some of them have no
    file, so that too few are left, all are.
    """
    d = cut(degrees(edges))
    names = located.select("id", "name", "path")
    least = d.orderBy(F.desc("degree")).limit(limit).agg(F.min("degree").alias("least"))
    top = cut(d.join(F.broadcast(least), F.col("degree") >= F.col("least")).select("id", "degree").join(names, "id"))
    if top.count() < limit:
        top = d.join(names, "id")
    return top.orderBy(F.desc("degree"), "name", "id").limit(limit)


def uncalled(located: DataFrame, edges: DataFrame) -> DataFrame:
    """Definitions that nothing calls and that are not named like tests."""
    called = edges.where("kind = 'calls'").select(F.col("dst_id").alias("id")).distinct()
    d = located.where("kind in ('function', 'class')").where(~F.col("name").startswith("test_"))
    return d.join(called, "id", "left_anti").select("id", "name", "path")


def module_coverage(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, coverage_pct): weighted by span over all kinds; null where nothing was measured."""
    w = F.when(F.col("coverage_pct").isNotNull(), span_weight("line_start", "line_end"))
    m = symbols.groupBy(F.col("file_id").alias("id")).agg((F.sum(F.col("coverage_pct") * w) / F.sum(w)).alias("coverage_pct"))
    return files.select("id", "path").join(m, "id", "left").select("path", "coverage_pct")


def covers_per_test(located: DataFrame, edges: DataFrame) -> DataFrame:
    n = edges.where("kind = 'test_covers'").groupBy(F.col("src_id").alias("id")).agg(F.count(F.lit(1)).alias("covers"))
    return n.join(located.select("id", "name", "path"), "id")


def covered_names(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    ids = edges.where("kind = 'test_covers'").select(F.col("dst_id").alias("id")).distinct()
    return symbols.join(ids, "id", "left_semi").select("name").distinct()


def calls_per_test(trace: DataFrame) -> DataFrame:
    return trace.groupBy("test").agg(F.count(F.lit(1)).alias("calls"))


def trace_view(trace: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (test, id, first_seq, depth) and edges (test, seq, src_id, dst_id).

    A source is seen with its event, one level above it; the depth of a node is the least seen.
    """
    src = trace.where("src_id is not null").select("test", F.col("src_id").alias("id"), "seq", F.greatest(F.lit(0), F.col("depth") - 1).alias("depth"))
    dst = trace.where("dst_id is not null").select("test", F.col("dst_id").alias("id"), "seq", "depth")
    nodes = src.unionByName(dst).groupBy("test", "id").agg(F.min("seq").alias("first_seq"), F.min("depth").alias("depth"))
    return nodes, trace.where("src_id is not null and dst_id is not null").select("test", "seq", "src_id", "dst_id")


def trace_transitions(trace: DataFrame) -> DataFrame:
    """(src_id, dst_id, n): how often each caller was seen calling each callee, over all tests."""
    return trace.where("src_id is not null and dst_id is not null").groupBy("src_id", "dst_id").agg(F.count(F.lit(1)).alias("n"))


def class_methods(symbols: DataFrame) -> DataFrame:
    """(method_id, class_id): innermost class that starts before the function and ends no earlier than its line."""
    f = symbols.where("kind = 'function' and line_start is not null").select(F.col("id").alias("method_id"), "file_id", F.col("line_start").alias("at"))
    c = symbols.where("kind = 'class' and line_start is not null").select(
        F.col("id").alias("class_id"), "file_id", (F.col("line_start") + 1).alias("start"), F.coalesce("line_end", "line_start").alias("end"))
    return innermost(f, c, "file_id", "at", "method_id", "class_id")


def public_api(located: DataFrame) -> DataFrame:
    """Classes and functions outside classes whose name does not start with an underscore."""
    methods = class_methods(located).select(F.col("method_id").alias("id"))
    d = located.where("kind in ('function', 'class')").where(~F.col("name").startswith("_"))
    return d.where("kind = 'class'").unionByName(d.where("kind = 'function'").join(methods, "id", "left_anti").select(*d.columns)).select("id", "name", "kind", "path")


def class_view(located: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes with their methods (name order), and inherits edges between classes."""
    names = located.select(F.col("id").alias("method_id"), F.col("name").alias("method"))
    m = class_methods(located).join(names, "method_id").groupBy(F.col("class_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("method", "method_id"))).alias("methods"))
    classes = located.where("kind = 'class'").select("id", "name", "path")
    ids = classes.select("id")
    inherits = edges.where("kind = 'inherits'").join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    return classes.join(m, "id", "left"), inherits.select("src_id", "dst_id")


def module_map(located: DataFrame, files: DataFrame, edges: DataFrame, level: str = "file") -> tuple[DataFrame, DataFrame]:
    """Nodes (module, symbols, files) and links (source, target, weight) between files or packages."""
    if level not in ("file", "package"):
        raise ValueError(f"bad level: {level}")
    group = F.col("path") if level == "file" else dirname("path")
    n = located.groupBy(group.alias("module")).agg(F.count(F.lit(1)).alias("symbols"))
    f = files.groupBy(group.alias("module")).agg(F.count(F.lit(1)).alias("files"))
    nodes = f.join(n, "module", "left").select("module", F.coalesce("symbols", F.lit(0).cast("long")).alias("symbols"), "files")
    side = located.select("id", group.alias("module"))
    e = edges.where(F.col("kind").isin(*STRUCTURE))
    pairs = e.join(side.select(F.col("id").alias("src_id"), F.col("module").alias("source")), "src_id").join(
        side.select(F.col("id").alias("dst_id"), F.col("module").alias("target")), "dst_id")
    return nodes, pairs.where("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def graph_nodes(located: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of the whole-graph view: degree, coverage band, foreign flag."""
    return located.join(degrees(edges), "id", "left").select(
        "id", "name", "kind", "path", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"), coverage_band("coverage_pct").alias("band"), is_foreign("kind").alias("is_foreign"))


def index_summary(files: DataFrame, symbols: DataFrame, language: DataFrame) -> DataFrame:
    """(lang, files, symbols): language has (ext, lang)."""
    f = files.select(F.col("id").alias("file_id"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext")).join(F.broadcast(language), "ext")
    n = symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return f.join(n, "file_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("symbols"))


def package_rollup(located: DataFrame) -> DataFrame:
    """Symbols per package and file, with subtotals (null: all)."""
    return located.select(dirname("path").alias("package"), "path").rollup("package", "path").agg(F.count(F.lit(1)).alias("symbols"))
