"""Queries of the code graph, with their SQL.

Questions about one symbol ask about the one that most calls go to (smallest id on ties); traversals
start at the smallest symbol that calls another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions.paths import is_test_code, lines, sha256_hex
from graphlens.operators import algorithms as alg
from graphlens.operators import coverage as cov
from graphlens.operators import lookup as lk
from graphlens.operators import rank as rk
from graphlens.operators import resolve as rs
from graphlens.operators import snapshot as sn
from graphlens.operators import traverse as tr
from graphlens.operators.snapshot import Graph
from graphlens.session import cut, parallel, table
from graphlens.streaming.changes import debounced, windowed_counts

QUERIES: dict = {}
SQL: dict[str, str] = {}

_G = """
WITH RECURSIVE f AS (SELECT id, min(path) AS path FROM files WHERE id IS NOT NULL AND path IS NOT NULL GROUP BY id),
s AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY written_at DESC NULLS LAST, file_id DESC NULLS LAST,
  name DESC NULLS LAST, kind DESC NULLS LAST, line_start DESC NULLS LAST, line_end DESC NULLS LAST, coverage_pct DESC NULLS LAST,
  import_module DESC NULLS LAST, import_name DESC NULLS LAST, docstring DESC NULLS LAST) AS rn FROM symbols WHERE id IS NOT NULL) WHERE rn = 1),
l AS (SELECT s.*, f.path FROM s JOIN f ON f.id = s.file_id),
e AS (SELECT DISTINCT src_id, dst_id, lower(trim(kind)) AS kind FROM edges
  WHERE src_id IN (SELECT id FROM symbols) AND dst_id IN (SELECT id FROM symbols)),
t AS (SELECT DISTINCT test, seq, depth, src_id, dst_id, called_at FROM call_trace),
d AS (SELECT * FROM l WHERE kind IN ('function', 'class')),
hot AS (SELECT name FROM s WHERE id = (SELECT dst_id FROM e WHERE kind = 'calls' GROUP BY 1 ORDER BY count(*) DESC, dst_id LIMIT 1)),
root AS (SELECT min(src_id) AS id FROM e WHERE kind = 'calls')
"""
_IS_TEST = """(split_part(path, '/', -1) LIKE 'test\\_%' ESCAPE '\\' OR split_part(path, '/', -1) LIKE '%\\_test.py' ESCAPE '\\'
  OR list_has_any(string_split(path, '/')[:-2], ['tests', 'test']))"""


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _hot_name(g: Graph) -> str:
    top = g.edges.where("kind = 'calls'").groupBy("dst_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst_id").limit(1)
    row = g.symbols("name").join(top.withColumnRenamed("dst_id", "id"), "id").select("name").first()
    return row.name if row else ""


def _root(g: Graph) -> DataFrame:
    return g.edges.where("kind = 'calls'").agg(F.min("src_id").alias("id"))


# ---- relational

@query("search_symbol", _G + "SELECT id, name, kind, line_start, docstring, path FROM l WHERE name = (SELECT name FROM hot)")
def search_symbol(spark, d):
    g = Graph(spark, d)
    return lk.search_symbol(g.located("name", "kind", "line_start", "docstring"), _hot_name(g))


@query("list_symbols", _G + "SELECT id, name, kind, line_start, path FROM d WHERE path ILIKE '%.py' AND kind = 'class'")
def list_symbols(spark, d):
    return lk.list_symbols(Graph(spark, d).located(), ".py", "class")


@query("get_callers", _G + "SELECT DISTINCT l.id, l.name, l.line_start, l.path FROM e JOIN s x ON x.id = e.dst_id JOIN l ON l.id = e.src_id WHERE e.kind = 'calls' AND x.name = (SELECT name FROM hot)")
def get_callers(spark, d):
    g = Graph(spark, d)
    return lk.callers(g.located(), g.edges, _hot_name(g))


@query("get_dependencies", _G + "SELECT DISTINCT l.id, l.name, e.kind, l.path FROM e JOIN s x ON x.id = e.src_id JOIN l ON l.id = e.dst_id WHERE e.kind IN ('calls', 'imports') AND x.name = (SELECT name FROM hot)")
def get_dependencies(spark, d):
    g = Graph(spark, d)
    return lk.dependencies(g.located(), g.edges, _hot_name(g))


@query("get_test_coverage", _G + "SELECT DISTINCT l.name AS test FROM e JOIN s x ON x.id = e.dst_id JOIN l ON l.id = e.src_id WHERE e.kind = 'test_covers' AND x.name = (SELECT name FROM hot)")
def get_test_coverage(spark, d):
    g = Graph(spark, d)
    return lk.covering_tests(g.located(), g.edges, _hot_name(g))


@query("get_coverage", _G + "SELECT arg_min_null(coverage_pct, id) AS coverage_pct FROM s WHERE name = (SELECT name FROM hot)")
def get_coverage(spark, d):
    g = Graph(spark, d)
    return lk.coverage_of(g.symbols("name", "coverage_pct"), _hot_name(g))


@query("uncovered_paths", _G + "SELECT id, name, path, line_start FROM l WHERE coverage_pct = 0.0")
def uncovered_paths(spark, d):
    return lk.uncovered(Graph(spark, d).located("name", "line_start", "coverage_pct"))


@query("never_measured", _G + f"SELECT id, name, path, line_start FROM d WHERE coverage_pct IS NULL AND NOT {_IS_TEST}")
def never_measured(spark, d):
    return lk.never_measured(Graph(spark, d).located("name", "kind", "line_start", "coverage_pct"))


@query("orphans", _G + f"SELECT id, name, path, line_start FROM d WHERE NOT {_IS_TEST} AND id NOT IN (SELECT src_id FROM e UNION SELECT dst_id FROM e)")
def orphans(spark, d):
    g = Graph(spark, d)
    return lk.orphans(g.located(), g.edges)


_BAND = "CASE WHEN coverage_pct IS NULL THEN 'none' WHEN coverage_pct <= 0 THEN 'uncovered' WHEN coverage_pct < 50 THEN 'low' WHEN coverage_pct < 80 THEN 'partial' WHEN coverage_pct < 100 THEN 'high' ELSE 'covered' END"


@query("coverage_band", _G + f"SELECT {_BAND} AS band, count(*) AS n FROM l GROUP BY 1")
def coverage_bands(spark, d):
    return lk.coverage_bands(Graph(spark, d).located("coverage_pct"))


@query("outline", _G + """, fl AS (SELECT file_id, regexp_split_to_array(content, '\\r\\n|\\r|\\n') AS ls FROM file_text WHERE content IS NOT NULL)
SELECT d.id, name, kind, line_start, line_end, docstring,
  CASE WHEN line_start BETWEEN 1 AND len(ls) - CASE WHEN ls[-1] = '' THEN 1 ELSE 0 END THEN trim(ls[line_start], ' ') END AS signature
FROM d LEFT JOIN fl ON fl.file_id = d.file_id
WHERE path = (SELECT path FROM l WHERE path ILIKE '%graph.py' ORDER BY length(path), path LIMIT 1)""")
def outline(spark, d):
    g = Graph(spark, d)
    return lk.outline(g.located("name", "kind", "line_start", "line_end", "docstring"), table(spark, d, "file_text"), "graph.py")


@query("source_span", _G + """, fl AS (SELECT file_id, CASE WHEN r[-1] = '' THEN r[:-2] ELSE r END AS ls FROM (SELECT file_id, regexp_split_to_array(content, '\\r\\n|\\r|\\n') AS r FROM file_text WHERE content IS NOT NULL))
SELECT id, name, path, line_start, coalesce(line_end, line_start) AS line_end, array_to_string(ls[line_start:coalesce(line_end, line_start)], chr(10)) AS code
FROM l JOIN fl USING (file_id) WHERE line_start IS NOT NULL""")
def source_span(spark, d):
    g = Graph(spark, d)
    return lk.sources(g.located(), table(spark, d, "file_text"))


@query("module_symbol_counts", _G + "SELECT f.path, count(s.id) AS symbols FROM f LEFT JOIN s ON s.file_id = f.id GROUP BY f.id, f.path")
def module_symbol_counts(spark, d):
    g = Graph(spark, d)
    return lk.symbols_per_file(g.files, g.symbols("file_id"))


_DEG = "SELECT id, count(*) AS degree FROM (SELECT unnest([src_id, dst_id]) AS id FROM e WHERE kind IN ('calls', 'imports', 'inherits')) GROUP BY 1"


@query("symbol_degree", _G + _DEG)
def symbol_degree(spark, d):
    return lk.degrees(Graph(spark, d).edges)


@query("hubs", _G + f"SELECT id, degree, name, path FROM ({_DEG}) JOIN l USING (id) ORDER BY degree DESC, name, id LIMIT 10")
def hubs(spark, d):
    g = Graph(spark, d)
    return lk.hubs(g.located(), g.edges).select("id", "degree", "name", "path")


@query("entry_points_no_inbound", _G + "SELECT id, name, path FROM d WHERE NOT starts_with(name, 'test_') AND id NOT IN (SELECT dst_id FROM e WHERE kind = 'calls')")
def entry_points_no_inbound(spark, d):
    g = Graph(spark, d)
    return lk.uncalled(g.located(), g.edges)


_SPAN = "CASE WHEN line_start IS NULL THEN 1 ELSE greatest(coalesce(line_end, line_start) - line_start + 1, 1) END"


@query("module_coverage", _G + f"SELECT f.path, round(sum(coverage_pct * {_SPAN}) / sum(CASE WHEN coverage_pct IS NOT NULL THEN {_SPAN} END), 6) AS coverage_pct FROM f LEFT JOIN s ON s.file_id = f.id GROUP BY f.id, f.path")
def module_coverage(spark, d):
    g = Graph(spark, d)
    return lk.module_coverage(g.files, g.symbols("file_id", "line_start", "line_end", "coverage_pct")).select("path", F.round("coverage_pct", 6).alias("coverage_pct"))


@query("covers_per_test", _G + "SELECT l.id, covers, name, path FROM (SELECT src_id AS id, count(*) AS covers FROM e WHERE kind = 'test_covers' GROUP BY 1) JOIN l USING (id)")
def covers_per_test(spark, d):
    g = Graph(spark, d)
    return lk.covers_per_test(g.located(), g.edges).select("id", "covers", "name", "path")


@query("covered_names", _G + "SELECT DISTINCT name FROM s WHERE id IN (SELECT dst_id FROM e WHERE kind = 'test_covers')")
def covered_names(spark, d):
    g = Graph(spark, d)
    return lk.covered_names(g.symbols("name"), g.edges)


@query("trace_list", _G + "SELECT test, count(*) AS calls FROM t GROUP BY 1")
def trace_list(spark, d):
    return lk.calls_per_test(Graph(spark, d).trace)


@query("trace_view", _G + """SELECT test, id, min(seq) AS first_seq, min(depth) AS depth FROM (
  SELECT test, src_id AS id, seq, greatest(0, depth - 1) AS depth FROM t WHERE src_id IS NOT NULL UNION ALL SELECT test, dst_id, seq, depth FROM t WHERE dst_id IS NOT NULL) GROUP BY 1, 2""")
def trace_view(spark, d):
    return lk.trace_view(Graph(spark, d).trace)[0]


@query("trace_edges", _G + "SELECT test, seq, src_id, dst_id FROM t WHERE src_id IS NOT NULL AND dst_id IS NOT NULL")
def trace_edges(spark, d):
    return lk.trace_view(Graph(spark, d).trace)[1]


@query("trace_transitions", _G + "SELECT src_id, dst_id, count(*) AS n FROM t WHERE src_id IS NOT NULL AND dst_id IS NOT NULL GROUP BY 1, 2")
def trace_transitions(spark, d):
    return lk.trace_transitions(Graph(spark, d).trace)


_METHODS = """, cm AS (SELECT method_id, class_id FROM (SELECT m.id AS method_id, c.id AS class_id, row_number() OVER (PARTITION BY m.id
  ORDER BY coalesce(c.line_end, c.line_start) - c.line_start, c.id) AS k FROM s m JOIN s c ON c.file_id = m.file_id AND c.kind = 'class'
  AND c.line_start < m.line_start AND m.line_start <= coalesce(c.line_end, c.line_start) WHERE m.kind = 'function') WHERE k = 1)
"""


@query("class_methods_innermost", _G + _METHODS + "SELECT method_id, class_id FROM cm")
def class_methods_innermost(spark, d):
    return lk.class_methods(Graph(spark, d).symbols())


@query("public_api", _G + _METHODS + "SELECT id, name, kind, path FROM d WHERE NOT starts_with(name, '_') AND (kind = 'class' OR id NOT IN (SELECT method_id FROM cm))")
def public_api(spark, d):
    return lk.public_api(Graph(spark, d).located())


@query("class_view_flat", _G + _METHODS + "SELECT c.id, c.name, c.path, m.name AS method, m.id AS method_id FROM l c JOIN cm ON cm.class_id = c.id JOIN l m ON m.id = cm.method_id WHERE c.kind = 'class'")
def class_view_flat(spark, d):
    g = Graph(spark, d)
    classes, _ = lk.class_view(g.located(), g.edges)
    return classes.select("id", "name", "path", F.explode("methods").alias("m")).select("id", "name", "path", "m.method", "m.method_id")


@query("class_inherits", _G + "SELECT e.src_id, e.dst_id FROM e JOIN l a ON a.id = src_id AND a.kind = 'class' JOIN l b ON b.id = dst_id AND b.kind = 'class' WHERE e.kind = 'inherits'")
def class_inherits(spark, d):
    g = Graph(spark, d)
    return lk.class_view(g.located(), g.edges)[1]


_DIR = "CASE WHEN regexp_extract({0}, '^(.*)/[^/]*$', 1) = '' THEN '.' ELSE regexp_extract({0}, '^(.*)/[^/]*$', 1) END"


@query("module_links", _G + "SELECT a.path AS source, b.path AS target, count(*) AS weight FROM e JOIN l a ON a.id = src_id JOIN l b ON b.id = dst_id WHERE e.kind <> 'test_covers' AND a.path <> b.path GROUP BY 1, 2")
def module_links(spark, d):
    g = Graph(spark, d)
    return lk.module_map(g.located(), g.files, g.edges)[1]


@query("package_links", _G + f"SELECT {_DIR.format('a.path')} AS source, {_DIR.format('b.path')} AS target, count(*) AS weight FROM e JOIN l a ON a.id = src_id JOIN l b ON b.id = dst_id WHERE e.kind <> 'test_covers' AND {_DIR.format('a.path')} <> {_DIR.format('b.path')} GROUP BY 1, 2")
def package_links(spark, d):
    g = Graph(spark, d)
    return lk.module_map(g.located(), g.files, g.edges, "package")[1]


@query("package_map", _G + f"""SELECT module, CAST(coalesce(sum(n), 0) AS BIGINT) AS symbols, count(*) AS files FROM (SELECT {_DIR.format('f.path')} AS module, (SELECT count(*) FROM s WHERE s.file_id = f.id) AS n FROM f) GROUP BY 1""")
def package_map(spark, d):
    g = Graph(spark, d)
    return lk.module_map(g.located(), g.files, g.edges, "package")[0]


@query("package_rollup", _G + f"SELECT {_DIR.format('path')} AS package, path, count(*) AS symbols FROM l GROUP BY ROLLUP (1, 2)")
def package_rollup(spark, d):
    return lk.package_rollup(Graph(spark, d).located())


@query("build_graph_nodes", _G + f"SELECT id, name, kind, path, coalesce(degree, 0) AS degree, {_BAND} AS band, kind IN ('foreign_module', 'foreign_export') AS is_foreign FROM l LEFT JOIN ({_DEG}) USING (id)")
def build_graph_nodes(spark, d):
    g = Graph(spark, d)
    return lk.graph_nodes(g.located("name", "kind", "coverage_pct"), g.edges)


@query("index_summary", _G + """SELECT lang, count(*) AS files, CAST(sum(n) AS BIGINT) AS symbols FROM (SELECT CASE WHEN x IN ('py', 'pyi') THEN 'python' WHEN x = 'rs' THEN 'rust' WHEN x IN ('ts', 'tsx', 'mts', 'cts') THEN 'typescript' WHEN x IN ('js', 'jsx', 'mjs', 'cjs') THEN 'javascript' END AS lang, n
  FROM (SELECT lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS x, (SELECT count(*) FROM s WHERE s.file_id = f.id) AS n FROM f)) WHERE lang IS NOT NULL GROUP BY 1""")
def index_summary(spark, d):
    from graphlens.sources.extract import BY_EXTENSION

    g = Graph(spark, d)
    return lk.index_summary(g.files, g.symbols("file_id"), spark.createDataFrame(list(BY_EXTENSION.items()), "ext string, lang string"))


@query("graph_signature", _G + "SELECT (SELECT count(*) FROM s) AS n_symbols, (SELECT round(sum(coverage_pct), 2) FROM s) AS coverage_sum, (SELECT count(*) FROM e) AS n_edges, (SELECT max(indexed_at) FROM files WHERE path IS NOT NULL) AS last_indexed")
def graph_signature(spark, d):
    return sn.signature(Graph(spark, d))


@query("file_hash", "SELECT file_id, sha256(content) AS hash FROM file_text WHERE content IS NOT NULL")
def file_hash(spark, d):
    return table(spark, d, "file_text").where("content is not null").select("file_id", sha256_hex("content").alias("hash"))


@query("needs_reindex", """WITH h AS (SELECT id, min(path) AS path, arg_max_null(hash, (coalesce(indexed_at, TIMESTAMP '1900-01-01'), coalesce(hash, ''))) AS hash FROM files WHERE path IS NOT NULL GROUP BY id)
SELECT file_id, path, hash IS DISTINCT FROM sha256(content) AS needs_reindex FROM h JOIN file_text ON file_id = id WHERE content IS NOT NULL""")
def needs_reindex(spark, d):
    return sn.needs_reindex(Graph(spark, d).files, table(spark, d, "file_text"))


@query("delete_cascade", _G + """SELECT src_id, dst_id, kind FROM e WHERE src_id NOT IN (SELECT id FROM l WHERE path LIKE '%.rs') AND dst_id NOT IN (SELECT id FROM l WHERE path LIKE '%.rs')""")
def delete_cascade(spark, d):
    g = Graph(spark, d)
    gone = g.files.where(F.col("path").endswith(".rs")).select("path")
    return sn.delete_files(g.files, g.symbols("file_id"), g.edges, gone)[2]


@query("doc_lines", "SELECT doc_id, CASE WHEN r[-1] = '' THEN len(r) - 1 ELSE len(r) END AS n_lines FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS r FROM documents WHERE text IS NOT NULL)")
def doc_lines(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(lines("text")).alias("n_lines"))


@query("test_code", _G + f"SELECT id, ({_IS_TEST}) OR starts_with(name, 'test_') OR name = 'test' AS is_test FROM l")
def test_code(spark, d):
    return Graph(spark, d).located().select("id", is_test_code("name", "path").alias("is_test"))


# ---- resolution

@query("resolve_def", _G + """, g AS (SELECT name, count(*) AS n, min(id) AS id FROM s WHERE kind IN ('function', 'class', 'foreign_export') GROUP BY 1),
k AS (SELECT name, file_id, count(*) AS n, min(id) AS id FROM s WHERE kind IN ('function', 'class', 'foreign_export') GROUP BY 1, 2)
SELECT s.id AS ref, s.name, s.file_id, CASE WHEN g.n = 1 THEN g.id WHEN k.n = 1 THEN k.id END AS dst_id,
  CASE WHEN g.n = 1 THEN 'unique' WHEN k.n = 1 THEN 'same_file' WHEN g.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status
FROM s LEFT JOIN g ON g.name = s.name LEFT JOIN k ON k.name = s.name AND k.file_id = s.file_id""")
def resolve_def(spark, d):
    s = Graph(spark, d).symbols("file_id", "name", "kind")
    return rs.resolve_names(s.select(F.col("id").alias("ref"), "name", "file_id"), rs.definition_index(s)).select("ref", "name", "file_id", "dst_id", "status")


_IMPORTS = """, df AS (SELECT id, name, file_id FROM s WHERE kind IN ('function', 'class', 'foreign_export')),
mp AS (SELECT id AS file_id, list_filter(string_split(regexp_replace(regexp_replace(path, '\\.pyi?$', ''), '/__init__$', ''), '/'), lambda x: x <> '') AS ps FROM f),
mk AS (SELECT file_id, array_to_string(ps[i:], '/') AS key FROM mp, unnest(range(1, len(ps) + 1)) AS u(i)),
g AS (SELECT name, count(*) AS n, min(id) AS id FROM df GROUP BY 1),
m AS (SELECT name, key, count(*) AS n, min(id) AS id FROM df JOIN mk USING (file_id) GROUP BY 1, 2),
im AS (SELECT id AS ref, file_id, coalesce(import_name, name) AS original, import_module AS module, name AS bound FROM s WHERE kind = 'import' AND coalesce(import_name, name) <> '*'),
ri AS (SELECT im.*, CASE WHEN g.n = 1 THEN g.id WHEN m.n = 1 THEN m.id END AS dst_id, CASE WHEN g.n = 1 THEN 'unique' WHEN m.n = 1 THEN 'module' WHEN g.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status
  FROM im LEFT JOIN g ON g.name = original LEFT JOIN m ON m.name = original AND m.key = array_to_string(list_filter(string_split(module, '.'), lambda x: x <> ''), '/') AND m.key <> '')
"""


@query("resolve_import", _G + _IMPORTS + "SELECT ref, file_id, original, module, bound, dst_id, status FROM ri")
def resolve_import(spark, d):
    g = Graph(spark, d)
    return rs.resolve_imports(rs.import_rows(g.symbols("file_id", "name", "kind", "import_module", "import_name")), rs.definition_index(g.symbols("file_id", "name", "kind")), g.files).select("ref", "file_id", "original", "module", "bound", "dst_id", "status")


@query("import_edges", _G + _IMPORTS + "SELECT DISTINCT ref AS src_id, dst_id, 'imports' AS kind FROM ri WHERE dst_id IS NOT NULL AND ref <> dst_id")
def import_edges(spark, d):
    g = Graph(spark, d)
    return rs.import_edges(g.symbols("file_id", "name", "kind", "import_module", "import_name"), g.files)[0]


@query("module_matches", _G + _IMPORTS + "SELECT DISTINCT im.module, mk.file_id FROM im JOIN mk ON mk.key = array_to_string(list_filter(string_split(im.module, '.'), lambda x: x <> ''), '/') WHERE mk.key <> ''")
def module_matches(spark, d):
    g = Graph(spark, d)
    key = F.array_join(F.filter(F.split("module", r"\."), lambda x: x != ""), "/")
    m = rs.import_rows(g.symbols("file_id", "name", "kind", "import_module", "import_name")).where("module is not null").select("module").distinct().withColumn("key", key).where("key <> ''")
    return m.join(rs.module_keys(g.files), "key").select("module", "file_id").distinct()


def _facts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    from graphlens.sources.extract import extract, fact_tables

    g = Graph(spark, d)
    texts = parallel(table(spark, d, "file_text").where("content is not null")).join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return fact_tables(cut(extract(texts)))  # parsed once, read by every table


@query("extract_symbols")
def extract_symbols(spark, d):
    return _facts(spark, d)["symbols"]


def _extracted(spark: SparkSession, d: str):
    facts = _facts(spark, d)
    files = Graph(spark, d).files
    ident = ["file_id", "name", "kind", "line_start"]
    symbols = cut(facts["symbols"].dropDuplicates(ident).withColumn("id", F.abs(F.xxhash64(*ident))).withColumn("coverage_pct", F.lit(None).cast("double")))
    return facts, symbols, files


@query("text_call_edges")
def text_call_edges(spark, d):
    facts, symbols, files = _extracted(spark, d)
    return rs.call_edges(facts["calls"], facts["assigns"], symbols, files)


@query("text_edges")
def text_edges(spark, d):
    facts, symbols, files = _extracted(spark, d)
    return rs.build_edges(facts, symbols, files)


# ---- traversal

_CALLS = ", c AS (SELECT DISTINCT src_id, dst_id FROM e WHERE kind = 'calls')\n"


@query("trace_outbound", _G + _CALLS + """, w(id, depth) AS (SELECT id, 0 FROM root UNION SELECT dst_id, depth + 1 FROM w JOIN c ON c.src_id = w.id WHERE depth < 3)
SELECT id, min(depth) AS depth, CASE WHEN min(depth) = 0 THEN 'self' ELSE 'outbound' END AS direction FROM w GROUP BY id""")
def trace_outbound(spark, d):
    g = Graph(spark, d)
    return tr.trace_calls(_root(g), g.edges, "outbound", 3)


@query("trace_inbound", _G + _CALLS + """, w(id, depth) AS (SELECT id, 0 FROM s WHERE name = (SELECT name FROM hot) UNION SELECT src_id, depth + 1 FROM w JOIN c ON c.dst_id = w.id WHERE depth < 2)
SELECT id, min(depth) AS depth, CASE WHEN min(depth) = 0 THEN 'self' ELSE 'inbound' END AS direction FROM w GROUP BY id""")
def trace_inbound(spark, d):
    g = Graph(spark, d)
    return tr.trace_calls(g.symbols("name").where(F.col("name") == _hot_name(g)).select("id"), g.edges, "inbound", 2)


@query("trace_both", _G + _CALLS + """, o(id, depth) AS (SELECT id, 0 FROM root UNION SELECT dst_id, depth + 1 FROM o JOIN c ON c.src_id = o.id WHERE depth < 2),
i(id, depth) AS (SELECT id, 0 FROM root UNION SELECT src_id, depth + 1 FROM i JOIN c ON c.dst_id = i.id WHERE depth < 2)
SELECT id, 0 AS depth, 'self' AS direction FROM root UNION ALL SELECT id, min(depth), 'outbound' FROM o GROUP BY id HAVING min(depth) > 0 UNION ALL SELECT id, min(depth), 'inbound' FROM i GROUP BY id HAVING min(depth) > 0""")
def trace_both(spark, d):
    g = Graph(spark, d)
    return tr.trace_calls(_root(g), g.edges, "both", 2)


# distances: every node enters once, in the round that reaches it first
_BLAST = """, x AS (SELECT DISTINCT src_id, dst_id, kind FROM e WHERE kind IN ('calls', 'imports', 'inherits')),
w(id, dist) USING KEY (id) AS (SELECT id, 0 FROM root UNION SELECT x.src_id, min(w.dist) + 1 FROM w JOIN x ON x.dst_id = w.id
  WHERE x.src_id NOT IN (SELECT id FROM recurring.w) GROUP BY x.src_id)
"""


@query("blast_radius", _G + _BLAST + "SELECT w.id, w.dist AS distance, min(x.kind) AS via FROM w JOIN x ON x.src_id = w.id JOIN w n ON n.id = x.dst_id AND n.dist = w.dist - 1 WHERE w.dist > 0 GROUP BY 1, 2")
def blast_radius(spark, d):
    g = Graph(spark, d)
    return tr.blast_radius(_root(g), g.edges)


@query("blast_radius_ids", _G + """, x AS (SELECT DISTINCT src_id, dst_id FROM e WHERE kind IN ('calls', 'imports', 'inherits')),
w(id) AS (SELECT id FROM root UNION SELECT src_id FROM w JOIN x ON x.dst_id = w.id) SELECT id FROM w WHERE id NOT IN (SELECT id FROM root)""")
def blast_radius_ids(spark, d):
    return blast_radius(spark, d).select("id")


@query("neighborhood", _G + """, x AS (SELECT src_id, dst_id FROM e WHERE kind <> 'test_covers' UNION SELECT dst_id, src_id FROM e WHERE kind <> 'test_covers'),
w(id, dist) AS (SELECT id, 0 FROM root UNION SELECT dst_id, dist + 1 FROM w JOIN x ON x.src_id = w.id WHERE dist < 2) SELECT id, min(dist) AS dist FROM w GROUP BY id""")
def neighborhood(spark, d):
    g = Graph(spark, d)
    return tr.neighborhood(_root(g), g.edges, 2)


@query("reachable", _G + _CALLS + ", w(id) AS (SELECT id FROM root UNION SELECT dst_id FROM w JOIN c ON c.src_id = w.id) SELECT id FROM w")
def reachable(spark, d):
    return flow_layers(spark, d).select("id")


_FLOW = _CALLS + """, w(id, layer) USING KEY (id) AS (SELECT id, 0 FROM root UNION SELECT c.dst_id, min(w.layer) + 1 FROM w JOIN c ON c.src_id = w.id
  WHERE c.dst_id NOT IN (SELECT id FROM recurring.w) GROUP BY c.dst_id)
"""


@query("flow_layers", _G + _FLOW + "SELECT id, layer FROM w")
def flow_layers(spark, d):
    g = Graph(spark, d)
    return tr.flow_layers(_root(g), g.edges)


@query("flow_edges", _G + _CALLS + ", w(id) AS (SELECT id FROM root UNION SELECT dst_id FROM w JOIN c ON c.src_id = w.id) SELECT src_id, dst_id FROM c WHERE src_id IN (SELECT id FROM w) AND dst_id IN (SELECT id FROM w)")
def flow_edges(spark, d):
    g = Graph(spark, d)
    return tr.induced(g.edges.where("kind = 'calls'").select("src_id", "dst_id"), tr.flow_layers(_root(g), g.edges))


@query("exec_path", _G + _CALLS + """, v AS (SELECT DISTINCT src_id AS test_id, dst_id AS id FROM e WHERE kind = 'test_covers'),
i AS (SELECT DISTINCT a.test_id, c.src_id, c.dst_id FROM c JOIN v a ON a.id = c.src_id JOIN v b ON b.id = c.dst_id AND b.test_id = a.test_id),
o AS (SELECT test_id, id FROM v EXCEPT SELECT test_id, dst_id FROM i WHERE src_id <> dst_id), o2 AS (SELECT * FROM o UNION SELECT * FROM v WHERE test_id NOT IN (SELECT test_id FROM o)),
w(test_id, id, layer) USING KEY (test_id, id) AS (SELECT test_id, id, 0 FROM o2 UNION SELECT i.test_id, i.dst_id, min(w.layer) + 1 FROM w JOIN i ON i.test_id = w.test_id AND i.src_id = w.id
  WHERE NOT EXISTS (SELECT 1 FROM recurring.w r WHERE r.test_id = i.test_id AND r.id = i.dst_id) GROUP BY 1, 2)
SELECT v.test_id, v.id, coalesce(w.layer, 0) AS layer FROM v LEFT JOIN w USING (test_id, id)""")
def exec_path(spark, d):
    g = Graph(spark, d)
    tests = g.edges.where("kind = 'test_covers'").select(F.col("src_id").alias("id")).distinct()
    return tr.exec_path(tests, g.edges)


@query("reach_size", _G + _CALLS + """, w(origin, id) AS (SELECT id, id FROM d UNION SELECT origin, dst_id FROM w JOIN c ON c.src_id = w.id)
SELECT origin AS id, count(*) - 1 AS reach FROM w GROUP BY 1""")
def reach_size(spark, d):
    g = Graph(spark, d)
    return tr.reach_sizes(g.located("kind").where("kind in ('function', 'class')"), g.calls)


# ---- whole-graph algorithms

def _calls_among(g: Graph) -> tuple[DataFrame, DataFrame]:
    d = cut(g.located("kind").where("kind in ('function', 'class')").select("id"))
    return d, cut(tr.induced(g.edges.where("kind = 'calls'").select("src_id", "dst_id"), d))


# calls among definitions, the pairs of which one reaches the other, components, edges between these
_AMONG = """, c AS (SELECT DISTINCT src_id, dst_id FROM e WHERE kind = 'calls' AND src_id IN (SELECT id FROM d) AND dst_id IN (SELECT id FROM d))
"""
_COMP = _AMONG + """, p(x, y) AS (SELECT src_id, dst_id FROM c UNION SELECT x, dst_id FROM p JOIN c ON c.src_id = p.y),
m AS (SELECT a.x AS id, min(a.y) AS y FROM p a JOIN p b ON b.x = a.y AND b.y = a.x GROUP BY 1),
k AS (SELECT d.id, least(d.id, coalesce(m.y, d.id)) AS comp FROM d LEFT JOIN m USING (id)),
cc AS (SELECT DISTINCT a.comp AS src_comp, b.comp AS dst_comp FROM c JOIN k a ON a.id = c.src_id JOIN k b ON b.id = c.dst_id WHERE a.comp <> b.comp),
rc AS (SELECT comp FROM k EXCEPT SELECT dst_comp FROM cc),
fl AS (SELECT id, comp, count(*) OVER (PARTITION BY comp) > 1 OR id IN (SELECT src_id FROM c WHERE src_id = dst_id) AS in_cycle FROM k)
"""


@query("in_cycle", _G + _COMP + "SELECT id, comp, in_cycle FROM fl")
def in_cycle(spark, d):
    n, e = _calls_among(Graph(spark, d))
    return alg.in_cycle(n, e)


@query("root_components", _G + _COMP + "SELECT comp FROM rc")
def root_components(spark, d):
    n, e = _calls_among(Graph(spark, d))
    return alg.root_components(cut(alg.strong_components(n, e)), e)


@query("scc", _G + _COMP + "SELECT id, comp FROM k")
def scc(spark, d):
    n, e = _calls_among(Graph(spark, d))
    return alg.strong_components(n, e)


@query("longest_path", _G + _COMP + """, w(comp, depth) AS (SELECT comp, 0 FROM rc UNION SELECT dst_comp, depth + 1 FROM w JOIN cc ON cc.src_comp = w.comp)
SELECT comp, max(depth) AS depth FROM w GROUP BY 1""")
def longest_path(spark, d):
    n, e = _calls_among(Graph(spark, d))
    comp = cut(alg.strong_components(n, e))
    return alg.longest_depths(alg.root_components(comp, e), cut(alg.condensed(comp, e)))


@query("main_spine", _G + _COMP + """, w(comp, depth) AS (SELECT comp, 0 FROM k WHERE id IN (SELECT id FROM root) UNION SELECT dst_comp, depth + 1 FROM w JOIN cc ON cc.src_comp = w.comp),
dp AS (SELECT comp, max(depth) AS depth FROM w GROUP BY 1),
h(comp, depth) AS (SELECT * FROM (SELECT comp, depth FROM dp ORDER BY depth DESC, comp LIMIT 1)
  UNION SELECT min(cc.src_comp), h.depth - 1 FROM h JOIN cc ON cc.dst_comp = h.comp JOIN dp ON dp.comp = cc.src_comp AND dp.depth = h.depth - 1 GROUP BY h.depth)
SELECT fl.id, h.depth AS layer, fl.in_cycle FROM h JOIN fl USING (comp)""")
def main_spine(spark, d):
    g = Graph(spark, d)
    n, e = _calls_among(g)
    return alg.main_spine(_root(g), n, e)


# shares flow back from the farthest layer of every source; one row per (source, node) and layer
@query("betweenness", _G + _AMONG + """, ce AS (SELECT * FROM c WHERE src_id <> dst_id),
w(s, v, dist, n) USING KEY (s, v) AS (SELECT id, id, 0, CAST(1 AS DOUBLE) FROM d UNION SELECT w.s, ce.dst_id, w.dist + 1, sum(w.n) FROM w JOIN ce ON ce.src_id = w.v
  WHERE NOT EXISTS (SELECT 1 FROM recurring.w r WHERE r.s = w.s AND r.v = ce.dst_id) GROUP BY w.s, ce.dst_id, w.dist),
z AS (SELECT w.s, w.v, w.dist, w.n, x.v AS nv, x.n AS nn FROM w LEFT JOIN (SELECT ce.src_id, t.s, t.v, t.dist, t.n FROM ce JOIN w t ON t.v = ce.dst_id) x ON x.src_id = w.v AND x.s = w.s AND x.dist = w.dist + 1),
b(s, v, dist, share) USING KEY (s, v) AS (SELECT s, v, dist, CAST(0 AS DOUBLE) FROM w WHERE dist = (SELECT max(dist) FROM w)
  UNION SELECT z.s, z.v, z.dist, sum(CASE WHEN z.nv IS NULL THEN 0 ELSE z.n / z.nn * (1 + r.share) END) FROM z LEFT JOIN recurring.b r ON r.s = z.s AND r.v = z.nv
    WHERE z.dist = (SELECT min(dist) - 1 FROM b) GROUP BY z.s, z.v, z.dist)
SELECT d.id, round(coalesce(t.share, 0), 4) AS betweenness FROM d LEFT JOIN (SELECT v AS id, sum(share) AS share FROM b WHERE s <> v GROUP BY 1) t USING (id)""")
def betweenness(spark, d):
    n, e = _calls_among(Graph(spark, d))
    return alg.betweenness(n, e).select("id", F.round("betweenness", 4).alias("betweenness"))


# a node dominates what the roots do not reach without it
_DOMINATES = """, ro AS (SELECT min(id) AS id FROM k WHERE comp IN (SELECT comp FROM rc) GROUP BY comp),
q(id) AS (SELECT id FROM ro UNION SELECT dst_id FROM q JOIN c ON c.src_id = q.id),
v(gone, id) AS (SELECT q.id, ro.id FROM q, ro WHERE q.id <> ro.id UNION SELECT gone, dst_id FROM v JOIN c ON c.src_id = v.id WHERE dst_id <> gone),
dm AS (SELECT d.id, CASE WHEN q.id IS NULL THEN 0 ELSE (SELECT count(*) FROM q) - 1 - coalesce(n, 0) END AS dominates FROM d LEFT JOIN q USING (id) LEFT JOIN (SELECT gone AS id, count(*) AS n FROM v GROUP BY 1) USING (id))
"""


@query("dominates_count", _G + _COMP + _DOMINATES + "SELECT id, dominates FROM dm")
def dominates_count(spark, d):
    """From the smallest member of every component that no other leads to."""
    n, e = _calls_among(Graph(spark, d))
    comp = cut(alg.strong_components(n, e))
    roots = comp.join(alg.root_components(comp, e), "comp", "left_semi").groupBy("comp").agg(F.min("id").alias("id"))
    return alg.dominated_counts(roots, n, e)


# ---- ranking

def _named_markers(g: Graph) -> DataFrame:
    """(id, marker, step): functions called main, and those whose name starts like a decorator that marks entry points."""
    f = g.symbols("file_id", "name", "kind").where("kind = 'function'")
    marker = F.when(F.col("name") == "main", "main").otherwise(rk.decorator_marker(F.split("name", "_")[0]))
    return f.select("id", marker.alias("marker"), F.when(F.col("name") == "main", 0).otherwise(2).alias("step")).where("marker is not null")


_MARKED = """, mk AS (SELECT id, CASE WHEN name = 'main' THEN 'main' WHEN list_contains({web}, string_split(name, '_')[1]) THEN 'web_route' WHEN list_contains({cli}, string_split(name, '_')[1]) THEN 'cli' END AS marker FROM s WHERE kind = 'function')
""".format(web=rk.WEB_DECORATORS, cli=rk.CLI_DECORATORS)


@query("named_markers", _G + _MARKED + "SELECT id, marker FROM mk WHERE marker IS NOT NULL")
def named_markers(spark, d):
    return _named_markers(Graph(spark, d)).select("id", "marker")


def _ranked(g: Graph, markers: DataFrame, inner: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    return cut(rk.entrypoints(g.located(), g.edges, markers, inner=inner))


_RANK = _MARKED + """, w(origin, id) AS (SELECT id, id FROM d UNION SELECT origin, dst_id FROM w JOIN (SELECT DISTINCT src_id, dst_id FROM e WHERE kind = 'calls') a ON a.src_id = w.id),
rs AS (SELECT origin AS id, count(*) - 1 AS reach FROM w GROUP BY 1), dg AS ({deg}),
lib AS (SELECT count(*) = 0 AS yes FROM mk WHERE marker IS NOT NULL),
own AS (SELECT d.id, coalesce(mk.marker, CASE WHEN (SELECT yes FROM lib) AND NOT starts_with(d.name, '_') AND (d.kind = 'class' OR d.id NOT IN (SELECT method_id FROM cm)) THEN 'public_api' END) AS marker FROM d LEFT JOIN mk USING (id)),
cand AS (SELECT d.*, own.marker FROM d JOIN own USING (id) WHERE own.marker IS NOT NULL OR d.id IN (SELECT id FROM k WHERE comp IN (SELECT comp FROM rc))),
en AS (SELECT row_number() OVER (ORDER BY marker IS NULL, CASE WHEN (SELECT yes FROM lib) THEN coalesce(degree, 0) ELSE reach END DESC, CASE WHEN (SELECT yes FROM lib) THEN reach ELSE coalesce(degree, 0) END DESC, name, id) AS rank,
  id, name, path, marker, (SELECT yes FROM lib) AS is_library, coalesce(degree, 0) AS degree, reach FROM cand JOIN rs USING (id) LEFT JOIN dg USING (id))
""".format(deg=_DEG)


@query("entrypoint_rank", _G + _METHODS + _COMP + _RANK + "SELECT CAST(rank AS INTEGER) AS rank, id, name, path, marker, is_library, degree, reach, rank = 1 AS primary FROM en")
def entrypoint_rank(spark, d):
    g = Graph(spark, d)
    return _ranked(g, _named_markers(g))


_NO_MARKED = ", mk AS (SELECT id, CAST(NULL AS VARCHAR) AS marker FROM s WHERE false)\n"


@query("library_rank", _G + _METHODS + _COMP + _RANK.replace(_MARKED, _NO_MARKED) + "SELECT CAST(rank AS INTEGER) AS rank, id, marker, is_library FROM en")
def library_rank(spark, d):
    """Without a marker the project is a library, and its public definitions count."""
    g = Graph(spark, d)
    return _ranked(g, spark.createDataFrame([], "id long, marker string, step int")).select("rank", "id", "marker", "is_library")


@query("decorator_markers", _G + """SELECT id AS file_id, CASE id % 4 WHEN 2 THEN 1 WHEN 3 THEN 5 ELSE 2 END AS line, CASE WHEN id % 4 = 2 THEN 'main' ELSE name END AS name, CASE id % 4 WHEN 0 THEN 'web_route' WHEN 1 THEN 'cli' WHEN 2 THEN 'main' ELSE 'main_guard' END AS marker
FROM s WHERE kind = 'function' AND regexp_full_match(name, '[a-z]+_[a-z_]+')""")
def decorator_markers(spark, d):
    """Markers that extraction finds in texts made of the names of functions: routes, commands, a main function, a call in a guard."""
    from graphlens.sources.extract import extract, fact_tables

    f = Graph(spark, d).symbols("file_id", "name", "kind").where("kind = 'function'").where(F.col("name").rlike("^[a-z]+_[a-z_]+$"))
    n, body = F.col("name"), F.lit("(a):\n    return a\n")
    k = F.col("id") % 4
    text = (F.when(k == 0, F.concat(F.lit("@app.get('/x')\ndef "), n, body)).when(k == 1, F.concat(F.lit("@cli.command\ndef "), n, body))
            .when(k == 2, F.concat(F.lit("def main():\n    pass\n\n@cached\ndef "), n, body)).otherwise(F.concat(F.lit("def "), n, body, F.lit("\nif __name__ == '__main__':\n    "), n, F.lit("(1)\n"))))
    return fact_tables(extract(f.select(F.col("id").alias("file_id"), F.lit("x.py").alias("path"), text.alias("content"))))["markers"].select("file_id", "line", "name", "marker")


@query("import_roots", _G + "SELECT DISTINCT file_id, string_split(coalesce(import_module, import_name, name), '.')[1] AS root FROM s WHERE kind = 'import'")
def import_roots(spark, d):
    return rk.import_roots(Graph(spark, d).symbols("file_id", "name", "kind", "import_module", "import_name"))


_LAYER = _MARKED + """, fr AS (SELECT file_id, list(DISTINCT string_split(coalesce(import_module, import_name, name), '.')[1]) AS r FROM s WHERE kind = 'import' GROUP BY 1),
fl2 AS (SELECT f.id AS file_id, CASE WHEN f.id IN (SELECT file_id FROM s JOIN mk USING (id) WHERE marker IN ('web_route', 'cli')) OR list_has_any(r, {web}) THEN 'interface' WHEN list_has_any(r, {data}) THEN 'data'
  WHEN list_has_any(r, {transport}) THEN 'transport' ELSE 'business' END AS layer FROM f LEFT JOIN fr ON fr.file_id = f.id)
""".format(web=rk.WEB, data=rk.DATA, transport=rk.TRANSPORT)


def _import_symbols(g: Graph) -> DataFrame:
    return g.symbols("file_id", "name", "kind", "import_module", "import_name")


@query("layers", _G + _LAYER + "SELECT s.id, name, layer FROM s JOIN fl2 USING (file_id) WHERE kind IN ('function', 'class')")
def layers(spark, d):
    g = Graph(spark, d)
    return rk.symbol_layers(g.files, _import_symbols(g), _named_markers(g))


@query("layer_counts", _G + _LAYER + "SELECT layer, count(*) AS n FROM s JOIN fl2 USING (file_id) WHERE kind IN ('function', 'class') GROUP BY 1")
def layer_counts(spark, d):
    return layers(spark, d).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query("layer_view", _G + _LAYER + """SELECT l.id, l.name, path, layer, list_position(['interface', 'business', 'data', 'transport'], layer) AS tier, l.name IN (SELECT s.name FROM s JOIN l USING (id) JOIN mk USING (id) WHERE marker = 'web_route') AS endpoint
FROM l JOIN fl2 USING (file_id) WHERE kind IN ('function', 'class')""")
def layer_view(spark, d):
    g = Graph(spark, d)
    located = g.located("name", "kind", "import_module", "import_name")
    return rk.layer_view(g.files, located, g.edges, _named_markers(g))[0].withColumn("tier", F.col("tier").cast("int"))


@query("layer_view_edges", _G + _AMONG + "SELECT src_id, dst_id FROM c")
def layer_view_edges(spark, d):
    g = Graph(spark, d)
    located = g.located("name", "kind", "import_module", "import_name")
    return rk.layer_view(g.files, located, g.edges, _named_markers(g))[1]


@query("archetype", _G + _MARKED + f"""SELECT CASE WHEN (SELECT bool_or(list_contains({rk.WEB + rk.QUEUE_RPC}, string_split(coalesce(import_module, import_name, name), '.')[1])) FROM s WHERE kind = 'import') OR 'web_route' IN (SELECT marker FROM mk) THEN 'service'
  WHEN (SELECT count(*) FROM mk WHERE marker IN ('main', 'main_guard', 'console_script', 'cli')) > 0 THEN 'application' ELSE 'library' END AS archetype""")
def archetype(spark, d):
    g = Graph(spark, d)
    return rk.archetype(_import_symbols(g), _named_markers(g))


_CENTRAL = _COMP + _DOMINATES + ", cdg AS (SELECT id, count(*) AS degree FROM (SELECT unnest([src_id, dst_id]) AS id FROM c) GROUP BY 1)\n"


def _central(g: Graph, inner: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(id, name, path, dominates, degree) below the smallest member of every component that no other leads to."""
    d, e = inner or rk.defined_calls(g.located(), g.calls)
    return cut(rk.gateways(d.select("id", "name", "path"), e, alg.root_heads(d, e), distinct=True))


@query("centrality", _G + _CENTRAL + "SELECT d.id, d.name, d.path, dominates, coalesce(degree, 0) AS degree FROM d JOIN dm USING (id) LEFT JOIN cdg USING (id)")
def centrality(spark, d):
    """Without the betweenness, which has a query of its own."""
    return _central(Graph(spark, d))


def _targets(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Ranked entry points, test targets by dominated symbols and degree."""
    g._edges = cut(g.edges)  # entry points, centrality and coverage read them
    inner = rk.defined_calls(g.located(), g.edges)
    ranked = _ranked(g, _named_markers(g), inner)
    return ranked, rk.test_targets(g.located("name", "kind"), g.edges, ranked, _central(g, inner).withColumn("betweenness", F.lit(0.0)))


_TARGETS = _CENTRAL.replace(_COMP, "") + """, tg AS (SELECT d.id, d.name, d.path, CASE WHEN en.rank = 1 THEN 1000.0 WHEN en.id IS NOT NULL THEN 200.0 ELSE 0.0 END + dominates * 5 + coalesce(cdg.degree, 0) AS score,
  concat_ws('; ', CASE WHEN en.rank = 1 THEN 'primary entrypoint' WHEN en.marker IS NOT NULL THEN 'entrypoint (' || en.marker || ')' WHEN en.id IS NOT NULL THEN 'entrypoint' END, CASE WHEN dominates > 0 THEN 'gateway (dominates ' || dominates || ')' END) AS why
  FROM d JOIN dm USING (id) LEFT JOIN cdg USING (id) LEFT JOIN en ON en.id = d.id WHERE NOT (""" + _IS_TEST.replace("path", "d.path") + """ OR starts_with(d.name, 'test_') OR d.name = 'test') AND d.id NOT IN (SELECT dst_id FROM e WHERE kind = 'test_covers'))
"""


@query("test_targets", _G + _METHODS + _COMP + _RANK + _TARGETS + "SELECT id, name, path, CAST(score AS DOUBLE) AS score, CASE WHEN why = '' THEN 'untested' ELSE why END AS reason FROM tg")
def test_targets(spark, d):
    """Scores without the betweenness, which has a query of its own."""
    return _targets(Graph(spark, d))[1]


@query("test_plan", _G + _METHODS + _COMP + _RANK + _TARGETS + """, tp AS (SELECT * FROM en WHERE NOT """ + _IS_TEST + """ ORDER BY rank = 1 DESC, reach DESC, rank LIMIT 15),
tr AS (SELECT name, CASE WHEN why = '' THEN 'untested' ELSE why END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, id) AS j FROM tg) WHERE j = 1)
SELECT tp.name, tp.path, tp.rank = 1 AS primary, tp.reach, tp.name IN (SELECT name FROM s WHERE id IN (SELECT dst_id FROM e WHERE kind = 'test_covers')) AS has_test,
  coalesce(tr.reason, CASE WHEN tp.rank = 1 THEN 'primary entrypoint' ELSE 'entrypoint' END) AS reason FROM tp LEFT JOIN tr USING (name)""")
def test_plan(spark, d):
    g = Graph(spark, d)
    ranked, targets = _targets(g)
    return rk.test_plan(g.located("name"), g.edges, ranked, targets)


@query("blast_radius_top_hubs", _G + """, hb AS (SELECT id, degree, name, path FROM (""" + _DEG + """) JOIN l USING (id) ORDER BY degree DESC, name, id LIMIT 10),
ht AS (SELECT * FROM hb WHERE NOT """ + _IS_TEST + """ ORDER BY degree DESC, name, id LIMIT 5), x AS (SELECT DISTINCT src_id, dst_id FROM e WHERE kind IN ('calls', 'imports', 'inherits')),
w(origin, id) AS (SELECT id, id FROM ht UNION SELECT origin, src_id FROM w JOIN x ON x.dst_id = w.id)
SELECT ht.id, ht.name, count(*) - 1 AS affected FROM ht JOIN w ON w.origin = ht.id GROUP BY 1, 2""")
def blast_radius_top_hubs(spark, d):
    g = Graph(spark, d)
    return rk.risk(lk.hubs(g.located(), g.edges), g.edges)


# ---- coverage

def _line_coverage(g: Graph) -> DataFrame:
    """Lines of the runtime trace's callees, as a report: hit where the trace calls an odd symbol."""
    at = g.located().where("line_start is not null").select(F.col("id").alias("dst_id"), F.col("path").alias("report"), "line_start")
    return g.trace.select("dst_id", "depth").distinct().join(at, "dst_id").select("report", (F.col("line_start") + F.col("depth")).alias("line"), (F.col("dst_id") % 2 == 1).alias("covered"))


_LINES = """, rl AS (SELECT path AS report, line_start + depth AS line, bool_or(dst_id % 2 = 1) AS covered FROM (SELECT DISTINCT dst_id, depth FROM t) JOIN l ON l.id = dst_id WHERE line_start IS NOT NULL GROUP BY 1, 2),
pf AS (SELECT path, min(id) AS file_id, count(*) AS n FROM f GROUP BY 1), fc AS (SELECT file_id, line, covered FROM rl JOIN pf ON pf.path = rl.report WHERE n = 1)
"""


@query("line_or_merge", _G + _LINES + "SELECT file_id, line, covered FROM fc")
def line_or_merge(spark, d):
    g = Graph(spark, d)
    return cov.file_line_coverage(_line_coverage(g), g.files)


@query("symbol_coverage", _G + _LINES + """SELECT s.id, round(100.0 * sum(CASE WHEN covered THEN 1 WHEN NOT covered THEN 0 END) / count(fc.line), 6) AS pct
FROM s LEFT JOIN fc ON fc.file_id = s.file_id AND fc.line BETWEEN s.line_start AND coalesce(s.line_end, s.line_start) WHERE s.line_start IS NOT NULL GROUP BY s.id""")
def symbol_coverage(spark, d):
    g = Graph(spark, d)
    return cov.symbol_coverage(g.symbols(), cov.file_line_coverage(_line_coverage(g), g.files)).select("id", F.round("pct", 6).alias("pct"))


@query("reconcile_paths", _G + """, r AS (SELECT DISTINCT array_to_string(string_split(path, '/')[2:], '/') AS report FROM f WHERE len(string_split(path, '/')) > 1),
h AS (SELECT report, id, path = report AS exact FROM r JOIN f ON path = report OR ends_with(path, '/' || report) OR ends_with(report, '/' || path))
SELECT report, CASE WHEN count(*) = 1 THEN min(id) ELSE min(CASE WHEN exact THEN id END) END AS file_id FROM h GROUP BY 1 HAVING count(*) = 1 OR count(CASE WHEN exact THEN 1 END) = 1""")
def reconcile_paths(spark, d):
    f = Graph(spark, d).files
    parts = F.split("path", "/")
    return cov.reconcile(f.where(F.size(parts) > 1).select(F.array_join(F.slice(parts, 2, F.size(parts)), "/").alias("report")).distinct(), f)


# ---- streams, in batch form

@query("debounce_sessions", """WITH x AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
y AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM y GROUP BY user_id, k""")
def debounce_sessions(spark, d):
    return debounced(table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "2 hours", path="user_id")


@query("tumbling_counts", """SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS "end", event_type, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def tumbling_counts(spark, d):
    return windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day")



