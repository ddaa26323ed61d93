"""Queries of resolution, test evidence, sources and the store, with their SQL.

Where the tables hold no such input, it is made of them: call sites of the traced calls, reports and
databases written out and read back, so that each reader and writer is held against SQL on the tables.
"""

from __future__ import annotations

import json
import sqlite3
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens import expose, index
from graphlens.functions.paths import module_parts
from graphlens.operators import algorithms as alg
from graphlens.operators import coverage as cov
from graphlens.operators import lookup as lk
from graphlens.operators import resolve as rs
from graphlens.operators import snapshot as sn
from graphlens.operators import traverse as tr
from graphlens.operators.snapshot import Graph
from graphlens.plans.graph import _COMP, _DEG, _FLOW, _G, _IMPORTS, _LINES, _METHODS, _calls_among, _facts, _line_coverage, _root
from graphlens.session import checkpoint_dir, cut, table
from graphlens.sources import reports
from graphlens.sources.extract import LANGUAGES
from graphlens.store import Store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/graphlens-{name}-{uuid.uuid4().hex}"


# ---- resolution over call sites made of traced calls and of methods that call themselves

def _sites(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(site, file_id, line, callee, receiver, var, args), (file_id, line, var, class_name)."""
    s = g.symbols()
    at = s.where("line_start is not null").select(F.col("id").alias("src_id"), "file_id", F.col("line_start").alias("line"))
    pairs = g.trace.where("src_id is not null and dst_id is not null").select("src_id", "dst_id").distinct()
    kind = F.col("dst_id") % 3
    text = lambda c: F.col(c).cast("string")
    traced = pairs.join(at, "src_id").join(s.select(F.col("id").alias("dst_id"), F.col("name").alias("callee")), "dst_id").select(
        F.concat(F.lit("t"), text("src_id"), F.lit("#"), text("dst_id")).alias("site"), "file_id", "line", "callee",
        F.when(kind == 0, "bare").when(kind == 1, "other").otherwise("local").alias("receiver"), F.when(kind == 2, F.concat(F.lit("v"), (F.col("dst_id") % 5).cast("string"))).alias("var"),
        F.array(F.concat(F.lit("p"), kind.cast("string")), F.lit("q")).alias("args"))
    names = s.select(F.col("id").alias("class_id"), F.col("name").alias("class_name"))
    own = lk.class_methods(s).join(s.select(F.col("id").alias("method_id"), "file_id", F.col("line_start").alias("line"), F.col("name").alias("callee")), "method_id").join(names, "class_id")
    none = F.array().cast("array<string>")
    self = own.select(F.concat(F.lit("m"), text("method_id")).alias("site"), "file_id", "line", "callee", F.lit("self").alias("receiver"), F.lit(None).cast("string").alias("var"), none.alias("args"))
    local = own.select(F.concat(F.lit("l"), text("method_id")).alias("site"), "file_id", "line", "callee", F.lit("local").alias("receiver"), F.lit("w").alias("var"), none.alias("args"))
    return cut(traced.unionByName(self).unionByName(local)), cut(own.select("file_id", "line", F.lit("w").alias("var"), "class_name").distinct())


_SITES = _METHODS + """, si AS (
  SELECT 't' || src_id || '#' || dst_id AS site, a.file_id, a.line_start AS line, b.name AS callee, CASE dst_id % 3 WHEN 0 THEN 'bare' WHEN 1 THEN 'other' ELSE 'local' END AS receiver,
    CASE WHEN dst_id % 3 = 2 THEN 'v' || (dst_id % 5) END AS var, ['p' || (dst_id % 3), 'q'] AS args
  FROM (SELECT DISTINCT src_id, dst_id FROM t WHERE src_id IS NOT NULL AND dst_id IS NOT NULL) JOIN s a ON a.id = src_id JOIN s b ON b.id = dst_id WHERE a.line_start IS NOT NULL
  UNION ALL SELECT 'm' || m.id, m.file_id, m.line_start, m.name, 'self', NULL, [] FROM cm JOIN s m ON m.id = method_id
  UNION ALL SELECT 'l' || m.id, m.file_id, m.line_start, m.name, 'local', 'w', [] FROM cm JOIN s m ON m.id = method_id),
asg AS (SELECT DISTINCT m.file_id, m.line_start AS line, 'w' AS var, c.name AS class_name FROM cm JOIN s m ON m.id = method_id JOIN s c ON c.id = class_id)
""" + _IMPORTS + """, bd AS (SELECT file_id, bound, arg_max(dst_id, ref) AS import_id FROM ri WHERE dst_id IS NOT NULL GROUP BY 1, 2),
lo AS (SELECT name, file_id, count(*) AS n, min(id) AS id FROM df GROUP BY 1, 2)
"""
_CALLER = """SELECT site, src_id FROM (SELECT si.site, x.id AS src_id, row_number() OVER (PARTITION BY si.site ORDER BY coalesce(x.line_end, x.line_start) - x.line_start, x.id) AS j
  FROM si JOIN s x ON x.file_id = si.file_id AND {0} AND si.line BETWEEN x.line_start AND coalesce(x.line_end, x.line_start)) WHERE j = 1"""
_RESOLVED = _SITES + ", cl AS (" + _CALLER.format("x.kind <> 'import'") + """),
mt AS (SELECT method_id, method, class_id FROM (SELECT m.id AS method_id, m.name AS method, c.id AS class_id, row_number() OVER (PARTITION BY m.id ORDER BY c.line_end - c.line_start, c.id) AS j
  FROM s m JOIN s c ON c.file_id = m.file_id AND c.kind = 'class' AND m.line_start BETWEEN c.line_start AND c.line_end AND m.line_end <= c.line_end WHERE m.kind = 'function') WHERE j = 1),
vc AS (SELECT site, CASE WHEN g.n = 1 THEN g.id WHEN lo.n = 1 THEN lo.id END AS var_class FROM (SELECT si.site, si.file_id, min(class_name) AS name FROM si JOIN cl USING (site) JOIN s x ON x.id = cl.src_id
    JOIN asg ON asg.file_id = si.file_id AND asg.var = si.var AND asg.line BETWEEN x.line_start AND coalesce(x.line_end, x.line_start) WHERE receiver = 'local' GROUP BY 1, 2 HAVING count(DISTINCT class_name) = 1) o
  LEFT JOIN g ON g.name = o.name LEFT JOIN lo ON lo.name = o.name AND lo.file_id = o.file_id),
rc2 AS (SELECT si.site, cl.src_id, tm.typed_id, bd.import_id, CASE WHEN g.n = 1 THEN g.id WHEN lo.n = 1 THEN lo.id END AS name_id,
    CASE WHEN g.n = 1 THEN 'unique' WHEN lo.n = 1 THEN 'same_file' WHEN g.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS st
  FROM si JOIN cl USING (site) LEFT JOIN mt ON mt.method_id = cl.src_id LEFT JOIN vc ON vc.site = si.site
  LEFT JOIN (SELECT class_id, method, max(method_id) AS typed_id FROM mt GROUP BY 1, 2) tm ON tm.method = si.callee AND tm.class_id = CASE receiver WHEN 'self' THEN mt.class_id WHEN 'local' THEN vc.var_class END
  LEFT JOIN bd ON bd.file_id = si.file_id AND bd.bound = si.callee LEFT JOIN g ON g.name = si.callee LEFT JOIN lo ON lo.name = si.callee AND lo.file_id = si.file_id),
rs2 AS (SELECT site, src_id, coalesce(typed_id, import_id, name_id) AS dst_id, CASE WHEN typed_id IS NOT NULL THEN 'typed' WHEN import_id IS NOT NULL THEN 'import' ELSE st END AS status FROM rc2),
ie AS (SELECT DISTINCT a.id AS src_id, coalesce(bd.import_id, CASE WHEN g.n = 1 THEN g.id WHEN lo.n = 1 THEN lo.id END) AS dst_id FROM (
    SELECT DISTINCT min(id) OVER (PARTITION BY file_id, line_start) AS id, file_id, base FROM (SELECT c.id, c.file_id, c.line_start, b.base FROM s c JOIN (SELECT x.file_id, x.line_start AS line, y.name AS base FROM e JOIN s x ON x.id = e.src_id JOIN s y ON y.id = e.dst_id
      WHERE e.kind = 'inherits' AND x.kind = 'class') b ON b.file_id = c.file_id AND b.line = c.line_start WHERE c.kind = 'class')) a
  LEFT JOIN bd ON bd.file_id = a.file_id AND bd.bound = a.base LEFT JOIN g ON g.name = a.base LEFT JOIN lo ON lo.name = a.base AND lo.file_id = a.file_id)
"""


def _all_symbols(g: Graph) -> DataFrame:
    return cut(g.symbols("file_id", "name", "kind", "line_start", "line_end", "import_module", "import_name"))


@query("call_edges", _G + _RESOLVED + "SELECT site, src_id, dst_id, status FROM rs2")
def call_edges(spark, d):
    g = Graph(spark, d)
    return rs.call_edges(*_sites(g), _all_symbols(g), g.files)


@query("edge_counters", _G + _RESOLVED + "SELECT status, count(*) AS n FROM rs2 GROUP BY 1")
def edge_counters(spark, d):
    return rs.status_counts(call_edges(spark, d))


def _bases(g: Graph) -> DataFrame:
    s = g.symbols()
    a = s.where("kind = 'class'").select(F.col("id").alias("src_id"), "file_id", F.col("line_start").alias("line"))
    return g.edges.where("kind = 'inherits'").join(a, "src_id").join(s.select(F.col("id").alias("dst_id"), F.col("name").alias("base")), "dst_id").select("file_id", "line", "base")


@query("inherits_edges", _G + _RESOLVED + "SELECT src_id, dst_id, 'inherits' AS kind FROM ie WHERE dst_id IS NOT NULL AND src_id <> dst_id")
def inherits_edges(spark, d):
    g = Graph(spark, d)
    return rs.inherit_edges(_bases(g), _all_symbols(g), g.files)


@query("built_edges", _G + _RESOLVED + """SELECT DISTINCT src_id, dst_id, 'calls' AS kind FROM rs2 WHERE dst_id IS NOT NULL UNION SELECT src_id, dst_id, 'inherits' FROM ie WHERE dst_id IS NOT NULL AND src_id <> dst_id
UNION SELECT ref, dst_id, 'imports' FROM ri WHERE dst_id IS NOT NULL AND ref <> dst_id""")
def built_edges(spark, d):
    g = Graph(spark, d)
    calls, assigns = _sites(g)
    return rs.build_edges({"calls": calls, "assigns": assigns, "bases": _bases(g)}, _all_symbols(g), g.files)


_FLOWS = _SITES + ", cf AS (" + _CALLER.format("x.kind = 'function'") + """),
fd AS (SELECT name, count(*) AS n, min(id) AS id FROM s WHERE kind IN ('function', 'class') GROUP BY 1), fo AS (SELECT name, file_id, count(*) AS n, min(id) AS id FROM s WHERE kind IN ('function', 'class') GROUP BY 1, 2),
pm AS (SELECT file_id, line_start AS line, 'p' || (id % 3) AS param FROM s WHERE kind = 'function' UNION SELECT file_id, line_start, 'q' FROM s WHERE kind = 'function' AND id % 2 = 0),
flows AS (SELECT DISTINCT cf.src_id, coalesce(bd.import_id, CASE WHEN fd.n = 1 THEN fd.id WHEN fo.n = 1 THEN fo.id END) AS dst_id, a.param FROM (SELECT site, file_id, callee, unnest(args) AS param FROM si) a JOIN cf USING (site) JOIN s x ON x.id = cf.src_id
  JOIN pm ON pm.file_id = a.file_id AND pm.line = x.line_start AND pm.param = a.param LEFT JOIN bd ON bd.file_id = a.file_id AND bd.bound = a.callee LEFT JOIN fd ON fd.name = a.callee LEFT JOIN fo ON fo.name = a.callee AND fo.file_id = a.file_id)
"""


@query("dataflow_edges", _G + _FLOWS + "SELECT src_id, dst_id, param FROM flows WHERE dst_id IS NOT NULL")
def dataflow_edges(spark, d):
    g = Graph(spark, d)
    f = g.symbols().where("kind = 'function'")
    p = f.select("file_id", F.col("line_start").alias("line"), F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("param")).unionByName(
        f.where("id % 2 = 0").select("file_id", F.col("line_start").alias("line"), F.lit("q").alias("param")))
    return rs.build_dataflow(_sites(g)[0], p, _all_symbols(g), g.files)


_DATA = """, tf AS (SELECT DISTINCT src_id, dst_id, 'p' || (dst_id % 3) AS param FROM t WHERE src_id IS NOT NULL AND dst_id IS NOT NULL), ds AS (SELECT min(src_id) AS id FROM tf),
w(id, layer) USING KEY (id) AS (SELECT id, 0 FROM ds UNION SELECT tf.dst_id, min(w.layer) + 1 FROM w JOIN tf ON tf.src_id = w.id WHERE tf.dst_id NOT IN (SELECT id FROM recurring.w) GROUP BY tf.dst_id)
"""


def _traced_flows(g: Graph) -> DataFrame:
    return cut(g.trace.where("src_id is not null and dst_id is not null").select("src_id", "dst_id", F.concat(F.lit("p"), (F.col("dst_id") % 3).cast("string")).alias("param")).distinct())


@query("data_flow_layers", _G + _DATA + "SELECT id, layer FROM w")
def data_flow_layers(spark, d):
    flows = _traced_flows(Graph(spark, d))
    return tr.data_flow_layers(flows.agg(F.min("src_id").alias("id")), flows)


@query("data_flow_edges", _G + _DATA + "SELECT src_id, dst_id, param FROM tf WHERE src_id IN (SELECT id FROM w) AND dst_id IN (SELECT id FROM w)")
def data_flow_edges(spark, d):
    flows = _traced_flows(Graph(spark, d))
    return tr.induced(flows, tr.data_flow_layers(flows.agg(F.min("src_id").alias("id")), flows))


_NEAR = """, x AS (SELECT src_id, dst_id FROM e WHERE kind <> 'test_covers' UNION SELECT dst_id, src_id FROM e WHERE kind <> 'test_covers'),
w(id, dist) AS (SELECT id, 0 FROM root UNION SELECT dst_id, dist + 1 FROM w JOIN x ON x.src_id = w.id WHERE dist < 2)
"""


@query("focus_edges", _G + _NEAR + "SELECT src_id, dst_id, kind FROM e WHERE kind <> 'test_covers' AND src_id IN (SELECT id FROM w) AND dst_id IN (SELECT id FROM w)")
def focus_edges(spark, d):
    g = Graph(spark, d)
    return tr.induced(g.edges.where("kind <> 'test_covers'"), tr.neighborhood(_root(g), g.edges, 2))


@query("system_flow", _G + _COMP + """, ca AS (SELECT DISTINCT src_id, dst_id FROM e WHERE kind = 'calls'), w(id, layer) USING KEY (id) AS (SELECT id, 0 FROM root
  UNION SELECT ca.dst_id, min(w.layer) + 1 FROM w JOIN ca ON ca.src_id = w.id WHERE ca.dst_id NOT IN (SELECT id FROM recurring.w) GROUP BY ca.dst_id),
w2(comp, depth) AS (SELECT comp, 0 FROM k WHERE id IN (SELECT id FROM root) UNION SELECT dst_comp, depth + 1 FROM w2 JOIN cc ON cc.src_comp = w2.comp), dp AS (SELECT comp, max(depth) AS depth FROM w2 GROUP BY 1),
h(comp, depth) AS (SELECT * FROM (SELECT comp, depth FROM dp ORDER BY depth DESC, comp LIMIT 1)
  UNION SELECT min(cc.src_comp), h.depth - 1 FROM h JOIN cc ON cc.dst_comp = h.comp JOIN dp ON dp.comp = cc.src_comp AND dp.depth = h.depth - 1 GROUP BY h.depth)
SELECT w.id, w.layer, w.id IN (SELECT k.id FROM k JOIN h USING (comp)) AS on_spine FROM w""")
def system_flow(spark, d):
    g = Graph(spark, d)
    n, e = _calls_among(g)
    spine = alg.main_spine(_root(g), n, e).select("id", F.lit(True).alias("on_spine"))
    return tr.flow_layers(_root(g), g.edges).join(spine, "id", "left").select("id", "layer", F.coalesce("on_spine", F.lit(False)).alias("on_spine"))


# ---- evidence of tests

_REC = """, rp AS (SELECT DISTINCT string_split(test, '::')[1] AS report FROM t WHERE contains(test, '::') UNION SELECT path FROM f),
rh AS (SELECT report, id, path = report AS exact FROM rp JOIN f ON path = report OR ends_with(path, '/' || report) OR ends_with(report, '/' || path)),
re AS (SELECT report, CASE WHEN count(*) = 1 THEN min(id) ELSE min(CASE WHEN exact THEN id END) END AS file_id FROM rh GROUP BY 1 HAVING count(*) = 1 OR count(CASE WHEN exact THEN 1 END) = 1)
"""


def _hits(g: Graph) -> DataFrame:
    """(test, report, line): every traced call as a covered line."""
    at = g.located().where("line_start is not null").select(F.col("id").alias("dst_id"), F.col("path").alias("report"), F.col("line_start").alias("line"))
    return g.trace.select("test", "dst_id").distinct().join(at, "dst_id").select(F.concat("test", F.lit("|run")).alias("test"), "report", "line")


@query("map_tests", _G + _REC + """, hi AS (SELECT DISTINCT test, path AS report, line_start AS line FROM t JOIN l ON l.id = t.dst_id WHERE line_start IS NOT NULL),
lb AS (SELECT DISTINCT test, CASE WHEN contains(test, '::') THEN string_split(test, '::')[1] END AS hint, string_split(string_split(test, '::')[-1], '[')[1] AS name FROM t),
wh AS (SELECT name, count(*) AS n, min(id) AS id FROM s GROUP BY 1),
hf AS (SELECT lb.test, count(*) AS n, min(s.id) AS id FROM lb JOIN re ON re.report = lb.hint JOIN s ON s.file_id = re.file_id AND s.name = lb.name GROUP BY 1),
sr AS (SELECT lb.test, coalesce(CASE WHEN hf.n = 1 THEN hf.id END, CASE WHEN wh.n = 1 THEN wh.id END) AS src_id FROM lb LEFT JOIN hf USING (test) LEFT JOIN wh ON wh.name = lb.name),
ds AS (SELECT test, x.id AS dst_id, x.name, row_number() OVER (PARTITION BY test, re.file_id, hi.line ORDER BY coalesce(x.line_end, x.line_start) - x.line_start, x.id) AS j
  FROM hi JOIN re USING (report) JOIN s x ON x.file_id = re.file_id AND hi.line BETWEEN x.line_start AND coalesce(x.line_end, x.line_start))
SELECT DISTINCT src_id, dst_id, 'test_covers' AS kind FROM ds JOIN sr USING (test) WHERE j = 1 AND src_id <> dst_id AND NOT starts_with(ds.name, 'test_')""")
def map_tests(spark, d):
    g = Graph(spark, d)
    return cov.map_tests(_hits(g), g.symbols(), g.files)


_NEW = """, pc AS (SELECT s.id, 100.0 * sum(CASE WHEN covered THEN 1 WHEN NOT covered THEN 0 END) / count(fc.line) AS pct FROM s LEFT JOIN fc ON fc.file_id = s.file_id AND fc.line BETWEEN s.line_start AND coalesce(s.line_end, s.line_start) WHERE s.line_start IS NOT NULL GROUP BY 1)
SELECT s.id, round(CASE WHEN s.line_start IS NOT NULL AND s.file_id IN (SELECT file_id FROM fc) THEN pct ELSE {} END, 6) AS coverage_pct FROM s LEFT JOIN pc USING (id)"""


def _applied(spark: SparkSession, d: str, reset: bool) -> DataFrame:
    g = Graph(spark, d)
    new = cov.apply_coverage(g.symbols("file_id", "line_start", "line_end", "coverage_pct"), cut(cov.file_line_coverage(_line_coverage(g), g.files)), reset)
    return new.select("id", F.round("coverage_pct", 6).alias("coverage_pct"))


@query("apply_coverage", _G + _LINES + _NEW.format("NULL"))
def apply_coverage(spark, d):
    return _applied(spark, d, True)


@query("apply_coverage_keep", _G + _LINES + _NEW.format("coverage_pct"))
def apply_coverage_keep(spark, d):
    return _applied(spark, d, False)


_EVENTS = """, ev AS (SELECT test, seq, depth, '/ci/build/' || a.path AS cf, a.line_start AS cl, '/ci/build/' || b.path AS df, b.line_start AS dl FROM t JOIN l b ON b.id = t.dst_id LEFT JOIN l a ON a.id = t.src_id),
rf AS (SELECT report, arg_min(id, (-length(path), id)) AS file_id FROM (SELECT cf AS report FROM ev UNION SELECT df FROM ev) JOIN f ON ends_with(report, '/' || path) GROUP BY 1),
pt AS (SELECT DISTINCT cf AS report, cl AS line FROM ev UNION SELECT DISTINCT df, dl FROM ev),
ps AS (SELECT report, line, id FROM (SELECT pt.*, x.id, row_number() OVER (PARTITION BY pt.report, pt.line ORDER BY coalesce(x.line_end, x.line_start) - x.line_start, x.id) AS j FROM pt JOIN rf USING (report)
  JOIN s x ON x.file_id = rf.file_id AND x.kind IN ('function', 'class') AND pt.line BETWEEN x.line_start AND coalesce(x.line_end, x.line_start)) WHERE j = 1)
"""


def _events(g: Graph) -> DataFrame:
    l = g.located()
    end = lambda k, side: l.select(F.col("id").alias(k), F.concat(F.lit("/ci/build/"), "path").alias(f"{side}_file"), F.col("line_start").alias(f"{side}_line"), F.col("name").alias(f"{side}_name"))
    return g.trace.drop("called_at").join(end("dst_id", "callee"), "dst_id").join(end("src_id", "caller"), "src_id", "left").drop("src_id", "dst_id")


@query("ingest_trace", _G + _EVENTS + "SELECT test, seq, depth, a.id AS src_id, b.id AS dst_id FROM ev JOIN ps b ON b.report = df AND b.line = dl LEFT JOIN ps a ON a.report = cf AND a.line = cl")
def ingest_trace(spark, d):
    """The trace written as JSON, read back and placed on the symbols."""
    g = Graph(spark, d)
    at = _folder(spark, "trace")
    e = _events(g)
    names = ["seq", "depth", "caller_file", "caller_line", "caller_name", "callee_file", "callee_line", "callee_name"]
    event = F.array(*[F.col(c).cast("string") for c in names])
    # one document a row, and one row a test
    docs = e.groupBy("test").agg(F.collect_list(event).alias("events")).select(F.to_json(F.create_map("test", "events")).alias("value"))
    docs.repartition(200).write.option("maxRecordsPerFile", 1).text(at)
    return cov.ingest_trace(reports.read_traces(spark, at), g.symbols(), g.files)


@query("lcov_parse", _G + _LINES + "SELECT report, line, covered FROM rl")
def lcov_parse(spark, d):
    """Line coverage written as LCOV, with records to be skipped, and read back."""
    at = _folder(spark, "lcov")
    lines = _line_coverage(Graph(spark, d))
    da = F.concat(F.lit("DA:"), F.col("line").cast("string"), F.when(F.col("covered"), ",3").otherwise(",0"))
    body = lines.groupBy("report").agg(F.array_join(F.sort_array(F.collect_list(da)), "\n").alias("b"))
    body.select(F.concat(F.lit("TN:x\nSF:"), "report", F.lit("\n"), "b", F.lit("\nDA:bad\nLF:1\nend_of_record\nDA:9,9")).alias("value")).write.text(at)
    return reports.parse_coverage(spark, at, "LCOV")


@query("cobertura_parse", _G + _LINES + "SELECT report, line, covered FROM rl")
def cobertura_parse(spark, d):
    """Line coverage written as Cobertura XML and read back."""
    at = _folder(spark, "xml")
    lines = _line_coverage(Graph(spark, d))
    line = F.concat(F.lit('<line number="'), F.col("line").cast("string"), F.lit('" hits="'), F.when(F.col("covered"), "2").otherwise("0"), F.lit('"/>'))
    body = lines.groupBy("report").agg(F.array_join(F.collect_list(line), "").alias("b"))
    doc = F.concat(F.lit('<coverage><packages><class filename="'), "report", F.lit('"><lines>'), "b", F.lit('<line number="x" hits="1"/></lines></class></packages></coverage>'))
    body.select(doc.alias("value")).repartition(64).write.option("maxRecordsPerFile", 1).text(at)
    return reports.parse_coverage(spark, at, "cobertura")


@query("contexts_parse", _G + """SELECT DISTINCT string_split(string_split('run.' || string_split(test, '::')[-1], '.')[-1], '[')[1] AS test, path AS report, line_start AS line
FROM t JOIN l ON l.id = t.dst_id WHERE line_start IS NOT NULL""")
def contexts_parse(spark, d):
    """Covered lines written as databases of per-test contexts, one a task, and read back."""
    at = _folder(spark, "contexts")
    spark.range(0).write.parquet(at)  # makes the folder
    hits = _hits(Graph(spark, d)).select(F.concat(F.lit("run."), F.element_at(F.split(F.split("test", r"\|")[0], "::"), -1)).alias("context"), "report", "line").distinct()
    local = at.removeprefix("file://").removeprefix("file:")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = f"{local}/{uuid.uuid4().hex}.db"
        con = sqlite3.connect(path)
        con.executescript("create table file(id integer primary key, path text unique); create table context(id integer primary key, context text unique); create table line_bits(file_id, context_id, numbits); insert into context(context) values ('')")
        for pdf in frames:
            for (context, report), lines in pdf.groupby(["context", "report"])["line"]:
                con.execute("insert or ignore into file(path) values (?)", (report,))
                con.execute("insert or ignore into context(context) values (?)", (context,))
                con.execute("insert into line_bits select f.id, c.id, ? from file f, context c where f.path = ? and c.context in ('', ?)", (reports.encode_numbits(lines.tolist()), report, context))
        con.commit()
        con.close()
        yield pd.DataFrame({"path": [path]})

    paths = [r.path for r in hits.repartition(4, "context").mapInPandas(write, "path string").collect()]  # one a task
    out = None
    for p in paths:
        part = reports.read_contexts(spark, p)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


# ---- scans, manifests, exposure

@query("scan_tree", """WITH f AS (SELECT id, min(path) AS path FROM files WHERE id IS NOT NULL AND path IS NOT NULL GROUP BY id), x AS (SELECT path, max(content) AS content FROM f JOIN file_text ON file_id = id WHERE content IS NOT NULL GROUP BY 1)
SELECT path, sha256(content) AS hash, length(content) AS n_chars FROM x WHERE NOT list_has_any(string_split(path, '/'), ['node_modules', 'target']) AND NOT regexp_matches(path, '(^|/)\\.')
  AND NOT contains(path, '/tests/') AND NOT (regexp_matches(path, '_[^/]*\\.rs$')) AND regexp_matches(lower(path), '\\.(py|pyi|rs|ts|tsx|mts|cts|js|jsx|mjs|cjs)$')""")
def scan_tree(spark, d):
    """The texts written out as a tree with an ignore file, and scanned."""
    from graphlens.sources.tree import scan_tree as scan

    at = _folder(spark, "tree")
    spark.range(0).write.parquet(at)
    g = Graph(spark, d)
    texts = table(spark, d, "file_text").where("content is not null").join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id").groupBy("path").agg(F.max("content").alias("content"))
    local = at.removeprefix("file://").removeprefix("file:")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pathlib import Path

        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                p = Path(local) / path
                p.parent.mkdir(parents=True, exist_ok=True)
                p.write_bytes(content.encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    texts.repartition(8).mapInPandas(write, "n long").agg(F.sum("n")).collect()
    with open(f"{local}/.gitignore", "w", encoding="utf-8") as f:
        f.write("# ignored\ntests/\n*_*.rs\n")
    return scan(spark, at).select("path", "hash", F.length("content").alias("n_chars"))


@query("languages", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{e}')" for k, es in LANGUAGES.items() for e in es) + ") AS v(lang, ext)")
def languages(spark, d):
    return spark.createDataFrame([(k, e) for k, es in LANGUAGES.items() for e in es], "lang string, ext string")


_SCRIPTS = """, sc AS (SELECT id, 'cmd-' || id AS script, replace(regexp_replace(regexp_replace(path, '\\.py$', ''), '/__init__$', ''), '/', '.') AS module, name AS function FROM l WHERE kind = 'function' AND id % 7 = 0 AND path LIKE '%.py' AND regexp_full_match(name, '\\w+') AND regexp_full_match(path, '[\\w/.]+'))
"""


def _scripts(g: Graph) -> DataFrame:
    """(source, script, module, function), by way of manifests with entries that are none."""
    l = g.located("name", "kind").where("kind = 'function' and id % 7 = 0").where(F.col("path").endswith(".py") & F.col("name").rlike(r"^\w+$") & F.col("path").rlike(r"^[\w/.]+$"))
    entry = F.concat(F.lit("cmd-"), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, ' = "').otherwise(" = "), F.array_join(module_parts("path"), "."), F.lit(":"), F.col("name"), F.when(F.col("id") % 2 == 0, '"').otherwise(""))
    toml, ini = l.where("id % 2 = 0"), l.where("id % 2 = 1")
    one = lambda df, source, head, tail: df.select(F.concat(F.lit(source), F.col("id").cast("string")).alias("source"), F.posexplode(F.array(*map(F.lit, head), entry, *map(F.lit, tail))).alias("n", "text"))
    return reports.console_scripts(one(toml, "t", ["[tool.x]", 'no = "a.b:c"', "[project.scripts]"], ["[other]", 'no = "a.b:c"']).unionByName(
        one(ini, "i", ["[options.entry_points]", "gui =", "no = a.b:c", "console_scripts ="], ["[x]", "no = a.b:c"])))


@query("console_scripts", _G + _SCRIPTS + "SELECT CASE WHEN id % 2 = 0 THEN 't' ELSE 'i' END || id AS source, script, module, function FROM sc")
def console_scripts(spark, d):
    return _scripts(Graph(spark, d))


@query("script_targets", _G + _SCRIPTS + _IMPORTS.replace("'function', 'class', 'foreign_export'", "'function', 'class'") + """, u AS (SELECT DISTINCT module, function FROM sc)
SELECT u.module, u.function, CASE WHEN g.n = 1 THEN g.id ELSE m.id END AS id FROM u JOIN g ON g.name = u.function LEFT JOIN m ON m.name = u.function AND m.key = replace(u.module, '.', '/') WHERE g.n = 1 OR m.n = 1""")
def script_targets(spark, d):
    g = Graph(spark, d)
    return index.script_targets(_scripts(g), g.symbols("file_id", "name", "kind"), g.files)


_ALLOW = """, pk AS (SELECT id, name, kind, file_id, line_start, line_end, path, list_filter(string_split(regexp_replace(regexp_replace(path, '\\.pyi?$', ''), '/__init__$', ''), '/'), lambda x: x <> '') AS ps FROM l),
fn AS (SELECT * FROM pk WHERE kind = 'function'), ch AS (SELECT id, name, array_to_string(ps, '.') AS module FROM fn WHERE path LIKE '%.py' AND id % 11 = 0 AND name NOT LIKE '%"%' AND name NOT LIKE '%:%'),
sp AS (SELECT DISTINCT module || ':' || name AS spec, module, name FROM ch WHERE id % 2 = 0 UNION SELECT DISTINCT name, NULL, name FROM ch WHERE id % 2 = 1),
ht AS (SELECT spec, sp.module AS module, sp.name AS name, count(fn.id) AS n, min(fn.id) AS id FROM sp LEFT JOIN fn ON fn.name = sp.name AND (sp.module IS NULL OR array_to_string(ps, '/') = replace(sp.module, '.', '/') OR ends_with(array_to_string(ps, '/'), '/' || replace(sp.module, '.', '/'))) GROUP BY 1, 2, 3),
ms AS (SELECT DISTINCT array_to_string(ps, '.') AS module FROM pk WHERE path LIKE '%.py' AND file_id % 13 = 0),
ct AS (SELECT DISTINCT a.id FROM fn a JOIN pk c ON c.kind = 'class' AND c.file_id = a.file_id AND a.line_start BETWEEN c.line_start AND c.line_end AND coalesce(a.line_end, 0) <= c.line_end)
"""


@query("exposed_functions", _G + _ALLOW + """SELECT ht.id, coalesce(ht.module, array_to_string(fn.ps, '.')) AS module, ht.name FROM ht JOIN fn ON fn.id = ht.id WHERE ht.n > 0 AND (ht.module IS NOT NULL OR ht.n = 1)
UNION SELECT fn.id, ms.module, fn.name FROM ms JOIN fn ON array_to_string(ps, '/') = replace(ms.module, '.', '/') OR ends_with(array_to_string(ps, '/'), '/' || replace(ms.module, '.', '/')) WHERE NOT starts_with(fn.name, '_') AND fn.id NOT IN (SELECT id FROM ct)""")
def exposed_functions(spark, d):
    """An allow-list of a share of the functions and modules."""
    g = Graph(spark, d)
    l = cut(g.located().withColumn("module", F.array_join(module_parts("path"), ".")))
    py = l.where(F.col("path").endswith(".py"))
    chosen = py.where("kind = 'function' and id % 11 = 0").where(~F.col("name").contains('"') & ~F.col("name").contains(":"))
    specs = sorted({f"{r.module}:{r.name}" if r.id % 2 == 0 else r.name for r in chosen.select("id", "module", "name").collect()})  # a settings text is made of them
    modules = sorted(r.module for r in py.where("file_id % 13 = 0").select("module").distinct().collect())
    quoted = lambda xs: ", ".join(f'"{x}"' for x in xs)
    return expose.exposed(l, f"functions = [{quoted(specs)}]\nmodules = [{quoted(modules)}]\n")[0]


# ---- the store and the front ends

@query("store_symbols", _G + """, n AS (SELECT l.*, row_number() OVER (PARTITION BY path, name, kind, line_start ORDER BY line_end NULLS FIRST, import_module NULLS FIRST, import_name NULLS FIRST) AS o FROM l),
a AS (SELECT *, row_number() OVER (ORDER BY path, line_start NULLS FIRST, name NULLS FIRST, kind NULLS FIRST, o) AS sid FROM n)
SELECT sid AS id, path, name, kind, line_start, CASE WHEN kind = 'class' THEN coalesce(line_end, 0) + 1 ELSE line_end END AS line_end FROM a WHERE kind <> 'import'""")
def store_symbols(spark, d):
    """All symbols written to a store, then written again with classes one line longer and without imports: ids stay, what vanished is gone."""
    g = Graph(spark, d)
    store = Store(spark, _folder(spark, "store")).create()
    store.write("files", g.files)
    s = cut(g.symbols("file_id", "name", "kind", "line_start", "line_end", "import_module", "import_name").drop("id").join(g.files.select(F.col("id").alias("file_id")), "file_id", "left_semi").withColumn("docstring", F.lit(None).cast("string")))
    store.write_symbols(s)
    store.write_symbols(s.where("kind <> 'import'").withColumn("line_end", F.when(F.col("kind") == "class", F.coalesce("line_end", F.lit(0)) + 1).otherwise(F.col("line_end"))))
    return store.graph.located().select("id", "path", "name", "kind", "line_start", "line_end")


@query("store_edges", _G + "SELECT row_number() OVER (ORDER BY src_id, dst_id, kind) AS id, src_id, dst_id, kind FROM (SELECT DISTINCT src_id, dst_id, kind FROM e)")
def store_edges(spark, d):
    g = Graph(spark, d)
    store = Store(spark, _folder(spark, "store")).create()
    store.write_edges(g.edges)
    return store.read("edges").select("id", "src_id", "dst_id", "kind")


@query("mark_indexed", """WITH h AS (SELECT id, min(path) AS path, arg_max_null(hash, (coalesce(indexed_at, TIMESTAMP '1900-01-01'), coalesce(hash, ''))) AS hash FROM files WHERE id IS NOT NULL AND path IS NOT NULL GROUP BY id),
known AS (SELECT * FROM h WHERE id % 3 > 0), done AS (SELECT path, max('h' || id) AS hash FROM h WHERE id % 3 < 2 GROUP BY 1), fresh AS (SELECT * FROM done WHERE path NOT IN (SELECT path FROM known))
SELECT k.id, k.path, coalesce(done.hash, k.hash) AS hash FROM known k LEFT JOIN done USING (path) UNION ALL SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY path), path, hash FROM fresh""")
def mark_indexed(spark, d):
    """A third of the files is known, a third known and read anew, a third new."""
    f = cut(Graph(spark, d).files)
    return sn.mark_indexed(f.where("id % 3 > 0"), f.where("id % 3 < 2").select("path", F.concat(F.lit("h"), F.col("id").cast("string")).alias("hash"))).select("id", "path", "hash")


@query("rpc_hubs", _G + f"SELECT id, degree, name, path FROM ({_DEG}) JOIN l USING (id) ORDER BY degree DESC, name, id LIMIT 25")
def rpc_hubs(spark, d):
    """A JSON-RPC answer, as rows."""
    from graphlens.engine import Engine

    answer = json.loads(Engine(spark, d).handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "get_architecture", "params": {"hub_limit": 25}})))["result"]["hubs"]
    return spark.createDataFrame([(r["id"], r["degree"], r["name"], r["path"]) for r in answer], "id long, degree long, name string, path string")


@query("web_flow", _G + ", st AS (SELECT id FROM s WHERE name = (SELECT name FROM s WHERE id = (SELECT id FROM root)))" + _FLOW.replace("FROM root", "FROM st") + "SELECT w.id, w.layer, l.name, l.path FROM w JOIN l USING (id)")
def web_flow(spark, d):
    """A page-wise answer of the flow route, put together again."""
    from urllib.parse import quote

    from graphlens.engine import Engine
    from graphlens.web import respond

    g = Graph(spark, d)
    name = g.symbols("name").join(_root(g), "id").first().name
    engine, rows, at = Engine(spark, d, max_rows=5_000), [], 0
    while at is not None:
        page = respond(engine, f"/flow?symbol={quote(name)}&offset={at}")[1]["nodes"]
        at = page.pop()["next_offset"] if page and page[-1].get("truncated") else None
        rows += page
    return spark.createDataFrame([(r["id"], r["layer"], r["name"], r["path"]) for r in rows], "id long, layer int, name string, path string")


@query("export_graph", _G + "SELECT src_id, dst_id, kind FROM e WHERE kind IN ('calls', 'imports', 'inherits')")
def export_graph(spark, d):
    """The links of the graph document, written and read back."""
    from graphlens.engine import Engine
    from graphlens.report import export_graph as export

    at = _folder(spark, "export").removeprefix("file://").removeprefix("file:")
    path = export(Engine(spark, d), at)
    doc = spark.read.schema("links array<struct<src_id:long,dst_id:long,kind:string>>").json(f"file://{path}", multiLine=True)
    return doc.select(F.explode("links").alias("x")).select("x.*")


# ---- extraction, where patterns over lines see the same

_LINES_OF = """WITH f AS (SELECT id, min(path) AS path FROM files WHERE id IS NOT NULL AND path IS NOT NULL GROUP BY id), tx AS (SELECT file_id, path, content FROM file_text JOIN f ON f.id = file_id WHERE content IS NOT NULL),
ls AS (SELECT file_id, path, regexp_split_to_array(content, '\\r\\n|\\r|\\n') AS x FROM tx), ln AS (SELECT file_id, path, x, i AS line, x[i] AS s FROM ls, unnest(range(1, len(x) + 1)) AS u(i))
"""


def _seen(spark: SparkSession, d: str, *suffixes: str) -> DataFrame:
    g = Graph(spark, d)
    paths = g.files.select("path", F.col("id").alias("file_id"))
    wanted = F.lit(False)
    for x in suffixes:
        wanted = wanted | F.col("path").endswith(x)
    return _facts(spark, d)["symbols"].join(paths.where(wanted), "file_id")


@query("extract_python", _LINES_OF + """SELECT DISTINCT file_id, regexp_extract(s, '^\\s*(?:async\\s+)?(?:def|class)\\s+(\\w+)', 1) AS name, CASE WHEN regexp_matches(s, '^\\s*class') THEN 'class' ELSE 'function' END AS kind, line AS line_start
FROM ln WHERE regexp_matches(path, '\\.pyi?$') AND regexp_matches(s, '^\\s*(?:async\\s+)?(?:def|class)\\s+\\w+\\s*[(:]')""")
def extract_python(spark, d):
    return _seen(spark, d, ".py", ".pyi").where("kind <> 'import'").select("file_id", "name", "kind", "line_start").distinct()


@query("extract_imports", _LINES_OF + """, im AS (SELECT file_id, line, nullif(regexp_extract(s, '^\\s*from\\s+([\\w.]+)', 1), '') AS module,
  CASE WHEN regexp_matches(s, 'import\\s*\\(') THEN regexp_extract(split_part(array_to_string(x[line:], ' '), ')', 1), 'import\\s*\\((.*)$', 1) ELSE regexp_replace(regexp_extract(s, '^\\s*(?:from\\s+[\\w.]+\\s+)?import\\s+(.*)$', 1), '\\s*#.*$', '') END AS items
  FROM ln WHERE regexp_matches(path, '\\.pyi?$') AND regexp_matches(s, '^\\s*(?:from\\s+[\\w.]+\\s+)?import\\s+[\\w.(]+')),
it AS (SELECT file_id, line, module, trim(unnest(string_split(items, ','))) AS item FROM im)
SELECT DISTINCT file_id, coalesce(nullif(regexp_extract(item, '\\sas\\s+(\\w+)$', 1), ''), item) AS name, line AS line_start, module AS import_module, regexp_extract(item, '^([\\w.]+)', 1) AS import_name FROM it WHERE item <> ''""")
def extract_imports(spark, d):
    return _seen(spark, d, ".py", ".pyi").where("kind = 'import'").select("file_id", "name", "line_start", "import_module", "import_name").distinct()


@query("extract_rust", _LINES_OF + """SELECT DISTINCT file_id, regexp_extract(s, '\\b(fn|struct|enum|trait)\\s+(\\w+)', 2) AS name, replace(regexp_extract(s, '\\b(fn|struct|enum|trait)\\s+\\w+', 1), 'fn', 'function') AS kind, line AS line_start
FROM ln WHERE path LIKE '%.rs' AND regexp_matches(s, '^\\s*(?:pub(?:\\([^)]*\\))?\\s+)?(?:(?:const|async|unsafe)\\s+)*(?:fn|struct|enum|trait)\\s+\\w+')""")
def extract_rust(spark, d):
    return _seen(spark, d, ".rs").select("file_id", "name", "kind", "line_start").distinct()


@query("extract_script_types", _LINES_OF + """SELECT DISTINCT file_id, regexp_extract(s, '\\b(class|interface|enum)\\s+(\\w+)', 2) AS name, regexp_extract(s, '\\b(class|interface|enum)\\s', 1) AS kind, line AS line_start
FROM ln WHERE regexp_matches(path, '\\.[mc]?[jt]s$') AND regexp_matches(s, '^\\s*(?:\\w+\\s+)*(?:class|interface|enum)\\s+\\w+')""")
def extract_script_types(spark, d):
    return _seen(spark, d, "js", "ts").where("kind in ('class', 'interface', 'enum')").select("file_id", "name", "kind", "line_start").distinct()


@query("extract_rust_docs", _LINES_OF + """SELECT DISTINCT file_id, regexp_extract(s, '\\bfn\\s+(\\w+)', 1) AS name, line AS line_start, trim(regexp_extract(x[line - 1], '^\\s*///(.*)$', 1)) AS docstring
FROM ln WHERE path LIKE '%.rs' AND regexp_matches(s, '^\\s*(?:pub(?:\\([^)]*\\))?\\s+)?(?:(?:const|async|unsafe)\\s+)*fn\\s+\\w+') AND line > 1 AND regexp_matches(x[line - 1], '^\\s*///\\s*\\S') AND (line = 2 OR NOT regexp_matches(x[line - 2], '^\\s*(///|#\\[)'))""")
def extract_rust_docs(spark, d):
    """Documentation of one line that is not blank, right above the function."""
    one = _seen(spark, d, ".rs").where("kind = 'function' and docstring is not null").where(~F.col("docstring").contains("\n"))
    at = table(spark, d, "file_text").select("file_id", F.split("content", "\r\n|\r|\n", -1).alias("x"))
    above = F.element_at("x", F.col("line_start").cast("int") - 1)
    over = F.when(F.col("line_start") > 2, F.element_at("x", F.greatest(F.col("line_start").cast("int") - 2, F.lit(1))))
    near = one.join(at, "file_id").where("line_start > 1").where(above.rlike(r"^\s*///") & ~F.coalesce(over.rlike(r"^\s*(///|#\[)"), F.lit(False)))
    return near.select("file_id", "name", "line_start", F.trim("docstring").alias("docstring")).distinct()


@query("foreign_exports", _LINES_OF + """SELECT file_id, regexp_extract(s, '^pub (?:async |unsafe )*fn (\\w+)', 1) AS name, line + row_number() OVER (PARTITION BY file_id ORDER BY line) AS line_start
FROM ln WHERE path LIKE '%.rs' AND regexp_matches(s, '^pub (?:async |unsafe )*fn \\w+')""")
def foreign_exports(spark, d):
    """Rust files whose public functions are marked as exports, on a line of its own before each."""
    from graphlens.sources.extract import extract, fact_tables

    g = Graph(spark, d)
    mark = F.regexp_replace(F.regexp_replace("content", "\r\n|\r", "\n"), r"(?m)^(pub (?:async |unsafe )*fn \w+)", "#[pyfunction]\n$1")
    texts = table(spark, d, "file_text").where("content is not null").join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id").where(F.col("path").endswith(".rs")).withColumn("content", mark)
    return fact_tables(extract(texts, foreign=True))["symbols"].where("kind = 'foreign_export'").select("file_id", "name", "line_start")


# ---- facts of texts that are made of the names of functions

def _made(g: Graph, path: str, *parts) -> dict[str, DataFrame]:
    """Fact tables of one text a function; in parts, None stands for its name."""
    from graphlens.sources.extract import extract, fact_tables

    f = g.symbols("file_id", "name", "kind").where("kind = 'function'").where(F.col("name").rlike("^[a-z]+_[a-z_]+$"))
    text = F.concat(*[F.col("name") if p is None else F.lit(p) for p in parts])
    return fact_tables(extract(f.select(F.col("id").alias("file_id"), F.lit(path).alias("path"), text.alias("content"))))


_OF_NAME = ", nm AS (SELECT id AS file_id, name FROM s WHERE kind = 'function' AND regexp_full_match(name, '[a-z]+_[a-z_]+'))\n"
_PYTHON = ("class Own(base.Kind, Other[int], metaclass=M):\n    def ", None, "(self, a, /, b: int = 1, *rest, c=2, **kw):\n        x = Worker(a)\n        x.", None, "(b, k=c)\n        self.", None, "()\n        ", None,
           "(a, 1, f(b))\n        y().", None, "()\n")


@query("python_calls", _G + _OF_NAME + """SELECT file_id, line, callee, receiver, var, args FROM nm, (VALUES (3, 'Worker', 'bare', NULL, 'a'), (4, '', 'local', 'x', 'b,c'), (5, '', 'self', NULL, ''), (6, '', 'bare', NULL, 'a'), (6, 'f', 'bare', NULL, 'b'), (7, '', 'other', NULL, ''), (7, 'y', 'bare', NULL, '')) v(line, what, receiver, var, args),
  LATERAL (SELECT CASE WHEN what = '' THEN name ELSE what END AS callee)""")
def python_calls(spark, d):
    """Call sites with the kind of their receiver and their bare arguments."""
    return _made(Graph(spark, d), "x.py", *_PYTHON)["calls"].select("file_id", F.col("line").cast("int").alias("line"), "callee", "receiver", "var", F.array_join("args", ",").alias("args"))


@query("python_params", _G + _OF_NAME + "SELECT file_id, 2 AS line, param FROM nm, (VALUES ('self'), ('a'), ('b'), ('rest'), ('c'), ('kw')) v(param)")
def python_params(spark, d):
    return _made(Graph(spark, d), "x.py", *_PYTHON)["params"].select("file_id", F.col("line").cast("int").alias("line"), "param")


@query("python_bindings", _G + _OF_NAME + "SELECT file_id, 3 AS line, 'x' AS var, 'Worker' AS class_name FROM nm")
def python_bindings(spark, d):
    return _made(Graph(spark, d), "x.py", *_PYTHON)["assigns"].select("file_id", F.col("line").cast("int").alias("line"), "var", "class_name")


@query("python_bases", _G + _OF_NAME + "SELECT file_id, 1 AS line, base FROM nm, (VALUES ('Kind'), ('Other')) v(base)")
def python_bases(spark, d):
    return _made(Graph(spark, d), "x.py", *_PYTHON)["bases"].select("file_id", F.col("line").cast("int").alias("line"), "base")


@query("python_docstrings", _G + """, dc AS (SELECT id AS file_id, name, docstring FROM s WHERE kind = 'function' AND regexp_full_match(name, '[a-z]+_[a-z_]+') AND docstring <> '' AND NOT contains(docstring, '"') AND NOT contains(docstring, '\\\\') AND NOT regexp_matches(docstring, '[\\r\\x00\\f]'))
SELECT file_id, name, docstring, 2 AS line_start, 3 + length(docstring) - length(replace(docstring, chr(10), '')) AS line_end FROM dc""")
def python_docstrings(spark, d):
    """Docstrings put into a function and read out of it, as written."""
    from graphlens.sources.extract import extract, fact_tables

    f = Graph(spark, d).symbols("file_id", "name", "kind", "docstring").where("kind = 'function'").where(F.col("name").rlike("^[a-z]+_[a-z_]+$"))
    f = f.where("docstring <> ''").where(~F.col("docstring").contains('"') & ~F.col("docstring").contains("\\") & ~F.col("docstring").rlike("[\r\x00\f]"))
    text = F.concat(F.lit("@deco\nasync def "), "name", F.lit('():\n    """'), "docstring", F.lit('"""\n'))
    got = fact_tables(extract(f.select(F.col("id").alias("file_id"), F.lit("x.py").alias("path"), text.alias("content"))))["symbols"]
    return got.select("file_id", "name", "docstring", F.col("line_start").cast("int").alias("line_start"), "line_end")


_SCRIPT = ("export class Box extends ui.Base {\n  ", None, "(a: string) {\n    return this.", None, "(a)\n  }\n}\n/**\n * Says it.\n */\nexport const ", None, "_arrow = async (x: number) => other.", None, "(x)\nexport default function ", None,
           "_plain() {\n  plain(1)\n}\nenum Kind { A }\ninterface Shape { n: number }\n")


@query("script_symbols", _G + _OF_NAME + """SELECT file_id, CASE v.what WHEN '' THEN name || tail ELSE what END AS name, kind, a AS line_start, z AS line_end, doc AS docstring FROM nm, (VALUES ('Box', '', 'class', 1, 5, NULL), ('', '', 'function', 2, 4, NULL), ('', '_arrow', 'function', 9, 9, 'Says it.'),
  ('', '_plain', 'function', 10, 12, NULL), ('Kind', '', 'enum', 13, 13, NULL), ('Shape', '', 'interface', 14, 14, NULL)) v(what, tail, kind, a, z, doc)""")
def script_symbols(spark, d):
    """Declarations, methods, arrow functions and their documentation in TypeScript."""
    got = _made(Graph(spark, d), "x.ts", *_SCRIPT)["symbols"]
    return got.select("file_id", "name", "kind", F.col("line_start").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"), "docstring")


@query("script_calls", _G + _OF_NAME + """SELECT file_id, line, CASE WHEN what = '' THEN name ELSE what END AS callee, receiver, var FROM nm, (VALUES (3, '', 'self', NULL), (9, '', 'local', 'other'), (11, 'plain', 'bare', NULL)) v(line, what, receiver, var)""")
def script_calls(spark, d):
    return _made(Graph(spark, d), "x.ts", *_SCRIPT)["calls"].select("file_id", F.col("line").cast("int").alias("line"), "callee", "receiver", "var")


@query("extract_errors", _G + _OF_NAME + "SELECT file_id, 2 AS line, name FROM nm")
def extract_errors(spark, d):
    """Texts with an error in the second line: one error row there, and the declarations before it."""
    facts = _made(Graph(spark, d), "x.py", "def ", None, "():\n    return )\n")
    return facts["errors"].select("file_id", F.col("line").cast("int").alias("line")).join(facts["symbols"].select("file_id", "name"), "file_id")


@query("project_name", _G + ", r AS (SELECT count(DISTINCT string_split(path, '/')[1]) AS n, min(string_split(path, '/')[1]) AS one FROM f WHERE contains(path, '/')) SELECT CASE WHEN n = 1 THEN one ELSE '' END AS name FROM r WHERE n <> 1")
def project_name(spark, d):
    """Empty where the files share no directory."""
    return spark.createDataFrame([(index.project_name(Graph(spark, d).files),)], "name string")
