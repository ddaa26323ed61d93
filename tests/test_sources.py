"""Readers, extraction, resolution, coverage and streams on small inline inputs."""

import datetime as dt
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from graphlens.operators import coverage as cov
from graphlens.operators import resolve as rs
from graphlens.operators.snapshot import delete_files, new_edges, rebuild_edges, snapshot_merge
from graphlens.sources.extract import extract, fact_tables, facts_of
from graphlens.sources.reports import allow_list, console_scripts, decode_numbits, encode_numbits, parse_coverage, read_contexts, read_traces
from graphlens.sources.tree import ignore_regex, ignored, project_root, scan_tree
from graphlens.streaming.changes import apply_changes, changed_paths, debounced, watch

SYM = "id long, file_id long, name string, kind string, line_start long, line_end long, docstring string, coverage_pct double, import_module string, import_name string"


def symbols(spark, rows):
    return spark.createDataFrame([(i, f, n, k, a, b, None, p, m, o) for i, f, n, k, a, b, p, m, o in rows], SYM)


def s(i, f, n, k, a, b, p=None, m=None, o=None):
    return (i, f, n, k, a, b, p, m, o)


def named(facts, fact="symbol"):
    return [(f["name"], f.get("kind"), f.get("line"), f.get("line_end")) for f in facts if f["fact"] == fact]


def test_python_facts():
    src = '@deco\ndef f(a, *b, c=1, **d):\n    """Says\n    it."""\n    x = Foo()\n    x.run(a)\n    self.go()\n\nclass A(m.Base, meta=X, G[int]):\n    def run(self):\n        pass\n\nfrom .m import (\n  a as b,\n  c)\nimport os.path\nif __name__ == "__main__":\n    f()\n@app.route("/")\ndef g(): pass\ndef main(): pass\n'
    out = facts_of(src.replace("m.Base, meta=X, G[int]", "m.Base, G[int], meta=X"), "py")
    assert {("f", "function", 2, 7), ("A", "class", 9, 11), ("run", "function", 10, 11), ("b", "import", 13, 15), ("c", "import", 13, 15), ("os.path", "import", 16, 16)} <= set(named(out))
    assert [f["docstring"] for f in out if f.get("name") == "f" and f["fact"] == "symbol"] == ["Says\n    it."]
    assert {f["name"] for f in out if f["fact"] == "base"} == {"Base", "G"}
    assert {f["name"] for f in out if f["fact"] == "param"} >= {"a", "b", "c", "d", "self"}
    calls = {(f["name"], f["receiver"], f["var"]) for f in out if f["fact"] == "call"}
    assert {("run", "local", "x"), ("go", "self", None), ("Foo", "bare", None)} <= calls
    assert {(f["name"], f["kind"]) for f in out if f["fact"] == "marker"} == {("f", "main_guard"), ("g", "web_route"), ("main", "main")}
    broken = facts_of("import x\ndef f():\n  pass\nclass A(:\n", "py")
    assert [f[0] for f in named(broken)] == ["x", "f", "A"] and named(broken, "error")


def test_script_and_rust_facts():
    ts = "/** Says it. */\nexport function f(a: string) {\n  return `}`;\n}\nclass A extends B {\n  run(x) {\n    this.go(x);\n  }\n}\nexport const g = async (x) => {\n};\ninterface I {}\n"
    out = facts_of(ts, "ts")
    assert {("f", "function", 2, 4), ("A", "class", 5, 9), ("run", "function", 6, 8), ("g", "function", 10, 11), ("I", "interface", 12, 12)} == set(named(out))
    assert [f["docstring"] for f in out if f.get("name") == "f"] == ["Says it."] and [f["name"] for f in out if f["fact"] == "base"] == ["B"]
    assert ("go", "self") in {(f["name"], f["receiver"]) for f in out if f["fact"] == "call"}
    rs_ = facts_of('/// Says\n/// it.\n#[inline]\npub fn f() {\n  let s = "}";\n}\nstruct S { a: u8 }\ntrait T { fn a(&self); }\n', "rs")
    assert set(named(rs_)) == {("f", "function", 4, 6), ("S", "struct", 7, 7), ("T", "trait", 8, 8), ("a", "function", 8, 8)} and rs_[0]["docstring"] == "Says\nit."
    assert facts_of("x", "txt") == [] and facts_of("", "py") == []


@pytest.fixture(scope="module")
def built(spark):
    texts = [
        (1, "pkg/a.py", "from pkg.b import helper\nclass A:\n    def run(self):\n        pass\n    def caller(self):\n        self.run()\nclass B(A):\n    def run(self):\n        pass\ndef use(x):\n    b = B()\n    b.run()\n    helper(x)\n"),
        (2, "pkg/b.py", "def helper(y):\n    pass\n"), (3, "pkg/c.py", "def helper(z):\n    pass\n"), (4, "d.py", None)]
    facts = fact_tables(extract(spark.createDataFrame(texts, "file_id long, path string, content string")))
    rows = sorted(facts["symbols"].collect(), key=lambda r: (r.file_id, r.line_start, r.name))
    sym = symbols(spark, [s(i + 1, r.file_id, r.name, r.kind, r.line_start, r.line_end, None, r.import_module, r.import_name) for i, r in enumerate(rows)])
    files = spark.createDataFrame([(i, p) for i, p, _ in texts], "id long, path string")
    return facts, sym, files, {i + 1: (r.name, r.file_id, r.line_start) for i, r in enumerate(rows)}


def test_resolution(spark, built):
    facts, sym, files, name = built
    e = {(name[r.src_id], name[r.dst_id], r.kind) for r in rs.build_edges(facts, sym, files).collect()}
    assert (("caller", 1, 5), ("run", 1, 3), "calls") in e  # the receiver's own class
    assert (("use", 1, 10), ("run", 1, 8), "calls") in e  # the class bound to the variable
    assert (("use", 1, 10), ("helper", 2, 1), "calls") in e  # the import decides between two of the name
    assert (("B", 1, 7), ("A", 1, 2), "inherits") in e and (("helper", 1, 1), ("helper", 2, 1), "imports") in e
    flow = {(name[r.src_id], name[r.dst_id], r.param) for r in rs.build_dataflow(facts["calls"], facts["params"], sym, files).collect()}
    assert flow == {(("use", 1, 10), ("helper", 2, 1), "x")}
    status = {r.status for r in rs.call_edges(facts["calls"], facts["assigns"], sym, files).collect()}
    assert status == {"typed", "import", "unique"}


def test_coverage_reports(spark, tmp_path):
    lcov = tmp_path / "x.info"
    lcov.write_text("TN:\nDA:9,1\nSF:src/foo.py\nDA:1,1\nDA:2,0\nDA:2,3,abc\nDA:x,1\nend_of_record\nDA:5,1\nSF:b.py\nDA:1,0\nend_of_record\n")
    assert {(r.report, r.line, r.covered) for r in parse_coverage(spark, str(lcov), "LCOV").collect()} == {("src/foo.py", 1, True), ("src/foo.py", 2, True), ("b.py", 1, False)}
    xml = tmp_path / "c.xml"
    xml.write_text('<coverage><class filename="a.py"><lines><line number="1" hits="0"/><line number="1" hits="2"/><line number="x" hits="1"/></lines></class><class><line number="3" hits="1"/></class></coverage>')
    assert {(r.report, r.line, r.covered) for r in parse_coverage(spark, str(xml), "cobertura").collect()} == {("a.py", 1, True)}
    with pytest.raises(ValueError):
        parse_coverage(spark, "/nowhere", "gcov")
    with pytest.raises(FileNotFoundError):
        parse_coverage(spark, "/nowhere", "lcov")


def test_contexts_and_traces(spark, tmp_path):
    for lines in ([], [1], [1, 2, 4, 5], [0, 7, 8, 63]):
        assert decode_numbits(encode_numbits(lines)) == lines
    db = tmp_path / "c.db"
    con = sqlite3.connect(db)
    con.executescript("create table file(id, path); create table context(id, context); create table line_bits(file_id, context_id, numbits)")
    con.execute("insert into file values (1, 'a.py')")
    con.executemany("insert into context values (?, ?)", [(1, ""), (2, "m.test_a[x]"), (3, "m.test_a[y]")])
    con.executemany("insert into line_bits values (1, ?, ?)", [(1, encode_numbits([9])), (2, encode_numbits([1, 3])), (3, encode_numbits([3, 4]))])
    con.commit()
    con.close()
    assert {(r.test, r.report, r.line) for r in read_contexts(spark, str(db)).collect()} == {("test_a", "a.py", n) for n in (1, 3, 4)}
    t = tmp_path / "t.json"
    t.write_text(json.dumps({"test_x": [[0, 0, "t.py", 1, "test_x", "/abs/pkg/a.py", 2, "f"], [1, 1, "?", 0, "q", "zzz.py", 1, "g"]]}))
    sym = symbols(spark, [s(1, 1, "f", "function", 1, 3), s(2, 2, "test_x", "function", 1, 9)])
    files = spark.createDataFrame([(1, "pkg/a.py"), (2, "t.py"), (3, "a.py")], "id long, path string")
    assert [tuple(r) for r in cov.ingest_trace(read_traces(spark, str(t)), sym, files).collect()] == [("test_x", 0, 0, 2, 1)]


def test_manifests(spark):
    toml = ["[project.scripts]", 'tool = "pkg.cli:main"', "[other]", 'no = "a:b"']
    ini = ["[options.entry_points]", "console_scripts =", "    run = pkg.m:go", "gui_scripts =", "    x = a:b"]
    rows = [("p", i, t) for i, t in enumerate(toml)] + [("s", i, t) for i, t in enumerate(ini)]
    got = {tuple(r) for r in console_scripts(spark.createDataFrame(rows, "source string, n int, text string")).collect()}
    assert got == {("p", "tool", "pkg.cli", "main"), ("s", "run", "pkg.m", "go")}
    assert allow_list('functions = ["a:b",\n "c"]\nmodules = []') == (["a:b", "c"], [])


def test_symbol_and_module_coverage(spark):
    sym = symbols(spark, [s(1, 1, "a", "function", 1, 1, 7.0), s(2, 1, "b", "function", 2, 5, 7.0), s(3, 2, "c", "function", 1, 2, 7.0), s(4, 1, "n", "import", None, None, 7.0)])
    files = spark.createDataFrame([(1, "src/a.py"), (2, "src/b.py"), (3, "x/b.py")], "id long, path string")
    lines = spark.createDataFrame([("a.py", 1, True), ("src/a.py", 3, True), ("a.py", 4, False), ("b.py", 1, True)], "report string, line long, covered boolean")
    at = cov.file_line_coverage(lines, files)  # b.py is ambiguous
    assert {(r.file_id, r.line, r.covered) for r in at.collect()} == {(1, 1, True), (1, 3, True), (1, 4, False)}
    assert {r.id: r.coverage_pct for r in cov.apply_coverage(sym, at).collect()} == {1: 100.0, 2: 50.0, 3: None, 4: None}
    assert {r.id: r.coverage_pct for r in cov.apply_coverage(sym, at, reset=False).collect()} == {1: 100.0, 2: 50.0, 3: 7.0, 4: 7.0}
    from graphlens.operators.lookup import module_coverage

    done = symbols(spark, [s(1, 1, "a", "function", 1, 1, 100.0), s(2, 1, "b", "function", 2, 5, 50.0), s(3, 2, "c", "function", 1, 2)])
    assert {r.path: r.coverage_pct for r in module_coverage(files, done).collect()} == {"src/a.py": 60.0, "src/b.py": None, "x/b.py": None}


def test_test_map(spark):
    sym = symbols(spark, [s(1, 1, "greet", "function", 1, 3), s(2, 2, "test_greet", "function", 1, 2), s(3, 1, "test_own", "function", 5, 6)])
    files = spark.createDataFrame([(1, "src/foo.py"), (2, "tests/test_foo.py")], "id long, path string")
    hits = spark.createDataFrame([("tests/test_foo.py::test_greet[a]|run", "src/foo.py", n) for n in (1, 2, 3, 5)] + [("nobody", "src/foo.py", 2)], "test string, report string, line long")
    assert [tuple(r) for r in cov.map_tests(hits, sym, files).collect()] == [(2, 1, "test_covers")]


def test_tree(spark, tmp_path):
    for p, t in {"a.py": "x", "b/c.ts": "y", "b/.gitignore": "skip.py\n!keep.py\n", "b/skip.py": "z", "d/skip.py": "z", "node_modules/e.js": "q", ".hid/f.py": "q", "build/g.py": "q", "bin.rs": b"\xff\xfe", "n.txt": "q"}.items():
        f = tmp_path / p
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(t if isinstance(t, bytes) else t.encode())
    got = {r.path: r.content for r in scan_tree(spark, str(tmp_path), extra_ignores=["build/", "[broken"]).collect()}
    assert got == {"a.py": "x", "b/c.ts": "y", "d/skip.py": "z", "bin.rs": None}
    with pytest.raises(FileNotFoundError):
        scan_tree(spark, str(tmp_path / "none"))
    rules = [r for r in map(ignore_regex, ["*.log", "!keep.log", "/top", "a/**/z"]) if r]
    assert [ignored(p, rules) for p in ("x/a.log", "keep.log", "top/x", "y/top", "a/b/c/z", "a/z")] == [True, False, True, False, True, True]
    assert project_root(["/p/q/a.py", "/p/q/r/b.py"], lambda p: p == "/p/setup.py") == "/p"


def test_snapshots(spark):
    cols = "id long, path string, name string, kind string, line_start long, line_end long, docstring string, import_module string, import_name string, coverage_pct double"
    old = spark.createDataFrame([(1, "a", "f", "function", 1, 2, None, None, None, 50.0), (2, "a", "g", "function", 3, 4, None, None, None, 1.0), (3, "b", "h", "function", 1, 2, None, None, None, None)], cols)
    new = spark.createDataFrame([("a", "f", "function", 1, 9, "doc", None, None), ("a", "n", "function", 5, 6, None, None, None), ("a", "n", "function", 5, 6, None, None, None), ("a", "e", "error", 1, 1, None, None, None)],
                                "path string, name string, kind string, line_start long, line_end long, docstring string, import_module string, import_name string")
    got = snapshot_merge(old, new)
    kept = {r.id: (r.name, r.line_end, r.coverage_pct) for r in got.collect()}
    assert kept[1] == ("f", 9, 50.0) and kept[3] == ("h", 2, None) and 2 not in kept and len(kept) == 4
    again = snapshot_merge(got, new)
    assert {r.id for r in again.collect()} == set(kept)
    none = spark.createDataFrame([], "path string")
    assert {r.id for r in apply_changes(old, new.limit(0), spark.createDataFrame([("b",)], "path string")).collect()} == {1, 2}
    assert {r.id for r in apply_changes(old, new, none).collect()} == set(kept)
    files = spark.createDataFrame([(1, "a"), (2, "b")], "id long, path string")
    syms = spark.createDataFrame([(10, 1), (11, 2)], "id long, file_id long")
    e = spark.createDataFrame([(10, 11, "calls"), (11, 11, "calls"), (11, 11, "test_covers")], "src_id long, dst_id long, kind string")
    f, sy, ed = delete_files(files, syms, e, spark.createDataFrame([("a",)], "path string"))
    assert [r.id for r in f.collect()] == [2] and [r.id for r in sy.collect()] == [11] and ed.count() == 2
    fresh = spark.createDataFrame([(1, 2, "calls"), (1, 2, "calls"), (11, 11, "calls")], "src_id long, dst_id long, kind string")
    assert {tuple(r) for r in rebuild_edges(e, fresh).collect()} == {(11, 11, "test_covers"), (1, 2, "calls"), (11, 11, "calls")}
    assert [tuple(r) for r in new_edges(e, fresh).collect()] == [(1, 2, "calls")]
    added, gone = changed_paths(spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], "path string, hash string"), spark.createDataFrame([("a", "1"), ("b", "2"), ("d", None)], "path string, hash string"))
    assert {r.path for r in added.collect()} == {"b", "d"} and {r.path for r in gone.collect()} == {"c"}


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    rows = [("a", t0 + dt.timedelta(milliseconds=m)) for m in (0, 100, 250, 900)] + [("b", t0)]
    df = spark.createDataFrame(rows, "path string, ts timestamp")
    assert {(r.path, r.n) for r in debounced(df).collect()} == {("a", 3), ("a", 1), ("b", 1)}
    src = tmp_path / "in"
    df.coalesce(1).write.parquet(str(src))
    seen = []

    def handle(batch, n):
        seen.extend(sorted(r.path for r in batch.collect()))

    for _ in range(2):  # the second run finds nothing new
        q = watch(spark.readStream.schema(df.schema).parquet(str(src)), handle, str(tmp_path / "cp"))
        q.awaitTermination(60)
    assert seen == ["a"] * 4 + ["b"]


def test_arrow_functions_end_where_their_expression_does():
    from graphlens.sources.extract import script_facts

    text = "const a = (x) => x\n  .map(y)\n  .filter(z)\nconst b = async (x) => f(\n  x,\n)\nconst c = x =>\n  x + 1;\nconst d = (x) => {\n  return x\n}\n"
    got = {r["name"]: (r["line"], r["line_end"]) for r in script_facts(text) if r["fact"] == "symbol"}
    assert got == {"a": (1, 3), "b": (4, 6), "c": (7, 8), "d": (9, 11)}
    assert not [r for r in script_facts("async (x) => 1\n") if r["fact"] == "call"]


def test_imports_of_broken_texts():
    from graphlens.sources.extract import python_facts

    got = python_facts("from a.b import (\n    c,\n    d as e,  # note\n)\nimport os, sys as s\nfrom . import *\ndef f(:\n    x\n\ny = 1\n")
    assert [(r["name"], r["line"], r["line_end"], r["import_module"], r["import_name"]) for r in got if r.get("kind") == "import"] == [
        ("c", 1, 4, "a.b", "c"), ("e", 1, 4, "a.b", "d"), ("os", 5, 5, None, "os"), ("s", 5, 5, None, "sys"), ("*", 6, 6, ".", "*")]
    assert [(r["name"], r["line"], r["line_end"]) for r in got if r.get("kind") == "function"] == [("f", 7, 8)] and got[-1]["fact"] == "error"
