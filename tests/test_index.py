"""A small tree, indexed end to end, then coverage, contexts, traces, changes and the front ends over its store."""

import json
import os
import sqlite3
import threading
import urllib.error
import urllib.request

import pytest

from graphlens import index, report
from graphlens.__main__ import main
from graphlens.engine import Engine
from graphlens.expose import exposed, register_functions
from graphlens.sources.extract import extractor_udtf
from graphlens.sources.reports import encode_numbits
from graphlens.store import SCHEMAS, Store

FILES = {
    "app/main.py": "from app.util import helper\nimport flask\n\n\ndef main():\n    helper(1)\n    w = Worker()\n    w.run()\n\n\nclass Worker:\n    def run(self):\n        return self.step()\n\n    def step(self):\n        return 1\n\n\n@app.route('/x')\ndef page(q):\n    return helper(q)\n",
    "app/util.py": "def helper(x):\n    '''Adds.'''\n    return low(x)\n\n\ndef low(x):\n    return x\n\n\nif __name__ == '__main__':\n    low(2)\n",
    "app/start.py": "def launch():\n    pass\n",
    "tests/test_util.py": "from app.util import helper\n\n\ndef test_helper():\n    helper(1)\n",
    "native/src/lib.rs": "#[pymodule]\nfn native(m: &M) {}\n\n#[pyfunction]\npub fn fast(x: i64) -> i64 { x }\n\nfn hidden() {}\n",
    "node_modules/x.js": "function no() {}\n", "build/gen.py": "def gen(): pass\n", "web/a.ts": "export class Box { \n  open(): number {\n    return size();\n  }\n}\nexport function size() { return 1 }\n",
    "broken.py": "def half(:\n", ".gitignore": "build/\n", "pyproject.toml": "[project.scripts]\ngo = \"app.start:launch\"\n"}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "latin.py").write_bytes(b"x = '\xff'\n")
    return root


@pytest.fixture(scope="module")
def store(spark, tree, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("store")))
    s.summary = index.index_tree(spark, str(tree), s)
    return s


def names(store):
    return {r.id: r.name for r in store.graph.symbols("name").collect()}


def edge_names(store):
    n = names(store)
    return {(n[r.src_id], r.kind, n[r.dst_id]) for r in store.graph.edges.collect()}


def test_index(store):
    s = store.summary
    assert (s["files"], s["skipped"], s["foreign"]) == (8, 1, 2) and s["by_language"]["rust"] == 2
    assert edge_names(store) >= {("main", "calls", "helper"), ("main", "calls", "run"), ("run", "calls", "step"), ("page", "calls", "helper"), ("helper", "calls", "low"),
                                 ("helper", "imports", "helper"), ("open", "calls", "size")}
    n = names(store)
    assert {(n[r.src_id], n[r.dst_id], r.param) for r in store.read("dataflow").collect()} == {("page", "helper", "q"), ("helper", "low", "x")}
    assert {(n[r.id], r.marker) for r in store.read("markers").collect()} == {("main", "main"), ("low", "main_guard"), ("page", "web_route"), ("launch", "console_script")}
    assert s["typed"] >= 2 and s["flows"] == 2 and "hidden" not in n.values() and "no" not in n.values() and "gen" not in n.values()


def test_again_changes_nothing(spark, tree, store):
    before = (names(store), edge_names(store))
    again = index.index_tree(spark, str(tree), store)
    assert again["edges"] == 0 and (names(store), edge_names(store)) == before and store.create().version() == 1


def test_evidence(spark, store, tmp_path):
    (tmp_path / "c.info").write_text("SF:/ci/app/util.py\nDA:2,1\nDA:3,1\nDA:7,0\nend_of_record\n")
    assert index.ingest_coverage(store, str(tmp_path / "c.info")) == 1
    pct = {r.name: r.coverage_pct for r in store.graph.symbols("name", "kind", "coverage_pct").where("kind = 'function'").collect()}
    assert (pct["helper"], pct["low"], pct["main"]) == (100.0, 0.0, None)
    with pytest.raises(ValueError):
        index.ingest_coverage(store, str(tmp_path / "c.info"), "gcov")
    with pytest.raises(FileNotFoundError):
        index.ingest_coverage(store, str(tmp_path / "none.info"))
    db = sqlite3.connect(tmp_path / "ctx.db")
    db.executescript("create table file(id, path); create table context(id, context); create table line_bits(file_id, context_id, numbits);")
    db.execute("insert into file values (1, '/ci/app/util.py')")
    db.executemany("insert into context values (?, ?)", [(1, ""), (2, "tests.test_util.test_helper")])
    db.executemany("insert into line_bits values (1, ?, ?)", [(1, encode_numbits([7])), (2, encode_numbits([2, 3]))])
    db.commit()
    db.close()
    assert index.ingest_logic_paths(store, str(tmp_path / "ctx.db")) == 1 == 1 + index.ingest_logic_paths(store, str(tmp_path / "ctx.db"))
    assert ("test_helper", "test_covers", "helper") in edge_names(store)
    events = {"tests/test_util.py::test_helper": [[0, 1, "/ci/tests/test_util.py", 5, "test_helper", "/ci/app/util.py", 1, "helper"], [1, 2, "/ci/app/util.py", 3, "helper", "/ci/app/util.py", 6, "low"], [2, 2, "a", 1, "b", "zz.py", 1, "c"]]}
    (tmp_path / "t.json").write_text(json.dumps(events))
    assert index.ingest_trace(store, str(tmp_path / "t.json")) == 2 == index.ingest_trace(store, str(tmp_path / "t.json"))
    n = names(store)
    assert sorted((r.seq, n[r.src_id], n[r.dst_id]) for r in store.graph.trace.collect()) == [(0, "test_helper", "helper"), (1, "helper", "low")]


def test_views(spark, store):
    e = Engine(spark, store.root)
    ask = lambda tool, **k: json.loads(e.handle(json.dumps({"id": 1, "method": tool, "params": k})))["result"]
    assert {(r["name"], r["layer"], r["endpoint"]) for r in ask("layer_view")["symbols"]} >= {("page", "interface", True), ("low", "business", False)}
    assert [r["name"] for r in ask("data_flow", symbol="page")["nodes"]] == ["page", "helper", "low"]
    flow = ask("system_flow", root="main")
    assert {r["name"]: r["on_spine"] for r in flow["nodes"]}["main"] and len(flow["edges"]) >= 4
    assert ask("infer_entrypoints")[0]["marker"] and {r["marker"] for r in ask("infer_entrypoints")} >= {"main", "web_route", "console_script"}
    assert [r["name"] for r in ask("exec_path", test="test_helper")["nodes"]] == ["helper"] and ask("tests")[0]["covers"] == 1
    assert {r["kind"] for r in ask("focus", symbol="helper", depth=1)["edges"]} == {"calls", "imports"} and ask("focus", symbol="zz")["nodes"] == []
    assert ask("class_view")["classes"][0]["methods"] and [r["first_seq"] for r in ask("trace", test="tests/test_util.py::test_helper")["nodes"]] == [0, 0, 1]
    small = Engine(spark, store.root, max_rows=3)
    page = small.answer("list_symbols", {})
    assert page[-1] == {"truncated": True, "next_offset": 3} and small.answer("list_symbols", {"offset": 3})[0] not in page


def test_engine_sees_new_tables(spark, store):
    e = Engine(spark, store.root)
    n = e.located.count()
    store.write("symbols", store.read("symbols").where("name <> 'hidden'").unionByName(spark.createDataFrame([(10**9, 1, "extra", "function", 1, 1, None, None, None, None, None)], SCHEMAS["symbols"])))
    assert e.located.count() == n + 1
    store.write("symbols", store.read("symbols").where("name <> 'extra'"))


def test_documents(spark, store, tmp_path):
    e = Engine(spark, store.root)
    with open(report.export_graph(e, str(tmp_path))) as f:
        g = json.load(f)
    assert {"nodes", "links", "modules", "module_links"} == set(g) and len(g["nodes"]) == e.located.count()
    with open(os.path.join(os.path.dirname(report.write_report(e, str(tmp_path / "r"))), "report.json")) as f:
        assert json.load(f)["symbols"] > 3
    with open(report.scaffold(e, str(tmp_path))) as f:
        assert "serve" in json.load(f)["mcpServers"]["graphlens"]["args"]
    assert index.project_name(spark.createDataFrame([("p/q/a.py",), ("p/q/r/b.py",)], "path string")) == "q" and index.project_name(spark.createDataFrame([], "path string")) == ""


def test_http(spark, store):
    from graphlens.web import respond, server

    e = Engine(spark, store.root)
    s = server(e, 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{s.server_port}"
    assert len(json.load(urllib.request.urlopen(f"{at}/graph.json"))["nodes"]) > 5
    with pytest.raises(urllib.error.HTTPError) as bad:
        urllib.request.urlopen(f"{at}/flow")
    assert bad.value.code == 400 and respond(e, "/nope")[0] == 404 and respond(e, "/architecture-map?level=x")[0] == 400 and respond(e, "/flow?symbol=main")[0] == 200
    s.shutdown()


def test_exposed(spark, store):
    loc = Engine(spark, store.root).located
    good, bad = exposed(loc, 'functions = ["app.util:helper", "launch", "nope", "app.util:nope"]\nmodules = ["app.main", "no.where"]\n')
    assert {(r.module, r.name) for r in good.collect()} == {("app.util", "helper"), ("app.start", "launch"), ("app.main", "main"), ("app.main", "page")}
    assert {(r.spec, r.problem) for r in bad.collect()} == {("nope", "not found"), ("app.util:nope", "not found"), ("no.where", "no functions")}
    assert register_functions(spark, [("graphlens.sources.reports", "decode_numbits"), ("os.path", "basename")])[0]["inputSchema"]["required"] == ["blob"]
    assert spark.sql("select basename('a/b.py') as x").first().x == "b.py"


def test_udtf(spark):
    spark.udtf.register("source_facts", extractor_udtf())
    got = spark.sql("select f.name, f.kind from values ('def a():\\n  pass\\n', 'py'), ('class B {}', 'ts'), ('?', 'txt') as t(content, ext), lateral source_facts(t.content, t.ext) f")
    assert {tuple(r) for r in got.where("f.kind is not null").collect()} == {("a", "function"), ("B", "class")}


def test_changes(spark, store):
    schema = "path string, content string, hash string, deleted boolean"
    handle = index.handle_changes(store)
    text = "def helper(x):\n    return x\n"
    handle(spark.createDataFrame([("app/util.py", text, "new", False), ("app/start.py", None, None, True)], schema), 0)
    assert not {"low", "launch"} & set(names(store).values()) and ("main", "calls", "helper") in edge_names(store)
    assert index.reindex(store, spark.createDataFrame([("app/util.py", text, "new")], "path string, content string, hash string")) == {"files": 0}
    assert {r.hash for r in store.graph.files.where("path = 'app/util.py'").collect()} == {"new"}
    with pytest.raises(ValueError):
        store.write("edges", spark.range(1))


def test_command_line(spark, tree, tmp_path, capsys):
    at = str(tmp_path / "s")
    assert main(["onboard", at, str(tree), "--out", str(tmp_path / "o")], spark) == 0
    done = json.loads(capsys.readouterr().out)["artifacts"]
    assert not [k for k in done if k.endswith("_error")] and {"BRIEF.md", "DIAGRAMS.md", "mcp.json", "report", "tools.json"} <= set(os.listdir(tmp_path / "o"))
    assert main(["ask", at, "get_callers", "symbol=low"], spark) == 0 and '"helper"' in capsys.readouterr().out
    assert main(["brief", str(tmp_path / "missing")], spark) == 2
