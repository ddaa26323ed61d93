"""Front ends over a small data directory; the registry of queries."""

import datetime as dt
import json

import pytest

from graphlens import report
from graphlens.engine import Engine

T = dt.datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("data"))
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    put("files", [(1, "p/a.py", "h", T), (2, "p/b.py", None, T), (2, "p/b.py", "x", None)], "id long, path string, hash string, indexed_at timestamp")
    put("file_text", [(1, "import flask\ndef main():\n    go()\n"), (2, "def go():\n    pass")], "file_id long, content string")
    sym = [(1, 1, "flask", "import", 1, 1, None, None, None, "flask", T), (2, 1, "main", "function", 2, 3, "Says.", None, None, None, T), (3, 2, "go", "function", 1, 2, None, 0.0, None, None, T),
           (3, 2, "old", "function", 1, 2, None, 0.0, None, None, T - dt.timedelta(1))]
    put("symbols", sym, "id long, file_id long, name string, kind string, line_start long, line_end long, docstring string, coverage_pct double, import_module string, import_name string, written_at timestamp")
    put("edges", [(1, 2, 3, " Calls ", T), (1, 2, 3, " Calls ", T), (2, 2, 3, "calls", T), (3, 2, 99, "calls", T)], "id long, src_id long, dst_id long, kind string, built_at timestamp")
    put("call_trace", [("t", 0, 0, None, 3, T)], "test string, seq long, depth long, src_id long, dst_id long, called_at timestamp")
    return Engine(spark, d)


def call(engine, method, **params):
    return json.loads(engine.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})))


def test_tools(engine):
    ask = lambda *a, **k: call(engine, *a, **k)["result"]
    assert [r["name"] for r in ask("get_callers", symbol="go")] == ["main"] == [r["name"] for r in ask("get_callers", name="go")]
    assert [r["id"] for r in ask("search_symbol", symbol="old")] == []  # an older row of the id
    assert [r["name"] for r in ask("get_dependencies", symbol="main")] == ["go"]
    assert ask("get_coverage", name="go") == [{"coverage_pct": 0.0}] and ask("get_coverage", name="main") == [{"coverage_pct": None}]
    assert [r["id"] for r in ask("get_uncovered_paths")] == [3]
    assert [(r["name"], r["direction"]) for r in ask("trace_calls", symbol="main")] == [("main", "self"), ("go", "outbound")]
    assert [(r["name"], r["via"]) for r in ask("blast_radius", symbol="go")] == [("main", "calls")]
    assert ask("get_source", name="main")[0]["code"] == "def main():\n    go()" and ask("get_source", file="p/b.py", start=2)[0]["code"] == "    pass"
    assert [r["signature"] for r in ask("get_outline", file="b.py")] == ["def go():"]
    assert [r["name"] for r in ask("infer_entrypoints")][0] in ("go", "main") and [r["layer"] for r in ask("main_spine", entry="main")] == [0, 1]
    assert {r["name"]: r["layer"] for r in ask("infer_layers")["layers"]} == {"main": "interface", "go": "business"} and ask("infer_layers")["archetype"] == [{"archetype": "service"}]
    assert len(ask("suggest_test_targets")) == 2 and len(ask("test_plan")) >= 1 and ask("version")[0]["n_edges"] == 1
    assert {r["id"] for r in ask("neighborhood", name="go")["nodes"]} == {2, 3} and ask("module_map")["edges"] == [{"source": "p/a.py", "target": "p/b.py", "weight": 1}]
    assert set(ask("get_overview")) == {"archetype", "layers", "entrypoints", "hubs", "spine"} and len(ask("get_architecture")["modules"]) == 2
    assert ask("search_symbol", name="nobody") == [] and [r["calls"] for r in ask("traces")] == [1]


def test_protocol(engine):
    code = lambda text: json.loads(engine.handle(text))["error"]["code"]
    assert code("{") == -32700 and code("[]") == -32600 and code('{"id": 1, "method": "nope"}') == -32601
    assert code('{"id": 1, "method": "search_symbol"}') == -32602 and code('{"id": 1, "method": "trace_calls", "params": {"symbol": "go", "direction": "up"}}') == -32602
    assert code('{"id": 1, "method": "get_outline", "params": {"file": "zzz"}}') == -32001
    assert engine.handle('{"method": "notifications/initialized"}') == ""
    names = {t["name"] for t in call(engine, "tools/list")["result"]["tools"]}
    assert {"search_symbol", "blast_radius", "main_spine", "neighborhood"} <= names
    wrapped = call(engine, "tools/call", name="get_callers", arguments={"symbol": "go"})["result"]["content"][0]["text"]
    assert json.loads(wrapped)[0]["name"] == "main" and call(engine, "initialize")["result"]["serverInfo"]["name"] == "graphlens"


def test_reports_are_deterministic(engine):
    for f in (report.brief, report.report, report.diagram):
        assert f(engine) == f(engine) and f(engine).startswith("# ")
    assert "n2 --> n3" in report.flow_diagram(engine) or "n3" in report.flow_diagram(engine)


def test_registry():
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and {"hubs", "p1_found", "p6_found"} <= set(q)
