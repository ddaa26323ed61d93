"""Command line: python -m graphlens VERB STORE ..."""

from __future__ import annotations

import argparse
import json
import os
import sys

from graphlens import index, report
from graphlens.engine import Engine
from graphlens.expose import FunctionServer, allow_text, exposed, register_functions, write_server
from graphlens.session import local_session
from graphlens.store import Store


def _print(value: object) -> None:
    print(json.dumps(value, indent=1, ensure_ascii=False, default=str))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphlens", description="A graph of source code: build it, ask it")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, about: str, **options) -> argparse.ArgumentParser:
        v = sub.add_parser(name, help=about)
        v.add_argument("store", help="directory of the graph tables")
        for flag, kw in options.items():
            v.add_argument(f"--{flag.replace('_', '-')}" if not kw.pop("plain", False) else flag, **kw)
        return v

    root = {"root": {"plain": True, "help": "source tree"}}
    verb("index", "scan a source tree into the store", **{k: dict(v) for k, v in root.items()}, ignore={"action": "append", "help": "one more ignore pattern"})
    verb("onboard", "index, then write brief, diagrams, report and client settings", **{k: dict(v) for k, v in root.items()}, out={"default": "."})
    verb("understand", "index, then list entry points without a test", **{k: dict(v) for k, v in root.items()}, limit={"type": int, "default": 15})
    verb("coverage", "take in a coverage report", report={"plain": True}, format={"default": "lcov", "choices": ["lcov", "cobertura"]}, keep={"action": "store_true", "help": "keep what the report does not name"})
    verb("logic-paths", "take in a database of per-test contexts", database={"plain": True})
    verb("trace", "take in a runtime trace", file={"plain": True})
    ask = verb("ask", "one question", tool={"plain": True, "choices": sorted(Engine.tools())})
    ask.add_argument("arguments", nargs="*", metavar="KEY=VALUE")
    verb("serve", "JSON-RPC, one request a line")
    verb("web", "JSON over HTTP", port={"type": int, "default": 7700})
    verb("export", "write graph.json", out={"default": "visualisation"})
    verb("scaffold", "write client settings and the tool manifest", out={"default": "."})
    for name in ("brief", "diagram"):
        verb(name, f"write the {name}", out={})
    verb("report", "write the health report, as text and JSON", out={"default": "report"})
    verb("expose", "list what the allow-list exposes, register it, or write a server for it", register={"action": "store_true"}, server={"metavar": "FILE"}, root={"default": "."})
    verb("serve-functions", "JSON-RPC over what the allow-list exposes", root={"default": "."})
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or local_session()
    store = Store(spark, a.store)
    if a.verb in ("index", "onboard", "understand"):
        if a.verb == "onboard":
            _print(report.onboard(spark, a.root, store, a.out))
            return 0
        summary = index.index_tree(spark, a.root, store, getattr(a, "ignore", None))
        _print(summary if a.verb == "index" else {"index": summary, "plan": Engine(spark, a.store).answer("test_plan", {"limit": a.limit})})
        return 0
    if not os.path.isdir(a.store) and "://" not in a.store:
        print(f"no such store: {a.store}", file=sys.stderr)
        return 2
    engine = Engine(spark, a.store)
    if a.verb == "coverage":
        _print({"files": index.ingest_coverage(store, a.report, a.format, not a.keep)})
    elif a.verb == "logic-paths":
        _print({"new_edges": index.ingest_logic_paths(store, a.database)})
    elif a.verb == "trace":
        _print({"events": index.ingest_trace(store, a.file)})
    elif a.verb == "ask":
        _print(engine.answer(a.tool, dict(x.split("=", 1) for x in a.arguments)))
    elif a.verb == "serve":
        for line in sys.stdin:
            if line.strip() and (out := engine.handle(line)):
                print(out, flush=True)
    elif a.verb == "web":
        from graphlens import web

        web.server(engine, a.port).serve_forever()
    elif a.verb == "export":
        print(report.export_graph(engine, a.out))
    elif a.verb == "scaffold":
        print(report.scaffold(engine, a.out))
    elif a.verb == "report":
        print(report.write_report(engine, a.out))
    elif a.verb == "expose":
        targets, problems = exposed(engine.located, allow_text(spark, a.store))
        rows = [(r.module, r.name) for r in targets.orderBy("module", "name", "id").collect()]
        if a.server:
            print(write_server(a.server, os.path.abspath(a.root), rows))
        else:
            _print({"functions": register_functions(spark, rows) if a.register else rows, "problems": [r.asDict() for r in problems.orderBy("spec").collect()]})
    elif a.verb == "serve-functions":
        sys.path.insert(0, os.path.abspath(a.root))
        server = FunctionServer([(r.module, r.name) for r in exposed(engine.located, allow_text(spark, a.store))[0].orderBy("module", "name", "id").collect()])
        for line in sys.stdin:
            if line.strip() and (out := server.handle(line)):
                print(out, flush=True)
    else:
        text = getattr(report, a.verb)(engine)
        if a.out:
            report.write_text(a.out, text)
        else:
            print(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
