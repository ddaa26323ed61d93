"""Markdown and Mermaid documents about a graph; lists in them are top lists."""

from __future__ import annotations

import json
import os
import sys
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions.paths import is_test_path
from graphlens.index import index_tree, project_name
from graphlens.operators import lookup as lk
from graphlens.operators import rank as rk
from graphlens.operators import traverse as tr
from graphlens.session import cut
from graphlens.store import Store

if TYPE_CHECKING:
    from graphlens.engine import Engine


def _table(df: DataFrame, columns: list[str], limit: int) -> list[str]:
    out = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    for r in df.select(*columns).limit(limit).collect():
        out.append("| " + " | ".join("" if v is None else f"{v:.1f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |")
    return out


def brief(e: Engine) -> str:
    """What the project is, where it starts and what holds it together."""
    v = e.version().first()
    lines = ["# Project brief", "", f"{v.n_symbols} symbols, {v.n_edges} edges. Archetype: {e.infer_layers()['archetype'].first().archetype}.", "", "## Entry points", ""]
    lines += _table(e.infer_entrypoints().where(~is_test_path("path")).orderBy("rank"), ["name", "path", "marker", "reach"], 8)
    lines += ["", "## Hubs", "", *_table(lk.hubs(e.located, e.edges, 8), ["name", "path", "degree"], 8)]
    lines += ["", "## Packages", "", *_table(lk.module_map(e.located, e.graph.files, e.edges, "package")[0].orderBy(F.desc("symbols"), "module"), ["module", "symbols", "files"], 8)]
    return "\n".join(lines) + "\n"


def report_data(e: Engine) -> dict:
    """Health: what is untested, never measured or unused, and what much depends on; the lists are top lists, n is the whole number."""
    located, edges, files = e.located, e.edges, e.graph.files
    order = ["path", F.coalesce("line_start", F.lit(0)), "name", "id"]

    def listed(df: DataFrame, columns: list[str], limit: int) -> dict:
        kept = cut(df)
        return {"n": kept.count(), "rows": [r.asDict() for r in kept.orderBy(*order).select(*columns).limit(limit).collect()]}

    own = located.where("kind in ('function', 'class')").where(~is_test_path("path"))
    modules = lk.module_coverage(files, located).where("coverage_pct is not null").where(~is_test_path("path"))
    return {
        "project": project_name(files), "symbols": own.count(), "source_files": files.where(~is_test_path("path")).count(),
        "modules": [r.asDict() for r in lk.symbols_per_file(files, located).where(~is_test_path("path")).orderBy(F.desc("symbols"), "path").limit(15).collect()],
        "hubs": [r.asDict() for r in lk.hubs(located, edges).where(~is_test_path("path")).select("name", "path", "degree").limit(8).collect()],
        "entry_points": [r.asDict() for r in e.infer_entrypoints().where(~is_test_path("path")).orderBy("rank").select("name", "path", "marker").limit(8).collect()],
        "coverage": [r.asDict() for r in modules.orderBy("coverage_pct", "path").limit(20).collect()],
        "bands": [r.asDict() for r in lk.coverage_bands(located).orderBy("band").collect()],
        "uncovered": listed(lk.uncovered(located).where(~is_test_path("path")), ["name", "path"], 20), "never_measured": listed(lk.never_measured(located), ["name", "path"], 20),
        "orphans": listed(lk.orphans(located, edges), ["name", "path"], 20), "risk": [r.asDict() for r in rk.risk(lk.hubs(located, edges), edges).select("name", "affected").collect()]}


def _rows(rows: list[dict]) -> list[str]:
    if not rows:
        return ["none"]
    return ["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * len(rows[0]), *("| " + " | ".join("" if v is None else f"{v:.1f}" if isinstance(v, float) else _clean(str(v)) for v in r.values()) + " |" for r in rows)]


def report(e: Engine) -> str:
    d = report_data(e)
    lines = ["# Health report", "", f"{d['project'] or 'Project'}: {d['symbols']} functions and classes in {d['source_files']} files, tests left out."]
    for title, key in (("Modules", "modules"), ("Hubs", "hubs"), ("Entry points", "entry_points"), ("Coverage by module", "coverage"), ("Coverage bands", "bands"),
                       ("Uncovered", "uncovered"), ("Never measured", "never_measured"), ("Orphans", "orphans"), ("Risk", "risk")):
        got = d[key]
        lines += ["", f"## {title}" + (f" ({got['n']})" if isinstance(got, dict) else ""), "", *_rows(got["rows"] if isinstance(got, dict) else got)]
    return "\n".join(lines) + "\n"


def write_text(path: str, text: str) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def write_report(e: Engine, out: str) -> str:
    write_text(os.path.join(out, "report.json"), json.dumps(report_data(e), indent=1, ensure_ascii=False, sort_keys=True))
    return write_text(os.path.join(out, "REPORT.md"), report(e))


def export_graph(e: Engine, out: str) -> str:
    """graph.json with nodes, links, modules and module links; whole, as rows are streamed and not collected."""
    path = os.path.join(out, "graph.json")
    os.makedirs(out, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("{")
        for k, (name, df) in enumerate(e.graph_view().items()):
            f.write(("," if k else "") + f'"{name}":[')
            for i, r in enumerate(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()):
                f.write(("," if i else "") + r.j)
            f.write("]")
        f.write("}")
    return path


def scaffold(e: Engine, out: str) -> str:
    """Settings for a client of the JSON-RPC server, and the manifest of its tools."""
    settings = {"mcpServers": {"graphlens": {"command": sys.executable, "args": ["-m", "graphlens", "serve", os.path.abspath(e.dir)]}}}
    write_text(os.path.join(out, "tools.json"), json.dumps({"tools": e.catalogue()}, indent=1, ensure_ascii=False))
    return write_text(os.path.join(out, "mcp.json"), json.dumps(settings, indent=1))


def onboard(spark: SparkSession, root: str, store: Store, out: str = ".") -> dict:
    """Index a tree and write all documents; one that fails is noted under <name>_error, the others go on."""
    from graphlens.engine import Engine

    summary = index_tree(spark, root, store)
    engine = Engine(spark, store.root)
    done: dict[str, str] = {"store": store.root}
    steps = {"brief": lambda: write_text(os.path.join(out, "BRIEF.md"), brief(engine)), "diagrams": lambda: write_text(os.path.join(out, "DIAGRAMS.md"), diagram(engine)),
             "report": lambda: write_report(engine, os.path.join(out, "report")), "client": lambda: scaffold(engine, out)}
    for name, step in steps.items():
        try:
            done[name] = step()
        except Exception as x:  # noqa: BLE001
            done[f"{name}_error"] = str(x)
    return {"index": summary, "artifacts": done}


def _clean(s: str) -> str:
    return "".join(c if c.isalnum() or c in "_./- " else " " for c in s)


def flow_diagram(e: Engine, limit: int = 60) -> str:
    start = e.infer_entrypoints().where("primary").select("id")
    layers = tr.flow_layers(start, e.edges).orderBy("layer", "id").limit(limit)
    nodes = cut(layers.join(e.located.select("id", "name"), "id"))
    spine = {r.id for r in e.main_spine().collect()} if not start.isEmpty() else set()
    out = ["```mermaid", "flowchart TD"]
    rows = nodes.orderBy("layer", "id").collect()
    out += [f'  n{r.id}["{_clean(r.name)}"]' + (":::spine" if r.id in spine else "") for r in rows] or ['  empty["(no entry point)"]']
    out += [f"  n{r.src_id} --> n{r.dst_id}" for r in tr.induced(e.edges.where("kind = 'calls'"), nodes).select("src_id", "dst_id").distinct().orderBy("src_id", "dst_id").collect()]
    return "\n".join([*out, "classDef spine stroke-width:3px;", "```"])


def module_diagram(e: Engine, limit: int = 40) -> str:
    nodes, links = lk.module_map(e.located, e.graph.files, e.edges, "package")
    rows = nodes.where(~is_test_path(F.concat("module", F.lit("/x")))).orderBy(F.desc("symbols"), "module").limit(limit).collect()
    ids = {r.module: f"m{i}" for i, r in enumerate(rows)}
    out = ["```mermaid", "flowchart LR"]
    out += [f'  {ids[r.module]}["{_clean(r.module)} ({r.symbols})"]' for r in rows] or ['  empty["(no modules)"]']
    names = list(ids)
    for r in links.where(F.col("source").isin(names) & F.col("target").isin(names)).orderBy("source", "target").collect():
        out.append(f"  {ids[r.source]} -->|{r.weight}| {ids[r.target]}")
    return "\n".join([*out, "```"])


def layer_diagram(e: Engine) -> str | None:
    """Tiers, for applications and services."""
    got = e.infer_layers()
    if got["archetype"].first().archetype == "library":
        return None
    n = {r.layer: r.n for r in got["layers"].groupBy("layer").agg(F.count(F.lit(1)).alias("n")).collect()}
    tiers = [t for t in ("interface", "business", "data", "transport") if n.get(t)]
    chain = [t for t in tiers if t != "transport"]
    out = ["```mermaid", "flowchart TD", *[f'  {t}["{t} ({n[t]})"]' for t in tiers], *[f"  {a} --> {b}" for a, b in zip(chain, chain[1:])]]
    if n.get("transport") and n.get("business"):
        out.append("  business --> transport")
    return "\n".join([*out, "```"])


def diagram(e: Engine) -> str:
    parts = [("Flow", flow_diagram(e)), ("Packages", module_diagram(e)), ("Tiers", layer_diagram(e))]
    return "# Diagrams\n" + "".join(f"\n## {t}\n\n{b}\n" for t, b in parts if b)
