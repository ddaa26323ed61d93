"""One registry of named questions, and the front ends over it: plain calls and JSON-RPC (see also web and __main__).

Answers of front ends are documents for a person or an agent, so they come in pages of at most max_rows
rows, and a page says where the next one begins; the operators themselves return whole DataFrames.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.expose import allow_text, exposed
from graphlens.operators import algorithms as alg
from graphlens.operators import lookup as lk
from graphlens.operators import rank as rk
from graphlens.operators import traverse as tr
from graphlens.operators.snapshot import SYMBOL_COLUMNS, Graph, signature
from graphlens.session import cut, table

_PARSE, _REQUEST, _PARAMS, _METHOD, _TOOL = -32700, -32600, -32602, -32601, -32001


class ToolError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class Engine:
    """Questions over one data directory; what several of them need is computed once."""

    def __init__(self, spark: SparkSession, sf_dir: str, markers: DataFrame | None = None, max_rows: int = 10_000):
        self.spark, self.dir, self.max_rows = spark, sf_dir, max_rows
        self.graph = Graph(spark, sf_dir)
        self._given = markers
        self._kept: dict[str, DataFrame] = {}
        self._seen: tuple | None = None

    def _written(self) -> tuple:
        """When the tables were last written, as the file system says."""
        sc = self.spark.sparkContext
        top = sc._jvm.org.apache.hadoop.fs.Path(self.dir)
        fs = top.getFileSystem(sc._jsc.hadoopConfiguration())
        return tuple(sorted((s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(top)))

    def _table(self, name: str, schema: str) -> DataFrame:
        """A table that a data directory may lack."""
        if any(n == f"{name}.parquet" for n, _ in self._written()):
            return table(self.spark, self.dir, name)
        return self.spark.createDataFrame([], schema)

    @property
    def markers(self) -> DataFrame:
        return self._given if self._given is not None else self._table("markers", "id long, marker string, step int")

    def keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """Computed once, until a table is written again."""
        now = self._written()
        if now != self._seen:
            self._kept.clear()
            self._seen = now
        if name not in self._kept:
            self._kept[name] = cut(make())
        return self._kept[name]

    @property
    def located(self) -> DataFrame:
        return self.keep("located", lambda: self.graph.located(*SYMBOL_COLUMNS))

    @property
    def edges(self) -> DataFrame:
        return self.keep("edges", lambda: self.graph.edges)

    def _ids(self, name: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
        hit = self.located.where(F.col("name") == name)
        return (hit.where(F.col("kind").isin(*kinds)) if kinds else hit).select("id")

    def _named(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.located.select("id", "name", "path"), "id")

    # ---- tools

    def search_symbol(self, name: str) -> DataFrame:
        """Symbols of that name."""
        return lk.search_symbol(self.located, name).orderBy("path", "line_start", "id")

    def get_callers(self, symbol: str) -> DataFrame:
        """Symbols that call the given one."""
        return lk.callers(self.located, self.edges, symbol).orderBy("path", "line_start", "id")

    def get_dependencies(self, symbol: str) -> DataFrame:
        """Symbols the given one calls or imports."""
        return lk.dependencies(self.located, self.edges, symbol).orderBy("path", "name", "id")

    def get_coverage(self, name: str) -> DataFrame:
        """Coverage of a symbol, or null."""
        return lk.coverage_of(self.located, name)

    def get_test_coverage(self, name: str) -> DataFrame:
        """Tests that cover a symbol."""
        return lk.covering_tests(self.located, self.edges, name).orderBy("test")

    def get_uncovered_paths(self) -> DataFrame:
        """Symbols measured and never hit."""
        return lk.uncovered(self.located).orderBy("path", "line_start", "id")

    def trace_calls(self, symbol: str, direction: str = "both", depth: int = 3) -> DataFrame:
        """Calls from or to a symbol, hop by hop."""
        return self._named(tr.trace_calls(self._ids(symbol), self.edges, direction, int(depth))).orderBy("depth", "name", "direction", "id")

    def blast_radius(self, symbol: str) -> DataFrame:
        """What depends on a symbol, directly or not."""
        real = self.located.where((F.col("name") == symbol) & (F.col("kind") != "import")).select("id")
        return self._named(tr.blast_radius(real if not real.isEmpty() else self._ids(symbol), self.edges)).orderBy("distance", "name", "id")

    def get_architecture(self, hub_limit: int = 10) -> dict[str, DataFrame]:
        """Modules, hubs and definitions that nothing calls."""
        return {"modules": lk.symbols_per_file(self.graph.files, self.located).orderBy("path"), "hubs": lk.hubs(self.located, self.edges, int(hub_limit)),
                "entry_points": lk.uncalled(self.located, self.edges).orderBy("name", "id")}

    def infer_entrypoints(self) -> DataFrame:
        """Ranked entry points, the primary first."""
        return self.keep("entrypoints", lambda: rk.entrypoints(self.located, self.edges, self.markers)).orderBy("rank")

    def main_spine(self, entry: str | None = None) -> DataFrame:
        """The longest call path from an entry (the primary one if none is named)."""
        d = self.located.where("kind in ('function', 'class')")
        start = d.where(F.col("name") == entry).select("id") if entry else self.infer_entrypoints().where("primary").select("id")
        return self._named(alg.main_spine(start, d.select("id"), tr.induced(self.edges.where("kind = 'calls'"), d))).orderBy("layer", "name", "id")

    def infer_layers(self) -> dict[str, DataFrame]:
        """Archetype and the layer of every definition."""
        return {"archetype": rk.archetype(self.located, self.markers), "layers": rk.symbol_layers(self.graph.files, self.located, self.markers).orderBy("name", "id")}

    def centrality(self) -> DataFrame:
        """Betweenness, dominated symbols and degree."""
        return self.keep("centrality", lambda: rk.centrality(self.located, self.edges, self.infer_entrypoints().select("id"))).orderBy(F.desc("betweenness"), "name", "id")

    def suggest_test_targets(self) -> DataFrame:
        """Untested definitions, the most important first."""
        return rk.test_targets(self.located, self.edges, self.infer_entrypoints(), self.centrality()).orderBy(F.desc("score"), "name", "id")

    def test_plan(self, limit: int = 15) -> DataFrame:
        """Entry points that lack a test."""
        return rk.test_plan(self.located, self.edges, self.infer_entrypoints(), self.suggest_test_targets(), int(limit))

    def get_source(self, name: str | None = None, file: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        """Source of a symbol, or of lines of a file."""
        texts = table(self.spark, self.dir, "file_text")
        if name is not None:
            return lk.sources(self.located, texts, name).orderBy("path", "line_start", "id")
        if file is None or start is None:
            raise ToolError(_PARAMS, "name, or file and start, is needed")
        if int(start) < 1:
            raise ToolError(_PARAMS, "start must be at least 1")
        at = self.graph.files.where(F.col("path") == file).select(F.col("id").alias("file_id"), "path").withColumn("id", F.lit(0)).withColumn("name", F.lit(None).cast("string"))
        return lk.sources(at.withColumn("line_start", F.lit(int(start))).withColumn("line_end", F.lit(int(end or start))), texts)

    def get_outline(self, file: str) -> DataFrame:
        """Signatures of the functions and classes of the best matching file."""
        out = lk.outline(self.located, table(self.spark, self.dir, "file_text"), file)
        if out.isEmpty():
            raise ToolError(_TOOL, f"no file matches {file}")
        return out.orderBy("line_start", "id")

    def get_overview(self) -> dict[str, DataFrame]:
        """Archetype, entry points, layers, hubs and spine in one answer."""
        layers = self.infer_layers()
        return {"archetype": layers["archetype"], "layers": layers["layers"].groupBy("layer").agg(F.count(F.lit(1)).alias("n")).orderBy("layer"),
                "entrypoints": self.infer_entrypoints().limit(8), "hubs": lk.hubs(self.located, self.edges, 8), "spine": self.main_spine()}

    def list_symbols(self, file: str | None = None, kind: str | None = None) -> DataFrame:
        """Functions and classes, by file and kind if asked for."""
        return lk.list_symbols(self.located, file, kind).orderBy("path", "line_start", "id")

    def neighborhood(self, name: str, depth: int = 1) -> dict[str, DataFrame]:
        """What lies within some hops of a definition, edge directions ignored."""
        n = cut(tr.neighborhood(self._ids(name, ("function", "class")), self.edges, int(depth)))
        return {"nodes": self._named(n).orderBy("dist", "name", "id"), "edges": tr.induced(self.edges.where(F.col("kind").isin(*lk.STRUCTURE)), n).orderBy("src_id", "dst_id", "kind")}

    def module_map(self, level: str = "file") -> dict[str, DataFrame]:
        """Files or packages and the edges between them."""
        nodes, links = lk.module_map(self.located, self.graph.files, self.edges, level)
        return {"nodes": nodes.orderBy("module"), "edges": links.orderBy("source", "target")}

    def _detail(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.located.select("id", "name", "kind", "path", "line_start"), "id")

    def graph_view(self) -> dict[str, DataFrame]:
        """The whole graph: nodes with degree and coverage band, links, modules and the links between them."""
        modules, module_links = lk.module_map(self.located, self.graph.files, self.edges)
        nodes = lk.graph_nodes(self.located, self.edges).join(self.accessible(), "id", "left").withColumn("accessible", F.coalesce("accessible", F.lit(False)))
        return {"nodes": nodes.orderBy("id"), "links": self.edges.where(F.col("kind").isin(*lk.STRUCTURE)).orderBy("src_id", "dst_id", "kind"),
                "modules": modules.orderBy("module"), "module_links": module_links.orderBy("source", "target")}

    def accessible(self) -> DataFrame:
        """Symbols that the allow-list beside the tables exposes."""
        return exposed(self.located, allow_text(self.spark, self.dir))[0].select("id", F.lit(True).alias("accessible")).distinct()

    def focus(self, symbol: str, depth: int = 1) -> dict[str, DataFrame]:
        """What lies within some hops of a symbol of any kind, with the kinds of the edges."""
        n = cut(tr.neighborhood(self._ids(symbol), self.edges, max(int(depth), 0)))
        e = tr.induced(self.edges.where(F.col("kind").isin(*lk.STRUCTURE)), n)
        return {"nodes": self._detail(n).orderBy("dist", "name", "id"), "edges": e.select("src_id", "dst_id", "kind").orderBy("src_id", "dst_id", "kind")}

    def flow(self, symbol: str) -> dict[str, DataFrame]:
        """What a symbol calls, directly or not, in layers."""
        return self._flow(self._ids(symbol))

    def _flow(self, start: DataFrame) -> dict[str, DataFrame]:
        n = cut(tr.flow_layers(start, self.edges))
        e = tr.induced(self.edges.where("kind = 'calls'").select("src_id", "dst_id"), n)
        return {"nodes": self._detail(n).orderBy("layer", "name", "id"), "edges": e.orderBy("src_id", "dst_id")}

    def system_flow(self, root: str | None = None) -> dict[str, DataFrame]:
        """The flow from the primary entry point (or root), what lies on the main spine marked."""
        start = self._ids(root) if root else self.infer_entrypoints().where("primary").select("id")
        flow = self._flow(start)
        spine = self.main_spine(root).select("id", F.lit(True).alias("on_spine"))
        nodes = flow["nodes"].join(spine, "id", "left").withColumn("on_spine", F.coalesce("on_spine", F.lit(False)))
        return {"nodes": nodes.orderBy("layer", "name", "id"), "edges": flow["edges"]}

    def data_flow(self, symbol: str) -> dict[str, DataFrame]:
        """Where the parameters of a symbol go, in layers; the edges name the parameter."""
        flows = self._table("dataflow", "src_id long, dst_id long, param string")
        n = cut(tr.data_flow_layers(self._ids(symbol), flows))
        return {"nodes": self._detail(n).orderBy("layer", "name", "id"), "edges": tr.induced(flows, n).orderBy("src_id", "dst_id", "param")}

    def exec_path(self, test: str) -> dict[str, DataFrame]:
        """What a test covers, laid out from what no covered symbol calls."""
        n = cut(tr.exec_path(self._ids(test), self.edges).groupBy("id").agg(F.min("layer").alias("layer")))
        e = tr.induced(self.edges.where("kind = 'calls'").select("src_id", "dst_id"), n)
        return {"nodes": self._detail(n).orderBy("layer", "name", "id"), "edges": e.orderBy("src_id", "dst_id")}

    def tests(self) -> DataFrame:
        """Tests and how many symbols each covers."""
        return lk.covers_per_test(self.located, self.edges).orderBy("name", "id")

    def class_view(self) -> dict[str, DataFrame]:
        """Classes with their methods, and what they inherit."""
        classes, inherits = lk.class_view(self.located, self.edges)
        return {"classes": classes.orderBy("path", "name", "id"), "edges": inherits.orderBy("src_id", "dst_id")}

    def layer_view(self) -> dict[str, DataFrame]:
        """Definitions by layer, web endpoints marked, and the calls between them."""
        symbols, calls = rk.layer_view(self.graph.files, self.located, self.edges, self.markers)
        return {"archetype": rk.archetype(self.located, self.markers), "symbols": symbols.orderBy("tier", "name", "id"), "edges": calls.orderBy("src_id", "dst_id")}

    def trace(self, test: str) -> dict[str, DataFrame]:
        """What a traced test ran, in order."""
        nodes, edges = lk.trace_view(self.graph.trace.where(F.col("test") == test))
        return {"nodes": self._detail(nodes.drop("test")).orderBy("first_seq", "id"), "edges": edges.drop("test").orderBy("seq")}

    def traces(self) -> DataFrame:
        """Traced tests and their calls."""
        return lk.calls_per_test(self.graph.trace).orderBy("test")

    def version(self) -> DataFrame:
        """Changes when the graph does."""
        return signature(self.graph)

    # ---- front ends

    @classmethod
    def tools(cls) -> dict[str, Callable]:
        hidden = {"keep", "tools", "handle", "answer", "catalogue", "accessible"}
        return {k: f for k, f in vars(cls).items() if callable(f) and not k.startswith("_") and k not in hidden}

    @classmethod
    def catalogue(cls) -> list[dict[str, Any]]:
        out = []
        for name, f in cls.tools().items():
            given = f.__code__.co_varnames[1:f.__code__.co_argcount]
            needed = list(given[:len(given) - len(f.__defaults__ or ())])
            props = {a: {"type": "integer" if "int" in str(f.__annotations__.get(a, "")) else "string"} for a in given} | {"offset": {"type": "integer"}}
            out.append({"name": name, "description": (f.__doc__ or "").strip(), "inputSchema": {"type": "object", "properties": props} | ({"required": needed} if needed else {})})
        return out

    def _plain(self, value: Any, offset: int) -> Any:
        if isinstance(value, dict):
            return {k: self._plain(v, offset) for k, v in value.items()}
        rows = [json.loads(r.j) for r in value.offset(offset).limit(self.max_rows + 1).select(F.to_json(F.struct(*value.columns), {"ignoreNullFields": "false"}).alias("j")).collect()]
        return rows if len(rows) <= self.max_rows else [*rows[:self.max_rows], {"truncated": True, "next_offset": offset + self.max_rows}]

    def answer(self, tool: str, arguments: dict[str, Any]) -> Any:
        """Rows of a tool; beyond max_rows the last one names the offset at which to ask again."""
        f = self.tools().get(tool)
        if f is None:
            raise ToolError(_METHOD, f"unknown tool: {tool}")
        args = dict(arguments)
        given = f.__code__.co_varnames[1:f.__code__.co_argcount]
        for a, b in (("name", "symbol"), ("symbol", "name")):  # either word names the symbol
            if a in args and a not in given and b in given:
                args[b] = args.pop(a)
        offset = args.pop("offset", 0)
        missing = [a for a in given[:len(given) - len(f.__defaults__ or ())] if a not in args]
        unknown = [a for a in args if a not in given]
        if missing or unknown:
            raise ToolError(_PARAMS, f"missing: {missing}, unknown: {unknown}")
        try:
            return self._plain(f(self, **args), max(int(offset), 0))
        except (ValueError, TypeError) as e:
            raise ToolError(_PARAMS, str(e)) from e

    def handle(self, request: str) -> str:
        """Answer one JSON-RPC request; never raises, and a notification gets an empty string."""
        ident = None
        try:
            try:
                q = json.loads(request)
            except ValueError as e:
                raise ToolError(_PARSE, f"no JSON: {e}") from e
            if not isinstance(q, dict) or not isinstance(q.get("method"), str):
                raise ToolError(_REQUEST, "method is missing")
            ident = q.get("id")
            if "id" not in q and q["method"].startswith("notifications/"):
                return ""
            params = q.get("params") or {}
            if not isinstance(params, dict):
                raise ToolError(_PARAMS, "params must be an object")
            if q["method"] == "initialize":
                result: Any = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "graphlens", "version": "0.1.0"}}
            elif q["method"] == "tools/list":
                result = {"tools": self.catalogue()}
            elif q["method"] == "tools/call":
                if not isinstance(params.get("name"), str):
                    raise ToolError(_PARAMS, "name is missing")
                result = {"content": [{"type": "text", "text": json.dumps(self.answer(params["name"], params.get("arguments") or {}), ensure_ascii=False)}]}
            else:
                result = self.answer(q["method"], params)
            return json.dumps({"jsonrpc": "2.0", "id": ident, "result": result}, ensure_ascii=False)
        except ToolError as e:
            return json.dumps({"jsonrpc": "2.0", "id": ident, "error": {"code": e.code, "message": str(e)}})
        except Exception as e:  # noqa: BLE001 - the server must go on
            return json.dumps({"jsonrpc": "2.0", "id": ident, "error": {"code": _TOOL, "message": str(e)[:500]}})
