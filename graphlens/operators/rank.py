"""Entry points, layers, test targets: what matters in a code base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.paths import is_test_code, is_test_path
from graphlens.operators.algorithms import betweenness, dominated_counts, root_members
from graphlens.operators.heavy_keys import balanced_row_number
from graphlens.operators.lookup import covered_names, degrees, public_api
from graphlens.operators.traverse import MAX_EDGES, bfs, induced, reach_sizes, reversed_
from graphlens.session import cut
from graphlens.sources.extract import CLI_DECORATORS, WEB_DECORATORS

# Top-level packages by family.
WEB = "flask fastapi starlette django aiohttp bottle tornado sanic quart".split()
QUEUE_RPC = "kafka confluent_kafka celery pika grpc aio_pika nameko".split()
TRANSPORT = "requests httpx urllib3 websockets kafka confluent_kafka celery pika grpc aio_pika nameko".split()
DATA = "sqlalchemy psycopg psycopg2 sqlite3 pymongo redis mysql asyncpg peewee tortoise motor cassandra elasticsearch".split()
RUN_MARKERS = ("main", "main_guard", "console_script", "cli")


def decorator_marker(name):
    c = F.col(name) if isinstance(name, str) else name
    last = F.element_at(F.split(c, r"\."), -1)
    return F.when(last.isin(*WEB_DECORATORS), "web_route").when(last.isin(*CLI_DECORATORS), "cli")


def entrypoints(located: DataFrame, edges: DataFrame, markers: DataFrame, max_edges: int = MAX_EDGES, inner: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(rank, id, name, path, marker, is_library, degree, reach, primary).

    Candidates are members of components that no other calls, and marked symbols; without any, every
    definition. markers has (id, marker, step): the smallest step counts. A project without a run or web
    marker is a library, and all its public definitions are marked too. inner: the definitions and the calls among them (see
    defined_calls), where they and edges have been written already.
    """
    if inner is None:
        edges = cut(edges)
        inner = defined_calls(located, edges)
    d, calls = inner
    roots = root_members(d.select("id"), calls, max_edges)
    own = markers.groupBy("id").agg(F.min(F.struct("step", "marker")).alias("m")).select("id", F.col("m.marker").alias("marker"))
    library = own.where(F.col("marker").isin(*RUN_MARKERS, "web_route")).isEmpty()
    if library:
        public = public_api(located).select("id").withColumn("public", F.lit("public_api"))
        own = public.join(own, "id", "full").select("id", F.coalesce("marker", "public").alias("marker"))
    candidates = cut(d.join(roots.unionByName(own.select("id")).distinct(), "id", "left_semi"))
    if candidates.isEmpty():
        candidates = d
    scored = (candidates.join(own, "id", "left").join(degrees(edges), "id", "left").join(reach_sizes(candidates, edges, max_edges), "id", "left")
              .withColumn("degree", F.coalesce("degree", F.lit(0).cast("long"))).withColumn("reach", F.coalesce("reach", F.lit(0).cast("long"))))
    keys = [F.col("marker").isNotNull().desc(), *([F.desc("degree"), F.desc("reach")] if library else [F.desc("reach"), F.desc("degree")]), F.col("name"), F.col("id")]
    # one ranking over all candidates, numbered range by range
    ranked = balanced_row_number(scored, [], keys, "rank").withColumn("rank", F.col("rank").cast("int"))
    return ranked.select("rank", "id", "name", "path", "marker", F.lit(library).alias("is_library"), "degree", "reach", (F.col("rank") == 1).alias("primary"))


def defined_calls(located: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions and the calls (src_id, dst_id) among them, written once."""
    d = cut(located.where("kind in ('function', 'class')").select("id", "name", "kind", "path", "file_id", "line_start", "line_end"))
    return d, cut(induced(edges.where("kind = 'calls'").select("src_id", "dst_id"), d))


def import_roots(symbols: DataFrame) -> DataFrame:
    """(file_id, root): first dotted part of what each import names."""
    key = F.coalesce("import_module", "import_name", "name")
    return symbols.where("kind = 'import'").select("file_id", F.split(key, r"\.")[0].alias("root")).distinct()


def file_layers(files: DataFrame, symbols: DataFrame, markers: DataFrame) -> DataFrame:
    """(file_id, layer): interface, data, transport or business; the first that holds."""
    marked = symbols.join(markers.where(F.col("marker").isin("web_route", "cli")), "id", "left_semi").select("file_id").distinct().withColumn("marked", F.lit(True))
    has = lambda names: F.max(F.col("root").isin(*names).cast("int")) == 1
    fam = import_roots(symbols).groupBy("file_id").agg(has(WEB).alias("web"), has(DATA).alias("data"), has(TRANSPORT).alias("transport"))
    j = files.select(F.col("id").alias("file_id")).join(fam, "file_id", "left").join(marked, "file_id", "left")
    return j.select("file_id", F.when(F.coalesce("marked", F.lit(False)) | F.coalesce("web", F.lit(False)), "interface")
                    .when(F.coalesce("data", F.lit(False)), "data").when(F.coalesce("transport", F.lit(False)), "transport").otherwise("business").alias("layer"))


def symbol_layers(files: DataFrame, symbols: DataFrame, markers: DataFrame) -> DataFrame:
    return symbols.where("kind in ('function', 'class')").select("id", "name", "file_id").join(file_layers(files, symbols, markers), "file_id").select("id", "name", "layer")


def archetype(symbols: DataFrame, markers: DataFrame) -> DataFrame:
    """One row: service, application or library."""
    service = F.coalesce(F.max(F.col("root").isin(*WEB, *QUEUE_RPC).cast("int")), F.lit(0))
    a = import_roots(symbols).agg(service.alias("imports"))
    m = markers.agg(F.coalesce(F.max((F.col("marker") == "web_route").cast("int")), F.lit(0)).alias("web"), F.coalesce(F.max(F.col("marker").isin(*RUN_MARKERS).cast("int")), F.lit(0)).alias("run"))
    return a.join(F.broadcast(m)).select(F.when((F.col("imports") == 1) | (F.col("web") == 1), "service").when(F.col("run") == 1, "application").otherwise("library").alias("archetype"))


def centrality(located: DataFrame, edges: DataFrame, roots: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(id, name, path, betweenness, dominates, degree) of definitions over calls; roots (id) hang under the virtual root."""
    d = cut(located.where("kind in ('function', 'class')").select("id", "name", "path"))
    calls = cut(induced(edges.where("kind = 'calls'"), d))
    return gateways(d, calls, roots, max_edges).join(betweenness(d, calls, max_edges), "id").select("id", "name", "path", "betweenness", "dominates", "degree")


def gateways(d: DataFrame, calls: DataFrame, roots: DataFrame, max_edges: int = MAX_EDGES, distinct: bool = False) -> DataFrame:
    """(id, name, path, dominates, degree) of definitions d (id, name, path) over the calls among them: centrality without a path from every source.

    distinct: no call stands there twice.
    """
    return (d.join(dominated_counts(roots, d, calls, max_edges, distinct), "id").join(degrees(calls.select("src_id", "dst_id", F.lit("calls").alias("kind")), ("calls",)), "id", "left")
            .withColumn("degree", F.coalesce("degree", F.lit(0).cast("long"))).select("id", "name", "path", "dominates", "degree"))


def test_targets(located: DataFrame, edges: DataFrame, ranked: DataFrame, central: DataFrame) -> DataFrame:
    """(id, name, path, score, reason): definitions no test covers, outside tests."""
    covered = edges.where("kind = 'test_covers'").select(F.col("dst_id").alias("id")).distinct()
    d = located.where("kind in ('function', 'class')").where(~is_test_code("name", "path")).select("id", "name", "path").join(covered, "id", "left_anti")
    j = d.join(ranked.select("id", "primary", "marker", F.lit(True).alias("entry")), "id", "left").join(central.select("id", "betweenness", "dominates", "degree"), "id", "left")
    b, dom = F.coalesce("betweenness", F.lit(0.0)), F.coalesce("dominates", F.lit(0))
    base = F.when(F.col("primary"), 1000.0).when(F.col("entry"), 200.0).otherwise(0.0)
    entry = F.when(F.col("primary"), "primary entrypoint").when(
        F.col("entry"), F.when(F.col("marker").isNotNull(), F.concat(F.lit("entrypoint ("), "marker", F.lit(")"))).otherwise("entrypoint"))
    why = F.concat_ws("; ", entry, F.when(b > 0, F.format_string("chokepoint (betweenness %.1f)", b)), F.when(dom > 0, F.format_string("gateway (dominates %d)", dom)))
    score = base + b * 10 + dom * 5 + F.coalesce("degree", F.lit(0))
    return j.select("id", "name", "path", score.alias("score"), F.when(why == "", "untested").otherwise(why).alias("reason"))


def test_plan(located: DataFrame, edges: DataFrame, ranked: DataFrame, targets: DataFrame, limit: int = 15) -> DataFrame:
    """The best entry points outside test files, untested ones first."""
    top = ranked.where(~is_test_path("path")).orderBy(F.col("primary").desc(), F.desc("reach"), "rank").limit(limit)
    names = covered_names(located, edges).withColumn("has_test", F.lit(True))
    why = targets.groupBy("name").agg(F.max_by("reason", F.struct("score", F.negative("id"))).alias("reason"))
    out = top.join(names, "name", "left").join(why, "name", "left").select(
        "name", "path", "primary", "reach", F.coalesce("has_test", F.lit(False)).alias("has_test"),
        F.coalesce("reason", F.when(F.col("primary"), "primary entrypoint").otherwise("entrypoint")).alias("reason"))
    return out.orderBy("has_test", F.col("primary").desc(), F.desc("reach"), "name")


def risk(hubs: DataFrame, edges: DataFrame, limit: int = 5, max_edges: int = MAX_EDGES) -> DataFrame:
    """(id, name, affected): how much depends on the first hubs outside tests, all in one traversal."""
    top = cut(hubs.where(~is_test_path("path")).orderBy(F.desc("degree"), "name", "id").limit(limit))
    e = edges.where("kind in ('calls', 'imports', 'inherits')")
    hit = bfs(top.select(F.col("id").alias("origin"), F.col("id").alias("node")), reversed_(e), None, max_edges)
    n = hit.where("node <> origin").groupBy(F.col("origin").alias("id")).agg(F.count(F.lit(1)).alias("affected"))
    return top.join(n, "id", "left").select("id", "name", F.coalesce("affected", F.lit(0).cast("long")).alias("affected")).orderBy(F.desc("affected"), "name")


def layer_view(files: DataFrame, located: DataFrame, edges: DataFrame, markers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions (id, name, path, layer, tier, endpoint) and the calls (src_id, dst_id) among them.

    tier orders the layers from interface to transport; a symbol is an endpoint if its name is that of one marked as a web route.
    """
    web = located.join(markers.where("marker = 'web_route'").select("id").distinct(), "id", "left_semi").select("name", F.lit(True).alias("endpoint")).distinct()
    tier = F.array_position(F.array(*map(F.lit, ("interface", "business", "data", "transport"))), F.col("layer"))
    s = symbol_layers(files, located, markers).select("id", "layer").join(located.select("id", "name", "path"), "id").join(web, "name", "left")
    symbols = s.select("id", "name", "path", "layer", tier.alias("tier"), F.coalesce("endpoint", F.lit(False)).alias("endpoint"))
    return symbols, induced(edges.where("kind = 'calls'").select("src_id", "dst_id"), symbols)
