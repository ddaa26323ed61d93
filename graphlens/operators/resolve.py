"""References in source turned into edges.

Facts come from extraction (sources.extract): imports, call sites, constructor bindings, class bases,
parameters. All resolution is joins against counted name indexes; nothing ambiguous becomes an edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.paths import module_parts, suffixes
from graphlens.operators.spans import innermost

DEFINING = ("function", "class", "foreign_export")


def resolve_names(refs: DataFrame, definitions: DataFrame) -> DataFrame:
    """refs (ref, name, file_id) with dst_id and status.

    unique (one definition of the name), same_file (several, one of them in the file), ambiguous or
    unresolved. definitions has (id, name, file_id).
    """
    g = definitions.groupBy("name").agg(F.count(F.lit(1)).alias("g_n"), F.min("id").alias("g_id"))
    l = definitions.groupBy("name", "file_id").agg(F.count(F.lit(1)).alias("l_n"), F.min("id").alias("l_id"))
    j = refs.join(g, "name", "left").join(l, ["name", "file_id"], "left")
    dst = F.when(F.col("g_n") == 1, F.col("g_id")).when(F.col("l_n") == 1, F.col("l_id"))
    status = F.when(F.col("g_n") == 1, "unique").when(F.col("l_n") == 1, "same_file").when(F.col("g_n") > 1, "ambiguous").otherwise("unresolved")
    return j.select(*refs.columns, dst.alias("dst_id"), status.alias("status"))


def module_keys(files: DataFrame) -> DataFrame:
    """(file_id, key): every suffix of each file's module path."""
    return files.select(F.col("id").alias("file_id"), F.explode(suffixes(module_parts("path"))).alias("key"))


def resolve_imports(imports: DataFrame, definitions: DataFrame, files: DataFrame) -> DataFrame:
    """imports (ref, file_id, original, module) with dst_id and status.

    The only definition of a name is taken whatever the module says; of several, the only one in a file
    that the module names.
    """
    g = definitions.groupBy(F.col("name").alias("original")).agg(F.count(F.lit(1)).alias("g_n"), F.min("id").alias("g_id"))
    key = F.array_join(F.filter(F.split("module", r"\."), lambda x: x != ""), "/")
    in_module = definitions.join(module_keys(files), "file_id").groupBy(F.col("name").alias("original"), "key").agg(F.count(F.lit(1)).alias("m_n"), F.min("id").alias("m_id"))
    j = imports.withColumn("key", F.when(key != "", key)).join(g, "original", "left").join(in_module, ["original", "key"], "left")
    dst = F.when(F.col("g_n") == 1, F.col("g_id")).when(F.col("m_n") == 1, F.col("m_id"))
    status = F.when(F.col("g_n") == 1, "unique").when(F.col("m_n") == 1, "module").when(F.col("g_n") > 1, "ambiguous").otherwise("unresolved")
    return j.select(*imports.columns, dst.alias("dst_id"), status.alias("status"))


def import_rows(symbols: DataFrame) -> DataFrame:
    return symbols.where("kind = 'import'").where(F.coalesce("import_name", "name") != "*").select(
        F.col("id").alias("ref"), "file_id", F.coalesce("import_name", "name").alias("original"), F.col("import_module").alias("module"), F.col("name").alias("bound"))


def definition_index(symbols: DataFrame, foreign: bool = True) -> DataFrame:
    kinds = DEFINING if foreign else DEFINING[:2]
    return symbols.where(F.col("kind").isin(*kinds)).select("id", "name", "file_id")


def import_edges(symbols: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src_id, dst_id, kind) and the map (file_id, bound, dst_id), the last import of a name winning."""
    r = resolve_imports(import_rows(symbols), definition_index(symbols), files).where("dst_id is not null")
    edges = r.where("ref <> dst_id").select(F.col("ref").alias("src_id"), "dst_id", F.lit("imports").alias("kind")).distinct()
    bound = r.groupBy("file_id", "bound").agg(F.max_by("dst_id", "ref").alias("import_id"))
    return edges, bound


def _callers(sites: DataFrame, symbols: DataFrame, functions_only: bool = False) -> DataFrame:
    keep = "kind = 'function'" if functions_only else "kind <> 'import'"
    spans = symbols.where(keep).where("line_start is not null").select(F.col("id").alias("src_id"), "file_id", F.col("line_start").alias("start"), F.col("line_end").alias("end"))
    return sites.join(innermost(sites.select("site", "file_id", "line"), spans, "file_id", "line", "site", "src_id"), "site")


def method_table(symbols: DataFrame) -> DataFrame:
    """(class_id, method, method_id): functions whose span lies within a class, innermost; the last of equal names."""
    f = symbols.where("kind = 'function' and line_start is not null and line_end is not null")
    c = symbols.where("kind = 'class' and line_start is not null and line_end is not null").select(F.col("id").alias("class_id"), "file_id", F.col("line_start").alias("start"), F.col("line_end").alias("end"))
    from graphlens.operators.spans import spans_at

    hit = spans_at(f.select("id", "file_id", F.col("line_start").alias("at"), F.col("line_end").alias("until"), "name"), c, "file_id", "at").where("until <= end")
    inner = hit.groupBy("id", "name").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("w"), "class_id")).alias("b")).select(F.col("id").alias("method_id"), F.col("name").alias("method"), F.col("b.class_id").alias("class_id"))
    return inner


def call_edges(sites: DataFrame, assigns: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Call sites (site, file_id, line, callee, receiver, var) with src_id, dst_id and status.

    Order: a receiver of known class, the file's imports, the name rule. A site outside any definition
    is dropped; a typed step that finds nothing falls through.
    """
    defs = definition_index(symbols)
    _, bound = import_edges(symbols, files)
    c = _callers(sites, symbols)
    methods = method_table(symbols)
    by_name = methods.groupBy("class_id", "method").agg(F.max("method_id").alias("typed_id"))
    own_class = methods.select(F.col("method_id").alias("src_id"), F.col("class_id").alias("self_class"))
    spans = symbols.select(F.col("id").alias("src_id"), F.col("line_start").alias("s0"), F.coalesce("line_end", "line_start").alias("s1"))
    local = c.where("receiver = 'local'").join(spans, "src_id").join(assigns.select("file_id", F.col("line").alias("a_line"), "var", "class_name"), ["file_id", "var"]).where("a_line between s0 and s1")
    one = local.groupBy("site", "file_id").agg(F.countDistinct("class_name").alias("n"), F.min("class_name").alias("name")).where("n = 1")
    var_class = resolve_names(one.select(F.col("site").alias("ref"), "name", "file_id"), defs).select(F.col("ref").alias("site"), F.col("dst_id").alias("var_class"))
    plain = resolve_names(c.select(F.col("site").alias("ref"), F.col("callee").alias("name"), "file_id"), defs).select(F.col("ref").alias("site"), F.col("dst_id").alias("name_id"), "status")
    j = (c.join(own_class, "src_id", "left").join(var_class, "site", "left")
         .withColumn("class_id", F.when(F.col("receiver") == "self", F.col("self_class")).when(F.col("receiver") == "local", F.col("var_class")))
         .join(by_name.withColumnRenamed("method", "callee"), ["class_id", "callee"], "left")
         .join(bound.withColumnRenamed("bound", "callee"), ["file_id", "callee"], "left").join(plain, "site", "left"))
    status = F.when(F.col("typed_id").isNotNull(), "typed").when(F.col("import_id").isNotNull(), "import").otherwise(F.col("status"))
    return j.select("site", "src_id", F.coalesce("typed_id", "import_id", "name_id").alias("dst_id"), status.alias("status"))


def inherit_edges(bases: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Edges from classes (file_id, line, base) to their bases: the file's imports first, then the name rule."""
    cls = symbols.where("kind = 'class' and line_start is not null").groupBy("file_id", F.col("line_start").alias("line")).agg(F.min("id").alias("src_id"))
    _, bound = import_edges(symbols, files)
    refs = bases.join(cls, ["file_id", "line"]).select("src_id", "file_id", F.col("base").alias("name")).distinct()
    r = resolve_names(refs, definition_index(symbols)).join(bound.withColumnRenamed("bound", "name"), ["file_id", "name"], "left")
    return r.select("src_id", F.coalesce("import_id", "dst_id").alias("dst_id"), F.lit("inherits").alias("kind")).where("dst_id is not null and src_id <> dst_id").distinct()


def edges_of_calls(resolved: DataFrame) -> DataFrame:
    """Edges (src_id, dst_id, kind) of resolved call sites."""
    return resolved.where("dst_id is not null").select("src_id", "dst_id", F.lit("calls").alias("kind"))


def status_counts(resolved: DataFrame) -> DataFrame:
    """(status, n): how many sites were resolved in which way, or not."""
    return resolved.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def build_edges(facts: dict[str, DataFrame], symbols: DataFrame, files: DataFrame) -> DataFrame:
    """All distinct edges (src_id, dst_id, kind) of calls, imports and inherits."""
    calls = edges_of_calls(call_edges(facts["calls"], facts["assigns"], symbols, files))
    return calls.unionByName(import_edges(symbols, files)[0]).unionByName(inherit_edges(facts["bases"], symbols, files)).distinct()


def build_dataflow(sites: DataFrame, params: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(src_id, dst_id, param): parameters of a function handed on as bare arguments.

    sites has args (array of names), params (file_id, line, param) is keyed by the function's line.
    """
    c = _callers(sites, symbols, functions_only=True).join(symbols.select(F.col("id").alias("src_id"), F.col("line_start").alias("f_line")), "src_id")
    passed = c.select("site", "file_id", "callee", "src_id", "f_line", F.explode(F.array_distinct("args")).alias("param"))
    own = passed.join(params.select("file_id", F.col("line").alias("f_line"), "param").distinct(), ["file_id", "f_line", "param"])
    _, bound = import_edges(symbols, files)
    plain = resolve_names(own.select(F.col("site").alias("ref"), F.col("callee").alias("name"), "file_id").distinct(), definition_index(symbols, False)).select(F.col("ref").alias("site"), F.col("dst_id").alias("name_id"))
    j = own.join(bound.withColumnRenamed("bound", "callee"), ["file_id", "callee"], "left").join(plain, "site", "left")
    return j.select("src_id", F.coalesce("import_id", "name_id").alias("dst_id"), "param").where("dst_id is not null").distinct()
