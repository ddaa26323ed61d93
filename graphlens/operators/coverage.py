"""Line coverage, per-test lines and runtime traces brought onto symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.paths import suffixes
from graphlens.operators.spans import innermost, spans_at
from graphlens.session import cut


def _parts(path):
    return F.filter(F.split(F.col(path), r"[/\\]"), lambda x: (x != "") & (x != "."))


def reconcile(reports: DataFrame, files: DataFrame) -> DataFrame:
    """(report, file_id): the graph file a reported path stands for.

    Paths match if the components of one are a suffix of the other's. One match is taken even if it is
    not exact; of several only a single exact one. All suffixes become keys, and each key is reduced to
    the number of its files before it meets a report, so a name that many files share is one row.
    """
    r = reports.select("report").where("report is not null").distinct().withColumn("parts", _parts("report")).where(F.size("parts") > 0)
    g = files.select(F.col("id").alias("file_id"), F.col("path")).withColumn("gparts", _parts("path")).where(F.size("gparts") > 0)
    full = F.array_join("gparts", "/")
    # files by the suffixes of their path: the report is the shorter one, or the same
    inside = g.select("file_id", full.alias("whole"), F.explode(suffixes("gparts")).alias("key")).groupBy("key").agg(
        F.countDistinct("file_id").alias("n"), F.min("file_id").alias("one"), F.min(F.when(F.col("whole") == F.col("key"), F.col("file_id"))).alias("exact"),
        F.countDistinct(F.when(F.col("whole") == F.col("key"), F.col("file_id"))).alias("n_exact"))
    # files by their whole path: the report is the longer one
    whole = g.groupBy(full.alias("key")).agg(F.countDistinct("file_id").alias("n"), F.min("file_id").alias("one"))
    r_full = r.select("report", F.array_join("parts", "/").alias("key"))
    none = F.lit(None).cast("long")
    r_rest = r.select("report", F.explode(suffixes("parts")).alias("key"), F.array_join("parts", "/").alias("own")).where("key <> own").drop("own")
    hits = r_full.join(inside, "key").select("report", "n", "one", "n_exact", "exact").unionByName(
        r_rest.join(whole, "key").select("report", "n", "one", F.lit(0).cast("long").alias("n_exact"), none.alias("exact")))
    c = hits.groupBy("report").agg(F.sum("n").alias("n"), F.min("one").alias("one"), F.sum("n_exact").alias("n_exact"), F.min("exact").alias("exact"))
    return c.where("n = 1 or n_exact = 1").select("report", F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("exact")).alias("file_id"))


def file_line_coverage(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, line, covered) from report lines (report, line, covered); several reports of a line are OR-ed."""
    m = reconcile(lines.select("report"), files)
    return lines.join(m, "report").groupBy("file_id", "line").agg(F.max("covered").alias("covered"))


def symbol_coverage(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, pct): share of the reported lines within each symbol's span that were hit; null where none was reported."""
    spans = symbols.where("line_start is not null").select("id", "file_id", F.col("line_start").alias("start"), F.col("line_end").alias("end"))
    hit = spans_at(lines.select("file_id", "line", "covered"), spans, "file_id", "line")
    n = hit.groupBy("id").agg((F.sum(F.col("covered").cast("int")) * 100.0 / F.count(F.lit(1))).alias("pct"))
    return spans.select("id").join(n, "id", "left")


def apply_coverage(symbols: DataFrame, lines: DataFrame, reset: bool = True) -> DataFrame:
    """symbols with coverage_pct written anew: in reported files every symbol with a line, elsewhere null (reset) or as it was."""
    reported = lines.select("file_id").distinct().withColumn("_reported", F.lit(True))
    pct = symbol_coverage(symbols, lines).withColumnRenamed("pct", "_pct")
    old = F.lit(None).cast("double") if reset else F.col("coverage_pct")
    new = F.when(F.col("_reported") & F.col("line_start").isNotNull(), F.col("_pct")).otherwise(old)
    return symbols.join(reported, "file_id", "left").join(pct, "id", "left").withColumn("coverage_pct", new).select(*symbols.columns)


def test_label(column):
    """Last part of a node id: after the last '::', before '[' and '|'."""
    return F.split(F.element_at(F.split(F.split(column, r"\|")[0], "::"), -1), r"\[")[0]


def context_test_name(column):
    """Test of a coverage context: last dotted part, cut at '['."""
    return F.split(F.element_at(F.split(column, r"\."), -1), r"\[")[0]


def map_tests(hits: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Edges (src_id, dst_id, kind='test_covers') from per-test lines (test, report, line).

    The test is the symbol of its name in the file its label names, if that is one, else the only one
    of the name anywhere; the target is the innermost symbol around the line.
    """
    t = hits.select("test").distinct().withColumn("name", test_label(F.col("test")))
    t = t.withColumn("hint", F.when(F.col("test").contains("::"), F.split("test", "::")[0]))
    named = symbols.select("id", "file_id", "name")
    whole = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only_id"))
    hinted = t.where("hint is not null").join(reconcile(t.select(F.col("hint").alias("report")), files).withColumnRenamed("report", "hint"), "hint").join(named, ["file_id", "name"])
    in_file = hinted.groupBy("test").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("hint_id")).where("k = 1")
    src = t.join(in_file, "test", "left").join(whole, "name", "left").select("test", F.coalesce("hint_id", F.when(F.col("n") == 1, F.col("only_id"))).alias("src_id")).where("src_id is not null")
    at = hits.join(reconcile(hits.select("report"), files), "report").select("test", "file_id", "line").distinct()
    spans = symbols.where("line_start is not null").select(F.col("id").alias("dst_id"), "file_id", F.col("line_start").alias("start"), F.col("line_end").alias("end"))
    inner = innermost(at.select("file_id", "line").distinct(), spans, "file_id", "line", ["file_id", "line"], "dst_id")
    dst = at.join(inner, ["file_id", "line"]).select("test", "dst_id")
    is_test = symbols.where(F.col("name").startswith("test_")).select(F.col("id").alias("dst_id"))
    return dst.join(src, "test").where("src_id <> dst_id").join(is_test, "dst_id", "left_anti").select("src_id", "dst_id", F.lit("test_covers").alias("kind")).distinct()


def ingest_trace(events: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(test, seq, depth, src_id, dst_id) from raw events with caller_file/line and callee_file/line.

    A file is the longest graph path that is a suffix of it (the first of equals); a point is the innermost function
    or class. Events whose callee is unknown are dropped, an unknown caller is null.
    """
    seen = events.select(F.explode(F.array("caller_file", "callee_file")).alias("report")).where("report is not null").distinct()
    keys = seen.withColumn("parts", _parts("report")).where(F.size("parts") > 0).select("report", F.explode(suffixes("parts")).alias("key"))
    full = files.select(F.col("id").alias("file_id"), F.array_join(_parts("path"), "/").alias("key"))
    best = keys.join(full, "key").groupBy("report").agg(F.max(F.struct(F.length("key").alias("n"), F.negative("file_id").alias("f"))).alias("b")).select("report", F.negative("b.f").alias("file_id"))
    points = events.select(F.explode(F.array(F.struct(F.col("caller_file").alias("report"), F.col("caller_line").alias("line")), F.struct(F.col("callee_file").alias("report"), F.col("callee_line").alias("line")))).alias("p")).select("p.*")
    located = points.where("report is not null and line is not null").distinct().join(best, "report")
    spans = symbols.where("kind in ('function', 'class') and line_start is not null").select(F.col("id").alias("sid"), "file_id", F.col("line_start").alias("start"), F.col("line_end").alias("end"))
    inner = cut(innermost(located, spans, "file_id", "line", ["report", "line"], "sid"))
    end = lambda side, name: inner.select(F.col("report").alias(f"{side}_file"), F.col("line").alias(f"{side}_line"), F.col("sid").alias(name))
    return events.join(end("caller", "src_id"), ["caller_file", "caller_line"], "left").join(end("callee", "dst_id"), ["callee_file", "callee_line"]).select(
        "test", "seq", "depth", "src_id", "dst_id")
