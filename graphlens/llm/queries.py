"""Queries of the subpackage, with SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphlens.llm.docpairs import documented_functions
from graphlens.llm.leaks import leaked_items, remove_leaks
from graphlens.llm.personal import find_personal, replace_personal
from graphlens.llm.provenance import file_provenance
from graphlens.llm.runs import collapse_runs
from graphlens.llm.syntax import acceptance, check_syntax
from graphlens.llm.tokens import encode_corpus
from graphlens.session import table


def _runs(spark: SparkSession, d: str, **kw) -> DataFrame:
    return collapse_runs(table(spark, d, "call_trace"), "test", "seq", "dst_id", "depth", "called_at", **kw)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, min_length=2).selectExpr("entity AS test", "first_pos AS first_seq", "last_pos AS last_seq")


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).selectExpr(
        "entity AS test", "value AS dst_id", "first_pos AS first_seq", "last_pos AS last_seq", "n_events AS n_calls", "duration_us")


def p3_pairs(spark: SparkSession, d: str, with_text: bool = True) -> DataFrame:
    above = table(spark, d, "edges").where("lower(trim(kind)) = 'inherits'").select("src_id", "dst_id") if with_text else None
    return documented_functions(table(spark, d, "symbols"), table(spark, d, "file_text"), table(spark, d, "files"), with_text, above)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pairs(spark, d, with_text=False).where("described_by = symbol_id").select("symbol_id").distinct()


def p4_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return check_syntax(table(spark, d, "files"), table(spark, d, "file_text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_verdicts(spark, d).where("not valid").select("file_id").distinct()


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return acceptance(p4_verdicts(spark, d))


def p5_provenance(spark: SparkSession, d: str) -> DataFrame:
    return file_provenance(table(spark, d, "files"), table(spark, d, "file_text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_provenance(spark, d).where("not hand_written").select("file_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return remove_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = find_personal(table(spark, d, "documents"), table(spark, d, "name_list"))
    return found.select("doc_id", "pii_type", "pii_value").distinct()


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    return replace_personal(table(spark, d, "documents"), table(spark, d, "name_list"))


_RUNS = """
WITH ev AS (SELECT DISTINCT test, seq, depth, dst_id, called_at FROM call_trace WHERE test IS NOT NULL AND seq IS NOT NULL),
marked AS (
  SELECT *, CASE WHEN dst_id = lag(dst_id) OVER w AND abs(depth - lag(depth) OVER w) <= 1 THEN 0 ELSE 1 END AS starts
  FROM ev WINDOW w AS (PARTITION BY test ORDER BY seq)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY test ORDER BY seq) AS run FROM marked)
"""

QUERIES = {
    "p2_found": p2_found,
    "p2_collapsed": p2_collapsed,
    "p3_found": p3_found,
    "p3_pairs": p3_pairs,
    "p4_found": p4_found,
    "p4_verdicts": p4_verdicts,
    "p4_rates": p4_rates,
    "p5_found": p5_found,
    "p5_provenance": p5_provenance,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_clean": p8_clean,
    "p9_found": p9_found,
    "p9_clean": p9_clean,
}

SQL = {
    "p2_found": _RUNS + """
SELECT test, min(seq) AS first_seq, max(seq) AS last_seq FROM numbered GROUP BY test, run HAVING count(*) >= 2""",
    "p2_collapsed": _RUNS + """
SELECT test, min(dst_id) AS dst_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_calls,
       CAST(epoch_us(arg_max(called_at, seq)) - epoch_us(arg_min(called_at, seq)) AS BIGINT) AS duration_us
FROM numbered GROUP BY test, run""",
}
