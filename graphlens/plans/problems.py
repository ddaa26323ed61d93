"""Queries over the code-graph tables for general data problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.operators.heavy_keys import balanced_row_number, heavy_keys
from graphlens.operators.references import code_graph_keys, orphan_counts, orphan_references, parent_lifetimes
from graphlens.session import table


def _keys_and_lives(spark: SparkSession, d: str):
    lives = parent_lifetimes(table(spark, d, "symbols"), table(spark, d, "tombstones"))
    return code_graph_keys(table(spark, d, "edges"), table(spark, d, "call_trace")), lives


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    keys, lives = _keys_and_lives(spark, d)
    return orphan_references(keys, lives).select("table_name", "field", "row_key").distinct()


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    keys, lives = _keys_and_lives(spark, d)
    return orphan_counts(keys, lives)


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").select("id", "dst_id", F.lower(F.trim("kind")).alias("kind"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(_kinds(spark, d), ["dst_id", "kind"], "id").select("dst_id", "kind", "n", "heavy")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(_kinds(spark, d), ["dst_id", "kind"], "id").where("heavy").select("dst_id", "kind")


def p6_positions(spark: SparkSession, d: str) -> DataFrame:
    edges = _kinds(spark, d).where("id is not null").distinct()
    return balanced_row_number(edges, ["dst_id", "kind"], ["id"])


_REFS = """
WITH life AS (
  SELECT id, min(written_at) AS valid_from, max(written_at) AS last_written FROM symbols
  WHERE id IS NOT NULL AND written_at IS NOT NULL GROUP BY id),
gone AS (SELECT symbol_id, max(removed_at) AS last_removed FROM tombstones GROUP BY symbol_id),
live AS (SELECT id, valid_from FROM life LEFT JOIN gone ON id = symbol_id
         WHERE last_removed IS NULL OR last_removed <= last_written),
refs AS (
  SELECT 'edges' AS table_name, 'src_id' AS field, CAST(id AS VARCHAR) AS row_key, src_id AS k, built_at AS t FROM edges
  UNION ALL SELECT 'edges', 'dst_id', CAST(id AS VARCHAR), dst_id, built_at FROM edges
  UNION ALL SELECT 'call_trace', 'dst_id', test || '#' || CAST(seq AS VARCHAR), dst_id, called_at FROM call_trace),
judged AS (
  SELECT refs.*, live.id IS NULL OR t IS NULL OR t < valid_from AS orphan
  FROM refs LEFT JOIN live ON k = live.id WHERE k IS NOT NULL)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p6_found": p6_found,
    "p6_counts": p6_counts,
    "p6_positions": p6_positions,
}

SQL = {
    "p1_found": _REFS + "SELECT DISTINCT table_name, field, row_key FROM judged WHERE orphan",
    "p1_counts": _REFS + """
SELECT table_name, field, strftime(t, '%Y-%m') AS month, count(DISTINCT row_key) AS n_references,
       count(DISTINCT row_key) FILTER (WHERE orphan) AS n_orphans
FROM judged GROUP BY 1, 2, 3""",
    "p6_found": """
SELECT dst_id, lower(trim(kind)) AS kind FROM edges GROUP BY 1, 2
HAVING count(DISTINCT id) >= 0.01 * (SELECT count(DISTINCT id) FROM edges)""",
    "p6_counts": """
SELECT dst_id, lower(trim(kind)) AS kind, count(DISTINCT id) AS n,
       count(DISTINCT id) >= 0.01 * (SELECT count(DISTINCT id) FROM edges) AS heavy
FROM edges WHERE id IS NOT NULL GROUP BY 1, 2""",
    "p6_positions": """
SELECT id, dst_id, kind, row_number() OVER (PARTITION BY dst_id, kind ORDER BY id) AS position
FROM (SELECT DISTINCT id, dst_id, lower(trim(kind)) AS kind FROM edges WHERE id IS NOT NULL)""",
}
