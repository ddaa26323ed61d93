"""Points in spans without comparing every point with every span of its group.

Spans are cut at bins of a fixed number of lines, so a point meets only the spans that touch its bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN = 256


def spans_at(points: DataFrame, spans: DataFrame, group: str, line: str, start: str = "start", end: str = "end") -> DataFrame:
    """Every (point, span) of a group with start <= line <= end; columns of both, the span's group dropped.

    Null lines, starts or groups match nothing; a null end is the start. A column of spans that points
    has too is taken from points.
    """
    s = spans.where(F.col(start).isNotNull() & F.col(group).isNotNull()).withColumn(end, F.coalesce(end, start)).where(F.col(end) >= F.col(start))
    s = s.withColumnRenamed(group, "_g").withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor(F.col(end) / BIN))))
    s = s.drop(*[c for c in points.columns if c in s.columns])
    p = points.withColumn("_pbin", F.floor(F.col(line) / BIN))
    on = (F.col(group) == F.col("_g")) & (F.col("_pbin") == F.col("_bin")) & F.col(line).between(F.col(start), F.col(end))
    return p.join(s, on).drop("_g", "_bin", "_pbin")


def innermost(points: DataFrame, spans: DataFrame, group: str, line: str, point_id: str | list[str], span_id: str,
              start: str = "start", end: str = "end") -> DataFrame:
    """(point_id, span_id): the narrowest span around each point; ties go to the smaller span_id.

    A point is known by one column or several, which may include group and line. Points without a span
    are absent. The spans of a point are reduced before any shuffle of pairs.
    """
    ids = [point_id] if isinstance(point_id, str) else point_id
    wanted = [*ids, *[c for c in (group, line) if c not in ids]]
    hits = spans_at(points.select(*wanted), spans.select(span_id, group, start, end), group, line, start, end)
    best = F.min(F.struct((F.col(end) - F.col(start)).alias("width"), F.col(span_id).alias("sid")))
    return hits.groupBy(*ids).agg(best.alias("b")).select(*ids, F.col("b.sid").alias(span_id))
