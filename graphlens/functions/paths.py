"""Column expressions over paths, names, coverage and text lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def basename(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def dirname(path) -> Column:
    """Directory of a path; '.' at the root."""
    d = F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)
    return F.when(d == "", F.lit(".")).otherwise(d)


def is_test_path(path) -> Column:
    """The file's base starts with test_ or ends in _test.py, or a directory is called test or tests."""
    p = _c(path)
    base = basename(p)
    dirs = F.split(dirname(p), "/")
    return F.coalesce(base.startswith("test_") | base.endswith("_test.py") | F.arrays_overlap(dirs, F.array(F.lit("tests"), F.lit("test"))), F.lit(False))


def is_test_code(name, path) -> Column:
    n = _c(name)
    return is_test_path(path) | F.coalesce(n.startswith("test_") | (n == "test"), F.lit(False))


def coverage_band(pct) -> Column:
    p = _c(pct)
    return (F.when(p.isNull(), "none").when(p <= 0, "uncovered").when(p < 50, "low").when(p < 80, "partial").when(p < 100, "high").otherwise("covered"))


def is_foreign(kind) -> Column:
    return _c(kind).isin("foreign_module", "foreign_export")


def span_weight(start, end) -> Column:
    s, e = _c(start), _c(end)
    return F.when(s.isNull(), F.lit(1)).otherwise(F.greatest(F.coalesce(e, s) - s + 1, F.lit(1))).cast("long")


def lines(text) -> Column:
    """Lines of a text with any line ends; nothing after a final line break."""
    parts = F.split(_c(text), "\r\n|\r|\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def source_span(line_array, start, end) -> Column:
    """Lines start..end (1-based, inclusive) in one text; the end is clamped, a start past the end gives ''."""
    s = _c(start).cast("int")
    return F.when(s >= 1, F.array_join(F.slice(_c(line_array), s, F.greatest(F.coalesce(_c(end), _c(start)).cast("int") - s + 1, F.lit(0))), "\n"))


def module_parts(path) -> Column:
    """Components of a Python module path: extension and a trailing __init__ dropped."""
    return F.filter(F.split(F.regexp_replace(F.regexp_replace(_c(path), r"\.pyi?$", ""), r"/__init__$", ""), "/"), lambda x: x != "")


def suffixes(parts) -> Column:
    """All suffixes of an array of components, joined with '/'."""
    p = _c(parts)
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), "/"))


def sha256_hex(text) -> Column:
    return F.sha2(_c(text).cast("binary"), 256)


def file_matches(path, fragment: str) -> Column:
    """Equality, or a case-insensitive suffix in which % and _ are wildcards."""
    return (_c(path) == fragment) | _c(path).ilike("%" + fragment)
