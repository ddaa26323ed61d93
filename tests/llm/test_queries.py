"""The queries over a small data directory: columns, empty tables, stability of a second run."""

import datetime as dt

import pytest

from graphlens.llm.queries import QUERIES, SQL

T = dt.datetime(2025, 1, 1)
COLUMNS = {
    "p2_found": ["test", "first_seq", "last_seq"], "p3_found": ["symbol_id"], "p4_found": ["file_id"], "p5_found": ["file_id"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"],
    "p9_found": ["doc_id", "pii_type", "pii_value"]}
SCHEMAS = {
    "files": "id long, path string, hash string, indexed_at timestamp", "file_text": "file_id long, content string",
    "symbols": "id long, file_id long, name string, kind string, line_start long, line_end long, docstring string, coverage_pct double, import_module string, import_name string, written_at timestamp",
    "edges": "id long, src_id long, dst_id long, kind string, built_at timestamp",
    "call_trace": "test string, seq long, depth long, src_id long, dst_id long, called_at timestamp", "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "benchmark": "item_id long, text string, suite string", "name_list": "name string, name_kind string"}
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen"
ROWS = {
    "files": [(1, "r/a.py", "h", T), (1, "r/a.py", "h", None), (2, "r/x_pb2.py", None, T)], "file_text": [(1, "def f():\n    return (\n"), (2, "x = 1\n"), (3, None)],
    "symbols": [(5, 1, "f", "function", 1, 2, "Says more.", None, None, None, T)] * 2 + [(6, 1, "f", "function", 9, 9, "Says more.", None, None, None, T)],
    "edges": [(1, 5, 6, " Inherits", T), (1, 5, 6, " Inherits", T), (2, None, 6, None, T)],
    "call_trace": [("t", 0, 0, None, 9, T), ("t", 4, 1, None, 9, T), ("t", 4, 1, None, 9, T), ("t", 5, 1, None, 8, T)],
    "documents": [(1, "a b", "en", "s", 3), (2, None, None, None, None), (3, f"> {LONG} a@b.example", "en", "s", 3)], "benchmark": [(7, LONG, "s"), (8, None, "s")], "name_list": [("Ulwen", "given")]}


@pytest.fixture(scope="module", params=["filled", "empty"])
def data(request, spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp(request.param))
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(ROWS[name] if request.param == "filled" else [], schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return request.param, d


def test_found(spark, data):
    kind, d = data
    got = {}
    for name, columns in COLUMNS.items():
        df = QUERIES[name](spark, d)
        assert df.columns == columns
        got[name] = sorted(tuple(list(v) if isinstance(v, list) else v for v in r) for r in df.collect())
    if kind == "empty":
        assert not any(got.values())
        return
    assert got["p2_found"] == [("t", 0, 4)] and got["p3_found"] == [(5,)] and got["p4_found"] == [(1,)] and got["p5_found"] == [(2,)]
    assert got["p8_found"] == [(3, 7)] and got["p9_found"] == [(3, "email", "a@b.example")] and [x for x, _ in got["p7_ids"]] == [1, 2, 3] and got["p7_ids"][1][1] == []


def test_others_run(spark, data):
    _, d = data
    for name in set(QUERIES) - set(COLUMNS):
        QUERIES[name](spark, d).collect()
    assert set(SQL) <= set(QUERIES)
