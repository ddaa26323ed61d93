"""Documentation: what says nothing, and pairs over files."""

import pytest

from graphlens.llm.docpairs import documented_functions, says_nothing, signature

TRIVIAL = [
    None, "", "  \n", "-----", "...", "?", "TODO", "todo todo todo", "TBD.", "FIXME: docs", "TODO(later): write proper documentation for this function", "FIXME - someone should describe this",
    "No description provided.", "Write me!", "<description>", "_summary_", "n/a", "Docstring goes here.", "load index", "Load the index.", "`load_index`", "loadIndex()", "A function to load index.",
    "This method is for load index", "Function load_index", "noqa: D103", "type: ignore", "pragma: no cover", "pylint: disable=missing-docstring", "eslint-disable-next-line", "@ts-ignore", "fmt: off",
    "istanbul ignore next", "@param x\n@return", "@param {any} row", "@returns {void}", ":param x:\n:return:", "Args:\n    x:\n\nReturns:\n", "\nParameters\n----------\nx\n", "# Errors\n\n# Panics", "* `x`",
    "_summary_\n\nArgs:\n    x (_type_): _description_\n", "@internal", "LOAD INDEX"]
TELLING = [
    "Idempotent.", "O(n log n).", "解析边并返回写入的行数。", "Gibt alle offenen Knoten zurück.", "TODO: breaks when the row is empty, because it is then never set", "@param row hop cap, zero means all",
    ":param row: hop cap", "Args:\n    x: the hop cap\n", "Loads the index from disk.", "Never raises.", "Parameters\n----------\nx : int\n    the hop cap\n", "noqa: D103 Reads from disk."]


@pytest.mark.parametrize("doc", TRIVIAL)
def test_trivial(doc):
    assert says_nothing(doc, "load_index") and says_nothing(doc, "loadIndex")


@pytest.mark.parametrize("doc", TELLING)
def test_telling(doc):
    assert not says_nothing(doc, "load_index")


def test_signature():
    assert signature("def f(self, a: int = 3, *, b: dict[str, int] = {}, **kw) -> int:", "f") == "a,b,**kw" or signature("def f(self, a: int = 3, *, b=1):", "f") == "a,b"
    assert signature("fn f(&self, a: &str, b: Vec<(u8, u8)>) -> u8 {", "f") == "a,b"
    assert signature(None, "f") == signature("x = 1", "f") == ""


SYM = "id long, file_id long, name string, kind string, line_start long, line_end long, docstring string, coverage_pct double, import_module string, import_name string, path string, code string"


def sym(i, f, name, a, b, doc, kind="function"):
    return (i, f, name, kind, a, b, doc, None, None, None, "clash", "clash")


def test_pairs(spark):
    files = spark.createDataFrame([(1, "r/a.pyi"), (2, "r/a.py"), (2, "r/a.py"), (3, "r/b.py"), (4, "r/c.py")], "id long, path string")
    texts = spark.createDataFrame([(1, "def f(x): ...\r\n"), (2, "class A:\n    pass\ndef f(x):\n    return 1"), (3, None), (4, ""), (9, "def g():\n  pass\n")], "file_id long, content string")
    rows = [sym(1, 1, "f", 1, 1, "Says more than its name."), sym(2, 2, "f", 3, 4, "TODO"), sym(2, 2, "f", 3, 4, "TODO"), sym(3, 3, "g", 1, 1, "Says a lot."), sym(4, 4, "g", 1, 1, "Says a lot."),
            sym(5, 2, "h", None, None, "Says a lot."), sym(6, 2, "h", 5, 5, "Says a lot."), sym(7, 2, "h", 4, 9, "Says a lot."), sym(8, 9, "g", 1, 2, "Says a lot."), sym(9, 2, "A", 1, 2, "Says a lot.", "class"),
            sym(10, 2, None, 1, None, "Says a lot.")]
    out = {r.symbol_id: r for r in documented_functions(spark.createDataFrame(rows, SYM), texts, files).collect()}
    assert {i for i, r in out.items() if r.described_by == i} == {1, 7, 8, 10}
    assert out[2].described_by == 1 and out[2].description == "Says more than its name." and out[2].code == "def f(x):\n    return 1"
    assert out[8].code == "def g():\n  pass" and out[7].code == "    return 1"
    lean = documented_functions(spark.createDataFrame(rows, SYM), texts, files, with_text=False)
    assert {(r.symbol_id, r.described_by) for r in lean.collect()} == {(i, r.described_by) for i, r in out.items()}
    assert documented_functions(spark.createDataFrame([], SYM), texts, files).collect() == []


@pytest.mark.parametrize("ends", [True, False])
def test_long_declarations(spark, ends):
    """Overloads that differ after many lines of parameters are two."""
    def text(tail):
        return "def f(\n" + "".join(f"    a{k},\n" for k in range(12)) + f"    {tail},\n):\n    return 1\n"

    files = spark.createDataFrame([(1, "r/a.pyi"), (2, "r/a.py")], "id long, path string")
    texts = spark.createDataFrame([(1, text("first")), (2, text("second"))], "file_id long, content string")
    rows = [sym(1, 1, "f", 1, 16 if ends else None, "Says more than its name."), sym(2, 2, "f", 1, 16 if ends else None, "TODO")]
    out = documented_functions(spark.createDataFrame(rows, SYM), texts, files).collect()
    assert {(r.symbol_id, r.signature.split(",")[-1]) for r in out} == {(1, "first")}


def test_types_above_lend(spark):
    files = spark.createDataFrame([(1, "r/base.py"), (2, "r/impl.py")], "id long, path string")
    body = "class {}:\n    def run(self, x):\n        return x\n    def halt(self):\n        pass\n"
    texts = spark.createDataFrame([(1, body.format("Base")), (2, body.format("Impl"))], "file_id long, content string")
    rows = [sym(1, 1, "Base", 1, 5, None, "trait"), sym(2, 2, "Impl", 1, 5, None, "class"), sym(11, 1, "run", 2, 3, "Says how it runs."), sym(12, 1, "halt", 4, 5, "TODO"), sym(21, 2, "run", 2, 3, "TODO"), sym(22, 2, "halt", 4, 5, None)]
    edges = spark.createDataFrame([(2, 1), (2, 1), (2, 2), (None, 1)], "src_id long, dst_id long")
    out = {r.symbol_id: r for r in documented_functions(spark.createDataFrame(rows, SYM), texts, files, inherits=edges).collect()}
    assert {i: r.described_by for i, r in out.items()} == {11: 11, 21: 11} and out[21].description == "Says how it runs." and out[21].code.startswith("    def run")
    assert documented_functions(spark.createDataFrame([], SYM), texts, files, inherits=edges.limit(0)).collect() == []
