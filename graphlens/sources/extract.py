"""Facts out of source texts: every file is parsed once, and one table of tagged rows comes out.

Python goes through the standard library's parser, with a line scanner where the text does not parse;
TypeScript, JavaScript and Rust through scanners that blank out strings and comments first and then
match declarations and braces.
"""

from __future__ import annotations

import ast
import bisect
import re
import warnings
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Languages and their extensions.
LANGUAGES = {
    "python": ("py", "pyi"), "rust": ("rs",), "typescript": ("ts", "tsx", "mts", "cts"), "javascript": ("js", "jsx", "mjs", "cjs")}
BY_EXTENSION = {e: k for k, es in LANGUAGES.items() for e in es}
# Decorators that mark entry points.
WEB_DECORATORS = "route get post put delete patch head options websocket".split()
CLI_DECORATORS = "command group callback".split()

# fact: symbol, call, assign, base, param, marker or error; n numbers the facts of a file; columns unused by a fact are null
SCHEMA = (
    "file_id long, n long, fact string, name string, kind string, line long, line_end long, docstring string, import_module string, import_name string, "
    "receiver string, var string, args array<string>")
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_EMPTY = dict.fromkeys(COLUMNS)


def _row(fact: str, **kw) -> dict:
    return {"fact": fact} | kw


# ---- Python

_LINE = re.compile(rb"[^\r\n]*(?:\r\n|\r|\n|\Z)")


def _doc(node: ast.AST, lines: list[bytes]) -> str | None:
    """The text between the quotes of a docstring, as written; lines are those of the source, in UTF-8."""
    body = getattr(node, "body", None)
    if not body or not isinstance(body[0], ast.Expr) or not isinstance(body[0].value, ast.Constant) or not isinstance(body[0].value.value, str):
        return None
    at = body[0].value
    own = lines[at.lineno - 1:at.end_lineno]
    own[-1] = own[-1][:at.end_col_offset]
    text = b"".join(own)[at.col_offset:].decode("utf-8", "replace")
    m = re.fullmatch(r"(?s)[rRuU]{0,2}('''|\"\"\"|'|\")(.*)\1", text)
    return m.group(2) if m and not re.search(r"(?<!\\)" + re.escape(m.group(1)), m.group(2)) else None


def _last(node: ast.AST) -> str | None:
    if isinstance(node, ast.Attribute):
        return node.attr
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Subscript):
        return _last(node.value)
    return None


def _params(a: ast.arguments) -> list[str]:
    return [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *([a.vararg] if a.vararg else []), *([a.kwarg] if a.kwarg else [])]]


def _decorator_name(node: ast.AST) -> str | None:
    return _last(node.func) if isinstance(node, ast.Call) else _last(node) if isinstance(node, (ast.Name, ast.Attribute)) else None


def marker_of(decorator: str | None) -> str | None:
    """Kind of entry point that a decorator makes of a function."""
    return "web_route" if decorator in WEB_DECORATORS else "cli" if decorator in CLI_DECORATORS else None


def python_facts(source: str) -> list[dict]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return _python_lines(source) + [_row("error", line=getattr(e, "lineno", None) or 1, name=type(e).__name__)]
    lines = _LINE.findall(source.encode("utf-8", "surrogatepass"))
    out = []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and node.name == "main" and not node.decorator_list:
            out.append(_row("marker", name="main", kind="main", line=node.lineno))
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            out.append(_row("symbol", name=node.name, kind=kind, line=node.lineno, line_end=node.end_lineno, docstring=_doc(node, lines)))
            if kind == "class":
                out += [_row("base", name=b, line=node.lineno) for b in map(_last, node.bases) if b]
            else:
                out += [_row("param", name=p, line=node.lineno) for p in _params(node.args)]
                for d in node.decorator_list:
                    k = marker_of(_decorator_name(d))
                    if k:
                        out.append(_row("marker", name=node.name, kind=k, line=node.lineno))
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            module = None
            if isinstance(node, ast.ImportFrom):
                module = "." * node.level + (node.module or "")
            for a in node.names:
                out.append(_row("symbol", name=a.asname or a.name, kind="import", line=node.lineno, line_end=node.end_lineno, import_module=module, import_name=a.name))
        elif isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                receiver, var, callee = "bare", None, f.id
            elif isinstance(f, ast.Attribute):
                callee = f.attr
                name = f.value.id if isinstance(f.value, ast.Name) else None
                receiver, var = ("self", None) if name in ("self", "cls") else ("local", name) if name else ("other", None)
            else:
                continue
            args = [x.id for x in [*node.args, *(k.value for k in node.keywords)] if isinstance(x, ast.Name)]
            out.append(_row("call", name=callee, line=node.lineno, receiver=receiver, var=var, args=args))
        elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Name):
            out += [_row("assign", var=t.id, name=node.value.func.id, line=node.lineno) for t in node.targets if isinstance(t, ast.Name)]
        elif isinstance(node, ast.If) and _is_guard(node.test):
            for inner in node.body:
                for c in ast.walk(inner):
                    if isinstance(c, ast.Call) and isinstance(c.func, ast.Name):
                        out.append(_row("marker", name=c.func.id, kind="main_guard", line=c.lineno))
    return out


def _is_guard(test: ast.AST) -> bool:
    if not isinstance(test, ast.Compare) or len(test.comparators) != 1:
        return False
    sides = [test.left, test.comparators[0]]
    return any(isinstance(s, ast.Name) and s.id == "__name__" for s in sides) and any(isinstance(s, ast.Constant) and s.value == "__main__" for s in sides)


_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([^\W\d]\w*)")
_IMPORT = re.compile(r"^[ \t]*(?:from[ \t]+([.\w]+)[ \t]+)?import\b[ \t]*(.*)$")
_IMPORTED = re.compile(r"\s*([\w.]+|\*)(?:\s+as\s+(\w+))?")


def _python_lines(source: str) -> list[dict]:
    """Declarations by line, where the text does not parse; a block ends before the next line that is not deeper."""
    out, open_blocks = [], []  # open blocks: depth and row
    last = 0
    lines = source.splitlines()
    for i, text in enumerate(lines, 1):
        if not text.strip():
            continue
        depth = len(text) - len(text.lstrip())
        while open_blocks and open_blocks[-1][0] >= depth:
            open_blocks.pop()[1]["line_end"] = last
        last = i
        m = _DEF.match(text)
        if m:
            out.append(_row("symbol", name=m.group(3), kind="class" if m.group(2) == "class" else "function", line=i, line_end=i))
            open_blocks.append((depth, out[-1]))
            continue
        m = _IMPORT.match(text)
        if m:
            names, end = m.group(2).split("#")[0], i
            if names.startswith("("):  # up to the closing bracket
                while ")" not in names and end < len(lines):
                    names, end = names + " " + lines[end].split("#")[0], end + 1
                names = names[1:].split(")")[0]
            for item in names.split(","):
                x = _IMPORTED.match(item)
                if x:
                    out.append(_row("symbol", name=x.group(2) or x.group(1), kind="import", line=i, line_end=end, import_module=m.group(1), import_name=x.group(1)))
    for _, row in open_blocks:
        row["line_end"] = last
    return out


# ---- languages with braces

def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m.group())


_TS_QUIET = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_RS_QUIET = re.compile(r"//[^\n]*|/\*.*?\*/|b?r(#*)\".*?\"\1|b?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\[^\n]{1,8}?)'", re.S)


_BODY = re.compile(r"[(){};\[\]]")


class _Braces:
    """A text without strings and comments, its brackets matched."""

    def __init__(self, text: str, quiet: re.Pattern):
        self.text = text
        self.code = quiet.sub(_blank, text)
        self.starts = [0] + [m.end() for m in re.finditer(r"\n", text)]
        self.close: dict[int, int] = {}
        self.at: list[int] = []  # braces in order, and how deep the text is after each
        self.deep: list[int] = []
        self.bad: int | None = None  # the first bracket without a partner
        stack: list[int] = []
        for m in re.finditer(r"[][(){}]", self.code):
            c, i = m.group(), m.start()
            if c in "([{":
                stack.append(i)
            elif stack and self.code[stack[-1]] + c in ("()", "[]", "{}"):
                self.close[stack.pop()] = i
            else:
                if self.bad is None:
                    self.bad = i
                # a closing brace ends what was left open inside its block
                while c == "}" and stack and self.code[stack[-1]] != "{":
                    stack.pop()
                if c == "}" and stack:
                    self.close[stack.pop()] = i
            if c in "{}":
                self.at.append(i)
                self.deep.append((self.deep[-1] if self.deep else 0) + (1 if c == "{" else -1))
        if stack and (self.bad is None or stack[0] < self.bad):
            self.bad = stack[0]

    def depth(self, at: int) -> int:
        """How many braces are open before at."""
        i = bisect.bisect_left(self.at, at)
        return self.deep[i - 1] if i else 0

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def body_end(self, at: int) -> int:
        """Where the declaration at at ends: its closing brace, or the end of its statement."""
        depth = 0
        for m in _BODY.finditer(self.code, at):
            c = m.group()
            if c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif depth == 0 and c == "{":
                return self.close.get(m.start(), len(self.code) - 1)
            elif depth == 0 and c in ";}":
                return m.start()
        return max(len(self.code) - 1, at)


_STEP = re.compile(r"[(){};\[\]\n]")
_BLANKS = re.compile(r"\s*")
_BLOCK = re.compile(r"\s*\{")


def _expression_end(b: _Braces, at: int) -> int:
    """Where the expression at at ends: at a semicolon, a bracket around it, or a line break that the next line does not carry on."""
    code, last = b.code, at
    for m in iter(lambda: _STEP.search(code, last), None):
        c, i = m.group(), m.start()
        if c in "([{":
            last = b.close.get(i, len(code) - 1) + 1
        elif c == "\n":
            back, ahead = i - 1, _BLANKS.match(code, i).end()
            while back >= at and code[back].isspace():
                back -= 1
            if back >= at and code[back] not in "+-*/&|?:=,.>" and code[ahead:ahead + 1] not in (*".?:+-*/%&|^=<>,([`",):
                return i - 1
            last = i + 1
        else:
            return i if c == ";" else i - 1
    return max(len(code) - 1, at)


_TS_DECL = re.compile(
    r"(?:^|(?<=[;{}\s]))(?P<pre>(?:export\s+|default\s+|declare\s+|abstract\s+|async\s+)*)(?:(?P<fn>function)\s*\*?\s*(?P<fname>[\w$]+)\s*[<(]|(?P<cls>class|interface|enum)\s+(?P<cname>[\w$]+)|"
    r"(?:const|let|var)\s+(?P<vname>[\w$]+)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:function\b|(?:<[^>]*>\s*)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^={;]+)?=>|[\w$]+\s*=>))")
_TS_METHOD = re.compile(r"(?m)^[ \t]*(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set)\s+)*\*?\s*(?P<name>#?[\w$]+)\s*(?:<[^>\n]*>)?\([^;{}]*\)\s*(?::[^;{}=]+)?\{")
_NOT_METHODS = frozenset("if for while switch catch function return with constructor else do try new typeof".split()) - {"constructor"}
_TS_CALL = re.compile(r"(?:(?P<recv>[\w$]+|\))\s*\??\.\s*)?(?P<name>[\w$]+)\s*\(")
_TS_WORDS = frozenset("if for while switch catch function return with typeof new await super import constructor async".split())


def _jsdoc(b: _Braces, at: int) -> str | None:
    """First line that says something of the comment just before at."""
    before = b.text[:at].rstrip()
    if not before.endswith("*/"):
        return None
    a = before.rfind("/*")
    if not before.startswith("/**", a):
        return None
    for line in before[a + 3:-2].splitlines():
        t = line.strip().lstrip("*").strip()
        if t:
            return t
    return None


def script_facts(source: str) -> list[dict]:
    b = _Braces(source, _TS_QUIET)
    out, classes = [], []
    for m in _TS_DECL.finditer(b.code):
        at = m.start("pre") if m.group("pre") else m.start()
        name = m.group("fname") or m.group("cname") or m.group("vname")
        kind = m.group("cls") or "function"
        key = m.start("fn") if m.group("fn") else m.start("cls") if m.group("cls") else m.start()
        arrow = m.group("vname") and m.group().endswith("=>") and not _BLOCK.match(b.code, m.end())
        end = _expression_end(b, m.end()) if arrow else b.body_end(m.end() - 1 if m.group("fname") else m.end())
        line = b.line(m.end(1) if m.group("pre") else key if m.group("fn") or m.group("cls") else m.start("vname"))
        out.append(_row("symbol", name=name, kind=kind, line=line, line_end=b.line(end), docstring=_jsdoc(b, at)))
        if kind == "class":
            o = b.code.find("{", m.end())
            if o >= 0:
                classes.append((o, b.close.get(o, len(b.code))))
                base = re.search(r"extends\s+([\w$.]+)", b.code[m.end():o])
                if base:
                    out.append(_row("base", name=base.group(1).split(".")[-1], line=line))
    for a, z in classes:
        for m in _TS_METHOD.finditer(b.code, a + 1, z):
            if m.group("name") in _NOT_METHODS or b.depth(m.start()) - b.depth(a) != 1:
                continue
            start = m.start("name")
            lead = re.compile(r"[ \t]*").match(b.code, m.start()).end()
            out.append(_row("symbol", name=m.group("name"), kind="function", line=b.line(start), line_end=b.line(b.close.get(m.end() - 1, z)), docstring=_jsdoc(b, lead)))
    declared = {(r["line"], r["name"]) for r in out if r["fact"] == "symbol"}
    for m in _TS_CALL.finditer(b.code):
        line = b.line(m.start("name"))
        if m.group("name") in _TS_WORDS or (line, m.group("name")) in declared:
            continue
        r = m.group("recv")
        receiver, var = ("bare", None) if r is None else ("self", None) if r == "this" else ("other", None) if r == ")" else ("local", r)
        out.append(_row("call", name=m.group("name"), line=line, receiver=receiver, var=var, args=[]))
    if b.bad is not None:
        out.append(_row("error", line=b.line(b.bad), name="unmatched bracket"))
    return out


_RS_DECL = re.compile(r"(?m)(?:^|(?<=[{;}]))[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?|default)\s+)*(?P<kw>fn|struct|enum|trait)\s+(?P<name>(?:r#)?\w+)")


def _rust_doc(lines: list[str], line: int) -> str | None:
    got, i = [], line - 2
    while i >= 0:
        t = lines[i].strip()
        if t.startswith("///"):
            got.append(t[3:].strip())
        elif not t.startswith("#["):
            break
        i -= 1
    return "\n".join(reversed(got)) or None


def rust_facts(source: str) -> list[dict]:
    b = _Braces(source, _RS_QUIET)
    lines = source.splitlines()
    out = []
    for m in _RS_DECL.finditer(b.code):
        line = b.line(m.start("kw"))
        out.append(_row("symbol", name=m.group("name"), kind="function" if m.group("kw") == "fn" else m.group("kw"), line=line, line_end=b.line(b.body_end(m.end())), docstring=_rust_doc(lines, line)))
    if b.bad is not None:
        out.append(_row("error", line=b.line(b.bad), name="unmatched bracket"))
    return out


_FOREIGN = re.compile(r"#\[\s*(?:pyo3::)?(pymodule|pyfunction)\b[^\]]*\]((?:\s*#\[[^\]]*\])*)\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe)\s+)*fn\s+(\w+)")


def foreign_facts(source: str) -> list[dict]:
    """Functions a native extension exports, its module (the last one) first."""
    code = re.sub(r"//[^\n]*|/\*.*?\*/", _blank, source, flags=re.S)
    if "pyfunction" not in source and "pymodule" not in source:
        return []
    module, exports = [], []
    for m in _FOREIGN.finditer(code):
        line = code.count("\n", 0, m.start(3)) + 1
        if m.group(1) == "pymodule":
            module = [_row("symbol", name=m.group(3), kind="foreign_module", line=line, line_end=line)]
        else:
            exports.append(_row("symbol", name=m.group(3), kind="foreign_export", line=line, line_end=line))
    return module + exports


#: Extractors by language; a new one is put in under its name.
EXTRACTORS: dict[str, Callable[[str], list[dict]]] = {"python": python_facts, "rust": rust_facts, "typescript": script_facts, "javascript": script_facts}


def facts_of(source: str, ext: str, foreign: bool = False) -> list[dict]:
    """Facts of one text; a failing extractor gives one error row, an unknown extension none. foreign: of Rust, only what it exports."""
    f = foreign_facts if foreign and ext.lower() == "rs" else EXTRACTORS.get(BY_EXTENSION.get(ext.lower(), ""))
    if f is None:
        return []
    try:
        return f(source)
    except Exception as e:  # noqa: BLE001 - one bad file must not end the scan
        return [_row("error", line=1, name=type(e).__name__)]


def _extract(frames: Iterator[pd.DataFrame], foreign: bool = False) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = [_EMPTY | r | {"file_id": i, "n": n} for i, path, text in zip(pdf["file_id"], pdf["path"], pdf["content"]) for n, r in enumerate(facts_of(text, path.rsplit(".", 1)[-1], foreign))]
        out = pd.DataFrame(rows, columns=COLUMNS, dtype=object)
        for c in ("file_id", "n", "line", "line_end"):
            out[c] = out[c].astype("Int64")
        yield out


def extract(texts: DataFrame, foreign: bool = False) -> DataFrame:
    """Facts of (file_id, path, content); null texts and paths give none. foreign: of Rust files only the exported functions."""
    rows = texts.where("content is not null and path is not null").select("file_id", "path", "content")
    return rows.mapInPandas(partial(_extract, foreign=foreign), SCHEMA)


def fact_tables(facts: DataFrame) -> dict[str, DataFrame]:
    """The tagged rows as tables; a call site is known by its file and number."""
    site = F.concat_ws("#", "file_id", "n")
    return {
        "symbols": facts.where("fact = 'symbol'").select("file_id", "name", "kind", F.col("line").alias("line_start"), "line_end", "docstring", "import_module", "import_name"),
        "calls": facts.where("fact = 'call'").select(site.alias("site"), "file_id", "line", F.col("name").alias("callee"), "receiver", "var", "args"),
        "assigns": facts.where("fact = 'assign'").select("file_id", "line", "var", F.col("name").alias("class_name")),
        "bases": facts.where("fact = 'base'").select("file_id", "line", F.col("name").alias("base")),
        "params": facts.where("fact = 'param'").select("file_id", "line", F.col("name").alias("param")),
        "markers": facts.where("fact = 'marker'").select("file_id", "line", "name", F.col("kind").alias("marker")),
        "errors": facts.where("fact = 'error'").select("file_id", "line", "name"),
    }


def extractor_udtf():
    """The extractors as a table function: SELECT * FROM file_text t, LATERAL source_facts(t.content, 'py')."""
    fields = ", ".join(SCHEMA.split(", ")[1:])

    @F.udtf(returnType=fields)
    class SourceFacts:
        def eval(self, content: str, extension: str):
            for n, r in enumerate(facts_of(content or "", extension or "")):
                row = _EMPTY | r | {"n": n}
                yield tuple(row[c] for c in COLUMNS[1:])

    return SourceFacts
