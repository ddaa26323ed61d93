"""Functions paired with their documentation.

All function symbols are placed in one table under a qualified name: repository, module (the path
without its extension, so a stub and its source are one module), enclosing type, name and a normalised
signature that tells overloads apart. A function whose own documentation is empty-handed takes that of
a separate declaration under the same qualified name; then pairs without documentation are dropped.

Source lines are cut out inside the JVM from the lines of each file; only declarations and docstrings
go through Arrow. Defined cases: functions without a line, without a file text, or with a line beyond
the last one give no pair; a last line without a line break counts, an empty text has no lines;
repeated symbol rows count once; a null name is an empty name; files without a path are modules of
their own. Texts may have any line ends.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.operators.heavy_keys import skew_join
from graphlens.operators.spans import innermost
from graphlens.session import cut

# Words that carry nothing beside a function's own name.
_NOTHING = set("the a an to function method this is for".split())
# Words of stock phrases that stand in for documentation or ask for it.
_STOCK = set(
    "todo fixme xxx tbd tba wip hack na none null nil placeholder placeholders undocumented documented documentation document docs doc docstring "
    "docstrings description describe described descriptions summary comment comments write written writing add added missing no not yet provided available "
    "pending goes go here to be me someone somebody should must needs need please proper properly later soon fill filled in this that function method "
    "the a an for of it is and with some text your type determined done given empty blank lorem ipsum stub auto generated autogenerated coming "
    "short long brief one line module class".split())
_STOCK_CORE = set(
    "todo fixme xxx tbd tba wip na none null nil placeholder placeholders undocumented documented documentation document docs doc docstring docstrings "
    "description describe described descriptions summary comment lorem autogenerated stub write".split())
# Headings of documentation sections.
_HEADINGS = (
    r"args|arguments|params|parameters?|other parameters|keyword arguments|keyword args|returns?|yields?|receives|raises|throws|exceptions?|errors|panics|"
    r"safety|examples?|notes?|warnings?|warns|see also|references|attributes|todo|usage|description|summary|remarks|output|inputs?|type parameters")
_PARAM_HEADINGS = re.compile(r"(args|arguments|params|parameters?|other parameters|keyword ar\w+|attributes|returns?|yields?|raises|throws|receives|inputs?|output)$", re.I)
_HEADING = re.compile(rf"^(?:#+\s*)?(?:{_HEADINGS})\s*:?\s*$", re.I)
_INLINE_HEADINGS = re.compile(rf"(?:^|(?<=\s))#+\s*(?:{_HEADINGS})(?=\s|$)\s*:?", re.I)
# Directives to tools.
_DIRECTIVE = re.compile(
    r"(?:#\s*|//\s*|/\*\s*|@)?(?:noqa\b(?:\s*:\s*[A-Z]+\d*(?:\s*,\s*[A-Z]+\d*)*)?|type:\s*ignore(?:\[[^\]]*\])?|pragma:?\s*no\s*(?:cover|branch)\w*|"
    r"pylint:\s*[\w-]+(?:\s*=\s*[\w,\s-]+?)?(?=$|\n|[.;])|fmt:\s*(?:on|off|skip)|yapf:\s*(?:disable|enable)|isort:\s*\w+|mypy:\s*[\w-]+(?:=\S+)?|flake8:\s*\w+(?:[:=]\s*\S+)?|"
    r"ruff:\s*\w+(?:[:=]\s*\S+)?|pyright:\s*\w+(?:\[[^\]]*\])?|nosec(?:\s+B\d+)?|eslint-(?:disable|enable)(?:-next-line|-line)?(?:\s+[@\w/,-]+(?:\s*,\s*[@\w/-]+)*)?|eslint-env\s+\w+|"
    r"ts-(?:ignore|nocheck|expect-error|check)|tslint:\s*[\w:-]+|jshint\s+\S+|jscs:\s*\w+|prettier-ignore(?:-start|-end)?|"
    r"(?:istanbul|c8|v8)\s+ignore\s+(?:next|file|if|else|start|stop)(?:\s+\d+)?|"
    r"rustfmt::?\s*skip\w*|clippy::?\s*\w+|codecov\s*ignore|coverage:\s*\w+|webpack\w+:\s*\S+|noinspection\s+\w+|NOLINT\w*(?:\([^)]*\))?|@formatter:(?:on|off)|sonar\s*ignore)", re.I)
_PHRASE_TAG = re.compile(r"<\s*(?:description|summary|doc|docs|docstring|todo|placeholder|name|text)\s*/?\s*>|\b_(?:summary|description|type)_\b|\[(?:description|summary|todo)\]", re.I)
_TYPE = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
_PARAM_TAG = re.compile(
    rf"[@\\](?:param|arg|argument|prop|property|typeparam|template|throws|exception|raises)\b[ \t]*(?:{_TYPE})?[ \t]*(?:\[[^\]]*\]|[\w.$*]+)?[ \t]*[-:–—]?|"
    rf"[@\\](?:returns?|yields?|type|typedef)\b[ \t]*(?:{_TYPE})?[ \t]*[-:–—]?|"
    r"[@\\][A-Za-z][\w-]*|"
    r":(?:param|parameter|arg|argument|key|keyword|raises?|except|exception|var|ivar|cvar|type)\b[^:\n]*:|:(?:returns?|rtype|yields?)\s*[^:\n]{0,30}:")
_RTYPE = re.compile(r":(?:rtype|type)\b[^:\n]*:[^\n]*")
_UNDERLINE = re.compile(r"^\s*[-=~^*#_.+`'\"]{3,}\s*$")
_ITEM = re.compile(r"^\s*(?:[-*+]\s+)?[`*]{0,2}\*{0,2}([A-Za-z_$][\w$.]*)[`*]{0,2}\s*(?:\([^()]*(?:\([^()]*\))?[^()]*\)|\[[^\]]*\])?\s*(?:[:–—-]+|$)\s*")
_NUMPY_ITEM = re.compile(r"^\s*\*{0,2}[A-Za-z_$][\w$]*(?:\s*,\s*\*{0,2}\w+)*\s*:\s*(.*)$")
_TYPES = re.compile(
    r"^(?:optional|default(?:s to)?|any|int|integer|float|double|number|str|string|bool|boolean|bytes|list|dict|tuple|set|object|array|none|null|void|undefined|self|"
    r"usize|u\d+|i\d+|f\d+|option|result|vec|promise|map|record|iterable|iterator|callable|function|unknown|never|type|of|or|[\[\]{}(),|<>&:?*`'\".=\s-])+$", re.I)
_LETTER = re.compile(r"[^\W_]")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")


def name_parts(name: str) -> list[str]:
    return [p.lower() for p in _PART.findall(name)]


def spoken_words(docstring: str) -> list[str]:
    """What is left of a docstring without tags, headings, types, parameter names and directives."""
    text = _DIRECTIVE.sub(" ", docstring)
    text = _PHRASE_TAG.sub(" ", text)
    text = _INLINE_HEADINGS.sub("\n", text)
    text = _RTYPE.sub(" ", text)
    lines = re.split(r"\r\n|\r|\n", text)
    kept: list[str] = []
    section = numpy = False
    for i, line in enumerate(lines):
        bare = line.strip()
        under = i + 1 < len(lines) and bool(_UNDERLINE.match(lines[i + 1]))
        if not bare or _UNDERLINE.match(line):
            continue
        head = re.sub(r"^#+\s*|[:*\s]+$|^\*+", "", bare)
        if _HEADING.match(bare) or under:
            section, numpy = bool(_PARAM_HEADINGS.match(head)), under
            continue
        one = re.match(rf"^((?:{_HEADINGS})\s*:)\s*(.+)$", bare, re.I)
        if one and _PARAM_HEADINGS.match(one.group(1).rstrip(": ")):
            bare, section, numpy = one.group(2), True, False
        if section and numpy:
            m = _NUMPY_ITEM.match(bare)
            if m and (_TYPES.match(m.group(1) or "-") or re.match(r"[\w\[\], |.]+$", m.group(1))) or re.fullmatch(r"\*{0,2}[\w.$]+(?:\s*,\s*\w+)*", bare) or _TYPES.match(bare):
                continue
        elif section:
            m = _ITEM.match(bare)
            if m:
                bare = bare[m.end():]
            if _TYPES.match(bare or "-"):
                continue
        else:
            m = re.match(r"^[-*+]\s+`([^`]+)`\s*(?:\([^()]*\))?\s*[:–—-]*\s*", bare)
            if m:
                bare = bare[m.end():]
        bare = _PARAM_TAG.sub(" ", bare)
        bare = re.sub(_TYPE, " ", bare) if "{" in bare and "@" in line else bare
        kept.append(bare)
    return [w for w in re.findall(r"[^\W_]+(?:_[^\W_]+)*", " ".join(kept))]


def says_nothing(docstring: str | None, name: str | None) -> bool:
    """Is the documentation of a function trivial?"""
    if docstring is None or not _LETTER.search(docstring):
        return True
    ws = spoken_words(docstring)
    parts = [p for w in ws for p in name_parts(w)]
    if not parts:
        return True
    own = set(name_parts(name or ""))
    if all(p in own or p in _NOTHING for p in parts):
        return True
    flat = [w.lower() for w in re.findall(r"[^\W_]+", re.sub(r"\bn/a\b", "na", " ".join(ws + [docstring]) if not ws else " ".join(ws), flags=re.I))]
    if re.fullmatch(r"\W*n\s*/\s*a\W*", docstring, re.I):
        return True
    return bool(flat) and all(w in _STOCK for w in flat) and any(w in _STOCK_CORE for w in flat)


def signature(declaration: str | None, name: str | None) -> str:
    """Parameter names and count, without types, defaults, receivers and blanks."""
    if not declaration:
        return ""
    at = declaration.find(name) if name else 0
    a = declaration.find("(", max(at, 0))
    if a < 0:
        return ""
    depth, part, parts = 0, "", []
    for ch in declaration[a:]:
        if ch in "([{<":
            depth += 1
            if depth == 1:
                continue
        elif ch in ")]}>":
            depth -= 1
            if depth <= 0:
                break
        elif ch == "," and depth == 1:
            parts.append(part)
            part = ""
            continue
        part += ch
    parts.append(part)
    names = [re.split(r"[:=?]", p.strip())[0].strip().lstrip("&").replace("mut ", "").strip() for p in parts]
    return ",".join(n for n in names if n and n not in ("self", "cls", "this", "/", "*"))


@F.pandas_udf(T.BooleanType())
def _trivial(doc: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([says_nothing(d, n) for d, n in zip(doc, name)], dtype=bool)


@F.pandas_udf(T.StringType())
def _signature(decl: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([signature(d, n) for d, n in zip(decl, name)], dtype=object)


def file_lines(file_text: DataFrame) -> DataFrame:
    """(file_id, lines): lines of each text; what follows the last line break counts only if not empty."""
    lines = F.split("content", "\r\n|\r|\n", -1)
    whole = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return file_text.where("content is not null").select("file_id", whole.alias("lines"))


def function_table(symbols: DataFrame, file_text: DataFrame, files: DataFrame, with_text: bool = True, declaration_lines: int = 8) -> DataFrame:
    """All functions with source: symbol_id, path, module, owner, name, signature, trivial[, docstring, code].

    What is needed of a text is taken out of it where symbols and texts meet; only that goes further.
    """
    is_function = "kind = 'function' and line_start is not null"
    name = F.coalesce("name", F.lit(""))
    text = [F.col("docstring")] if with_text else []
    funcs = symbols.where(is_function).select(
        F.col("id").alias("symbol_id"), "file_id", name.alias("name"), "line_start", "line_end", _trivial("docstring", name).alias("trivial"), *text)
    paths = files.where("path is not null").groupBy(F.col("id").alias("file_id")).agg(F.min("path").alias("path"))
    # paths go to the functions, so that the texts are shuffled once
    placed = skew_join(funcs.join(paths, "file_id", "left"), file_lines(file_text), "file_id", ["symbol_id", "line_start"]).where(F.col("line_start") <= F.size("lines"))
    start = F.greatest(F.col("line_start"), F.lit(1)).cast("int")
    last = F.greatest(start, F.coalesce(F.col("line_end"), F.col("line_start")).cast("int"))
    # to the end of the symbol, or of the file where that is not known: the parameters may take any number of lines
    span = F.when(F.col("line_end").isNull(), F.size("lines")).otherwise(F.greatest(last - start + 1, F.lit(declaration_lines)))
    declaration = F.array_join(F.slice("lines", start, span), "\n")
    path = F.coalesce("path", F.concat(F.lit("?"), F.col("file_id").cast("string")))
    code = [F.col("docstring"), F.array_join(F.slice("lines", start, last - start + 1), "\n").alias("code")] if with_text else []
    taken = placed.select("symbol_id", path.alias("path"), "name", _signature(declaration, "name").alias("signature"), "trivial", *code)
    taken = taken.withColumn("module", F.regexp_replace("path", r"(\.d)?\.[^./]*$", ""))
    owners = symbols.where("kind in ('class', 'struct', 'enum', 'trait', 'interface')").select(
        F.col("id").alias("owner_id"), "file_id", F.col("name").alias("owner"), F.col("line_start").alias("start"), F.col("line_end").alias("end"))
    # an owner starts before the function's line
    inner = innermost(symbols.where(is_function).select(F.col("id").alias("symbol_id"), "file_id", F.col("line_start").alias("at")),
                      owners.withColumn("start", F.col("start") + 1), "file_id", "at", "symbol_id", "owner_id")
    owner_names = owners.groupBy("owner_id").agg(F.min("owner").alias("owner"))
    owned = inner.join(owner_names, "owner_id").groupBy("symbol_id").agg(F.min(F.struct("owner", "owner_id")).alias("o")).select("symbol_id", "o.owner", "o.owner_id")
    # read several times below, so it is written once
    return cut(taken.join(owned, "symbol_id", "left").withColumn("owner", F.coalesce("owner", F.lit(""))).distinct())


def documented_functions(symbols: DataFrame, file_text: DataFrame, files: DataFrame, with_text: bool = True, inherits: DataFrame | None = None) -> DataFrame:
    """(symbol_id, path, qualified_name, signature, described_by[, description, code]).

    described_by is the symbol whose documentation it is: the function itself, or the declaration with
    the smallest id under the same qualified name and signature. With inherits (src_id, dst_id: a type
    and what it derives from or implements) a method that neither describes takes the text of the method
    of that name and signature with the smallest id in a type right above its own. with_text=False leaves
    the texts and the types above out.
    """
    table = function_table(symbols, file_text, files, with_text)
    key = ["module", "owner", "name", "signature"]
    qualified = F.concat_ws("::", "module", F.when(F.col("owner") != "", F.col("owner")), "name").alias("qualified_name")
    out = ["symbol_id", "path", qualified, "signature", "described_by"]
    if not with_text:
        # every definition meets the documented declarations of its name, its own among them; what none describes is dropped then
        declared = table.where(~F.col("trivial")).groupBy(*key).agg(F.min("symbol_id").alias("declared_by"))
        linked = table.join(declared, key, "left").withColumn("described_by", F.when(F.col("trivial"), F.col("declared_by")).otherwise(F.col("symbol_id")))
        return linked.where("described_by is not null").select(*out)
    described = table.where(~F.col("trivial"))
    declared = described.groupBy(*key).agg(F.min(F.struct("symbol_id", "docstring")).alias("d"))
    own = described.withColumn("described_by", F.col("symbol_id"))
    taken = table.where("trivial").join(declared, key).withColumn("described_by", F.col("d.symbol_id"))
    pairs = own.select(*out, F.col("docstring").alias("description"), "code").unionByName(
        taken.select(*out, F.col("d.docstring").alias("description"), "code"))
    if inherits is None:
        return pairs
    above = inherits.select(F.col("src_id").alias("owner_id"), F.col("dst_id").alias("parent_id")).where("owner_id <> parent_id").distinct()
    method = ["owner_id", "name", "signature"]
    lent = described.where("owner_id is not null").groupBy(*method).agg(F.min(F.struct("symbol_id", "docstring")).alias("d"))
    left = table.where("trivial and owner_id is not null").join(declared.select(*key), key, "left_anti")
    # keys meet the types above first; texts are joined to the one row that is left of each
    met = left.select("symbol_id", *method).distinct().join(above, "owner_id").select("symbol_id", "name", "signature", F.col("parent_id").alias("owner_id"))
    hit = met.join(lent, method).groupBy("symbol_id").agg(F.min("d").alias("d"))
    got = left.join(hit, "symbol_id").withColumn("described_by", F.col("d.symbol_id"))
    return pairs.unionByName(got.select(*out, F.col("d.docstring").alias("description"), "code"))
