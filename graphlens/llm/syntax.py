"""Source files that do not parse.

Each text goes through a recursive-descent parser of the language its path promises (precedence
climbing for expressions, panic-mode recovery after an error), which stores all errors and the first
cause. For Python, a finding is confirmed by the interpreter's own parser. Files are judged one by
one, without a shuffle but the join of texts and paths; rates are counted from one row per file.

Defined cases: null texts and files without a known extension get no verdict (valid is null); an
empty text is valid; repeated rows of files count once (a file under several paths is judged by the
first of them in order); texts may be of any length and nest as deep as they are long.
"""

from __future__ import annotations

import ast
import re
import sys
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.parsing.base import SyntaxFault
from graphlens.llm.parsing.ecma import Ecma
from graphlens.llm.parsing.python import Python
from graphlens.llm.parsing.rust import Rust
from graphlens.session import parallel

# Extensions and their languages.
LANGUAGES = {
    "py": "python", "pyi": "python", "rs": "rust", "ts": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript"}


def extension(path: str | None) -> str:
    m = re.search(r"\.([A-Za-z0-9]+)$", path or "")
    return m.group(1).lower() if m else ""


def faults_of(text: str, ext: str) -> tuple[int, list[SyntaxFault]] | None:
    """(number of errors, their list by line), or None without a verdict."""
    language = LANGUAGES.get(ext)
    if language is None:
        return None
    limit = sys.getrecursionlimit()
    # calls between the parser's methods lie on the heap; no text nests deeper than it is long
    sys.setrecursionlimit(max(limit, min(2**30, 100_000 + 64 * len(text))))
    try:
        if language == "python":
            parser = Python(text)
        elif language == "rust":
            parser = Rust(text)
        else:
            parser = Ecma(text, language == "typescript", ext != "cjs")
        parser.program()
        faults = sorted(parser.faults, key=lambda f: f.line)
        if faults and language == "python" and _accepted(text):
            return 0, []
        return parser.n_faults, faults
    except RecursionError:
        return None
    finally:
        sys.setrecursionlimit(limit)


def _accepted(text: str) -> bool:
    """The exact check that follows a finding in Python."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            return True
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            return False


_SCHEMA = (
    "file_id long, path string, repository string, language string, valid boolean, n_errors int, first_line int, first_error string, "
    "errors array<struct<line:int,message:string>>")
_ERROR = pa.list_(pa.struct([("line", pa.int32()), ("message", pa.string())]))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, path, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            ext = extension(path)
            got = faults_of(text, ext)
            n, faults = got or (None, [])
            rows.append((
                i, path, path.split("/")[0] if path else None, LANGUAGES.get(ext), None if got is None else n == 0, n,
                faults[0].line if faults else None, faults[0].message if faults else None,
                None if got is None else [{"line": f.line, "message": f.message} for f in faults]))
        if rows:
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), _ERROR]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split(" ")[0] for x in re.split(r", (?=\w+ \w)", _SCHEMA)])


def check_syntax(files: DataFrame, file_text: DataFrame) -> DataFrame:
    """One row per file with a text and a path: verdict, number of errors, first cause, all errors."""
    paths = files.where("path is not null").groupBy(F.col("id").alias("file_id")).agg(F.min("path").alias("path"))
    texts = parallel(file_text.where("content is not null").select("file_id", "content"))
    return texts.join(paths, "file_id").select("file_id", "path", "content").mapInArrow(_judge, _SCHEMA)


def acceptance(verdicts: DataFrame) -> DataFrame:
    """(repository, language, n_files, n_invalid, invalid_rate): over the files with a verdict."""
    counted = verdicts.where("valid is not null").groupBy("repository", "language").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum((~F.col("valid")).cast("long")).alias("n_invalid"))
    return counted.withColumn("invalid_rate", F.col("n_invalid") / F.col("n_files"))
