"""Scans of source trees."""

from __future__ import annotations

import hashlib
import json
import os
import re

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphlens.session import ship
from graphlens.sources.extract import BY_EXTENSION

SKIPPED = ("node_modules", "target")
TASK_FILES, TASK_BYTES = 2_000, 64 << 20


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """(regular expression over a relative path, negated) of one ignore pattern; None for blanks, remarks and malformed ones."""
    p = pattern.rstrip("\n").rstrip()
    if not p or p.startswith("#"):
        return None
    negated = p.startswith("!")
    p = p[1:] if negated else p
    only_dir = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[":
            j = p.find("]", i + 1)
            if j < 0:
                return None
            out, i = out + "[" + p[i + 1:j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    head = "^" if anchored else "(?:^|/)"
    tail = "/" if only_dir else "(?:/|$)"
    try:
        re.compile(head + out + tail)
    except re.error:
        return None
    return head + out + tail, negated


def ignored(rel_path: str, rules: list[tuple[str, bool]]) -> bool:
    """The last matching rule decides."""
    verdict = False
    for rx, negated in rules:
        if re.search(rx, rel_path):
            verdict = not negated
    return verdict


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there; a path without a scheme is one of this machine."""
    m = re.match(r"([a-z][a-z0-9+.-]*):/*", uri)
    if m is None:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri("file:///" + uri[m.end():] if m.group(1) == "file" else uri)


def source_paths(root: str, extensions: list[str], extra_ignores: list[str], ignore_files: list[str]) -> list[tuple[str, int]]:
    """(path below root, bytes) of the files with one of the extensions that no rule leaves out, in order. Only names are read, and ignore files."""
    system, top = file_system(root)
    if system.get_file_info(top).type != fs.FileType.Directory:
        raise FileNotFoundError(root)
    wanted = {e.lower() for e in extensions}
    extra = [("", *r) for r in map(ignore_regex, extra_ignores) if r]
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, list[tuple[str, str, bool]]]] = [("", [])]
    while stack:
        prefix, rules = stack.pop()
        entries = sorted(system.get_file_info(fs.FileSelector(f"{top}/{prefix}".rstrip("/"))), key=lambda x: x.base_name)
        rules = list(rules)  # those of this directory and the ones above it
        for x in entries:
            if x.base_name in ignore_files and x.type == fs.FileType.File:
                with system.open_input_stream(x.path) as f:
                    text = f.read().decode("utf-8", "replace")
                rules += [(prefix, *r) for r in map(ignore_regex, text.splitlines()) if r]

        def left_out(path: str, rules=rules) -> bool:
            verdict = False
            for at, rx, negated in [*rules, *extra]:
                if re.search(rx, path[len(at):]):
                    verdict = not negated
            return verdict

        for x in entries:
            path = prefix + x.base_name
            if x.base_name.startswith("."):
                continue
            if x.type == fs.FileType.Directory:
                if x.base_name not in SKIPPED:
                    stack.append((path + "/", rules))
            elif x.extension.lower() in wanted and not left_out(path):
                out.append((path, x.size or 0))
    return sorted(out)


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.settings = [json.loads(options[k]) for k in ("extensions", "ignores", "ignore_files")]

    def partitions(self):
        """Files in order, a task's share bounded by number and bytes."""
        parts, size = [[]], 0
        for path, n in source_paths(self.root, *self.settings):
            if parts[-1] and (len(parts[-1]) >= TASK_FILES or size + n > TASK_BYTES):
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += n
        return [InputPartition(p) for p in parts]

    def read(self, partition):
        system, top = file_system(self.root)
        for path in partition.value:
            with system.open_input_stream(f"{top}/{path}") as f:
                content = f.read()
            try:
                text = content.decode("utf-8")
            except UnicodeDecodeError:
                text = None
            yield path, text, hashlib.sha256(content).hexdigest(), system.get_file_info(f"{top}/{path}").mtime


class TreeSource(DataSource):
    """Files of a source tree, also those whose names other readers take for hidden (__init__.py) and empty ones."""

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return "path string, content string, hash string, modified timestamp"

    def reader(self, schema):
        return _TreeReader(self.options)


def scan_tree(spark: SparkSession, root: str, extensions: list[str] | None = None, extra_ignores: list[str] | None = None,
              ignore_files: tuple[str, ...] = (".gitignore", ".codeignore")) -> DataFrame:
    """(path, content, hash, modified) of the source files under root, ignore files of its directories honoured.

    Hidden files and those under node_modules or target are left out; bytes that are no UTF-8 give a
    null content. A missing root raises. Only files that are not left out are opened.
    """
    system, top = file_system(root)
    if system.get_file_info(top).type != fs.FileType.Directory:
        raise FileNotFoundError(root)
    ship(spark)
    spark.dataSource.register(TreeSource)
    settings = {"extensions": list(extensions or BY_EXTENSION), "ignores": list(extra_ignores or []), "ignore_files": list(ignore_files)}
    return spark.read.format("source_tree").options(**{k: json.dumps(v) for k, v in settings.items()}).load(root)


def project_root(paths: list[str], exists=os.path.exists, limit: int = 40) -> str | None:
    """Longest common directory of paths, then upwards until a manifest is found."""
    if not paths:
        return None
    at = os.path.commonpath([os.path.dirname(p) for p in paths])
    here = at
    for _ in range(limit):
        if any(exists(os.path.join(here, m)) for m in ("pyproject.toml", "setup.cfg", "setup.py")):
            return here
        up = os.path.dirname(here)
        if up == here:
            break
        here = up
    return at
