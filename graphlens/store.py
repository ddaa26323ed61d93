"""The graph tables as a store that is written to: typed, versioned, replaced as a whole.

Every table is a Parquet folder <root>/<name>.parquet, so a store is read like any data directory. A
write goes to a new folder beside it first and takes the table's name when it is complete: a reader sees
the old rows or the new ones. All paths go through the file system that Spark uses for the root.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.operators.snapshot import Graph, mark_indexed, snapshot_merge

VERSION = 1
SCHEMAS = {
    "files": "id long, path string, hash string, indexed_at timestamp",
    "file_text": "file_id long, content string",
    "symbols": "id long, file_id long, name string, kind string, line_start long, line_end long, docstring string, coverage_pct double, import_module string, import_name string, written_at timestamp",
    "edges": "id long, src_id long, dst_id long, kind string, built_at timestamp",
    "dataflow": "src_id long, dst_id long, param string",
    "call_trace": "test string, seq long, depth long, src_id long, dst_id long, called_at timestamp",
    "markers": "id long, marker string, step int",
}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def has(self, name: str) -> bool:
        return self._fs.exists(self._path(self._at(name)))

    def create(self) -> Store:
        """Make what is missing: folders, empty typed tables, the version. Repeating it changes nothing."""
        found = self.version()
        if found is not None and found > VERSION:
            raise ValueError(f"{self.root} has version {found}, this package knows {VERSION}")
        for name, schema in SCHEMAS.items():
            if not self.has(name):
                self.write(name, self.spark.createDataFrame([], schema))
        if found != VERSION:
            self.write("_store_version", self.spark.createDataFrame([(VERSION,)], "version int"))
        return self

    def version(self) -> int | None:
        return self.spark.read.parquet(self._at("_store_version")).first().version if self.has("_store_version") else None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(self._at(name)) if name in SCHEMAS else self.spark.read.parquet(self._at(name))

    def write(self, name: str, df: DataFrame) -> None:
        """Replace a table. Columns are brought to its schema; a missing one or one of another type fails before anything is written."""
        if name in SCHEMAS:
            want = self.spark.createDataFrame([], SCHEMAS[name]).schema
            lacking = [f.name for f in want if f.name not in df.columns]
            if lacking:
                raise ValueError(f"{name} lacks {lacking}")
            df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want])
        new = f"{self.root}/.{name}-{uuid.uuid4().hex}"
        df.write.parquet(new)
        self._fs.delete(self._path(self._at(name)), True)
        if not self._fs.rename(self._path(new), self._path(self._at(name))):
            raise OSError(f"cannot put {name} in place")

    @property
    def graph(self) -> Graph:
        return Graph(self.spark, self.root)

    # ---- what is ingested

    def write_files(self, scan: DataFrame) -> None:
        """Files of a scan (path, hash[, content]) marked as indexed; with content, their texts replaced."""
        self.write("files", mark_indexed(self.graph.files, scan.select("path", "hash")))
        if "content" in scan.columns:
            ids = self.graph.files.select(F.col("id").alias("file_id"), "path")
            fresh = scan.join(ids, "path").select("file_id", "content")
            self.write("file_text", self.read("file_text").join(fresh.select("file_id"), "file_id", "left_anti").unionByName(fresh))

    def write_symbols(self, incoming: DataFrame) -> int:
        """Merge symbols (file_id, name, kind, line_start, line_end, docstring, import_module, import_name) of re-read files.

        Files that are in incoming lose what is not. Error rows are no symbols. Gives the number of rows of the files.
        """
        paths = self.graph.files.select(F.col("id").alias("file_id"), "path")
        every = ("name", "kind", "line_start", "line_end", "docstring", "coverage_pct", "import_module", "import_name")
        stored = self.graph.symbols("file_id", *every).join(paths, "file_id").drop("file_id")
        merged = snapshot_merge(stored, incoming.join(paths, "file_id").drop("file_id"))
        self.write("symbols", merged.join(paths, "path").withColumn("written_at", F.current_timestamp()))
        return self.read("symbols").join(incoming.select("file_id").distinct(), "file_id", "left_semi").count()

    def write_edges(self, edges: DataFrame) -> int:
        """Replace the edges (src_id, dst_id, kind); ids follow the triples. Gives how many were not there before."""
        from graphlens.operators.heavy_keys import balanced_row_number

        triple = ["src_id", "dst_id", "kind"]
        before = self.read("edges").select(*triple).distinct()
        rows = balanced_row_number(edges.select(*triple).distinct(), [], triple, "id").withColumn("built_at", F.current_timestamp())
        added = rows.select(*triple).join(before, triple, "left_anti").count()
        self.write("edges", rows)
        return added

    def write_trace(self, events: DataFrame) -> None:
        """Replace the events of the tests that are in events (test, seq, depth, src_id, dst_id[, called_at])."""
        e = events if "called_at" in events.columns else events.withColumn("called_at", F.current_timestamp())
        kept = self.read("call_trace").join(events.select("test").distinct(), "test", "left_anti")
        self.write("call_trace", kept.unionByName(e.select(*kept.columns)))
