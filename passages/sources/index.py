"""A stored index that grows by segments: a batch writes its own rows and nothing else, a manifest says which segments count, and readers merge.

Below the index's folder, segments/<name>/<table> hold the rows of one batch each, with a table `docs` of the documents that it speaks for, and
manifests/<n> list the segments in order. A document's rows are those of the last segment that speaks for it; what earlier ones hold of it is passed
over on reading, until compaction leaves one segment. A manifest counts once it's complete, so that no reader sees half a batch.
One writer at a time is assumed; a second one fails on the manifest's folder.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.operators.sizes import few
from passages.sources import corpus
from passages.sources.storage import children, exists, remove

#: Segments above which an append compacts the index.
MOST_SEGMENTS = 16


class StoredIndex:
    """The tables of an index at a path, such as chunks, postings, vectors and sources; key is the column that names a document."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _version(self) -> int:
        """Number of the last complete manifest, 0 without one."""
        numbers = [int(n) for n in children(self.spark, f"{self.path}/manifests") if n.isdigit()]
        return max((n for n in numbers if exists(self.spark, f"{self.path}/manifests/{n}/_SUCCESS")), default=0)

    def _manifest(self, version: int) -> list[tuple[str, str, list[str]]]:
        """(segment, batch, tables) in order."""
        if not version:
            return []
        rows = self.spark.read.parquet(f"{self.path}/manifests/{version}").orderBy("position").collect()  # a segment each, at most MOST_SEGMENTS and one
        return [(r["segment"], r["batch"], list(r["tables"])) for r in rows]

    def _publish(self, version: int, segments: list[tuple[str, str, list[str]]]) -> None:
        target = f"{self.path}/manifests/{version}"
        if not exists(self.spark, f"{target}/_SUCCESS"):
            remove(self.spark, target)  # what a writer that died left
        rows = [(i, *s) for i, s in enumerate(segments)]
        self.spark.createDataFrame(rows, "position int, segment string, batch string, tables array<string>").coalesce(1).write.parquet(target)

    def batches(self) -> list[str]:
        return [b for _, b, _ in self._manifest(self._version())]

    def append(self, tables: dict[str, DataFrame], docs: DataFrame, batch: str) -> None:
        """Adds a batch: docs (key) are all documents that it speaks for, whose rows in earlier segments no longer count, be they in tables or not.

        tables have the key, or a chunk_id that the table chunks has. A batch that the index has already changes nothing.
        """
        version = self._version()
        segments = self._manifest(version)
        if any(batch in b.split("+") for _, b, _ in segments):
            return
        name = uuid.uuid4().hex
        self._write(name, tables, docs)
        self._publish(version + 1, [*segments, (name, batch, sorted(tables))])
        if len(segments) + 1 > MOST_SEGMENTS:
            self.compact()

    def delete(self, docs: DataFrame, batch: str) -> None:
        """Documents (key) of which the index shall have no rows."""
        self.append({}, docs, batch)

    def _write(self, name: str, tables: dict[str, DataFrame], docs: DataFrame) -> None:
        base = f"{self.path}/segments/{name}"
        docs.select(self.key).distinct().write.parquet(f"{base}/docs")
        for table, rows in tables.items():
            if self.key not in rows.columns:
                rows = rows.join(tables["chunks"].select("chunk_id", self.key), "chunk_id")
            if "term" in rows.columns:
                corpus.write_index(rows, f"{base}/{table}")
            else:
                rows.write.parquet(f"{base}/{table}")

    def read(self, table: str, terms: DataFrame | None = None) -> DataFrame:
        """A table as the last complete manifest has it; of a table with terms only those of `terms` (term), if given, whose folders alone are read."""
        return self._merged(self._manifest(self._version()), table, terms)

    def _merged(self, segments: list[tuple[str, str, list[str]]], table: str, terms: DataFrame | None = None) -> DataFrame:
        parts = []
        for i, (name, _, tables) in enumerate(segments):
            if table not in tables:
                continue
            path = f"{self.path}/segments/{name}/{table}"
            rows = corpus.read_index(self.spark, path, terms) if exists(self.spark, f"{path}/_index") else self.spark.read.parquet(path)
            later = [self.spark.read.parquet(f"{self.path}/segments/{n}/docs") for n, _, _ in segments[i + 1 :]]
            if later:
                rows = rows.join(few(reduce(DataFrame.union, later).distinct()), self.key, "left_anti")
            parts.append(rows)
        if not parts:
            raise ValueError(f"the index has no table {table}")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def compact(self) -> None:
        """Leaves one segment with the rows that count. The segments it replaces go, but for those of the manifest before, which readers may still hold."""
        version = self._version()
        segments = self._manifest(version)
        if len(segments) < 2:
            return
        names = sorted({t for _, _, tables in segments for t in tables})
        docs = reduce(DataFrame.union, [self.spark.read.parquet(f"{self.path}/segments/{n}/docs") for n, _, _ in segments])
        merged = uuid.uuid4().hex
        self._write(merged, {t: self._merged(segments, t) for t in names}, docs)
        self._publish(version + 1, [(merged, "+".join(b for _, b, _ in segments), names)])
        held = {n for v in (version, version + 1) for n, _, _ in self._manifest(v)}
        for name in children(self.spark, f"{self.path}/segments"):
            if name not in held:
                remove(self.spark, f"{self.path}/segments/{name}")
        for n in children(self.spark, f"{self.path}/manifests"):
            if n.isdigit() and int(n) < version:
                remove(self.spark, f"{self.path}/manifests/{n}")
