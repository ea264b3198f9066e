"""A stored vector index: cells as folders, vectors as codes of a few bytes, the best candidates scored exactly.

Each vector goes to the cell of its nearest centre, and what is left of it beside the centre is cut into parts, each of which becomes the number of the
nearest entry of a codebook. A query then needs one small table of products, from which a stored vector's score is looked up by its codes. Reading goes
by cells: Spark leaves the folders of other cells and the columns of full vectors unread until the candidates are known.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from passages.operators.dense import QUERY_BYTES, Cells, _double, dot, fit_cells, unit
from passages.operators.lexical import top_k

#: Vectors that codebooks are fitted on at most, and entries of a codebook: a code is one byte.
SAMPLE, ENTRIES = 20_000, 256


@dataclass(frozen=True)
class Codes:
    """Codebooks by part of a vector: arrays (parts, entries, width of a part)."""

    cells: Cells
    books: np.ndarray

    def encode(self, vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Codes (rows, parts) of unit vectors in their cells."""
        parts, entries, width = self.books.shape
        rest = (vectors - np.asarray(self.cells.centres)[cells]).reshape(len(vectors), parts, width)
        out = np.empty((len(vectors), parts), np.uint8)
        for j in range(parts):
            out[:, j] = ((self.books[j] ** 2).sum(axis=1) - 2 * rest[:, j] @ self.books[j].T).argmin(axis=1)
        return out


def _book(points: np.ndarray, entries: int, rounds: int = 12) -> np.ndarray:
    """The entries of one codebook by k-means over a bounded sample; entries without a point stay where they started."""
    rng = np.random.default_rng(3)
    book = points[rng.choice(len(points), entries, replace=len(points) < entries)]
    for _ in range(rounds):
        nearest = ((book**2).sum(axis=1) - 2 * points @ book.T).argmin(axis=1)
        sums, n = np.zeros_like(book), np.bincount(nearest, minlength=entries)
        np.add.at(sums, nearest, points)
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
    return book


def fit_codes(vectors: DataFrame, parts: int = 16, cells: Cells | None = None) -> Codes:
    """Cells and codebooks from at most SAMPLE vectors (chunk_id, embedding), those with the least hash of their id. parts must divide the width."""
    cells = cells or fit_cells(vectors)
    sample = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).select(unit(_double(F.col("embedding"))).alias("v")).where(F.size("v") > 0)
    points = np.array([r["v"] for r in sample.collect()])  # at most SAMPLE rows
    centres = np.asarray(cells.centres)
    rest = points - centres[(points @ centres.T).argmax(axis=1)]
    width = points.shape[1] // parts
    if width * parts != points.shape[1]:
        raise ValueError(f"{parts} parts don't divide vectors of width {points.shape[1]}")
    return Codes(cells, np.stack([_book(rest[:, j * width : (j + 1) * width], ENTRIES) for j in range(parts)]))


def write_vectors(vectors: DataFrame, codes: Codes, path: str) -> None:
    """Writes every vector (chunk_id, model, embedding) with its cell and code, in folders by cell, and the centres and codebooks beside them.

    Large cells are dealt out over files by chunk as Spark sees fit: a full cell is no hot key.
    """

    def run(batches):
        centres = np.asarray(codes.cells.centres)
        for batch in batches:
            v = np.array(batch.column(2).to_pylist(), float).reshape(-1, centres.shape[1])
            cell = (v @ centres.T).argmax(axis=1) if len(v) else np.zeros(0, int)
            code = codes.encode(v, cell)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], names=["chunk_id", "model", "v", "cell", "code"])

    spark = vectors.sparkSession
    rows = vectors.select("chunk_id", "model", unit(_double(F.col("embedding"))).alias("v")).where(F.size("v") == len(codes.cells.centres[0]))
    found = rows.mapInArrow(run, f"chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, model string, v array<double>, cell int, code binary")
    found.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)
    layout = json.dumps({"centres": codes.cells.centres, "books": codes.books.tolist()})
    spark.createDataFrame([(layout,)], "layout string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_index")


def read_codes(spark: SparkSession, path: str) -> Codes:
    layout = json.loads(spark.read.parquet(f"{path}/_index").first()["layout"])
    return Codes(Cells(layout["centres"]), np.array(layout["books"]))


def search_vectors(queries: DataFrame, path: str, k: int, probes: float = 0.5, head: int = 25) -> DataFrame:
    """Approximate top k of queries (query_id, model, embedding): rows (query_id, chunk_id, score, rank).

    A query looks at the codes of its nearest cells, a share `probes` of all, and the head * k best of these by code are scored exactly. Queries go along in
    blocks of QUERY_BYTES; a task keeps the best candidates of each Arrow batch, so that what is shuffled follows the queries, not the vectors.
    """
    spark = queries.sparkSession
    codes = read_codes(spark, path)
    centres, (parts, _, width) = np.asarray(codes.cells.centres), codes.books.shape
    n, most = max(1, int(np.ceil(probes * len(centres)))), head * k
    asked = queries.select("query_id", "model", unit(_double(F.col("embedding"))).alias("q")).where(F.size("q") == parts * width)
    each = 8 * (parts * ENTRIES + parts * width + len(centres))
    total = asked.count()
    blocks = max(1, -(-total * each // QUERY_BYTES))
    id_type, id_arrow, out = asked.schema["query_id"].dataType.simpleString(), to_arrow_type(asked.schema["query_id"].dataType), None
    stored = spark.read.parquet(path)
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect() if blocks > 1 else asked.collect()  # one block of queries
        if not part:
            continue
        q = np.array([r["q"] for r in part])
        products = q @ centres.T
        probed = np.argsort(-products, axis=1, kind="stable")[:, :n]
        tables = np.einsum("qpw,pew->qpe", q.reshape(len(q), parts, width), codes.books)
        ids, models = [r["query_id"] for r in part], np.array([r["model"] for r in part], object)
        by_cell: dict[int, list[int]] = {}
        for i, row in enumerate(probed):
            for c in row.tolist():
                by_cell.setdefault(c, []).append(i)

        def run(batches, by_cell=by_cell, tables=tables, products=products, ids=ids, models=models):
            for batch in batches:
                code = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, parts)
                cell, model = batch.column(2).to_numpy(), np.array(batch.column(1).to_pylist(), object)
                best: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
                for c in np.unique(cell):
                    for m in set(model[cell == c]):
                        rows = np.flatnonzero((cell == c) & (model == m))
                        for i in by_cell.get(int(c), ()):
                            if models[i] == m:
                                best.setdefault(i, []).append((rows, products[i, c] + tables[i][np.arange(parts), code[rows]].sum(axis=1)))
                for i, found in best.items():
                    rows, score = (np.concatenate(x) for x in zip(*found, strict=True))
                    keep = np.argsort(-score, kind="stable")[:most]
                    chunk = batch.column(0).take(pa.array(rows[keep]))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * len(keep), id_arrow), chunk, pa.array(score[keep]), pa.array(cell[rows[keep]], pa.int32())], names=["query_id", "chunk_id", "score", "cell"])

        coded = stored.where(F.col("cell").isin(sorted(by_cell))).select("chunk_id", "model", "cell", "code")
        near = coded.mapInArrow(run, f"query_id {id_type}, chunk_id {coded.schema['chunk_id'].dataType.simpleString()}, score double, cell int")
        near = top_k(near, most).select("query_id", "chunk_id", "cell")
        exact = near.join(stored.where(F.col("cell").isin(sorted(by_cell))).select("cell", "chunk_id", "v"), ["cell", "chunk_id"]).join(asked.select("query_id", "q"), "query_id")
        found = top_k(exact.select("query_id", "chunk_id", F.round(dot(F.col("q"), F.col("v")), 6).alias("score")), k)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], f"query_id {id_type}, chunk_id {stored.schema['chunk_id'].dataType.simpleString()}, score double, rank long")
