"""Dense retrieval over array<float> embeddings; arithmetic in double."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from passages.operators.lexical import analyse, in_scope, top_k
from passages.operators.sizes import few
from passages.sources.storage import kept

#: Bytes of query vectors that are broadcast at once against all stored vectors, and what a row takes besides its numbers.
QUERY_BYTES, ROW_BYTES = 24 << 20, 100


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    # the length once a vector: inside the inner function it would be worked out for each entry
    scaled = F.transform(F.array(F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("norm"))), lambda a: F.transform(a["v"], lambda x: F.when(a["norm"] > 0, x / a["norm"]).otherwise(0.0)))
    return F.get(scaled, F.lit(0))


def truncate_embeddings(vectors: DataFrame, dims: int, supports: dict[str, bool]) -> DataFrame:
    """Brings all vectors to one width. Models that support it are cut and scaled to length 1; others must match or are refused with a reason."""
    width = F.size("embedding")
    can = F.create_map(*[x for m, ok in supports.items() for x in (F.lit(m), F.lit(ok))])
    able = F.coalesce(F.try_element_at(can, F.col("model")), F.lit(False))
    reason = F.when(width == dims, None).when(~able, "fixed width").when(width < dims, "too narrow")
    rows = vectors.withColumn("reject_reason", reason)
    cut = F.when(F.col("reject_reason").isNull(), F.when(width == dims, _double(F.col("embedding"))).otherwise(unit(F.slice(_double(F.col("embedding")), 1, dims))))
    return rows.withColumn("embedding", cut)


def _blocks(queries: DataFrame, rows_each: int = 1) -> int:
    """Into how many blocks queries are dealt, so that one fits QUERY_BYTES: by their number and width. rows_each: narrow rows that go along with each."""
    found = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    return max(1, -(-found["n"] * (8 * (found["width"] or 0) + ROW_BYTES * rows_each) // QUERY_BYTES))


def source_groups(asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries that see the same sources are one group: rows (query_id, grp), and rows (source_id, grps) of the groups that see a source. asks: (query_id, source_id).

    Sets are told apart by their size and two sums of hashes, so that no query's sources are ever gathered in one place.
    """
    asks = asks.select("query_id", "source_id").where("query_id IS NOT NULL AND source_id IS NOT NULL").distinct()
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("source_id")), F.sum(F.xxhash64(F.lit("sum"), "source_id").cast("decimal(38,0)")))
    marks = asks.groupBy("query_id").agg(mark.alias("mark"))
    members = kept(marks.join(marks.groupBy("mark").agg(F.min("query_id").alias("grp")), "mark").select("query_id", "grp"), "groups")
    reach = asks.join(members.where("query_id = grp").select("query_id", "grp"), "query_id").groupBy("source_id").agg(F.collect_list("grp").alias("grps"))
    return members, reach


def _regular(v: str, width: int) -> Column:
    """Whether a vector has the width and finite numbers only: those can be multiplied as matrices."""
    return F.coalesce((F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _best(vectors: DataFrame, asked: list, k: int, id_type, keys: list[str], scaled: bool, probes: np.ndarray | None = None) -> DataFrame:
    """Rows (query_id, chunk_id, score) that hold the top k of each query of a block, asked (query_id, *keys, q), among vectors (chunk_id, *keys, v, and cell if there are probes); v is scaled to length 1 if it isn't yet, as unit() does.

    A task multiplies its vectors with the block tile by tile and keeps what may be among a query's best k. Scores of these are then added up entry by entry,
    as dot() does, so that they hang on no order of the matrix product; equal ones beyond the k least ids go. probes: by query and cell, whether the query looks at the cell.
    """
    names, by_key = [r["query_id"] for r in asked], {}
    matrix = np.array([r["q"] for r in asked], float)
    for i, r in enumerate(asked):
        by_key.setdefault(tuple(r[x] for x in keys), []).append(i)
    block = vectors.sparkSession.sparkContext.broadcast((names, matrix, {key: np.array(at) for key, at in by_key.items()}, probes))
    arrow_id, tile, margin, slack = to_arrow_type(id_type), 1 << 21, 1.0000001e-6, 1e-9

    def run(batches):
        names, matrix, by_key, probes = block.value
        least = np.full(len(names), -np.inf)  # the k-th score so far
        held, n_held, most = [], 0, 1 << 20

        def compact():
            """Drops what can't be among the best k after rounding to six places."""
            nonlocal held, n_held
            q, score = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            ids = pa.concat_arrays([x[2] for x in held])
            rank = pd.factorize(ids.to_pandas(), sort=True)[0]
            order = np.lexsort((rank, -score, q))
            q, score = q[order], score[order]
            new = np.r_[True, q[1:] != q[:-1]]
            run_start = np.flatnonzero(new | np.r_[True, score[1:] != score[:-1]])
            at = np.arange(len(q))
            in_run = at - np.repeat(run_start, np.diff(np.r_[run_start, len(q)]))
            starts = np.flatnonzero(new)
            sizes = np.diff(np.r_[starts, len(q)])
            last = np.where(sizes >= k, score[np.minimum(starts + k - 1, len(q) - 1)], -np.inf)
            least[q[starts]] = last
            keep = (in_run < k) & (score >= np.repeat(last, sizes) - margin)
            held, n_held = [(q[keep], score[keep], ids.take(pa.array(order[keep])))], int(keep.sum())

        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            flat = np.asarray(columns["v"].flatten()).reshape(len(batch), -1)
            if not scaled:
                square = np.zeros(len(flat))
                with np.errstate(over="ignore"):
                    for d in range(flat.shape[1]):
                        square += flat[:, d] * flat[:, d]
                norm = np.sqrt(square)[:, None]
                flat = np.divide(flat, norm, out=np.zeros_like(flat), where=norm > 0)
            frame = pd.DataFrame({x: columns[x].to_pandas() for x in keys})
            for key, rows in frame.groupby(keys, sort=False).indices.items():
                found = by_key.get(key if isinstance(key, tuple) else (key,))
                if found is None:
                    continue
                v = flat[rows]
                cell = np.asarray(columns["cell"])[rows] if probes is not None else None
                step = max(1, tile // len(rows))
                for start in range(0, len(found), step):
                    q = found[start : start + step]
                    scores = matrix[q] @ v.T
                    unknown = np.isinf(least[q])
                    if unknown.any() and len(rows) > k:
                        open_ = scores[unknown] if probes is None else np.where(probes[q[unknown]][:, cell], scores[unknown], -np.inf)
                        bound = least[q]
                        bound[unknown] = np.partition(open_, len(rows) - k, axis=1)[:, len(rows) - k]
                    else:
                        bound = least[q]
                    i, j = np.nonzero(scores >= (bound - margin - slack)[:, None])
                    if probes is not None:
                        seen = probes[q[i], cell[j]]
                        i, j = i[seen], j[seen]
                    some = max(1, (1 << 19) // v.shape[1])
                    for a in range(0, len(i), some):
                        b, c = i[a : a + some], j[a : a + some]
                        exact, left, right = np.zeros(len(b)), matrix[q[b]], v[c]
                        for d in range(v.shape[1]):
                            exact += left[:, d] * right[:, d]
                        held.append((q[b], exact, columns["chunk_id"].take(pa.array(rows[c]))))
                        n_held += len(b)
                    if n_held > most:
                        compact()
                        most = max(1 << 20, 2 * n_held)  # where near-ties leave more
            if n_held:
                compact()
        if n_held:
            q, score, ids = held[0]
            for a in range(0, len(q), 1 << 16):
                part = q[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in part], arrow_id), ids.slice(a, len(part)), pa.array(score[a : a + len(part)])], names=["query_id", "chunk_id", "score"])

    found = vectors.mapInArrow(run, f"query_id {id_type.simpleString()}, chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, score double")
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def dense_search(queries: DataFrame, vectors: DataFrame, k: int, scope: DataFrame | None = None) -> DataFrame:
    """Top k by cosine for queries (query_id, model, embedding) among vectors (chunk_id, model, embedding) of the query's model, within the scope of each query.

    scope: rows (query_id, source_id); vectors must then have source_id. A vector meets only queries that may see its source: it's given the
    groups of such queries before the product, and vectors of sources that nobody asks for go. A query without a source finds nothing.
    A scope by chunk (query_id, chunk_id) is applied to scored pairs instead. Queries are broadcast in blocks of QUERY_BYTES, and each task keeps its best k
    of a matrix product; vectors of another width than the queries, or with entries that are no finite numbers, are scored one by one.
    """
    blocks = _blocks(queries)
    by_source = scope is not None and "source_id" in scope.columns and "chunk_id" not in scope.columns
    q = queries.select("query_id", "model", unit(_double(F.col("embedding"))).alias("q"))
    v = vectors.select("chunk_id", "model", *(["source_id"] if by_source else []), _double(F.col("embedding")).alias("v"))
    if by_source:
        members, reach = source_groups(scope)
        q = q.join(members, "query_id")
        v = v.join(few(reach), "source_id").select("chunk_id", "model", "v", F.explode("grps").alias("grp"))

    keys = ["model", "grp"] if by_source else ["model"]
    by_one = lambda v, q: v.join(F.broadcast(q), keys).select("query_id", "chunk_id", F.round(dot(F.col("q"), F.col("unit")), 6).alias("score"))
    with_unit = lambda rows: rows.withColumn("unit", unit(F.col("v")))

    def search(part: DataFrame) -> DataFrame:
        if scope is not None and not by_source:
            return top_k(in_scope(by_one(with_unit(v), part), scope), k)
        width = part.agg(F.max(F.size("q"))).first()[0] or 0
        usual_q, usual_v = _regular("q", width), _regular("v", width)
        asked = part.where(usual_q).where(" AND ".join(f"{x} IS NOT NULL" for x in keys)).collect()  # a block of queries
        hits = by_one(with_unit(v.where(~usual_v)), part)
        if asked:
            hits = hits.union(_best(v.where(usual_v), asked, k, part.schema["query_id"].dataType, keys, scaled=False))
        unusual = part.where(~usual_q)
        return top_k(hits if unusual.isEmpty() else hits.union(by_one(with_unit(v.where(usual_v)), unusual)), k)

    if blocks <= 1:
        return search(q)
    return reduce(DataFrame.union, [search(q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)) for i in range(blocks)])


@dataclass(frozen=True)
class Cells:
    """An inverted-file index: the centres of its cells, as rows of unit length."""

    centres: list[list[float]]

    def nearest(self, n: int):
        """A column function: the numbers of the n cells nearest to a vector of unit length."""
        centres = np.array(self.centres)

        @F.pandas_udf("array<int>")
        def cells(vectors: pd.Series) -> pd.Series:
            scores = np.stack(vectors.to_numpy()) @ centres.T if len(vectors) else np.zeros((0, len(centres)))
            return pd.Series(list(np.argsort(-scores, axis=1, kind="stable")[:, :n].astype(np.int32)))

        return cells


def fit_cells(vectors: DataFrame, cells: int | None = None, sample: int = 20_000, seed: int = 5) -> Cells:
    """Centres of cells by k-means over at most `sample` vectors, those with the least hash of their id; six times the root of the number of vectors cells, 1,024 at most."""
    n = vectors.count()
    cells = cells or max(2, min(1024, 6 * math.isqrt(n), n // 4))
    chosen = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select(array_to_vector(unit(_double(F.col("embedding")))).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(chosen.where(F.size(vector_to_array("features")) > 0))
    centres = np.array(model.clusterCenters())
    lengths = np.linalg.norm(centres, axis=1, keepdims=True)
    return Cells((centres / np.where(lengths > 0, lengths, 1.0)).tolist())


def index_cells(vectors: DataFrame, cells: Cells) -> DataFrame:
    """Every vector with its cell: (chunk_id, model, embedding, v, cell); v is of unit length."""
    rows = vectors.select("chunk_id", "model", "embedding", unit(_double(F.col("embedding"))).alias("v"))
    return rows.withColumn("cell", F.get(cells.nearest(1)("v"), F.lit(0)))


def dense_search_ann(queries: DataFrame, vectors: DataFrame, k: int, cells: Cells | None = None, probes: float = 0.5) -> DataFrame:
    """Approximate top k: a query looks at the vectors of its nearest cells, a share `probes` of all, and scores these exactly.

    Half of the cells give a recall of 0.9 even where vectors have no structure at all; where they form clusters, far fewer do.
    Cells decide what is compared, not where: vectors stay in their tasks, and the queries are broadcast to them in blocks of
    QUERY_BYTES, each with a byte a cell, so that a full cell is no hot key.
    """
    cells = cells or fit_cells(vectors)
    n = max(1, math.ceil(probes * len(cells.centres)))
    width = len(cells.centres[0])
    q = queries.select("query_id", "model", unit(_double(F.col("embedding"))).alias("q"))
    v = index_cells(vectors, cells)
    blocks = _blocks(queries, 1 + len(cells.centres) // ROW_BYTES)

    def by_one(v: DataFrame, q: DataFrame) -> DataFrame:
        probed = q.select("query_id", "model", F.explode(cells.nearest(n)("q")).alias("cell"))
        near = v.join(F.broadcast(probed), ["model", "cell"]).join(F.broadcast(q.select("query_id", "q")), "query_id")
        return near.select("query_id", "chunk_id", F.round(dot(F.col("q"), F.col("v")), 6).alias("score"))

    def search(part: DataFrame) -> DataFrame:
        usual_q, usual_v = _regular("q", width), _regular("embedding", width)
        asked = part.where(usual_q).where("model IS NOT NULL").withColumn("cells", cells.nearest(n)("q")).collect()  # a block of queries
        hits = by_one(v.where(~usual_v), part)
        if asked:
            looks = np.zeros((len(asked), len(cells.centres)), bool)
            for i, r in enumerate(asked):
                looks[i, r["cells"]] = True
            hits = hits.union(_best(v.where(usual_v).select("chunk_id", "model", "v", "cell"), asked, k, part.schema["query_id"].dataType, ["model"], scaled=True, probes=looks))
        unusual = part.where(~usual_q)
        return top_k(hits if unusual.isEmpty() else hits.union(by_one(v.where(usual_v), unusual)), k)

    return reduce(DataFrame.union, [search(q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else q) for i in range(blocks)])


def hashed_embeddings(chunks: DataFrame, dims: int = 64) -> DataFrame:
    """A default embedding without a model: term counts hashed into dims places. Rows (chunk_id, embedding); a chunk without a term has none.

    A chunk's terms stand in one row, so its places are counted before anything is shuffled.
    """
    rows = chunks.select("chunk_id", F.explode(analyse(F.col("text"))).alias("term"))
    place = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long") % dims
    counts = rows.groupBy("chunk_id", place.cast("int").alias("place")).agg(F.count("*").cast("double").alias("n"))
    counts = counts.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("counts"))
    return counts.select("chunk_id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("counts", i), F.lit(0.0))).alias("embedding"))


def embed_corpus(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 100) -> DataFrame:
    """Rows (chunk_id, embedding) from a caller's model, which gets up to `batch` texts at a time and must return as many vectors."""

    def run(pdfs):
        for pdf in pdfs:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start : start + batch]
                vectors = embed(part["text"].fillna("").tolist())
                if len(vectors) != len(part):
                    raise ValueError(f"{len(part)} texts, {len(vectors)} vectors")
                yield part[["chunk_id"]].assign(embedding=list(vectors))

    return chunks.select("chunk_id", "text").mapInPandas(run, "chunk_id long, embedding array<float>")
