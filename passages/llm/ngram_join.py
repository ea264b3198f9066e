"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the matrix are documents, columns are word n-grams. Documents with equal sets are one row. The product is only
formed where it can hold a link: size-derived bounds say that two linked documents share one of the rarest n-grams of both,
so the lists of those n-grams tie documents into clusters. A cluster that fits into one block is multiplied as a whole. A larger
one is multiplied along its diagonal first, each block beside a few documents of the whole cluster; what these links leave outside the
cluster's largest component is then put into blocks of its own, and these are multiplied with the blocks they share a rare n-gram with, as all else is connected already.
A block holds documents of one kind, and a product only gets those of its documents that may link with one of the other block, so that copies of
different texts which a chance n-gram ties into one cluster are not multiplied with each other.
Overlap counts are accumulated column chunk by column chunk, and pairs below the size-derived bound are discarded; each
product returns a spanning forest of its links, never its pairs.

How rare an n-gram is only steers the order of n-grams, on which results do not depend; it is read from counts over all
documents, held in a table of at most 2 ** MAX_BITS counters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from passages.llm.common import ship, small, unused, written
from passages.llm.components import components

#: Counters for n-gram frequencies: one for about 64 n-grams, 2 ** 24 (16 MB as bytes) at most.
MIN_BITS, MAX_BITS = 16, 24
_CHUNK = 1 << 16
#: Documents and n-grams in a block of the product, and documents of its whole cluster beside each; blocks that are multiplied with
#: others, of which fewer documents take part, hold so many times the documents.
BLOCK_DOCS, BLOCK_NGRAMS, HUBS, WIDER = 128, 1 << 20, 8, 4
#: Scaled count from which an n-gram's list is not ordered (about 500 documents).
HOT = 81

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))  # A-Z only
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_R1, _R2 = np.uint64(29), np.uint64(32)


def ngrams(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; with fewer words, of the whole sequence; empty without words."""
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()  # bytes.split() knows ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        out = (out ^ hashes[j : j + len(out)]) * _K1
        out ^= out >> _R1
        out *= _K2
        out ^= out >> _R2
    return np.unique(out)


def least_overlap(a, b, percent: int):
    """Shared n-grams that sets of these sizes need for a Jaccard similarity of percent / 100."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """How many of its rarest n-grams a document shows as the larger and as the smaller one of a pair."""
    return n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1


def _profile(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """Per document its size and set signature, per task (its number is in n) and chunk of counters the n-gram counts: rows of two kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])
        part_no = TaskContext.get().partitionId()
        counts, waiting, size = np.zeros(1 << bits, np.uint32), [], 0
        shift = np.uint64(64 - bits)

        def add() -> None:
            nonlocal waiting, size
            if waiting:
                np.add.at(counts, (np.concatenate(waiting) >> shift).astype(np.int64), np.uint32(1))
            waiting, size = [], 0

        for batch in batches:
            n, hi, lo = [], [], []
            for text in batch.column(1).to_pylist():
                grams = ngrams(text, width)
                high, low = np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), np.int64).tolist()
                n.append(len(grams))
                hi.append(high)
                lo.append(low)
                waiting.append(grams)
                size += len(grams)
                if size > 1 << 21:
                    add()
            empty = [None] * len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(empty, pa.int32()), pa.array(empty, pa.binary())], schema=schema)
        add()
        pack = zstandard.ZstdCompressor(level=1).compress
        for c in range(0, 1 << bits, _CHUNK):
            part = counts[c : c + _CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([part_no], pa.int32()), *[pa.array([None], pa.int64())] * 2, pa.array([c // _CHUNK], pa.int32()), pa.array([pack(part.astype(np.int64).tobytes())], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "id long, n int, hi long, lo long, chunk int, counts binary")


def _frequencies(profile: DataFrame, bits: int, fan_in: int = 64) -> np.ndarray:
    """The counters on a logarithmic scale of one byte each: 2 ** bits bytes, whatever the corpus. Tasks' counters are summed up in a tree of that fan-in."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        counts = np.zeros(_CHUNK, np.int64)
        for packed in pdf["counts"]:
            counts += np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.int64)
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "part": [int(pdf["part"].iloc[0])], "counts": [zstandard.ZstdCompressor(level=1).compress(counts.tobytes())]})

    rows = profile.where(F.col("chunk").isNotNull()).select("chunk", F.col("n").cast("long").alias("part"), "counts")
    n = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while n > 1:
        rows = rows.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("chunk", "part").applyInPandas(total, "chunk int, part long, counts binary")
        n = -(-n // fan_in)
        rows = written(rows, "counters") if n > 1 else rows
    import zstandard

    out = np.zeros(1 << bits, np.uint8)
    for row in rows.toLocalIterator():
        counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["counts"]), np.int64)
        out[row["chunk"] * _CHUNK : (row["chunk"] + 1) * _CHUNK] = np.minimum(255, np.round(9 * np.log2(1.0 + counts)))
    return out


def _prefixes(docs: DataFrame, width: int, percent: int, frequencies, bits: int) -> DataFrame:
    """Rows (gram, id, n, at, hot): the rarest n-grams of each document; `at` is twice the place in that order, odd if also shown as the smaller one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, shift = frequencies.value, np.uint64(64 - bits)
        for batch in batches:
            out: list[tuple[np.ndarray, int, int, np.ndarray, np.ndarray]] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = ngrams(text, width)
                n = len(grams)
                if n:
                    larger, smaller = prefix_lengths(n, percent)
                    rarity = order[(grams >> shift).astype(np.int64)]
                    first = np.argsort(rarity, kind="stable")[:larger]  # ties by hash
                    at = 2 * np.arange(larger) + (np.arange(larger) < smaller)
                    out.append((grams[first].view(np.int64), i, n, at.astype(np.int32), rarity[first] >= HOT))
            if out:
                lengths = [len(x[0]) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([x[0] for x in out])), pa.array(np.repeat(np.array([x[1] for x in out], np.int64), lengths)), pa.array(np.repeat(np.array([x[2] for x in out], np.int32), lengths)), pa.array(np.concatenate([x[3] for x in out])), pa.array(np.concatenate([x[4] for x in out]))],
                    names=["gram", "id", "n", "at", "hot"],
                )

    return docs.mapInArrow(run, "gram long, id long, n int, at int, hot boolean")


def _cluster_edges(prefixes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose components hold every pair that shares a prefix n-gram within the size and place bounds.

    Each document is tied to the first one in its n-gram's list that may stand on the smaller side of a pair and is not too small for it. By
    induction over sizes this connects all of the list that may pair up: the two ends of a pair are tied to documents that are themselves a possible pair of smaller ones. Lists
    of documents of like size so are stars rather than chains, which components() joins in few rounds. Lists that may be too long for one task are
    not ordered: there, sizes fall into bands so wide that a pair spans two neighbouring ones at most, and each document is tied to
    one document of its band and of the band below that may stand on the smaller side.
    """
    reach = 1.0001 * float(np.log(100 / percent))
    first = F.expr(f"min(CASE WHEN at % 2 = 1 THEN struct(n, id) END) OVER (PARTITION BY gram ORDER BY ln(n) RANGE BETWEEN {reach}D PRECEDING AND CURRENT ROW)")
    ties = prefixes.where("NOT hot").select("id", first["id"].alias("other")).where("other IS NOT NULL")
    hot = prefixes.where("hot").withColumn("band", F.floor(F.log("n") / reach))
    centres = written(hot.where(F.col("at") % 2 == 1).groupBy("gram", "band").agg(F.min("id").alias("other")), "band-centres")
    for step in (0, 1):
        ties = ties.union(hot.join(small(centres.withColumn("band", F.col("band") + step)), ["gram", "band"]).select("id", "other"))
    return ties.where("id <> other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def linked(sizes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, percent: int) -> np.ndarray:
    """The block's links as a boolean matrix, left documents by the others (by all, if all are left).

    The sparse product of the block: columns are the n-grams that occur twice or more, taken in chunks.
    """
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    first = np.ones(len(grams), bool)
    first[1:] = grams[1:] != grams[:-1]
    del grams
    group = np.cumsum(first, dtype=np.int32) - 1
    times = np.bincount(group)
    keep = times[group] > 1
    rows = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[order[keep]]
    columns = (np.cumsum(times > 1, dtype=np.int32) - 1)[group[keep]]  # in order
    width = int((times > 1).sum())
    del order, first, group, keep, times
    right = ~left if not left.all() else left
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    position = np.empty(len(sets), np.int64)
    position[a] = np.arange(len(a))
    overlap = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, width, 4096):
        lo, hi = np.searchsorted(columns, [start, start + 4096])
        dense = np.zeros((len(sets), min(4096, width - start)), np.float32)
        dense[rows[lo:hi], columns[lo:hi] - start] = 1.0
        overlap += dense[a] @ dense[b].T
    union = sizes[a][:, None] + sizes[b][None, :] - overlap
    return 100 * overlap >= percent * union


def _forest(links: np.ndarray, left: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links connect: at most one fewer than there are documents."""
    a = np.flatnonzero(left)
    b = np.flatnonzero(~left) if not left.all() else a
    root = np.arange(len(ids))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    edges = []
    for i in range(len(a)):
        for j in np.flatnonzero(links[i]):
            x, y = find(a[i]), find(b[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                edges.append((int(ids[a[i]]), int(ids[b[j]])))
    return edges


def _products(docs: DataFrame, places: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (a, b) between linked documents, as the forests of the products (i, j) of each cluster.

    places: (id, cluster, i, j, left); a product is formed of its left documents and its others, or of all by all if all are left.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [ngrams(x, width).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], names=["id", "grams"])

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[["id", "left", "grams"]].drop_duplicates("id").sort_values("id", ignore_index=True)
        grams = [np.frombuffer(x, np.uint64) for x in pdf.pop("grams")]
        left = pdf["left"].to_numpy().astype(bool)
        links = linked(np.array([len(x) for x in grams]), grams, left, percent) if left.any() else np.zeros((0, len(grams)), bool)
        return pd.DataFrame(_forest(links, left, pdf["id"].to_numpy()), columns=["a", "b"], dtype="int64")

    wanted = written(places.select("id").distinct(), "product-ids")
    rows = docs.join(small(wanted), "id", "left_semi").select("id", "text").mapInArrow(sets, "id long, grams binary")
    return rows.join(small(places), "id").groupBy("cluster", "i", "j").applyInPandas(product, "a long, b long")


def _blocks(members: DataFrame, grams: DataFrame, name: str, docs: int) -> DataFrame:
    """Rows (id, cluster, block) of members (id, cluster, n, held): documents of one kind stand together, as far as a block of so many docs holds them.

    Of one kind are those of the component `held`, if it isn't null, and else those whose n-gram that most of the cluster show is the same one. Kinds
    that fill half a block have blocks of their own, the others share some.
    """
    rows = grams.join(small(members.select("id", "cluster")), "id").select("id", "cluster", "gram")
    times = rows.groupBy("cluster", "gram").agg(F.count("*").alias("times"))
    most = written(rows.join(times, ["cluster", "gram"]).groupBy("id").agg(F.max_by("gram", F.struct("times", "gram")).alias("most")), "most-shown")
    kind = F.coalesce(F.xxhash64(F.lit("held"), "held"), "most") if "held" in members.columns else F.col("most")
    rows = written(members.join(small(most), "id").select("id", "cluster", "n", kind.alias("kind")).dropDuplicates(["id"]), "kinds")
    fill = F.greatest(F.count("*") / docs, F.sum("n") / BLOCK_NGRAMS)
    kinds = written(rows.groupBy("cluster", "kind").agg(fill.alias("fill")), "kind-sizes")
    shape = kinds.where("fill < 0.5").groupBy("cluster").agg(F.ceil(1.25 * F.sum("fill")).cast("long").alias("buckets"))
    shared = F.when(F.col("fill") < 0.5, F.pmod(F.xxhash64("kind"), F.col("buckets"))).otherwise(F.xxhash64("kind"))
    kinds = kinds.join(small(written(shape, "bucket-counts")), "cluster", "left").select("cluster", "kind", shared.alias("bucket"))
    rows = written(rows.join(small(written(kinds, "kind-buckets")), ["cluster", "kind"]).select("id", "cluster", "n", "bucket"), "buckets")
    parts = rows.groupBy("cluster", "bucket").agg(F.ceil(fill).cast("long").alias("parts"))
    rows = rows.join(small(written(parts, "bucket-parts")), ["cluster", "bucket"])
    return written(rows.select("id", "cluster", F.xxhash64(F.lit(name), "bucket", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block")), "blocks")


def _beyond(stands: DataFrame, percent: int) -> DataFrame:
    """Places of the products that find the links between documents of different components (`to`), one of which is not `inside`.

    stands: rows (id, cluster, block, to, inside, n, gram, small) of documents and the n-grams they show, small if also as the smaller one of a pair. A
    document takes part in a product with a block only if one of its n-grams is shown there by a document of another component within the size bounds.
    """
    least = F.min(F.when(F.col("small"), F.col("n"))).alias("small_low")
    shown = stands.groupBy("cluster", "gram", F.col("block").alias("other"), F.col("inside").alias("other_inside")).agg(F.min("n").alias("low"), F.max("n").alias("high"), least, F.min("to").alias("to_low"), F.max("to").alias("to_high"))
    met = stands.join(written(shown, "shown"), ["cluster", "gram"])
    met = met.where((F.col("to") != F.col("to_low")) | (F.col("to") != F.col("to_high")))
    met = met.where((percent * F.col("n") <= 100 * F.col("high")) & (percent * F.col("low") <= 100 * F.col("n")))
    met = met.where((F.col("small") & (F.col("high") >= F.col("n"))) | (F.col("small_low") <= F.col("n")))
    left = met.where("NOT inside AND (other_inside OR block <= other)").select("id", "cluster", F.col("block").alias("i"), F.col("other").alias("j"), F.lit(True).alias("left"))
    right = met.where("NOT other_inside AND (inside OR other < block)").select("id", "cluster", F.col("other").alias("i"), F.col("block").alias("j"), F.lit(False).alias("left"))
    places = written(left.union(right).distinct(), "met")
    both = places.groupBy("cluster", "i", "j").agg(F.count_distinct("left").alias("sides")).where("sides = 2 OR i = j").drop("sides")
    return places.join(small(written(both, "block-pairs")), ["cluster", "i", "j"]).select("id", "cluster", "i", "j", "left")


def _links(docs: DataFrame, members: DataFrame, prefixes: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (a, b) that connect what the links inside the clusters connect. members: (id, cluster, n, blocks)."""
    whole = members.where("blocks = 1").select("id", "cluster", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(True).alias("left"))
    large = written(members.where("blocks > 1").select("id", "cluster", "n"), "large-clusters")
    if large.isEmpty():
        return _products(docs, written(whole, "places"), width, percent)
    grams = written(prefixes.join(small(large.select("id")), "id", "left_semi").select("id", "n", "gram", (F.col("at") % 2 == 1).alias("small")), "large-prefixes")
    blocks = _blocks(large, grams, "first", BLOCK_DOCS)
    # the diagonal, each block with some documents of its whole cluster
    order = Window.partitionBy("cluster").orderBy(F.xxhash64("id"), "id")
    hubs = written(blocks.withColumn("n", F.row_number().over(order)).where(F.col("n") <= HUBS).select("cluster", "id"), "hubs")
    beside = blocks.select("cluster", "block").distinct().join(small(hubs), "cluster")
    diagonal = blocks.select("id", "cluster", "block").union(beside.select("id", "cluster", "block")).distinct()
    diagonal = diagonal.select("id", "cluster", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(True).alias("left"))
    links = written(_products(docs, written(whole.union(diagonal), "places"), width, percent), "first-links")
    # what the largest component of a cluster leaves outside forms blocks of its own, those of a component together: these
    # go against each other and against those of the largest one, wherever a document and a block show the same n-gram
    found = components(links)
    grouped = written(blocks.join(small(found.withColumnRenamed("component", "to")), "id", "left").select("id", "cluster", F.coalesce("to", "id").alias("to")), "grouped")
    counts = written(grouped.groupBy("cluster", "to").agg(F.count("*").alias("size")), "component-sizes")
    largest = counts.groupBy("cluster").agg(F.max_by("to", F.struct("size", "to")).alias("largest"))
    held = counts.join(small(written(largest, "largest")), "cluster").select("cluster", "to", (F.col("to") == F.col("largest")).alias("inside"), F.when(F.col("size") * 2 >= BLOCK_DOCS, F.col("to")).alias("held"))
    grouped = grouped.join(small(written(held, "held")), ["cluster", "to"]).join(small(large.select("id", "n")), "id")
    grouped = written(grouped.select("id", "cluster", "n", "to", "inside", "held"), "inside")
    if grouped.where("NOT inside").isEmpty():
        return links
    rows = grouped.select("id", "cluster", "n", "held", "inside")
    blocks = _blocks(rows.where("inside"), grams, "inside", WIDER * BLOCK_DOCS).union(_blocks(rows.where("NOT inside"), grams, "rest", WIDER * BLOCK_DOCS))
    stands = written(grouped.join(small(blocks.select("id", "block")), "id").select("id", "cluster", "block", "to", "inside"), "stands")
    stands = written(grams.join(small(stands), "id").select("id", "cluster", "block", "to", "inside", "n", "gram", "small"), "stands-by-gram")
    return links.union(_products(docs, written(_beyond(stands, percent), "places"), width, percent))


def join_ngrams(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """Rows (id, n_ngrams, component), one per input row; ids are unique, but for repeated equal rows, which come back as often as they came.

    n_ngrams is the size of the document's set of distinct word n-grams (A-Z lower-cased; with fewer words than `width`, the whole
    sequence is one). Documents link when percent of the union is shared; component is the smallest id reachable by links. Texts
    that are null or without words have 0 n-grams and only themselves. Rows with a null id have their number of n-grams, no links and
    a null component. N-grams are compared by 64-bit hashes, and so are ids that are not integers. An empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        return _by_hashed_id(docs, id_col, text_col, width, percent)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(MAX_BITS, max(MIN_BITS, (n_bytes // 6 // 64).bit_length()))
    profile = written(_profile(rows, width, bits), "profile")
    named = rows.where(F.col("id").isNotNull())
    frequencies = spark.sparkContext.broadcast(_frequencies(profile, bits))
    every = profile.where(F.col("chunk").isNull()).select("id", "n", "hi", "lo")
    sizes = every.where(F.col("id").isNotNull())
    # only sets that occur twice or more are joined back, so a set that a third of the rows hold is no hot key
    first = sizes.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("id").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    classes = sizes.where("n > 0").join(small(written(first, "repeated")), ["hi", "lo", "n"], "left").select("id", "n", F.coalesce("first", "id").alias("first"))
    classes = written(classes, "classes")
    distinct = named.join(small(written(classes.where("id <> first").select("id"), "copies")), "id", "left_anti")
    prefixes = written(_prefixes(distinct, width, percent, frequencies, bits), "prefixes")
    edges = written(_cluster_edges(prefixes, percent), "cluster-edges")
    clusters = components(edges)
    members = clusters.join(classes.select("id", "n").dropDuplicates(["id"]), "id").select("id", F.col("component").alias("cluster"), "n")
    members = written(members, "clusters")
    shape = members.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_NGRAMS)).cast("long").alias("blocks"))
    members = written(members.join(small(written(shape, "shapes")), "cluster"), "members")
    links = written(_links(named, members, prefixes, width, percent), "links")
    found = written(components(links), "components")
    joined = classes.join(small(found.select(F.col("id").alias("first"), "component")), "first", "left")
    linked_rows = joined.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_ngrams"), F.coalesce("component", "first").alias("component"))
    alone = every.where("n = 0 OR id IS NULL").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_ngrams"), F.col("id").alias("component"))
    return linked_rows.unionByName(alone)


def _by_hashed_id(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """join_ngrams() over the hashes of ids of any type; components are named by their least id again."""
    key = F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)).alias("key")
    rows = docs.select(F.col(id_col).alias("name"), key, F.col(text_col).alias("text"))
    found = written(join_ngrams(rows.select("key", "text"), id_col="key", width=width, percent=percent), "hashed")
    names = written(rows.where("key IS NOT NULL").select("key", "name").distinct(), "names")
    least = found.join(names, "key").groupBy("component").agg(F.min("name").alias("least"))
    named = found.join(names, "key", "left").join(small(written(least, "least-names")), "component", "left")
    return named.select(F.col("name").alias(id_col), "n_ngrams", F.col("least").alias("component"))


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Rows (id, component), written: the documents whose component has a smaller id than theirs."""
    found = join_ngrams(docs, id_col=id_col, text_col=text_col, width=width, percent=percent)
    return written(found.where(F.col("component") != F.col(id_col)).select(F.col(id_col).alias("id"), "component"), "near-copies")


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the smallest id of their component, with all their columns; rows with a null id are kept.

    Null, empty and wordless texts link with nothing and stay. Of rows with the same id and text one stays, whichever.
    """
    copies = near_copies(docs, id_col=id_col, text_col=text_col, width=width, percent=percent).select(F.col("id").alias(id_col))
    left = docs.join(small(copies), id_col, "left_anti")
    again = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias(unused(docs, "n_rows"))).where(F.col(unused(docs, "n_rows")) > 1)
    again = written(again.select(id_col), "repeated-ids")
    if again.isEmpty():
        return left.select(docs.columns)
    once = left.join(small(again), id_col, "left_anti").select(docs.columns)
    return once.unionByName(left.join(small(again), id_col, "left_semi").dropDuplicates([id_col, text_col]).select(docs.columns))
