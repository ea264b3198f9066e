"""Chunks: budgeted pieces of documents, all of them slices of the text. A token is a word, sixteen characters of a longer one, or a character of a script without blanks. Even pieces are native arithmetic; greedy packing depends on what came before, so it folds over sorted segments in linear time."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.sources.storage import kept

SIZE, OVERLAP = 400, 40


def _checked(size: int, overlap: int) -> None:
    if size <= 0 or overlap >= size:
        raise ValueError("the size must be positive and larger than the overlap")


#: Scripts that are written without blanks between words: kana, Han, Hangul.
_UNSPACED = "\u1100-\u11ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0002fa1f"

#: What counts as a token of a budget, in a pattern that Spark, Python and SQL read alike; another tokenizer's unit may be put in its place.
TOKEN = f"[{_UNSPACED}]|[^\\x20\\x09-\\x0D{_UNSPACED}]{{1,16}}"

#: A token with the white space before it: joined, these are the text up to its last token.
SPACED_TOKEN = f"[\\x20\\x09-\\x0D]*(?:{TOKEN})"

BLANK = " \t\n\x0b\x0c\r"


def spaced_tokens(text: Column) -> Column:
    """The tokens of a text, each with the white space before it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPACED_TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN))


def chunk_fixed(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks (doc, ordinal, text, tokens) of documents (doc, text), cut at token positions into even pieces; lines and indentation stay as they are."""
    _checked(size, overlap)
    rows = docs.select("doc", spaced_tokens(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    rows = rows.where("n > 0").withColumn("pieces", F.ceil(F.col("n") / (size - overlap)))
    rows = rows.withColumn("stride", F.ceil(F.col("n") / F.col("pieces")).cast("int")).withColumn("width", F.least(F.lit(size), F.col("stride") + overlap))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - F.col("width")) / F.col("stride"))).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("w", k * F.col("stride") + 1, F.col("width")))
    rows = rows.select("doc", F.posexplode(pieces).alias("ordinal", "p"))
    return rows.select("doc", "ordinal", F.btrim(F.array_join("p", ""), F.lit(BLANK)).alias("text"), F.size("p").alias("tokens"))


SEPARATORS = ("\n\n", "\n", ". ", " ")


def n_tokens(text: str) -> int:
    """Tokens of a text, as token_count() counts them."""
    return len(_TOKEN.findall(text))


_TOKEN = re.compile(TOKEN)


def even_slices(text: str, size: int, overlap: int) -> list[str]:
    """The text in as few pieces as chunk_fixed() makes of it, all about equally long."""
    at = [m.span() for m in _TOKEN.finditer(text)]
    pieces = max(1, math.ceil(len(at) / max(1, size - overlap)))
    stride = max(1, math.ceil(len(at) / pieces))
    width = min(size, stride + overlap)
    starts = [0, *(k for k in range(stride, len(at), stride) if k - stride + width < len(at))]
    return [text[at[k][0] : at[min(k + width, len(at)) - 1][1]] for k in starts]


def _units(text: str, budget: int, level: int = 0) -> Iterator[int]:
    """The tokens of each unit of the text in order, of at most the budget, cut as coarsely as fits: behind paragraphs, else lines, sentences, words, and last between tokens."""
    n = n_tokens(text)
    if n <= budget:
        yield n
        return
    if level == len(SEPARATORS):
        yield from (min(budget, n - k) for k in range(0, n, budget))
        return
    if SEPARATORS[level] not in text:
        yield from _units(text, budget, level + 1)
        return
    at = 0
    while at < len(text):
        end = text.find(SEPARATORS[level], at)
        end = len(text) if end < 0 else end + len(SEPARATORS[level])
        yield from _units(text[at:end], budget, level + 1)
        at = end


def split_text(text: str, budget: int, overlap: int) -> list[str]:
    """Pieces of a text within the budget, in tokens; each is a slice of the text.

    Units fill a piece up to the budget. The next piece starts with the last tokens of the one before it: as many as the overlap
    says, or as its first unit leaves room for. A last piece of less than a quarter of the budget is sliced evenly together with the one before.
    """
    spans: list[tuple[int, int]] = []  # of tokens
    start = end = 0
    for n in _units(text, budget):
        if end > start and end - start + n > budget:
            spans.append((start, end))
            start = max(start, end - max(0, min(overlap, budget - n)))
        end += n
    if end > start and (not spans or end > spans[-1][1]):
        spans.append((start, end))
    at = [m.span() for m in _TOKEN.finditer(text)]
    pieces = [text[at[a][0] : at[b - 1][1]] for a, b in spans]
    if len(spans) > 1 and spans[-1][1] - spans[-1][0] < budget // 4:
        pieces[-2:] = even_slices(text[at[spans[-2][0]][0] :], budget, overlap)
    return pieces


BETWEEN = " > "


def breadcrumb(title: str | None, section: list[str] | None) -> str:
    return BETWEEN.join(x for x in (title, *(section or ())) if x)


def body_budget(size: int, crumb: str) -> int:
    """What a chunk's size leaves for its body beside the breadcrumb: at least half."""
    return max(size - (n_tokens(crumb) + 1 if crumb else 0), size // 2)


def _streamed(segments: DataFrame, each: Callable, types: str) -> DataFrame:
    """Rows (doc, ...) that each() yields for the segments of a document in order, one document after the other.

    A document's segments meet in one task, sorted with spilling, and stream by: each() holds no more than what it packs.
    """
    wanted = {"title": F.lit(None).cast("string"), "page": F.lit(None).cast("int"), "section": F.array().cast("array<string>")}
    extra = [F.col(c) if c in segments.columns else made.alias(c) for c, made in wanted.items()]
    rows = segments.select("doc", "seg_no", "text", *extra).repartition("doc").sortWithinPartitions("doc", "seg_no")

    def run(batches):
        import pyarrow as pa

        def segments_of():
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

        out: list[tuple] = []
        for doc, group in groupby(segments_of(), key=lambda x: x[0]):
            for row in each(group):
                out.append((doc, *row))
                if len(out) == 1000:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)
                    out = []
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = StructType([rows.schema["doc"], *StructType.fromDDL(types).fields])
    schema = to_arrow_schema(fields)
    return rows.mapInArrow(run, fields)


def _emit(body: str, title: str | None, section: list[str], size: int, overlap: int) -> list[tuple[str, int]]:
    """(text, tokens) of the chunks that a packed body makes: one, or several where it is over the size with its breadcrumb."""
    crumb = breadcrumb(title, section)
    whole = lambda x: f"{crumb}\n{x}" if crumb else x
    body = body.strip(BLANK)
    if not body:
        return []
    if n_tokens(whole(body)) <= size:
        return [(whole(body), n_tokens(whole(body)))]
    return [(whole(x), n_tokens(whole(x))) for x in split_text(body, body_budget(size, crumb), overlap)]


def split_oversized(segments: DataFrame, budget: int, overlap: int = 0) -> DataFrame:
    """Pieces (doc, seg_no, piece_no, section, text, tokens) of segments (doc, seg_no, section, text), each within the budget; see split_text()."""
    _checked(budget, overlap)

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, budget, overlap))

    fits = token_count(F.col("text")) <= budget
    rows = segments.where(F.col("text").isNotNull())
    small, large = rows.where(fits), rows.where(~fits)
    one = small.select("doc", "seg_no", F.lit(0).alias("piece_no"), "section", F.btrim("text", F.lit(BLANK)).alias("text")).where("text <> ''")
    many = large.select("doc", "seg_no", F.posexplode(pieces("text")).alias("piece_no", "text"), "section").select("doc", "seg_no", "piece_no", "section", "text")
    return one.unionByName(many).withColumn("tokens", token_count(F.col("text")))


def chunk_per_unit(segments: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks (doc, ordinal, section, page, page_end, text, tokens), one for each segment (doc, seg_no, text, and maybe section, page, title); oversize ones are split."""
    _checked(size, overlap)

    def each(group):
        ordinal = 0
        for _, _, text, title, page, section in group:
            for body, tokens in _emit(text or "", title, section or [], size, overlap):
                yield ordinal, section or [], page, None, body, tokens
                ordinal += 1

    return _streamed(segments, each, CHUNK)


CHUNK = "ordinal int, section array<string>, page int, page_end int, text string, tokens int"


def _shared(a: list[str], b: list[str]) -> list[str]:
    n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:n]


def chunk_semantic(segments: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Packs neighbouring segments (doc, seg_no, text, and maybe section, page, title) of a document greedily into chunks.

    Segments that are too large are split first. A pack closes when the next one would not fit beside the breadcrumb of its
    first segment, or when it would shorten the heading path that all of the pack share while the pack already holds half of the size.
    Chunks (doc, ordinal, section, page, page_end, text, tokens): section is the shared path, text starts with the
    breadcrumb of title and section, page_end is null unless it is another page. What is over the size after all is split again.
    """
    _checked(size, overlap)

    def each(group):
        pack: list[tuple[str, int | None]] = []
        path: list[str] = []
        first: list[str] = []
        title, used, ordinal = None, 0, 0

        def close():
            nonlocal pack, used, ordinal
            pages = [p for _, p in pack if p is not None]
            page, end = (pages[0], pages[-1]) if pages else (None, None)
            for body, tokens in _emit("\n\n".join(t for t, _ in pack), title, path, size, overlap) if pack else ():
                yield ordinal, path, page, end if end != page else None, body, tokens
                ordinal += 1
            pack, used = [], 0

        for _, _, text, title, page, section in group:
            section = section or []
            budget = body_budget(size, breadcrumb(title, section))
            text = text or ""
            for piece in [text.strip(BLANK)] if n_tokens(text) <= budget else split_text(text, budget, overlap):
                n = n_tokens(piece)
                if not n:
                    continue
                common = _shared(path, section)
                full = used + n + 2 > body_budget(size, breadcrumb(title, first))
                if pack and (full or path and common != path and used >= size // 2):
                    yield from close()
                if pack:
                    path, used = common, used + n + 2
                else:
                    path = first = section
                    used = n
                pack.append((piece, page))
        yield from close()

    return _streamed(segments, each, CHUNK)


def chunk_report(chunks: DataFrame, by: str | None = None) -> DataFrame:
    """Number of chunks, their mean, least and most tokens, and the share of those with a heading path, by a column or over all."""
    rows = chunks.groupBy(by) if by else chunks.groupBy()
    pathed = F.count_if(F.size("section") > 0) / F.count("*") if "section" in chunks.columns else F.lit(0.0)
    return rows.agg(F.count("*").alias("chunks"), F.round(F.avg("tokens"), 4).alias("avg_tokens"), F.min("tokens").cast("long").alias("min_tokens"), F.max("tokens").cast("long").alias("max_tokens"), F.round(pathed, 4).alias("with_path"))


VERSION, STRATEGIES = 1, ("semantic", "per_unit", "fixed")


def ingest_corpus(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, strategy: str = "semantic", loaders: dict | None = None) -> dict[str, DataFrame]:
    """Documents (doc, name, text, and maybe title) on their way into the index: the tables chunks, postings, vectors and sources.

    Texts are cleaned, cut into segments by the loader of their extension, tagged with their language and chunked; chunks get
    postings and hashed vectors. sources has a row a document: status ready or failed with its error, language, chunks, tokens, pages, and the
    settings it was chunked by. A document that fails is a row, and aborts nothing.
    """
    from passages.functions.text import clean, tag_language
    from passages.operators.dense import hashed_embeddings
    from passages.operators.lexical import build_lexical_index
    from passages.operators.segments import load_segments
    from passages.sources.corpus import route

    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    rows = tag_language(route(docs.withColumn("text", clean(F.col("text")))))
    segments = load_segments(rows.where("reject_reason IS NULL"), loaders)
    if "title" in docs.columns:  # what a document is called counts where its text says nothing
        segments = segments.join(docs.select("doc", F.col("title").alias("_given")), "doc", "left").withColumn("title", F.coalesce("title", "_given")).drop("_given")
    make = {"semantic": chunk_semantic, "per_unit": chunk_per_unit}.get(strategy)
    if make:
        chunks = make(segments, size, overlap)
    else:
        whole = segments.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_no", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
        nothing = [F.array().cast("array<string>").alias("section"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("page_end")]
        chunks = chunk_fixed(whole, size, overlap).select("doc", "ordinal", *nothing, "text", "tokens")
    # written once: four tables follow from it
    chunks = kept(chunks.join(rows.select("doc", "lang"), "doc").withColumn("chunk_id", F.concat_ws("#", "doc", "ordinal")), "chunks")
    stats = chunks.groupBy("doc").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), F.count_distinct("page").alias("pages"))
    error = F.coalesce("reject_reason", F.when(F.col("chunks").isNull(), "no text"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    stamp = [F.lit(VERSION).alias("chunker_version"), F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"), F.lit(strategy).alias("chunk_strategy")]
    sources = rows.join(stats, "doc", "left").select("doc", F.when(error.isNull(), "ready").otherwise("failed").alias("status"), error.alias("error"), "lang", zero("chunks"), zero("tokens"), zero("pages"), *stamp)
    return {"chunks": chunks, "postings": build_lexical_index(chunks), "vectors": hashed_embeddings(chunks), "sources": sources}
