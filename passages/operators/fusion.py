"""Fusion, reranking, context packing, prompts and citations, for all queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passages.operators.lexical import analyse

DEFAULT_PROMPT = "You are a helpful assistant."


def rrf_fuse(ranked: DataFrame, limit: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rows (query_id, chunk_id, rank, retriever, retriever_order); ties by chunk_id."""
    fused = ranked.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 10).alias("score"),
        F.transform(F.sort_array(F.collect_set(F.struct("retriever_order", "retriever"))), lambda x: x["retriever"]).alias("matched_by"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def term_overlap(query: Column, text: Column) -> Column:
    """Default score of a pair: share of the query's distinct words that the text has."""
    words = F.array_distinct(analyse(query))
    return F.round(F.size(F.array_intersect(words, analyse(text))) / F.greatest(F.size(words), F.lit(1)), 6)


def pair_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]):
    """A column function (query, text) -> score around a model that scores pairs; load() runs once a task, batches stream through."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for query, text in batches:
            yield pd.Series(model(query.fillna("").tolist(), text.fillna("").tolist()), dtype="float64")

    return scores


def rerank_head(hits: DataFrame, score: Column | None, candidates: int = 15, top_k: int | None = None, model: bool = False) -> DataFrame:
    """Rescores the first `candidates` of each query; the rest follow unscored in fused order. Fewer than two hits, or no scorer: unchanged.

    model: the score is one of pair_scorer(), to which only the rows that are rescored are sent.
    """
    rows = hits
    if score is not None:
        several = F.count("*").over(Window.partitionBy("query_id")) >= 2
        head = (F.col("rank") <= candidates) & several
        if model:  # Python functions run on every row they are given
            rows = rows.withColumn("_head", head)
            rows = rows.where("_head").withColumn("new", score.cast("double")).unionByName(rows.where("NOT _head").withColumn("new", F.lit(None).cast("double"))).drop("_head")
        else:
            rows = rows.withColumn("new", F.when(head, score))
        order = Window.partitionBy("query_id").orderBy(F.col("new").isNull(), F.desc("new"), F.when(F.col("new").isNotNull(), F.col("chunk_id")), "rank")
        rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("score", F.coalesce("new", "score")).drop("new")
    return rows.where(F.col("rank") <= top_k) if top_k else rows


def pack_context(hits: DataFrame, token_budget: int) -> DataFrame:
    """Adds marker and snippet to hits (query_id, rank, source_name, location, text), and keeps the prefix that fits the budget."""
    marker = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    rows = hits.withColumn("marker", marker)
    rows = rows.withColumn("snippet", F.concat(F.lit("["), F.col("marker").cast("string"), F.lit("] source: "), F.col("source_name"), F.lit(" ("), F.col("location"), F.lit(")\n"), F.col("text")))
    rows = rows.withColumn("tokens", F.size(F.regexp_extract_all("snippet", F.lit(r"[^\x20\x09-\x0D]+"), 0)))
    so_far = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank"))
    return rows.withColumn("tokens_so_far", so_far).where(F.col("tokens_so_far") <= token_budget)


def assemble_prompts(queries: DataFrame, packed: DataFrame, system_prompt: str = DEFAULT_PROMPT) -> DataFrame:
    """Rows (query_id, prompt); a query without context gets the bare prompt. A column system_prompt of queries is its bot's; without one, or where it is null, the default serves."""
    context = packed.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("marker", "snippet"))), lambda x: x["snippet"]), "\n\n").alias("context"))
    own = F.coalesce("system_prompt", F.lit(system_prompt)) if "system_prompt" in queries.columns else F.lit(system_prompt)
    rows = queries.select("query_id", own.alias("own")).join(context, "query_id", "left")
    full = F.concat(F.col("own"), F.lit("\n\nAnswer only from the context. Cite passages as [n].\n\n----- CONTEXT -----\n"), F.col("context"))
    return rows.select("query_id", F.coalesce(full, F.col("own")).alias("prompt"))


def resolve_citations(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Rows (query_id, marker, chunk_id, cited, position): which context chunks an answer cites, by first appearance of their marker."""
    found = answers.select("query_id", F.posexplode(F.regexp_extract_all("answer", F.lit(r"\[(\d{1,2})\]"), 1)).alias("pos", "m"))
    first = found.groupBy("query_id", F.col("m").cast("int").alias("marker")).agg(F.min("pos").alias("pos"))
    rows = context.select("query_id", "marker", "chunk_id").join(first, ["query_id", "marker"], "left")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("pos")))
    cited = F.col("pos").isNotNull()
    return rows.select("query_id", "marker", "chunk_id", cited.alias("cited"), F.when(cited, place).alias("position"))


def location() -> Column:
    """Where a chunk stands: its pages, else its page, else its section path, else its number."""
    pages = F.when(F.col("page_end").isNotNull() & (F.col("page_end") != F.col("page")), F.concat(F.lit("pages "), F.col("page").cast("string"), F.lit("-"), F.col("page_end").cast("string")))
    page = F.concat(F.lit("page "), F.col("page").cast("string"))
    section = F.when(F.size("section") > 0, F.array_join("section", " > "))
    return F.coalesce(pages, page, section, F.concat(F.lit("chunk "), F.col("ordinal").cast("string")))


def attach_chunks(hits: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds text and ordinal of the chunk (chunk_id, source_id, ordinal, text, page, page_end, section), name of its source and location."""
    rows = hits.join(chunks.select("chunk_id", "source_id", "ordinal", "text", "page", "page_end", "section"), "chunk_id").join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id")
    return rows.withColumn("location", location())


def retrieval_sources(hits: DataFrame) -> DataFrame:
    """What retrieval considered: rounded score, retrievers and location of each hit."""
    return hits.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"), F.array_join("matched_by", ",").alias("matched_by"), "location")
