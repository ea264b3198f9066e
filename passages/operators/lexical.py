"""Lexical retrieval: analysis, postings with positions, occurrence score, cover density and Okapi BM25. Matching is an equi-join on terms."""

from __future__ import annotations

import glob
import os
import re
import zipfile

import pyspark
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passages.operators.sizes import few

#: The languages that have a list of stop words, by the names that Spark ML gives its lists.
LISTS = {"en": "english", "de": "german", "fr": "french", "es": "spanish", "it": "italian", "pt": "portuguese", "nl": "dutch", "ru": "russian"}


def _listed(names: dict[str, str]) -> dict[str, list[str]]:
    """Spark ML's own lists of stop words, read from its library, so that SQL can be written before a session is there; words that analyse() would cut are left out."""
    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    jars = glob.glob(os.path.join(home, "jars", "spark-mllib_*.jar")) + glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    if jars:
        with zipfile.ZipFile(jars[0]) as jar:
            found = {lang: jar.read(f"org/apache/spark/ml/feature/stopwords/{name}.txt").decode().split() for lang, name in names.items()}
    else:  # Spark isn't installed beside Python: ask the session
        found = {lang: StopWordsRemover.loadDefaultStopWords(name) for lang, name in names.items()}
    return {lang: sorted({w.lower() for w in words if re.fullmatch(r"\w+", w)}) for lang, words in found.items()}


STOPWORDS = _listed(LISTS)


def analyse(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda x: x != "")


def drop_stopwords(words: DataFrame, langs: list[str]) -> DataFrame:
    """Drops a word (column term) that any of the languages in scope calls a stop word; languages without a list call none."""
    stop = sorted({w for lang in langs for w in STOPWORDS.get(lang, ())})
    return words.where(~F.col("term").isin(stop)) if stop else words


def analysed(chunks: DataFrame) -> DataFrame:
    """Adds words: those of the text without the stop words of its own language."""
    rows = chunks.select("chunk_id", "lang", analyse(F.col("text")).alias("words"))
    without = lambda listed: F.filter("words", lambda w: ~w.isin(listed))
    left = F.col("words")
    for lang, listed in STOPWORDS.items():  # a chunk's language is looked at once, not for each word
        left = F.when(F.col("lang") == lang, without(listed)).otherwise(left)
    return rows.select("chunk_id", left.alias("words"))


def build_lexical_index(chunks: DataFrame) -> DataFrame:
    """Postings (term, chunk_id, tf, doc_len) of chunks (chunk_id, text, lang), each analysed in its own language.

    Terms are counted within the task, so the only data that leaves it is one posting a distinct term of a chunk.
    """
    rows = analysed(chunks).select("chunk_id", F.size("words").cast("long").alias("doc_len"), F.explode("words").alias("term"))
    return rows.groupBy("term", "chunk_id", "doc_len").agg(F.count("*").alias("tf"))


def positional_postings(chunks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Postings (term, chunk_id, doc_len, tf, positions) of chunks (chunk_id, text, lang): positions count all words of a chunk from 1, stop words included.

    terms: only the words of its column term, which are dropped within the task if they are few. An occurrence leaves its task as one number.
    """
    words = chunks.select("chunk_id", "lang", F.posexplode(analyse(F.col("text"))).alias("at", "term"))
    lengths = analysed(chunks).select("chunk_id", F.size("words").cast("long").alias("doc_len"))
    stop = F.lit(False)
    for lang, listed in STOPWORDS.items():
        stop = F.when(F.col("lang") == lang, F.col("term").isin(listed)).otherwise(stop)
    words = words.where(~stop)
    if terms is not None:
        words = words.join(few(terms.select("term").distinct()), "term", "left_semi")
    found = words.groupBy("term", "chunk_id").agg(F.sort_array(F.collect_list((F.col("at") + 1).cast("int"))).alias("positions"))
    return found.join(lengths, "chunk_id").select("term", "chunk_id", "doc_len", F.size("positions").cast("long").alias("tf"), "positions")


def cover_density(occurrences: Column, n_terms: Column) -> Column:
    """The cover density of one chunk: occurrences is an array of (at, term), term from 0 to n_terms - 1, sorted by place.

    Every shortest stretch that holds all the terms counts 0.1, divided by one more than the number of other words in it: stretches of the
    terms alone count in full, and terms that stand apart count little. One sweep: a stretch is shortest where its start, the
    earliest of the terms' last places, has just moved.
    """
    start = F.struct(
        F.array_repeat(F.lit(0), n_terms).alias("last"), F.array_repeat(F.lit(-1), n_terms).alias("order"), F.lit(-1).alias("i"), F.lit(0).alias("start"), F.lit(0.0).alias("score"))

    def step(acc: Column, x: Column) -> Column:
        i = acc["i"] + 1
        put = lambda values, v: F.transform(values, lambda old, k: F.when(k == x["term"], v).otherwise(old))
        last, order = put(acc["last"], x["at"]), put(acc["order"], i)
        begin, noise = F.array_min(last), x["at"] - F.array_min(last) - (i - F.array_min(order))
        found = F.when(begin > acc["start"], 0.1 / (1 + noise)).otherwise(0.0)
        return F.struct(last.alias("last"), order.alias("order"), i.alias("i"), F.greatest(begin, acc["start"]).alias("start"), (acc["score"] + found).alias("score"))

    return F.aggregate(occurrences, start, step, lambda acc: acc["score"])


def languages_in_scope(chunks: DataFrame) -> list[str]:
    """The languages of the chunks that are searched: a few names."""
    return sorted(r["lang"] for r in chunks.select("lang").distinct().collect() if r["lang"] is not None)


def matching_postings(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of build_lexical_index() for the words of terms alone, without an index: words that no query asks for never leave their task.

    Queries' words are few beside a corpus; they are broadcast in a checked number, and shuffled beyond it.
    """
    asked = terms.select("term").distinct()
    rows = analysed(chunks).select("chunk_id", F.size("words").cast("long").alias("doc_len"), F.explode("words").alias("term"))
    return rows.join(few(asked), "term", "left_semi").groupBy("term", "chunk_id", "doc_len").agg(F.count("*").alias("tf"))


def corpus_lengths(chunks: DataFrame) -> DataFrame:
    """One row: how many chunks have a word (n_docs), and their mean number of words (avg_len)."""
    return analysed(chunks).select(F.size("words").alias("len")).where("len > 0").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))


def analyse_queries(queries: DataFrame, langs: list[str]) -> DataFrame:
    """Rows (query_id, term): distinct words of each query without stop words; a query without any has no row."""
    rows = queries.select("query_id", F.explode(F.array_distinct(analyse(F.col("text")))).alias("term"))
    return drop_stopwords(rows, langs)


def top_k(hits: DataFrame, k: int) -> DataFrame:
    """Ranks hits (query_id, chunk_id, score) within their query; ties by chunk_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def in_scope(hits: DataFrame, scope: DataFrame | None) -> DataFrame:
    """The hits (query_id, chunk_id, ...) that a query may see: scope holds its chunks (query_id, chunk_id); no scope, all; a query without a row, none."""
    return hits if scope is None else hits.join(scope.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi")


def lexical_search(terms: DataFrame, postings: DataFrame, k: int, scope: DataFrame | None = None) -> DataFrame:
    """Chunks with any of the words; score is a tenth of the number of occurrences."""
    hits = postings.join(terms, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum("tf") * 0.1, 6).alias("score"))
    return top_k(in_scope(hits, scope), k)


def cover_density_search(terms: DataFrame, postings: DataFrame, k: int, scope: DataFrame | None = None) -> DataFrame:
    """Chunks with any of the words, ranked by cover density over those of the query's words that a chunk holds.

    postings: positional_postings(). Stretches with more of a query's words come first by weight: a chunk's density is
    multiplied by the number of its words. With a single word the score is that of lexical_search(), a tenth of its occurrences.
    """
    rows = in_scope(postings.join(terms, "term").select("query_id", "chunk_id", "term", "positions"), scope)
    groups = rows.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("term", "positions"))).alias("found"))
    places = F.flatten(F.transform("found", lambda x, i: F.transform(x["positions"], lambda at: F.struct(at.cast("int").alias("at"), i.cast("int").alias("term")))))
    n = F.size("found")
    groups = groups.select("query_id", "chunk_id", n.alias("n"), F.array_sort(places).alias("places"))
    score = F.round(F.col("n") * cover_density(F.col("places"), F.col("n")), 6)
    return top_k(groups.select("query_id", "chunk_id", score.alias("score")), k)


def bm25_search(terms: DataFrame, postings: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, docs: DataFrame | None = None) -> DataFrame:
    """The same matches by Okapi BM25. Document frequencies are only counted for the queries' terms.

    docs: corpus_lengths() of the chunks; without it, the lengths are taken from the postings, which must then be those of all words.
    """
    if docs is None:
        docs = postings.groupBy("chunk_id").agg(F.max("doc_len").alias("len")).agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    wanted = postings.join(terms.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    rows = wanted.join(terms, "term").join(df, "term").crossJoin(F.broadcast(docs))  # docs is a single row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len")))
    return top_k(rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score")), k)
