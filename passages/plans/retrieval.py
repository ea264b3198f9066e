"""Queries over retrieval: documents are the chunks, benchmark passages the questions.

Hybrid queries embed chunks and questions by hashed terms; dense queries alone take the stored embeddings, searched for by every vector whose id is divisible by 50.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.adapters import view, with_views
from passages.operators import dense, fusion, lexical, vector_index
from passages.sources.storage import shared_dir

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

LANGS = ["de", "en", "es", "fr"]  # those of the documents, for the SQL


def query(sql: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_views(sql, *views)
        return f

    return register


def chunks(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("source_id"), F.lit(0).alias("ordinal"), "text", "lang", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 40).alias("page"),
        F.when(F.col("doc_id") % 6 == 0, F.col("doc_id") % 40 + F.col("doc_id") % 4).alias("page_end"), F.when(F.col("doc_id") % 3 == 1, F.array(F.lit("Part"), F.col("lang"))).alias("section"))


def terms(spark, sf_dir) -> DataFrame:
    return lexical.analyse_queries(questions(spark, sf_dir), lexical.languages_in_scope(chunks(spark, sf_dir)))


def questions(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def query_vectors(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.expr("concat('m', vec_id % 2)").alias("model"), "embedding")


_STOP = " ".join(f"WHEN '{lang}' THEN [{', '.join(repr(w) for w in ws)}]" for lang, ws in lexical.STOPWORDS.items())
_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda x: x <> '')"
SQL_POSTINGS = f"""SELECT term, chunk_id, doc_len, count(*) AS tf FROM (SELECT chunk_id, len(ws) AS doc_len, unnest(ws) AS term FROM (
  SELECT doc_id AS chunk_id, list_filter({_WORDS}, lambda w: NOT list_contains(coalesce(CASE lang {_STOP} END, []), w)) AS ws FROM documents)) GROUP BY ALL"""
_STOP_SCOPE = ", ".join(repr(w) for w in sorted({w for lang in LANGS for w in lexical.STOPWORDS[lang]}))
SQL_TERMS = f"SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({_WORDS}) AS term FROM benchmark) WHERE term NOT IN ({_STOP_SCOPE})"


def _ranked(hits: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ({hits})) WHERE rank <= {k}"


SQL_LEXICAL = _ranked(f"SELECT query_id, chunk_id, round(sum(tf) * 0.1::DOUBLE, 6) AS score FROM ({SQL_POSTINGS}) JOIN ({SQL_TERMS}) USING (term) GROUP BY ALL", 20)
SQL_DENSE = _ranked("""SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN embeddings v ON q.vec_id % 2 = v.vec_id % 2 WHERE q.vec_id % 50 = 0""", 20)
def _sql_hashed(key: str, table: str) -> str:
    return f"""SELECT id, place, count(*)::DOUBLE AS n FROM (SELECT id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS place FROM (SELECT {key} AS id, unnest({_WORDS}) AS term FROM {table})) GROUP BY ALL"""


SQL_HYBRID_DENSE = _ranked(f"""WITH d AS ({_sql_hashed('doc_id', 'documents')}), q AS ({_sql_hashed('item_id', 'benchmark')}),
  dn AS (SELECT id, sqrt(sum(n * n)) AS l FROM d GROUP BY 1), qn AS (SELECT id, sqrt(sum(n * n)) AS l FROM q GROUP BY 1)
  SELECT query_id, chunk_id, round(dot / (dn.l * qn.l), 6) AS score FROM (SELECT q.id AS query_id, d.id AS chunk_id, sum(q.n * d.n) AS dot FROM q JOIN d USING (place) GROUP BY 1, 2) JOIN dn ON dn.id = chunk_id JOIN qn ON qn.id = query_id""", 20)
SQL_FUSED = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS score, string_agg(DISTINCT retriever, ',' ORDER BY retriever) AS matched_by FROM (
    SELECT query_id, chunk_id, rank, 'bm25' AS retriever FROM ({SQL_LEXICAL}) UNION ALL SELECT query_id, chunk_id, rank, 'dense' FROM ({SQL_HYBRID_DENSE})) GROUP BY 1, 2)) WHERE rank <= 30"""


@query(SQL_POSTINGS)
def build_lexical_index(spark, sf_dir):
    return lexical.build_lexical_index(chunks(spark, sf_dir))


@query(SQL_TERMS)
def analyse_queries(spark, sf_dir):
    return terms(spark, sf_dir)


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({_WORDS}) AS term FROM documents) WHERE term NOT IN ({_STOP_SCOPE}) GROUP BY 1")
def drop_stopwords(spark, sf_dir):
    words = view(spark, sf_dir, "documents").select(F.explode(lexical.analyse(F.col("text"))).alias("term"))
    return lexical.drop_stopwords(words, LANGS).groupBy("term").agg(F.count("*").alias("n"))


def _lexical(spark, sf_dir):
    asked = terms(spark, sf_dir)
    return lexical.lexical_search(asked, lexical.matching_postings(chunks(spark, sf_dir), asked), 20)


@query(SQL_LEXICAL)
def lexical_search(spark, sf_dir):
    return _lexical(spark, sf_dir)


_SQL_POSITIONS = f"""SELECT term, chunk_id, place FROM (SELECT doc_id AS chunk_id, lang, unnest(ws) AS term, generate_subscripts(ws, 1) AS place FROM (SELECT doc_id, lang, {_WORDS} AS ws FROM documents)) WHERE NOT list_contains(coalesce(CASE lang {_STOP} END, []), term)"""


@query(f"SELECT term, chunk_id, tf, array_to_string(positions, ',') AS positions FROM (SELECT term, chunk_id, count(*) AS tf, list(place ORDER BY place) AS positions FROM ({_SQL_POSITIONS}) WHERE term IN (SELECT term FROM ({SQL_TERMS})) GROUP BY 1, 2)")
def positional_postings(spark, sf_dir):
    found = lexical.positional_postings(chunks(spark, sf_dir), terms(spark, sf_dir))
    return found.select("term", "chunk_id", "tf", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@query(_ranked(f"""WITH o AS (SELECT query_id, chunk_id, term, place, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY place) AS i FROM ({_SQL_POSITIONS}) JOIN ({SQL_TERMS}) USING (term)),
  m AS (SELECT DISTINCT query_id, chunk_id, term AS u FROM o),
  l AS (SELECT o.query_id, o.chunk_id, o.i, o.place, u, max(CASE WHEN o.term = u THEN o.place END) OVER w AS latest, max(CASE WHEN o.term = u THEN o.i END) OVER w AS last_i FROM o JOIN m USING (query_id, chunk_id) WINDOW w AS (PARTITION BY query_id, chunk_id, u ORDER BY o.i)),
  c AS (SELECT query_id, chunk_id, i, place, count(*) AS n, min(latest) AS p, min(last_i) AS pi FROM l GROUP BY 1, 2, 3, 4 HAVING count(latest) = count(*)),
  d AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY query_id, chunk_id ORDER BY i), 0) AS before FROM c)
  SELECT query_id, chunk_id, round(max(n) * sum(0.1::DOUBLE / (1 + (place - p) - (i - pi))), 6) AS score FROM d WHERE p > before GROUP BY 1, 2""", 20))
def cover_density_search(spark, sf_dir):
    """Lexical search ranked by how close the question's words stand together."""
    asked = terms(spark, sf_dir)
    return lexical.cover_density_search(asked, lexical.positional_postings(chunks(spark, sf_dir), asked), 20)


@query(_ranked(f"""WITH p AS ({SQL_POSTINGS}), t AS ({SQL_TERMS}), n AS (SELECT count(*) AS n_docs, avg(l) AS avg_len FROM (SELECT chunk_id, max(doc_len) AS l FROM p GROUP BY 1) WHERE l > 0),
  d AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
  SELECT query_id, chunk_id, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len))), 6) AS score
  FROM p JOIN t USING (term) JOIN d USING (term), n GROUP BY 1, 2""", 20))
def bm25_search(spark, sf_dir):
    rows, asked = chunks(spark, sf_dir), terms(spark, sf_dir)
    return lexical.bm25_search(asked, lexical.matching_postings(rows, asked), 20, docs=lexical.corpus_lengths(rows))


@query(SQL_DENSE)
def dense_search(spark, sf_dir):
    return dense.dense_search(query_vectors(spark, sf_dir), view(spark, sf_dir, "vectors"), 20)


@query()
def dense_search_ann(spark, sf_dir):
    return dense.dense_search_ann(query_vectors(spark, sf_dir), view(spark, sf_dir, "vectors"), 20)


@query()
def stored_vector_search(spark, sf_dir):
    """Approximate search over a vector index that is written first: cells as folders, codes of 16 bytes, the head scored exactly."""
    path, vectors = f"{shared_dir(spark)}/passages-{uuid.uuid4().hex}/vectors", view(spark, sf_dir, "vectors")
    vector_index.write_vectors(vectors, vector_index.fit_codes(vectors), path)
    return vector_index.search_vectors(query_vectors(spark, sf_dir), path, 20)


@query("""SELECT chunk_id, model, CASE WHEN model = 'm1' THEN 'fixed width' END AS reject_reason, CASE WHEN model = 'm0' THEN 32 END AS width,
  CASE WHEN model = 'm0' THEN round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding[1:32]::DOUBLE[], embedding[1:32]::DOUBLE[])), 6) END AS first FROM vectors""", "vectors")
def truncate_embeddings(spark, sf_dir):
    rows = dense.truncate_embeddings(view(spark, sf_dir, "vectors"), 32, {"m0": True, "m1": False})
    return rows.select("chunk_id", "model", "reject_reason", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("width"), F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


@query(f"""WITH d AS ({_sql_hashed('doc_id', 'documents')})
SELECT id AS chunk_id, string_agg(coalesce(n, 0)::BIGINT::VARCHAR, ',' ORDER BY p.place) AS embedding FROM (SELECT id, unnest(range(64)) AS place FROM (SELECT DISTINCT id FROM d)) p LEFT JOIN d USING (id, place) GROUP BY 1""")
def hashed_embeddings(spark, sf_dir):
    rows = dense.hashed_embeddings(chunks(spark, sf_dir))
    return rows.select("chunk_id", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",").alias("embedding"))


@query(r"""SELECT doc_id AS chunk_id, length(coalesce(text, ''))::BIGINT AS chars, len(regexp_extract_all(coalesce(text, ''), '[aeiou]'))::BIGINT AS vowels FROM documents""")
def embed_corpus(spark, sf_dir):
    """Every chunk through a caller's model, which here counts characters and vowels."""
    rows = dense.embed_corpus(chunks(spark, sf_dir), lambda texts: [[float(len(t)), float(sum(map(t.count, "aeiou")))] for t in texts])
    return rows.select("chunk_id", F.get("embedding", F.lit(0)).cast("long").alias("chars"), F.get("embedding", F.lit(1)).cast("long").alias("vowels"))


def _hashed(spark, sf_dir):
    """Questions and chunks in the space of hashed terms."""
    as_model = lambda df: df.withColumn("model", F.lit("hashed"))
    asked = dense.hashed_embeddings(questions(spark, sf_dir).withColumnRenamed("query_id", "chunk_id")).withColumnRenamed("chunk_id", "query_id")
    return as_model(asked), as_model(dense.hashed_embeddings(chunks(spark, sf_dir)))


def _fused(spark, sf_dir, scope=None):
    tagged = lambda df, name, n: df.select("query_id", "chunk_id", "rank", F.lit(name).alias("retriever"), F.lit(n).alias("retriever_order"))
    rows, asked = chunks(spark, sf_dir), terms(spark, sf_dir)
    questioned, vectors = _hashed(spark, sf_dir)
    if scope is not None:
        vectors = vectors.join(rows.select("chunk_id", "source_id"), "chunk_id")
    found = dense.dense_search(questioned, vectors, 20, scope)
    words = lexical.lexical_search(asked, lexical.matching_postings(rows, asked), 20, scope if scope is None else scope.join(rows.select("chunk_id", "source_id"), "source_id"))
    return fusion.rrf_fuse(tagged(words, "bm25", 0).unionByName(tagged(found, "dense", 1)), 30)


@query(SQL_FUSED)
def rrf_fuse(spark, sf_dir):
    return _fused(spark, sf_dir).withColumn("matched_by", F.array_join("matched_by", ","))


def _attached(spark, sf_dir, scope=None):
    return fusion.attach_chunks(_fused(spark, sf_dir, scope), chunks(spark, sf_dir), view(spark, sf_dir, "sources"))


_SQL_ATTACHED = f"""SELECT f.*, d.text, s.name AS source_name, CASE WHEN f.chunk_id % 6 = 0 AND f.chunk_id % 4 > 0 THEN concat('pages ', f.chunk_id % 40, '-', f.chunk_id % 40 + f.chunk_id % 4) WHEN f.chunk_id % 3 = 0 THEN concat('page ', f.chunk_id % 40)
  WHEN f.chunk_id % 3 = 1 THEN concat_ws(' > ', 'Part', d.lang) ELSE 'chunk 0' END AS location
  FROM ({SQL_FUSED}) f JOIN documents d ON d.doc_id = f.chunk_id JOIN sources s ON s.id = f.chunk_id"""


@query(f"SELECT query_id, rank, chunk_id, source_name, location, md5(text) AS text_md5 FROM ({_SQL_ATTACHED})", "sources")
def attach_chunks(spark, sf_dir):
    return _attached(spark, sf_dir).select("query_id", "rank", "chunk_id", "source_name", "location", F.md5("text").alias("text_md5"))


@query(f"SELECT query_id, rank, chunk_id, round(score, 6) AS score, matched_by, location FROM ({_SQL_ATTACHED})", "sources")
def retrieval_sources(spark, sf_dir):
    return fusion.retrieval_sources(_attached(spark, sf_dir))


def _with_question(spark, sf_dir, rows):
    return rows.join(questions(spark, sf_dir).select("query_id", F.col("text").alias("question")), "query_id")


def _reranked(spark, sf_dir, top_k=None, scope=None):
    rows = _with_question(spark, sf_dir, _attached(spark, sf_dir, scope))
    return fusion.rerank_head(rows, fusion.term_overlap(F.col("question"), F.col("text")), 15, top_k)


_SQL_RERANKED = f"""SELECT query_id, chunk_id, text, source_name, location, coalesce(new, score) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY new IS NULL, new DESC, CASE WHEN new IS NOT NULL THEN chunk_id END, rank) AS rank FROM (
  SELECT a.*, CASE WHEN rank <= 15 AND count(*) OVER (PARTITION BY query_id) >= 2 THEN round(len(list_intersect(list_distinct({_WORDS.replace('text', 'b.text')}), {_WORDS.replace('text', 'a.text')}))::DOUBLE / greatest(len(list_distinct({_WORDS.replace('text', 'b.text')})), 1), 6) END AS new
  FROM ({_SQL_ATTACHED}) a JOIN benchmark b ON b.item_id = a.query_id)"""


@query(f"SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM ({_SQL_RERANKED})", "sources")
def rerank_head(spark, sf_dir):
    return _reranked(spark, sf_dir).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(f"SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM ({_SQL_RERANKED})", "sources")
def rerank_model(spark, sf_dir):
    """rerank_head by a model that scores pairs in Python, here with the words that they share."""

    def load():
        import re

        words = lambda t: [w for w in re.split(r"[^\w]+", t.lower()) if w]

        def score(queries, texts):
            pairs = [(dict.fromkeys(words(q)), set(words(t))) for q, t in zip(queries, texts, strict=True)]
            return [round(sum(w in t for w in q) / max(1, len(q)), 6) for q, t in pairs]

        return score

    rows = fusion.rerank_head(_with_question(spark, sf_dir, _attached(spark, sf_dir)), fusion.pair_scorer(load)(F.col("question"), F.col("text")), 15, model=True)
    return rows.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


_SQL_PACKED = f"""SELECT query_id, marker, chunk_id, snippet, tokens_so_far FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS tokens_so_far FROM (
  SELECT *, len(regexp_extract_all(snippet, '[^\\x20\\x09-\\x0D]+')) AS tokens FROM (SELECT *, concat('[', rank, '] source: ', source_name, ' (', location, ')', chr(10), text) AS snippet, rank AS marker FROM ({_SQL_RERANKED}) WHERE rank <= 5))) WHERE tokens_so_far <= 6000"""


def _packed(spark, sf_dir):
    return fusion.pack_context(_reranked(spark, sf_dir, 5), 6000)


@query(f"SELECT query_id, marker, chunk_id, tokens_so_far::BIGINT AS tokens_so_far FROM ({_SQL_PACKED})", "sources")
def pack_context(spark, sf_dir):
    return _packed(spark, sf_dir).select("query_id", F.col("marker").cast("long").alias("marker"), "chunk_id", "tokens_so_far")


@query(f"""SELECT item_id AS query_id, coalesce(own || chr(10) || chr(10) || 'Answer only from the context. Cite passages as [n].' || chr(10) || chr(10) || '----- CONTEXT -----' || chr(10) || context, own) AS prompt
FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'You are a bot for ' || (item_id % 5) ELSE '{fusion.DEFAULT_PROMPT}' END AS own FROM benchmark) LEFT JOIN (SELECT query_id AS item_id, string_agg(snippet, chr(10) || chr(10) ORDER BY marker) AS context FROM ({_SQL_PACKED}) GROUP BY 1) USING (item_id)""", "sources")
def assemble_prompts(spark, sf_dir):
    own = F.when(F.col("query_id") % 3 == 0, F.concat(F.lit("You are a bot for "), (F.col("query_id") % 5).cast("string")))
    return fusion.assemble_prompts(questions(spark, sf_dir).withColumn("system_prompt", own), _packed(spark, sf_dir))


_ANSWERS = "SELECT item_id AS query_id, concat('See [', 1 + item_id % 4, '] and [', 1 + item_id % 7, '], not [77] or [123].') AS answer FROM {t}"


@query(f"""WITH m AS (SELECT query_id, marker, min(pos) AS pos FROM (SELECT query_id, unnest([1 + query_id % 4, 1 + query_id % 7]) AS marker, unnest([0, 1]) AS pos FROM (SELECT item_id AS query_id FROM benchmark)) GROUP BY 1, 2)
SELECT query_id, marker, chunk_id, pos IS NOT NULL AS cited, CASE WHEN pos IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY pos NULLS LAST) END AS position
FROM ({_SQL_PACKED}) LEFT JOIN m USING (query_id, marker)""", "sources")
def resolve_citations(spark, sf_dir):
    found = fusion.resolve_citations(spark.sql(_ANSWERS, t=view(spark, sf_dir, "benchmark")), _packed(spark, sf_dir))
    return found.withColumn("marker", F.col("marker").cast("long")).withColumn("position", F.col("position").cast("long"))


@query(f"""SELECT query_id, chunk_id, rank, round(score, 6) AS score, source_name, location, marker, tokens_so_far::BIGINT AS tokens_so_far
FROM ({_SQL_PACKED}) JOIN (SELECT query_id, chunk_id, rank, score, source_name, location FROM ({_SQL_RERANKED}) WHERE rank <= 5) USING (query_id, chunk_id)""", "sources")
def hybrid_search(spark, sf_dir):
    """The flagship: dense and lexical retrieval, fusion, reranking and packing, for every question in one plan."""
    return _packed(spark, sf_dir).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), "source_name", "location", F.col("marker").cast("long").alias("marker"), "tokens_so_far")


def _scope(spark, sf_dir):
    """Which chunks a question may see: those of one organisation's sources, and of these the English ones for every second question."""
    from passages.operators import tree

    asked = questions(spark, sf_dir).select("query_id", (F.col("query_id") % 4).alias("org_id"))
    sources = view(spark, sf_dir, "sources").select("id", "org_id", "lang")
    return tree.search_scope(asked, sources, chunks(spark, sf_dir)).join(sources.select(F.col("id").alias("source_id"), "lang"), "source_id").where("query_id % 2 = 0 OR lang = 'en'").select("query_id", "chunk_id")


def _source_scope(spark, sf_dir):
    """The same by source: rows (query_id, source_id)."""
    asked = questions(spark, sf_dir).select("query_id", (F.col("query_id") % 4).alias("org_id"))
    owned = view(spark, sf_dir, "sources").select(F.col("id").alias("source_id"), "org_id", "lang")
    return asked.join(owned, "org_id").where("query_id % 2 = 0 OR lang = 'en'").select("query_id", "source_id")


_SQL_SCOPED = "SELECT item_id AS query_id, id AS chunk_id FROM benchmark JOIN sources ON org_id = item_id % 4 WHERE item_id % 2 = 0 OR lang = 'en'"


@query(_ranked(f"SELECT query_id, chunk_id, round(sum(tf) * 0.1::DOUBLE, 6) AS score FROM ({SQL_POSTINGS}) JOIN ({SQL_TERMS}) USING (term) JOIN ({_SQL_SCOPED}) USING (query_id, chunk_id) GROUP BY ALL", 20), "sources")
def scoped_lexical_search(spark, sf_dir):
    """Lexical search in which each question sees its organisation's sources only."""
    asked = terms(spark, sf_dir)
    return lexical.lexical_search(asked, lexical.matching_postings(chunks(spark, sf_dir), asked), 20, _scope(spark, sf_dir))


@query(_ranked(f"SELECT d.query_id, d.chunk_id, d.score FROM ({SQL_HYBRID_DENSE.replace('rank <= 20', 'rank <= 1000000')}) d JOIN ({_SQL_SCOPED}) s USING (query_id, chunk_id)", 20), "sources")
def scoped_dense_search(spark, sf_dir):
    """Dense search in which each question sees its organisation's sources only."""
    asked, vectors = _hashed(spark, sf_dir)
    return dense.dense_search(asked, vectors.join(chunks(spark, sf_dir).select("chunk_id", "source_id"), "chunk_id"), 20, _source_scope(spark, sf_dir))


_SQL_SCOPED_HITS = {name: _ranked(f"SELECT h.query_id, h.chunk_id, h.score FROM ({sql.replace('rank <= 20', 'rank <= 1000000')}) h JOIN ({_SQL_SCOPED}) s USING (query_id, chunk_id)", 20) for name, sql in (("bm25", SQL_LEXICAL), ("dense", SQL_HYBRID_DENSE))}


@query(f"""SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS score FROM (SELECT query_id, chunk_id, rank FROM ({_SQL_SCOPED_HITS['bm25']}) UNION ALL SELECT query_id, chunk_id, rank FROM ({_SQL_SCOPED_HITS['dense']})) GROUP BY 1, 2)) WHERE rank <= 30""", "sources")
def scoped_hybrid_search(spark, sf_dir):
    """Both retrievers within each question's sources, fused."""
    return _fused(spark, sf_dir, _source_scope(spark, sf_dir)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


_ONE_SPACE = r"concat(' ', array_to_string(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), ' '), ' ')"
_SQL_SAMPLES = """SELECT item_id, coalesce(expected_sources, '') AS expected_sources, coalesce(retrieved_sources, '') AS retrieved_sources, coalesce(context, '') AS context,
  CASE WHEN context IS NULL THEN 'I do not know.' ELSE 'See [1].' END AS answer FROM (SELECT item_id FROM benchmark)
  LEFT JOIN (SELECT item_id, string_agg('doc-' || doc_id, ',') AS expected_sources FROM (SELECT item_id, @TEXT AS b FROM benchmark) JOIN (SELECT doc_id, @TEXT AS d FROM documents) ON contains(d, b) GROUP BY 1) USING (item_id)
  LEFT JOIN (SELECT query_id AS item_id, string_agg('doc-' || chunk_id, ',') AS retrieved_sources, 'context' AS context FROM (@HITS) GROUP BY 1) USING (item_id)"""


def _sql_means(hits: str, run: int) -> str:
    from passages.plans.evaluation import _SQL_METRICS

    samples = _SQL_SAMPLES.replace("@TEXT", _ONE_SPACE).replace("@HITS", hits)
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({sql}::DOUBLE), 4) AS mean_{run} FROM ({samples})" for m, sql in _SQL_METRICS.items())


@query(f"""SELECT metric, mean_0 AS baseline, mean_1 AS candidate, round(mean_1 - mean_0, 4) AS delta FROM ({_sql_means(f'SELECT query_id, chunk_id FROM ({SQL_FUSED}) WHERE rank <= 5', 0)}) JOIN ({_sql_means(f'SELECT query_id, chunk_id FROM ({_SQL_RERANKED}) WHERE rank <= 5', 1)}) USING (metric)""", "sources")
def evaluate_retrieval(spark, sf_dir):
    """Every question through hybrid search in two configurations, without and with reranking: all metrics of both, and their difference."""
    from passages.operators import evals

    names = F.concat(F.lit("doc-"), F.col("chunk_id").cast("string"))
    asked = questions(spark, sf_dir).select(F.col("query_id").alias("item_id"), "text")
    golden = evals.documents_that_hold(asked, view(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))
    golden = golden.groupBy("item_id").agg(F.array_join(F.collect_list(names), ",").alias("expected_sources"))
    attached = _attached(spark, sf_dir)
    reranked = fusion.rerank_head(_with_question(spark, sf_dir, attached), fusion.term_overlap(F.col("question"), F.col("text")), 15, 5)
    hits = attached.where("rank <= 5").select(F.lit(0).alias("run_id"), "query_id", "chunk_id").union(reranked.select(F.lit(1), "query_id", "chunk_id"))
    found = hits.groupBy("run_id", F.col("query_id").alias("item_id")).agg(F.array_join(F.collect_list(names), ",").alias("retrieved_sources"), F.lit("context").alias("context"))
    runs = asked.select("item_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("run_id"))
    samples = runs.join(golden, "item_id", "left").join(found, ["run_id", "item_id"], "left").select(
        "run_id", "item_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("expected_sources", "retrieved_sources", "context")], F.when(F.col("context").isNull(), "I do not know.").otherwise("See [1].").alias("answer"))
    means = evals.summarise_runs(evals.score_items(samples, evals.start_run(list(evals.METRICS))), samples.select("run_id", "item_id", F.lit(None).cast("string").alias("error")))
    return evals.compare_runs(means.where("run_id = 0"), means.where("run_id = 1"))
