"""Queries over sources, text, segments and chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from passages.adapters import view, with_views
from passages.functions import text
from passages.operators import chunking, lexical, segments
from passages.plans.retrieval import SQL_LEXICAL, SQL_POSTINGS, build_lexical_index, chunks, terms
from passages.sources import corpus as sources
from passages.sources import index
from passages.sources.storage import shared_dir

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_views(sql, *views)
        return f

    return register


def _docs(spark, sf_dir):
    return view(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")


_EXT = "CASE WHEN contains(name, '.') THEN lower(regexp_extract(name, '[^.]*$')) ELSE '' END"


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT 'txt' AS extension, NULL AS reject_reason, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes FROM documents
UNION ALL SELECT 'csv', 'unsupported type: csv', sum(strlen(concat_ws(',', doc_id, quality, toxic)) + 1)::BIGINT FROM labels""")
def scan_corpus(spark, sf_dir):
    """Texts written as text files and labels as CSV files, and the folder of both scanned: files of what type were taken or refused, with how many bytes."""
    path = _folder(spark, "corpus")
    view(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.text(f"{path}/texts")
    view(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").write.csv(f"{path}/labels")
    taken, refused = sources.scan_corpus(spark, path)
    rows = taken.select("extension", F.lit(None).cast("string").alias("reject_reason"), "length").unionByName(refused.select("extension", "reject_reason", "length"))
    return rows.groupBy("extension", "reject_reason").agg(F.sum("length").alias("bytes"))


@query(f"SELECT id, CASE WHEN {_EXT} NOT IN {sources.SUPPORTED} THEN 'unsupported type: ' || {_EXT} WHEN n_chars = 0 THEN 'empty' WHEN n_chars > 5000 THEN 'too large' END AS reject_reason FROM sources", "sources")
def admit_documents(spark, sf_dir):
    return sources.admit_documents(view(spark, sf_dir, "sources").withColumn("length", F.col("n_chars")), 5000).select("id", "reject_reason")


_URLS = """SELECT page_id, CASE CAST(page_id % 8 AS INT) WHEN 0 THEN replace(url, 'https://', 'ftp://') WHEN 1 THEN concat('http://10.1.2.', page_id % 250, '/x') WHEN 2 THEN concat('http://8.8.', page_id % 250, '.8/y')
  WHEN 3 THEN concat('http://192.168.0.', page_id % 250) WHEN 4 THEN 'http:///nohost' WHEN 5 THEN concat('http://[::ffff:127.0.0.', page_id % 250, ']/') ELSE url END AS url FROM {t}"""


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"


@query(rf"""SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?:') THEN 'scheme' WHEN {_HOST} = '' THEN 'no host'
  WHEN regexp_matches({_HOST}, '^(\[::ffff:)?(10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|22[4-9]\.|2[34][0-9]\.|25[0-5]\.)') THEN 'private address' END AS reject_reason FROM ({_URLS.format(t='pages')})""")
def admit_urls(spark, sf_dir):
    return sources.admit_urls(spark.sql(_URLS, t=view(spark, sf_dir, "pages"))).select("page_id", "reject_reason")


_SITES = "SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS site, url FROM {t}"


@query(f"""WITH u AS (SELECT DISTINCT site, regexp_replace(url, '/+$', '') AS url FROM ({_SITES.format(t='pages')}))
SELECT site, count(*) AS total_found, least(count(*), 3)::BIGINT AS would_import, array_to_string(list(url ORDER BY url)[1:20], ',') AS preview FROM u GROUP BY 1""")
def sitemap_select(spark, sf_dir):
    return sources.sitemap_select(spark.sql(_SITES, t=view(spark, sf_dir, "pages")), 3)


_GOLDEN = "SELECT item_id AS row_no, CASE WHEN item_id % 9 = 0 THEN '  ' ELSE text END AS question, concat('doc-', item_id, '.txt, ,doc-', item_id % 7) AS expected_sources, CASE WHEN item_id % 2 = 0 THEN NULL ELSE ' a,b ' END AS tags FROM {t}"


@query(f"""SELECT row_no, md5(trim(question)) AS question, concat('doc-', item, '.txt|doc-', item % 7) AS expected_sources, CASE WHEN tags IS NULL THEN '' ELSE 'a|b' END AS tags
FROM (SELECT row_number() OVER (ORDER BY row_no) AS row_no, row_no AS item, question, tags FROM ({_GOLDEN.format(t='benchmark')})) WHERE trim(question) <> ''""")
def import_golden_set(spark, sf_dir):
    """The questions written as a CSV file and imported from it; blank ones are left out. A golden set is one file of at most 1,000 rows."""
    path = _folder(spark, "golden") + ".csv"
    rows = spark.sql(_GOLDEN, t=view(spark, sf_dir, "benchmark")).orderBy("row_no").coalesce(1)
    rows.select("question", "expected_sources", "tags").write.csv(path, header=True, escape='"', quoteAll=True, nullValue="")
    items, _ = sources.import_golden_set(spark, path)
    return items.select("row_no", F.md5("question").alias("question"), F.array_join("expected_sources", "|").alias("expected_sources"), F.array_join("tags", "|").alias("tags"))


@query("SELECT doc_id AS source_id, n_chars + CASE WHEN doc_id % 4 = 0 THEN 1000000 ELSE 0 END AS n FROM documents WHERE doc_id % 4 <> 0 OR n_chars > 500 UNION ALL SELECT doc_id, n_chars FROM documents WHERE doc_id % 4 = 0 AND n_chars <= 500")
def replace_by_source(spark, sf_dir):
    rows = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.col("n_chars").alias("n"))
    return sources.replace_by_source(rows, rows.where("source_id % 4 = 0 AND n > 500").withColumn("n", F.col("n") + 1000000))


@query("SELECT term, count(*) AS chunks, sum(tf)::BIGINT AS occurrences FROM (" + SQL_POSTINGS + ") GROUP BY 1")
def write_index(spark, sf_dir):
    """Writes the postings as a table in folders by term, and reads them all again."""
    path = _folder(spark, "postings")
    sources.write_index(build_lexical_index(spark, sf_dir), path)
    return sources.read_index(spark, path).groupBy("term").agg(F.count("*").alias("chunks"), F.sum("tf").alias("occurrences"))


@query(SQL_LEXICAL)
def indexed_search(spark, sf_dir):
    """Lexical search over a stored index, of which only the folders of the questions' words are read."""
    path, asked = _folder(spark, "postings"), terms(spark, sf_dir)
    sources.write_index(build_lexical_index(spark, sf_dir), path)
    return lexical.lexical_search(asked, sources.read_index(spark, path, asked), 20)


_LATEST = "(SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN concat(text, ' ', text) ELSE text END AS text FROM documents WHERE doc_id % 11 <> 5)"


@query(SQL_LEXICAL.replace("FROM documents", f"FROM {_LATEST}"))
def merged_index_search(spark, sf_dir):
    """Lexical search over an index of three segments: all documents, then new texts of every seventh, then every eleventh gone."""
    held, rows = index.StoredIndex(spark, _folder(spark, "index"), key="doc_id"), chunks(spark, sf_dir).withColumn("doc_id", F.col("chunk_id"))
    with_postings = lambda part: {"chunks": part, "postings": lexical.build_lexical_index(part)}
    changed = rows.where("doc_id % 7 = 0").withColumn("text", F.concat_ws(" ", "text", "text"))
    held.append(with_postings(rows), rows, "all")
    held.append(with_postings(changed), changed, "changed")
    held.delete(rows.where("doc_id % 11 = 5"), "gone")
    asked = terms(spark, sf_dir)
    return lexical.lexical_search(asked, held.read("postings", asked), 20)


_STATEMENT = "SELECT o_orderpriority, count(*) AS n, sum(o_orderkey) AS keys FROM orders GROUP BY o_orderpriority"


@query("SELECT o_orderpriority, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def guarded_sql(spark, sf_dir):
    return sources.guarded_sql(spark, {"orders": view(spark, sf_dir, "orders")}, _STATEMENT)[0]


# text

_DIRTY = "SELECT doc_id, concat('a', chr(13), chr(10), 'b  ', chr(10), chr(10), chr(10), chr(10), replace(coalesce(text, ''), ' ', '  '), repeat('.', 200), chr(9), ' ') AS text FROM {t}"


def _sql_clean(x: str) -> str:
    for pattern, by in ((r"\r\n?", "chr(10)"), (r"[ \t]+\n", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)"), (r"[ \t]{2,}", "' '"), (r"\.{33,}", "repeat('.', 32)"), ("-{33,}", "repeat('-', 32)"), (r"^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$", "''")):
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    return x.replace("coalesce(text, '')", "replace(coalesce(text, ''), chr(0), '')", 1)


@query(f"SELECT doc_id, md5({_sql_clean('coalesce(text, ' + chr(39) * 2 + ')')}) AS digest FROM ({_DIRTY.format(t='documents')})")
def clean_corpus(spark, sf_dir):
    return text.clean_corpus(spark.sql(_DIRTY, t=view(spark, sf_dir, "documents"))).select("doc_id", F.md5("text").alias("digest"))


_SCRIPTS = "SELECT doc_id, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN text WHEN 1 THEN 'Привет, как дела' WHEN 2 THEN 'Привіт, як справи' ELSE concat('да ', text) END AS text FROM {t}"


@query(f"""SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'english' WHEN 'ru' THEN 'russian' ELSE 'simple' END AS lang_config FROM (SELECT doc_id, CASE WHEN length(regexp_replace(h, '[^Ѐ-ӿ]', '', 'g')) <= length(regexp_replace(h, '[^a-z]', '', 'g')) THEN 'en'
  WHEN regexp_matches(h, '[їієґ]') THEN 'uk' ELSE 'ru' END AS lang FROM (SELECT doc_id, lower(coalesce(text, '')) AS h FROM ({_SCRIPTS.format(t='documents')})))""")
def tag_language(spark, sf_dir):
    return text.tag_language(spark.sql(_SCRIPTS, t=view(spark, sf_dir, "documents"))).select("doc_id", "lang", "lang_config")


_SQL_TOKENS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\x20\x09-\x0D]'))"


@query(f"""SELECT doc_id, {_SQL_TOKENS.format('c')}::BIGINT AS tokens, round(CASE WHEN n > 0 THEN greatest(1.2::DOUBLE, least(12.0::DOUBLE, length(h)::DOUBLE / n)) ELSE 3.5::DOUBLE END, 6) AS chars_per_token
FROM (SELECT doc_id, h, c, {_SQL_TOKENS.format('h')} AS n FROM (SELECT doc_id, coalesce(text, '') AS h, {_sql_clean("coalesce(text, '')")} AS c FROM documents))""")
def token_profile(spark, sf_dir):
    return text.token_profile(view(spark, sf_dir, "documents")).select("doc_id", "tokens", "chars_per_token")


# segments

_MARKDOWN = "SELECT doc_id AS doc, concat('# Doc ', doc_id, chr(10), replace(replace(coalesce(text, ''), '. ', concat('.', chr(10), '## Part', chr(10))), ', ', concat(',', chr(10), '### Sub #', chr(10)))) AS text FROM {t}"


def _sql_sections(lines: str) -> str:
    """DuckDB SQL for heading_sections over lines (doc, seq, level, text)."""
    own = ", ".join(f"max(CASE WHEN level = {n} THEN seq END) OVER w AS s{n}, arg_max(CASE WHEN level = {n} THEN text END, CASE WHEN level = {n} THEN seq END) OVER w AS t{n}" for n in range(1, 7))
    path = ", ".join(f"CASE WHEN s{n} > coalesce(greatest({', '.join([f's{m}' for m in range(1, n)] or ['NULL::BIGINT'])}), -1) THEN t{n} END" for n in range(1, 7))
    return f"""SELECT doc, seg_no, array_to_string(list_filter(any_value(section), lambda x: x IS NOT NULL), ' > ') AS section, string_agg(text, chr(10) ORDER BY seq) AS text FROM (
  SELECT *, [{path}] AS section FROM (SELECT *, count(level) OVER w AS seg_no, {own} FROM ({lines}) WINDOW w AS (PARTITION BY doc ORDER BY seq ROWS UNBOUNDED PRECEDING))) WHERE level IS NULL AND trim(text) <> '' GROUP BY 1, 2"""


def _flat(df):
    return df.select("doc", "seg_no", F.array_join("section", " > ").alias("section"), F.md5("text").alias("text"))


def _sql_flat(sql: str) -> str:
    return f"SELECT doc, seg_no, section, md5(text) AS text FROM ({sql})"


_SQL_MD_LINES = rf"""SELECT doc, seq, CASE WHEN regexp_matches(line, '^ {{0,3}}#{{1,6}}[ \t]+.+?[ \t]*#*[ \t]*$') THEN length(regexp_extract(line, '^ {{0,3}}(#{{1,6}})[ \t]', 1)) END AS level,
  CASE WHEN regexp_matches(line, '^ {{0,3}}#{{1,6}}[ \t]+.+?[ \t]*#*[ \t]*$') THEN regexp_extract(line, '^ {{0,3}}#{{1,6}}[ \t]+(.+?)[ \t]*#*[ \t]*$', 1) ELSE line END AS text FROM (
  SELECT doc, ls[i] AS line, i AS seq FROM (SELECT doc, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc, string_split(text, chr(10)) AS ls FROM ({_MARKDOWN.format(t='documents')}))))"""


@query(f"SELECT *, 'Doc ' || doc AS title FROM ({_sql_flat(_sql_sections(_SQL_MD_LINES))})")
def markdown_segments(spark, sf_dir):
    found = segments.markdown_segments(spark.sql(_MARKDOWN, t=view(spark, sf_dir, "documents")))
    return found.select("doc", "seg_no", F.array_join("section", " > ").alias("section"), F.md5("text").alias("text"), "title")


_LEVELS = "SELECT l_orderkey AS doc, CAST(l_linenumber * 100000000 + l_partkey * 100 + l_quantity AS BIGINT) AS seq, CASE WHEN l_quantity < 20 THEN CAST(1 + l_suppkey % 6 AS INT) END AS level, concat('line ', l_partkey) AS text FROM {t}"


@query(_sql_flat(_sql_sections(_LEVELS.format(t="lineitem"))))
def heading_sections(spark, sf_dir):
    return _flat(segments.heading_sections(spark.sql(_LEVELS, t=view(spark, sf_dir, "lineitem"))))


_STYLES = "SELECT l_orderkey AS doc, CAST(l_linenumber * 100000000 + l_partkey * 100 + l_quantity AS BIGINT) AS seq, CASE CAST(l_suppkey % 5 AS INT) WHEN 0 THEN 'Title' WHEN 1 THEN 'Heading 2' WHEN 2 THEN 'heading 9' ELSE 'Normal' END AS style, concat('par ', l_partkey) AS text FROM {t}"


@query(_sql_flat(_sql_sections(f"SELECT doc, seq, CASE style WHEN 'Title' THEN 1 WHEN 'Heading 2' THEN 2 WHEN 'heading 9' THEN 6 END AS level, text FROM ({_STYLES.format(t='lineitem')})")))
def styled_segments(spark, sf_dir):
    return _flat(segments.styled_segments(spark.sql(_STYLES, t=view(spark, sf_dir, "lineitem"))))


_LAYOUT = "SELECT l_orderkey AS doc, CAST(1 + l_linenumber / 4 AS INT) AS page, CAST(l_linenumber * 100000000 + l_partkey * 100 + l_quantity AS BIGINT) AS seq, concat('text of line ', l_partkey) AS text, CASE WHEN l_suppkey % 7 = 0 THEN 24.0D WHEN l_suppkey % 5 = 0 THEN 18.0D ELSE 11.0D END AS size FROM {t}"
_SQL_LAYOUT = _LAYOUT.replace("24.0D", "24.0::DOUBLE").replace("18.0D", "18.0::DOUBLE").replace("11.0D", "11.0::DOUBLE").replace("CAST(1 + l_linenumber / 4 AS INT)", "CAST(1 + l_linenumber // 4 AS INT)").format(t="lineitem")
_SQL_LAYOUT_LINES = f"""SELECT doc, min(seq) AS seq, min(page) AS page, any_value(level) AS level, string_agg(text, ' ' ORDER BY seq) AS text FROM (SELECT *, sum(start::INT) OVER (PARTITION BY doc ORDER BY seq) AS island FROM (
  SELECT *, level IS NULL OR (lag(level) OVER o) IS DISTINCT FROM level OR coalesce((lag(page) OVER o) <> page, false) AS start FROM (SELECT l.*, CASE WHEN length(text) <= 120 THEN r.rank END AS level FROM ({_SQL_LAYOUT}) l LEFT JOIN (
    SELECT doc, size, dense_rank() OVER (PARTITION BY doc ORDER BY size DESC) AS rank FROM (SELECT doc, size, arg_max(size, (chars, size)) OVER (PARTITION BY doc) AS body FROM (SELECT doc, size, sum(length(text)) AS chars FROM ({_SQL_LAYOUT}) GROUP BY 1, 2)) WHERE size > 1.1 * body) r USING (doc, size))
  WINDOW o AS (PARTITION BY doc ORDER BY seq))) GROUP BY doc, island"""


def _sql_paged(lines: str) -> str:
    """_sql_sections() in which the end of a page ends a segment."""
    one = _sql_sections(lines)
    rows = one[one.index("FROM (") + 6 : one.rindex(") WHERE level IS NULL")]
    rows = f"SELECT * FROM ({rows}) WHERE level IS NULL AND trim(text) <> ''"
    rows = f"SELECT * REPLACE (sum(fresh) OVER (PARTITION BY doc ORDER BY seq)::BIGINT AS seg_no) FROM (SELECT *, CASE WHEN (lag(seg_no) OVER o) = seg_no AND (lag(page) OVER o) = page THEN 0 ELSE 1 END AS fresh FROM ({rows}) WINDOW o AS (PARTITION BY doc ORDER BY seq))"
    return f"SELECT doc, seg_no, page, array_to_string(list_filter(any_value(section), lambda x: x IS NOT NULL), ' > ') AS section, md5(string_agg(text, chr(10) ORDER BY seq)) AS text FROM ({rows}) GROUP BY 1, 2, 3"


@query(_sql_paged(_SQL_LAYOUT_LINES))
def layout_segments(spark, sf_dir):
    found = segments.layout_segments(spark.sql(_LAYOUT.replace("l_linenumber / 4", "l_linenumber div 4"), t=view(spark, sf_dir, "lineitem")))
    return found.select("doc", "seg_no", "page", F.array_join("section", " > ").alias("section"), F.md5("text").alias("text"))


_SQL_TITLE = r"regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), '[ \t\r\n]+', ' ', 'g')"


def _sql_decode(x: str) -> str:
    """The named character references that the given pages may hold; they hold no numeric ones."""
    for name, char in {"lt": "<", "gt": ">", "quot": '"', "nbsp": "\u00a0", "copy": "©", "middot": "·", "amp": "&"}.items():
        x = f"replace({x}, '&{name};', '{char}')"
    return x


def _sql_html_lines(source: str) -> str:
    x = r"regexp_replace(html, '(?is)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", *segments.NOISE):
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    root = ", ".join(rf"nullif(regexp_extract(clean, '(?is)<{t}\b[^>]*>(.*?)(</{t}\s*>|\z)', 1), '')" for t in ("main", "article", "body"))
    y = r"regexp_replace(root, '(?i)</t[dh]\s*>\s*<t[dh]\b[^>]*>', ' | ', 'g')"
    y = rf"regexp_replace({y}, '(?i)<h([1-6])\b[^>]*>', chr(1) || '\1', 'g')"
    y = rf"regexp_replace(regexp_replace({y}, '[\r\n]+', ' ', 'g'), '(?i)</?(p|div|section|article|main|body|ul|ol|li|table|tbody|thead|tr|td|th|br|h[1-6]|blockquote|pre)\b[^>]*>', chr(10), 'g')"
    y = rf"regexp_replace(replace({y}, chr(1), chr(10) || chr(1)), '<[^>]*>', '', 'g')"
    out = _sql_decode("regexp_replace(line, '^' || chr(1) || '[1-6]', '')")
    return rf"""SELECT doc, seq, nullif(regexp_extract(line, '^' || chr(1) || '([1-6])', 1), '')::INT AS level, trim(regexp_replace({out}, '[ \t]+', ' ', 'g')) AS text FROM (
  SELECT doc, ls[i] AS line, i AS seq FROM (SELECT doc, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc, string_split({y}, chr(10)) AS ls FROM (SELECT doc, coalesce({root}, clean) AS root FROM (SELECT doc, {x} AS clean FROM ({source}))))))"""


@query(rf"""SELECT doc, seg_no, section, md5(text) AS text, md5(title) AS title FROM ({_sql_sections(_sql_html_lines("SELECT page_id AS doc, coalesce(html, '') AS html FROM pages"))})
LEFT JOIN (SELECT page_id AS doc, trim({_sql_decode(_SQL_TITLE)}) AS title FROM pages) USING (doc)""")
def html_segments(spark, sf_dir):
    pages = view(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), "html")
    found = segments.html_segments(pages)
    return found.select("doc", "seg_no", F.array_join("section", " > ").alias("section"), F.md5("text").alias("text"), F.md5("title").alias("title"))


@query("SELECT event_id AS doc, 0 AS seg_no, CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'k' END AS section, CASE WHEN event_id % 10 = 0 THEN 'not json {' ELSE regexp_extract(props, '[0-9]+') END AS text FROM events")
def json_segments(spark, sf_dir):
    rows = view(spark, sf_dir, "events").select(F.col("event_id").alias("doc"), F.expr("CASE WHEN event_id % 10 = 0 THEN 'not json {' ELSE props END").alias("json"))
    return segments.json_segments(rows)


@query("SELECT doc, seg_no, string_agg(line, chr(10) ORDER BY p_partkey) AS text FROM (SELECT p_brand AS doc, p_partkey, concat(p_name, ' | ', p_size, ' | ', p_type) AS line, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 1000 AS seg_no FROM part) GROUP BY 1, 2")
def tabular_segments(spark, sf_dir):
    return segments.tabular_segments(view(spark, sf_dir, "part"), "p_brand", "p_partkey", ["p_name", "p_size", "p_type"]).select("doc", "seg_no", "text")


@query("SELECT c_custkey AS doc FROM customer WHERE c_mktsegment <> 'BUILDING'")
def drop_contents_sections(spark, sf_dir):
    rows = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.array(F.when(F.col("c_mktsegment") == "BUILDING", " Contents ").otherwise(F.col("c_name"))).alias("section"))
    return segments.drop_contents_sections(rows).select("doc")


# chunks

# arrays of tokens, each with the white space before it: joined and trimmed, they are a slice of the text
_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_W = f"regexp_extract_all(coalesce(text, ''), '{chunking.SPACED_TOKEN}')"
SQL_FIXED = f"""SELECT doc, (start // stride)::INT AS ordinal, {_TRIM.format("array_to_string(w[start + 1:start + width], '')")} AS text, len(w[start + 1:start + width])::INT AS tokens FROM (
  SELECT *, unnest(range(0, n, stride)) AS start FROM (SELECT *, least(400, stride + 40) AS width FROM (SELECT *, (n + pieces - 1) // pieces AS stride FROM (
    SELECT doc, w, n, (n + 359) // 360 AS pieces FROM (SELECT doc_id AS doc, {_W} AS w, len({_W}) AS n FROM documents) WHERE n > 0)))) WHERE start = 0 OR start - stride + width < n"""


@query(f"SELECT doc, ordinal, md5(text) AS digest, tokens FROM ({SQL_FIXED})")
def chunk_fixed(spark, sf_dir):
    return chunking.chunk_fixed(_docs(spark, sf_dir)).select("doc", "ordinal", F.md5("text").alias("digest"), "tokens")


@query(f"SELECT count(*) AS chunks, round(avg(tokens), 4) AS avg_tokens, min(tokens)::BIGINT AS min_tokens, max(tokens)::BIGINT AS max_tokens, round(avg(CASE WHEN doc % 3 = 0 THEN 1.0 ELSE 0.0 END), 4) AS with_path FROM ({SQL_FIXED})")
def chunk_report(spark, sf_dir):
    return chunking.chunk_report(chunking.chunk_fixed(_docs(spark, sf_dir)).withColumn("section", F.when(F.col("doc") % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))))


def _segments(spark, sf_dir):
    return segments.markdown_segments(spark.sql(_MARKDOWN, t=view(spark, sf_dir, "documents")))


_NW = f"len(regexp_extract_all({{}}, '{chunking.SPACED_TOKEN}'))"


def _nw(column: str) -> str:
    return _NW.replace("{}", column)


def _sql_pieces(source: str, overlap: int) -> str:
    """DuckDB SQL for the pieces of rows (k, text, budget, ...) that are over their budget: rows (k, piece_no, words), of split_text()."""
    units = "[text]"
    for separator in ("chr(10) || chr(10)", "chr(10)", "'. '", "' '"):
        parts = f"string_split(p, {separator})"
        units = f"flatten(list_transform({units}, lambda p: CASE WHEN {_nw('p')} <= budget THEN [p] ELSE list_filter(list_transform({parts}, lambda x, i: CASE WHEN i < len({parts}) THEN x || {separator} ELSE x END), lambda x: x <> '') END))"
    return f"""SELECT k, i::INT - 1 AS piece_no, pieces[i] AS words FROM (SELECT k, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM (
  SELECT k, CASE WHEN len(spans) > 1 AND spans[-1].e - spans[-1].a < budget // 4 THEN list_transform(spans[:-3], lambda x: w[x.a + 1:x.e]) || list_transform(list_filter(range(0, m, stride), lambda s: s = 0 OR s - stride + width < m), lambda s: tail[s + 1:s + width])
    ELSE list_transform(spans, lambda x: w[x.a + 1:x.e]) END AS pieces FROM (
    SELECT *, least(budget, stride + {overlap}) AS width FROM (SELECT *, (m + ((m + budget - {overlap} - 1) // (budget - {overlap})) - 1) // ((m + budget - {overlap} - 1) // (budget - {overlap})) AS stride FROM (
      SELECT *, w[spans[len(spans) - 1].a + 1:] AS tail, len(w[spans[len(spans) - 1].a + 1:]) AS m FROM (
        SELECT k, budget, w, CASE WHEN e > a AND (len(spans) = 0 OR e > spans[-1].e) THEN spans || [{{'a': a, 'e': e}}] ELSE spans END AS spans FROM (
          WITH RECURSIVE u AS (SELECT k, budget, {_nw('text').replace('len(', '(', 1)} AS w, flatten(list_transform({units}, lambda p: CASE WHEN {_nw('p')} <= budget THEN [{_nw('p')}] ELSE list_transform(range(0, {_nw('p')}, budget), lambda k: least(budget, {_nw('p')} - k)) END)) AS sizes FROM ({source}) WHERE {_nw('text')} > budget),
          f AS (SELECT k, 0 AS i, 0 AS a, 0 AS e, CAST([] AS STRUCT(a INT, e INT)[]) AS spans FROM u
            UNION ALL SELECT f.k, i + 1, CASE WHEN e > a AND e - a + n > budget THEN greatest(a, e - greatest(0, least({overlap}, budget - n))) ELSE a END, (e + n)::INT,
              CASE WHEN e > a AND e - a + n > budget THEN spans || [{{'a': a, 'e': e}}] ELSE spans END FROM (SELECT f.*, u.budget, u.sizes[f.i + 1]::INT AS n FROM f JOIN u USING (k) WHERE f.i < len(u.sizes)) f)
          SELECT f.*, u.budget, u.w FROM f JOIN u USING (k) WHERE f.i = len(u.sizes))))))))"""


_SQL_SEGMENTS = f"SELECT *, doc || '/' || seg_no AS k FROM ({_sql_sections(_SQL_MD_LINES)})"


@query(f"""WITH s AS (SELECT *, 50 AS budget FROM ({_SQL_SEGMENTS})), p AS ({_sql_pieces('SELECT * FROM s', 10)})
SELECT doc, seg_no, 0 AS piece_no, section, md5({_TRIM.format('text')}) AS digest, len({_W})::INT AS tokens FROM s WHERE len({_W}) BETWEEN 1 AND 50
UNION ALL SELECT doc, seg_no, piece_no, section, md5({_TRIM.format("array_to_string(words, '')")}), len(words)::INT FROM s JOIN p USING (k)""")
def split_oversized(spark, sf_dir):
    pieces = chunking.split_oversized(_segments(spark, sf_dir), 50, 10)
    return pieces.select("doc", "seg_no", "piece_no", F.array_join("section", " > ").alias("section"), F.md5("text").alias("digest"), "tokens")


def _sql_crumb(parts: str) -> str:
    return f"array_to_string(list_filter({parts}, lambda x: x <> ''), ' > ')"


_SQL_TITLED = f"SELECT *, coalesce('Doc ' || doc, '') AS title FROM ({_SQL_SEGMENTS})"


def _sql_crumbs(segments_sql: str, size: int) -> str:
    """Segments (.., title, section) with their breadcrumb and what it leaves of a size."""
    return f"SELECT *, greatest({size} - CASE WHEN crumb = '' THEN 0 ELSE {_nw('crumb')} + 1 END, {size} // 2) AS budget FROM (SELECT *, {_sql_crumb('[title, section]')} AS crumb FROM ({segments_sql}))"


def _chunks_flat(df):
    return df.select("doc", "ordinal", F.array_join("section", " > ").alias("section"), F.md5("text").alias("digest"), "tokens")


@query(f"""WITH s AS ({_sql_crumbs(_SQL_TITLED, 60)}), c AS (SELECT *, {_nw('text')} + {_nw('crumb')} AS whole FROM s), p AS ({_sql_pieces("SELECT * FROM c WHERE whole > 60", 10)}),
e AS (SELECT doc, seg_no, 0 AS piece_no, section, crumb, {_W} AS words FROM c WHERE whole <= 60 UNION ALL SELECT doc, seg_no, 0, section, crumb, {_W} FROM c WHERE whole > 60 AND {_nw('text')} <= budget UNION ALL SELECT doc, seg_no, piece_no, section, crumb, words FROM c JOIN p USING (k))
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY seg_no, piece_no) - 1)::INT AS ordinal, section, md5(CASE WHEN crumb = '' THEN '' ELSE crumb || chr(10) END || {_TRIM.format("array_to_string(words, '')")}) AS digest, (len(words) + {_nw('crumb')})::INT AS tokens FROM e WHERE len(words) > 0""")
def chunk_per_unit(spark, sf_dir):
    return _chunks_flat(chunking.chunk_per_unit(_segments(spark, sf_dir), 60, 10))


def _sql_semantic(segments_sql: str) -> str:
    return f"""WITH RECURSIVE s AS ({_sql_crumbs(segments_sql, 400)}), p AS ({_sql_pieces('SELECT * FROM s', 40)}),
e AS (SELECT doc, seg_no, 0 AS piece_no, string_split(section, ' > ') AS path, section, budget, title, {_W} AS words FROM s WHERE {_nw('text')} <= budget UNION ALL SELECT doc, seg_no, piece_no, string_split(section, ' > '), section, budget, title, words FROM s JOIN p USING (k)),
o AS (SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY seg_no, piece_no))::INT AS i, CASE WHEN section = '' THEN [] ELSE path END AS path, budget, title, words, len(words)::INT AS n FROM e WHERE len(words) > 0),
f AS (SELECT doc, i, 0 AS pack, path, budget, n AS used FROM o WHERE i = 1
  UNION ALL SELECT doc, i, CASE WHEN fresh THEN pack + 1 ELSE pack END, CASE WHEN fresh THEN npath ELSE common END, CASE WHEN fresh THEN nbudget ELSE budget END, CASE WHEN fresh THEN n ELSE used + n + 2 END FROM (
    SELECT *, used + n + 2 > budget OR len(path) > 0 AND common <> path AND used >= 200 AS fresh FROM (
      SELECT f.doc, o.i, f.pack, f.path, f.budget, f.used, o.n, o.path AS npath, o.budget AS nbudget,
        f.path[1:coalesce(list_position(list_transform(range(1, greatest(len(f.path), len(o.path)) + 1), lambda j: coalesce(f.path[j] = o.path[j], false)), false), len(f.path) + 1) - 1] AS common FROM f JOIN o ON o.doc = f.doc AND o.i = f.i + 1))),
c AS (SELECT doc, pack AS ordinal, arg_max(f.path, i) AS path, any_value(title) AS title, string_agg({_TRIM.format("array_to_string(words, '')")}, chr(10) || chr(10) ORDER BY i) AS body, sum(n) AS n FROM f JOIN o USING (doc, i) GROUP BY 1, 2)
SELECT doc, ordinal, array_to_string(path, ' > ') AS section, CASE WHEN crumb = '' THEN body ELSE crumb || chr(10) || body END AS text, (n + {_nw('crumb')})::INT AS tokens FROM (SELECT *, {_sql_crumb("[title] || path")} AS crumb FROM c)"""


@query(f"SELECT doc, ordinal, section, md5(text) AS digest, tokens FROM ({_sql_semantic(_SQL_TITLED)})")
def chunk_semantic(spark, sf_dir):
    return _chunks_flat(chunking.chunk_semantic(_segments(spark, sf_dir)))


_NAMED = "SELECT doc_id AS doc, text, concat('doc-', doc_id, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.exe' ELSE '.TXT' END) AS name FROM {t}"
_SQL_CLEANED = f"""SELECT doc_id AS doc, 0 AS seg_no, doc_id || '/0' AS k, '' AS section, '' AS title, CASE WHEN doc_id % 4 = 1 THEN array_to_string(list_filter(string_split(c, chr(10)), lambda x: trim(x) <> ''), chr(10)) ELSE c END AS text
FROM (SELECT doc_id, {_sql_clean("coalesce(text, '')")} AS c FROM documents) WHERE doc_id % 4 <> 2"""
_SQL_EN = ", ".join(repr(w) for w in lexical.STOPWORDS["en"])


@query(rf"""WITH c AS ({_sql_semantic(_SQL_CLEANED)}), s AS (SELECT doc, count(*) AS chunks, sum(tokens)::BIGINT AS tokens, string_agg(md5(text), ',' ORDER BY ordinal) AS digests,
  sum(len(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '' AND w NOT IN ({_SQL_EN}))))::BIGINT AS occurrences FROM c GROUP BY 1)
SELECT doc_id AS doc, CASE WHEN doc_id % 4 = 2 OR chunks IS NULL THEN 'failed' ELSE 'ready' END AS status, CASE WHEN doc_id % 4 = 2 THEN 'unsupported type: exe' WHEN chunks IS NULL THEN 'no text' END AS error, 'en' AS lang,
  coalesce(chunks, 0) AS chunks, coalesce(tokens, 0) AS tokens, 400 AS chunk_size, 40 AS chunk_overlap, 'semantic' AS chunk_strategy, digests, coalesce(occurrences, 0) AS occurrences, chunks AS vectors FROM documents LEFT JOIN s ON doc = doc_id""")
def ingest_corpus(spark, sf_dir):
    """Every document into the index: its row in sources, the digests of its chunks, the words in its postings, and its vectors."""
    found = chunking.ingest_corpus(spark.sql(_NAMED, t=view(spark, sf_dir, "documents")))
    digest = F.md5("text")
    digests = found["chunks"].groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", digest.alias("d")))), lambda x: x["d"]), ",").alias("digests"))
    doc = F.substring_index("chunk_id", "#", 1).cast("long").alias("doc")
    postings = found["postings"].groupBy(doc).agg(F.sum("tf").alias("occurrences"))
    vectors = found["vectors"].groupBy(doc).agg(F.count("*").alias("vectors"))
    rows = found["sources"].select("doc", "status", "error", "lang", "chunks", "tokens", "chunk_size", "chunk_overlap", "chunk_strategy")
    return rows.join(digests, "doc", "left").join(postings, "doc", "left").join(vectors, "doc", "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))
