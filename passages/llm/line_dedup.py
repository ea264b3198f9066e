"""Line dedup over a tree of log templates.

Each line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens, variable ones masked. In a leaf
that holds several lines, a token that several of them carry at a position is constant, any other is a variable field;
a line with a wildcard for each of its variable fields is its template. A leaf so holds as many templates as there are. Lines
that recur as they are, and lines whose template recurs, are dropped.

Lines are counted by 64-bit hashes with partial sums, so a line in a third of all documents is one counter a task. Whole lines
are only fetched for leaves that hold variants. The numbers of a document's dropped lines are joined to it in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.llm.common import WORD, small, unused, words_of, written

WILDCARD = "<*>"
#: Documents that a line or template needs to recur, and those that suffice for a long one.
SHORT_DOCS, LONG_DOCS = 3, 2


def _tokens(text: Column) -> Column:
    """The line's words; those that hold a digit, @ or :// are masked, which most lines need not be searched for word by word."""
    words = words_of(text)
    return F.when(text.rlike("[0-9@]|://"), F.transform(words, lambda w: F.when(w.rlike("[0-9]|@|://"), WILDCARD).otherwise(w))).otherwise(words)


def _lines(docs: DataFrame, id_col: str, text_col: str, depth: int, long_tokens: int) -> DataFrame:
    """Rows (id, owner, line_no, leaf, line, long), written once, of each line with a word; a leaf's lines are equally long."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("owner"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "text"))
    rows = rows.where(F.col("text").rlike(WORD)).select("id", "owner", "line_no", _tokens(F.col("text")).alias("tokens"))
    leaf = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth))
    return written(rows.select("id", "owner", "line_no", leaf.alias("leaf"), F.xxhash64("tokens").alias("line"), (F.size("tokens") >= long_tokens).alias("long")), "lines")


def _fetch(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds tokens to wanted (id, line_no, ...), from the texts of the documents it names."""
    at = written(wanted.groupBy(F.col("id").alias("_id")).agg(F.collect_set("line_no").alias("_at")), "wanted-lines")
    texts = docs.select(F.col(id_col).alias("_id"), F.split(F.col(text_col), "\n").alias("_parts"))
    found = texts.join(small(at, items=wanted.count()), "_id")
    rows = found.select(F.col("_id").alias("id"), F.inline(F.transform("_at", lambda i: F.struct(i.alias("line_no"), F.get("_parts", i).alias("text")))))
    rows = rows.where(F.col("text").isNotNull()).select("id", "line_no", _tokens(F.col("text")).alias("tokens"))
    return rows.join(wanted, ["id", "line_no"])


def _need() -> Column:
    return F.when(F.col("long"), LONG_DOCS).otherwise(SHORT_DOCS)


def _same_template(variants: DataFrame, depth: int, similarity: float) -> DataFrame:
    """Rows (line) of the variants whose template stands in enough documents.

    A token is constant if at least two lines of the leaf carry it at its position, which together stand for at least as many
    documents as a line needs to recur (each for one fewer at most). Where values of variable fields recur as well, these
    are split off: a line also has the templates that fourfold, sixteenfold, ... numbers of documents yield. A template needs
    constants in at least `similarity` of the line's positions beyond the leading ones, masked tokens aside.
    """
    tokens = F.slice("tokens", depth + 1, F.greatest(F.size("tokens") - depth, F.lit(0)))
    at = variants.select("line", "leaf", _need().alias("need"), F.least("n", _need() - 1).alias("weight"), F.posexplode(tokens).alias("pos", "token")).where(F.col("token") != WILDCARD)
    at = written(at.select("line", "need", "weight", F.xxhash64("leaf", "pos", "token").alias("place")), "token-places")
    constant = at.groupBy("place", "need").agg(F.sum("weight").alias("support")).where(F.col("support") >= F.col("need"))
    level = ((F.length(F.bin(F.floor(F.col("support") / F.col("need")))) - 1) / 2).cast("int")  # of powers of four
    constant = small(written(constant.select("place", level.alias("level")), "constants"))
    marked = at.select("line", "place").join(constant, "place").groupBy("line").agg(F.sort_array(F.collect_list(F.struct("place", "level"))).alias("constants"))
    n_open = F.size(F.filter(tokens, lambda t: t != WILDCARD))
    narrow = variants.select("line", _need().alias("need"), "n", "low", "high", n_open.alias("n_open"))
    rows = narrow.join(marked, "line").select("*", F.explode(F.array_distinct(F.col("constants.level"))).alias("least"))
    rows = rows.withColumn("constants", F.filter("constants", lambda x: x["level"] >= F.col("least"))).where(F.size("constants") >= similarity * F.col("n_open"))
    rows = written(rows.select("line", "need", "n", "low", "high", F.xxhash64(F.col("constants.place")).alias("template")), "templates")
    # a line that doesn't recur as it is has two owners at most: low and high
    owners = rows.select("template", "need", "n", F.explode(F.array("low", "high")).alias("owner"))
    groups = owners.groupBy("template", "need").agg(F.count_distinct("owner").alias("owners"), F.max("n").alias("most"))
    groups = small(written(groups.where(F.greatest("owners", "most") >= F.col("need")).select("template"), "recurring-templates"))
    return rows.join(groups, "template", "left_semi").select("line")


def recurring_lines(docs: DataFrame, lines: DataFrame, *, id_col: str, text_col: str, depth: int, similarity: float) -> DataFrame:
    """Rows (line): hashes of the masked lines that recur, as they are or by their template. Owners are counted, not ids."""
    places = lines.groupBy("owner", "leaf", "long", "line").agg(F.min(F.struct("id", "line_no")).alias("first"))
    counts = places.groupBy("leaf", "long", "line").agg(F.count("*").alias("n"), F.min("owner").alias("low"), F.max("owner").alias("high"), F.min("first").alias("first"))
    counts = written(counts.select("leaf", "long", "line", "n", "low", "high", "first.*"), "line-counts")
    exact = counts.where(F.col("n") >= _need()).select("line")
    leaves = counts.groupBy("leaf", "long").agg(F.sum("n").alias("total"), F.min("n").alias("least"), F.count("*").alias("kinds"))
    leaves = leaves.where((F.col("total") >= _need()) & (F.col("least") < _need()) & (F.col("kinds") > 1)).select("leaf")
    wanted = written(counts.join(small(written(leaves, "leaves")), "leaf", "left_semi"), "variants")
    variants = written(_fetch(docs, wanted, id_col, text_col).dropDuplicates(["line"]), "variant-lines")
    return written(exact.union(_same_template(variants, depth, similarity)).distinct(), "recurring")


def drop_recurring_lines(
    docs: DataFrame, copies: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, similarity: float = 0.6, long_tokens: int = 20, spare_emptied: bool = False
) -> DataFrame:
    """docs with two more columns, n_dropped and emptied (not one word is left), and every text without its recurring lines.

    A line or template recurs in three documents, or in two if it has at least long_tokens words. Documents with equal texts count as one. copies
    (id, component) may name near copies instead: a component then counts as one document, so that what only copies share
    does not recur and is left to the operator that drops copies. No share of recurring lines exempts a document; with
    spare_emptied, one that would lose its last word stays whole, so that no text is emptied everywhere.

    Lines without a word stay. Null and empty texts stay as they are, and so do documents with a null id, which count for no line.
    Ids should be unique; repeated equal rows count as one document and are treated alike. Columns n_dropped and emptied of docs are replaced.
    """
    lines = _lines(docs, id_col, text_col, depth, long_tokens)
    if copies is not None:
        copies = written(copies.groupBy("id").agg(F.min("component").alias("component")), "copies")
        lines = lines.drop("owner").join(small(copies), "id", "left").withColumn("owner", F.coalesce("component", "id")).drop("component")
    recurring = recurring_lines(docs, lines, id_col=id_col, text_col=text_col, depth=depth, similarity=similarity)
    key, at, parts = (unused(docs, x) for x in ("_id", "_at", "_parts"))
    hits = lines.join(small(recurring), "line", "left_semi").groupBy(F.col("id").alias(key)).agg(F.collect_set("line_no").alias(at))
    # the hits grow with the corpus, so this join always shuffles; texts travel as the lines they are put together from again
    others = [c for c in docs.columns if c not in (text_col, "n_dropped", "emptied")]
    named = docs.where(F.col(id_col).isNotNull()).select(*others, F.split(F.col(text_col), "\n").alias(parts))
    rows = named.join(hits, named[id_col] == hits[key], "left").drop(key)
    last = F.size(parts) - 1
    left = F.array_except(F.sequence(F.lit(0), last), F.col(at))
    text = F.array_join(F.when(F.col(at).isNull(), F.col(parts)).otherwise(F.transform(left, lambda i: F.get(parts, i))), "\n")
    emptied = F.col(at).isNotNull() & ~F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    rows = rows.withColumn(text_col, text).withColumn("emptied", emptied)
    if spare_emptied:
        rows = rows.withColumn(text_col, F.when(F.col("emptied"), F.array_join(parts, "\n")).otherwise(F.col(text_col))).withColumn(at, F.when(~F.col("emptied"), F.col(at)))
        rows = rows.withColumn("emptied", F.lit(False))
    rows = rows.withColumn("n_dropped", F.when(F.col(at).isNotNull(), F.size(at)).otherwise(0).cast("long"))
    unnamed = docs.where(F.col(id_col).isNull()).select(*others, text_col, F.lit(0).cast("long").alias("n_dropped"), F.lit(False).alias("emptied"))
    names = [c for c in docs.columns if c not in ("n_dropped", "emptied")]
    return rows.select(*names, "n_dropped", "emptied").unionByName(unnamed.select(*names, "n_dropped", "emptied"))


#: DuckDB SQL for op1; lines are compared as text.
ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, text, list_transform(regexp_extract_all(s, '[^\x20\x09-\x0D]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9]|@|://') THEN '<*>' ELSE w END) AS tokens
  FROM (SELECT doc_id, text, parts[i] AS s, i FROM (SELECT doc_id, text, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)))
  WHERE regexp_matches(s, '[^\x20\x09-\x0D]')
), k AS (
  SELECT *, (len(tokens), tokens[1:3])::VARCHAR AS leaf, CASE WHEN len(tokens) >= 20 THEN 2 ELSE 3 END AS need FROM l
), c AS (
  SELECT leaf, need, tokens, count(DISTINCT text) AS n FROM k GROUP BY ALL
), v AS (
  SELECT * FROM c WHERE leaf IN (SELECT leaf FROM c GROUP BY leaf, need HAVING sum(n) >= need AND min(n) < need AND count(*) > 1)
), p AS (
  SELECT leaf, need, tokens, n, pos, tokens[pos] AS token FROM (SELECT *, unnest(range(4, len(tokens) + 1)) AS pos FROM v) WHERE token <> '<*>'
), s AS (
  SELECT leaf, pos, token, (length(bin(sum(least(n, need - 1))::BIGINT // need)) - 1) // 2 AS level FROM p GROUP BY leaf, need, pos, token HAVING sum(least(n, need - 1)) >= need
), m AS (
  SELECT leaf, need, tokens, list({'pos': pos, 'token': token, 'level': level} ORDER BY pos) AS constants,
    len(list_filter(tokens[4:], lambda t: t <> '<*>')) AS n_open FROM p JOIN s USING (leaf, pos, token) GROUP BY ALL
), t AS (
  SELECT leaf, need, tokens, n_open, list_transform(list_filter(constants, lambda x: x.level >= least), lambda x: (x.pos, x.token))::VARCHAR AS template,
    len(list_filter(constants, lambda x: x.level >= least)) AS n_constant
  FROM (SELECT *, unnest(list_distinct(list_transform(constants, lambda x: x.level))) AS least FROM m)
), g AS (
  SELECT leaf, template FROM (SELECT * FROM t WHERE n_constant >= 0.6 * n_open) JOIN k USING (leaf, need, tokens) GROUP BY leaf, template, need HAVING count(DISTINCT text) >= need
), r AS (
  SELECT leaf, tokens FROM c WHERE n >= need
  UNION SELECT leaf, tokens FROM t JOIN g USING (leaf, template) WHERE n_constant >= 0.6 * n_open
), h AS (
  SELECT doc_id, list(i) AS ats FROM k JOIN r USING (leaf, tokens) GROUP BY doc_id
), d AS (
  SELECT doc_id, text, ats, list_filter(string_split(text, chr(10)), lambda x, j: NOT list_contains(ats, j)) AS kept FROM documents LEFT JOIN h USING (doc_id)
)
SELECT doc_id, CASE WHEN ats IS NOT NULL THEN array_to_string(kept, chr(10)) ELSE text END AS text,
  CASE WHEN ats IS NOT NULL THEN len(ats) ELSE 0 END::BIGINT AS n_dropped,
  ats IS NOT NULL AND NOT regexp_matches(array_to_string(kept, chr(10)), '[^\x20\x09-\x0D]') AS emptied
FROM d
"""
