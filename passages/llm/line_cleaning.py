"""Line-first cleaning: rules judge lines, failing lines go, and a document that loses too much text goes with them.

Only DataFrame functions: one narrow pass, no shuffle, nothing leaves the JVM. Arrays that a lambda refers to are
columns of an earlier projection, so that Spark computes each of them once a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.llm.common import SPACE, WORD, words_of

#: Words in a window of the repetition count (fixed by the result contract).
WINDOW = 8

#: Phrases that mark a line as boilerplate wherever they stand in it; matched in either case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under", "is licensed", "terms of use", "terms of service",
    "privacy policy", "cookie policy", "uses cookies", "enable javascript", "subscribe to our", "sign up for",
    "click here", "read more", "lorem ipsum", "copyright \\(c\\)", "©",
)
_BOILERPLATE = "(?i)(" + "|".join(BOILERPLATE) + ")"
_SENTENCE_END = "[.!?…:;。！？][\")'\\]»”’]*([\\x20\\x09-\\x0D]|\\z)"


def _facts(line: Column) -> Column:
    """What the rules ask of a line."""
    return F.struct(
        line.alias("line"),
        F.regexp_count(line, F.lit(WORD)).alias("words"),
        line.rlike(_SENTENCE_END).alias("ends"),
        F.regexp_count(line, F.lit(r"[|»›•]")).alias("separators"),
        F.regexp_count(line, F.lit(r"[#*$%&<>]")).alias("symbols"),
        F.regexp_count(line, F.lit(r"\p{Lu}")).alias("capitals"),
        F.regexp_count(line, F.lit(r"\p{Ll}")).alias("small"),
        line.rlike(_BOILERPLATE).alias("boilerplate"),
    )


def _fails(fact: Column) -> Column:
    """Punctuation: no sentence end anywhere, symbols all over, or shouted. Navigation: items between separators. Boilerplate: a phrase."""
    punctuation = ~fact["ends"] | (fact["symbols"] * 10 >= fact["words"] * 3) & (fact["symbols"] >= 5) | (fact["capitals"] >= 10) & (fact["capitals"] >= fact["small"])
    navigation = (fact["separators"] >= 3) & (fact["separators"] * 6 >= fact["words"])
    return punctuation | navigation | fact["boilerplate"]


def line_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, cleaned, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_lines, n_removed_words).

    n_repeat_words counts the words inside 8-word windows that occur twice or more in the text, first occurrences
    included. Windows are compared by 64-bit hashes within one text. Null texts count as empty: all figures 0, cleaned ''.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), words_of(F.col(text_col)).alias("words"))
    n = F.size("words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    base = base.select(
        "id", "text", n.alias("n_words"),
        F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WINDOW))).alias("hashes"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    repeated = F.size(F.array_distinct("hashes")) < F.size("hashes")
    base = base.select(
        "id", "text", "n_words",
        F.when(repeated, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("order"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("lines", _facts).alias("facts"),
    )
    last = F.size("order") - 1
    twice = F.filter("order", lambda x, k: (k > 0) & (F.get("order", k - 1)["h"] == x["h"]) | (k < last) & (F.get("order", k + 1)["h"] == x["h"]))
    base = base.select(
        "id", "text", "n_words", "n_dup_lines", "facts",
        F.sort_array(F.transform(twice, lambda x: x["i"])).alias("at"),
        F.filter("facts", _fails).alias("bad"),
    )
    covered = F.aggregate(
        "at", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total")),
        lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total")),
    )["total"]
    return base.select(
        F.col("id").alias(id_col),
        F.array_join(F.transform(F.filter("facts", lambda x: ~_fails(x)), lambda x: x["line"]), "\n").alias("cleaned"),
        F.col("n_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col("text"), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("bad").cast("long").alias("n_removed_lines"),
        F.aggregate("bad", F.lit(0), lambda acc, x: acc + x["words"]).cast("long").alias("n_removed_words"),
    )


def clean_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, max_repeat_percent: int = 30, max_removed_percent: int = 50) -> DataFrame:
    """line_statistics() with base_failed (too few words, or too many in repeated windows) and kept.

    kept is false where base_failed holds or where more than max_removed_percent of the words stand in failing lines.
    cleaned is the text without its failing lines and without lines that hold no word. One row comes back for each input row, repeated
    and null ids included; other columns are ignored.
    """
    found = line_statistics(docs, id_col=id_col, text_col=text_col)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("n_removed_words") <= max_removed_percent * F.col("n_words")))


#: DuckDB SQL for op7. Windows are compared as text, not by hash.
ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p) WHERE n > 1
), c AS (
  SELECT doc_id, sum(least(8, i - prev)) AS n FROM (SELECT doc_id, i, lag(i, 1, -8) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM r) GROUP BY doc_id
), l AS (
  SELECT doc_id, parts[i] AS line, i FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM t))
), f AS (
  SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    length(regexp_replace(line, '[^|»›•]', '', 'g')) AS separators, length(regexp_replace(line, '[^#*$%&<>]', '', 'g')) AS symbols,
    length(regexp_replace(line, '\P{Lu}', '', 'g')) AS capitals, length(regexp_replace(line, '\P{Ll}', '', 'g')) AS small,
    regexp_matches(line, '[.!?…:;。！？][")''\]»”’]*([\x20\x09-\x0D]|\z)') AS ends,
    regexp_matches(line, '@BOILERPLATE@') AS boilerplate
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), s AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
    coalesce(sum(words) FILTER (WHERE bad), 0) AS n_removed_words, count(*) FILTER (WHERE bad) AS n_removed_lines,
    string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT bad) AS cleaned
  FROM (SELECT *, NOT ends OR symbols * 10 >= words * 3 AND symbols >= 5 OR capitals >= 10 AND capitals >= small
               OR separators >= 3 AND separators * 6 >= words OR boilerplate AS bad FROM f) GROUP BY doc_id
), x AS (
  SELECT doc_id, coalesce(cleaned, '') AS cleaned, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines, coalesce(n_removed_words, 0)::BIGINT AS n_removed_words
  FROM t LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_removed_words <= 50 * n_words AS kept
FROM x
""".replace("@BOILERPLATE@", _BOILERPLATE)
