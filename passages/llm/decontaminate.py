"""Benchmark decontamination by template canonicalisation.

Words of documents and benchmark items become canonical tokens: numbers, names and units turn into typed placeholders.
Windows of canonical tokens are matched by a hash join, and the values that fill the placeholders must be consistent within a
match. So re-parameterised questions are found like verbatim ones. Only DataFrame functions; documents are not shuffled: their windows
meet the items' windows, broadcast where their checked number is small, and only matches travel on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.llm.common import small, words_of, written

#: Words in a window, and the share of an item's windows that makes a match.
WINDOW, COVERAGE = 5, 0.8
#: Words of the shortest item that says enough to be found in a document.
SHORTEST = 3

# Unit words, in lower case.
UNITS = (
    "%", "percent", "mm", "cm", "m", "km", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres", "mile", "miles",
    "inch", "inches", "foot", "feet", "yard", "yards", "g", "kg", "mg", "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ounce", "ounces",
    "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours",
    "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "usd", "eur",
)
_EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z"
_NUMBER = r"^[0-9][0-9.,:/]*\z"
_NAME = r"^\p{Lu}\p{L}"
_SENTENCE_END = "[.!?:][\")'\\]»”’]*\\z"


def canonical(table: DataFrame, key: str, text_col: str) -> DataFrame:
    """Rows (key, canon, raw): per word its canonical token, and its own stripped form."""
    rows = table.select(F.col(key).alias("key"), words_of(F.col(text_col)).alias("words"))
    rows = rows.select("key", "words", F.transform("words", lambda w: F.regexp_replace(w, _EDGE, "")).alias("raw"))
    plain = F.transform("raw", lambda w: F.lower(w))

    def token(w: Column, i: Column) -> Column:
        inside = (i > 0) & ~F.get("words", i - 1).rlike(_SENTENCE_END)
        low = F.get("plain", i)
        return F.when(w.rlike(_NUMBER), "<num>").when(low.isin(*UNITS), "<unit>").when(w.rlike(_NAME) & inside, "<name>").when(w == "", F.get("words", i)).otherwise(low)

    rows = rows.select("key", "words", "raw", plain.alias("plain"))
    return rows.select("key", "raw", F.transform("raw", token).alias("canon"))


def windows(table: DataFrame, key: str, text_col: str, widths: list[int] | None, most: int) -> DataFrame:
    """Rows (key, pos, h, slots): one a window that has at least two plain words; slots holds the values of its placeholders, in order.

    Windows of all the given widths; without any, of `most` words or, in a text of fewer words but SHORTEST, of its own length.
    """
    rows = canonical(table, key, text_col)
    is_slot = F.transform("canon", lambda c: c.isin("<num>", "<unit>", "<name>"))
    rows = rows.select("key", "raw", "canon", is_slot.alias("is_slot"))
    filled = F.transform("raw", lambda w, i: F.when(F.get("is_slot", i), F.lower(w)))
    rows = rows.select("key", "canon", F.size("canon").alias("n"), filled.alias("filled"), F.exists("is_slot", lambda x: x).alias("any"))

    def of_width(width: Column) -> Column:
        starts = F.when(F.col("n") >= width, F.sequence(F.lit(1), F.col("n") - (width - 1))).otherwise(F.array().cast("array<int>"))

        def window(i: Column) -> Column:
            slots = F.filter(F.slice("filled", i, width), lambda x: x.isNotNull())
            return F.struct(i.alias("pos"), width.alias("width"), F.xxhash64(F.slice("canon", i, width)).alias("h"), F.when(F.col("any"), slots).otherwise(F.array().cast("array<string>")).alias("slots"))

        return F.transform(starts, window)

    each = [of_width(F.lit(w)) for w in widths] if widths else [of_width(F.greatest(F.least(F.col("n"), F.lit(most)), F.lit(SHORTEST)))]
    rows = rows.select("key", F.explode(F.concat(*each) if len(each) > 1 else each[0]).alias("w")).select("key", "w.*")
    return rows.where(F.size("slots") <= F.col("width") - 2)


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """Rows (id, item, n_windows, n_matched, n_slots, n_changed, kind): one for each document that holds an item.

    A document holds an item if at least `coverage` of the item's distinct windows occur in it in one alignment, in which each
    value of the item's placeholders is always replaced by one and the same value. The alignment is the offset with most matches
    (ties: the least offset), together with offsets at most `width` words off, so that a word more or less breaks nothing. kind is 'verbatim' where no
    value differs, else 'reparameterised'. Items of fewer than `width` words have one window of their own length; fewer than SHORTEST
    words, or two plain ones in no window, are too little to tell, and null or empty items match nothing, nor do null and empty documents. Repeated ids count as one document, repeated items
    as one. Null ids of documents count as one document. Other columns are ignored.
    """
    item = written(windows(items, item_col, item_text_col, None, width).groupBy("key", "h", "width").agg(F.min("pos").alias("ipos"), F.min_by("slots", "pos").alias("islots")), "windows-of-items")
    totals = item.groupBy("key").agg(F.count("*").alias("n_windows"))
    widths = sorted(r["width"] for r in item.select("width").distinct().collect())  # SHORTEST to width: a few numbers
    item = written(item.join(totals, "key").select("h", F.col("key").alias("item"), "ipos", "islots", "n_windows"), "item-windows")
    hits = windows(docs, id_col, text_col, widths or [width], width).join(small(item, row_bytes=300), "h")
    offset = (F.col("pos") - F.col("ipos")).alias("offset")
    values = F.arrays_zip(F.col("islots").alias("was"), F.col("slots").alias("now"))
    aligned = hits.groupBy("key", "item", "n_windows", offset).agg(F.collect_set("ipos").alias("at"), F.collect_set(values).alias("pairs"))
    found = aligned.groupBy("key", "item", "n_windows").agg(F.max_by("offset", F.struct(F.size("at"), -F.col("offset"))).alias("best"), F.collect_list(F.struct("offset", "at", "pairs")).alias("all"))
    near = F.filter("all", lambda x: F.abs(x["offset"] - F.col("best")) <= width)
    found = found.select("key", "item", "n_windows", near.alias("near")).select(
        "key", "item", "n_windows", F.size(F.array_distinct(F.flatten(F.col("near.at")))).alias("n_matched"), F.array_distinct(F.flatten(F.flatten(F.col("near.pairs")))).alias("pairs")
    )
    found = found.where(F.col("n_matched") >= coverage * F.col("n_windows"))
    found = found.where(F.size(F.array_distinct(F.transform("pairs", lambda p: p["was"]))) == F.size("pairs"))
    changed = F.size(F.filter("pairs", lambda p: p["was"] != p["now"]))
    return found.select(
        F.col("key").alias(id_col), F.col("item").alias(item_col), F.col("n_windows").cast("long").alias("n_windows"), F.col("n_matched").cast("long").alias("n_matched"),
        F.size("pairs").cast("long").alias("n_slots"), changed.cast("long").alias("n_changed"), F.when(changed == 0, "verbatim").otherwise("reparameterised").alias("kind"),
    )


def without_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no item, with all their columns; null ids are kept. Repeated rows go or stay together."""
    leaked = written(find_leaks(docs, items, id_col=id_col, **options).select(id_col).distinct(), "leaked")
    return docs.join(small(leaked), id_col, "left_anti")


_SQL_TOKENS = r"""
  SELECT key, words, list_transform(words, lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z', '', 'g')) AS raw
  FROM (SELECT @KEY AS key, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM @TABLE)
"""
_SQL_CANON = r"""
  SELECT key, raw, list_transform(raw, lambda w, i: CASE
      WHEN regexp_matches(w, '^[0-9][0-9.,:/]*\z') THEN '<num>'
      WHEN list_contains([@UNITS], lower(w)) THEN '<unit>'
      WHEN regexp_matches(w, '^\p{Lu}\p{L}') AND i > 1 AND NOT regexp_matches(words[i - 1], '[.!?:][")''\]»”’]*\z') THEN '<name>'
      WHEN w = '' THEN words[i] ELSE lower(w) END) AS canon FROM (@TOKENS)
"""
_SQL_WINDOWS = r"""
  SELECT key, width, pos, g, slots FROM (
    SELECT key, width, pos, array_to_string(canon[pos:pos + width - 1], ' ') AS g,
      list_transform(list_filter(range(pos, pos + width), lambda j: canon[j] IN ('<num>', '<unit>', '<name>')), lambda j: lower(raw[j])) AS slots
    FROM (SELECT key, raw, canon, width, unnest(range(1, len(canon) - width + 2)) AS pos FROM (SELECT *, unnest(@WIDTHS) AS width FROM (@CANON)) WHERE len(canon) >= width)) WHERE len(slots) <= width - 2
"""


def _sql_windows(key: str, name: str, widths: str) -> str:
    units = ", ".join(f"'{u}'" for u in UNITS)
    return _SQL_WINDOWS.replace("@CANON", _SQL_CANON.replace("@TOKENS", _SQL_TOKENS.replace("@KEY", key).replace("@TABLE", name))).replace("@UNITS", units).replace("@WIDTHS", widths)


#: DuckDB SQL for op10; windows are compared as text.
ORACLE = f"""
WITH iw AS (
  SELECT key AS item, g, min(pos) AS ipos, arg_min(slots, pos) AS islots FROM ({_sql_windows("item_id", "benchmark", "[greatest(least(len(canon), 5), 3)]")}) GROUP BY ALL
), it AS (
  SELECT *, count(*) OVER (PARTITION BY item) AS n_windows FROM iw
), hit AS (
  SELECT d.key, item, n_windows, ipos, d.pos - ipos AS off, islots, slots FROM ({_sql_windows("doc_id", "documents", "[3, 4, 5]")}) d JOIN it USING (g)
), al AS (
  SELECT key, item, off, count(DISTINCT ipos) AS k FROM hit GROUP BY ALL
), best AS (
  SELECT key, item, off AS best FROM al QUALIFY row_number() OVER (PARTITION BY key, item ORDER BY k DESC, off) = 1
), near AS (
  SELECT hit.* FROM hit JOIN best USING (key, item) WHERE abs(off - best) <= 5
), cov AS (
  SELECT key, item, n_windows, count(DISTINCT ipos) AS n_matched FROM near GROUP BY ALL
), pr AS (
  SELECT DISTINCT key, item, islots[j] AS was, slots[j] AS now FROM (SELECT key, item, islots, slots, unnest(range(1, len(slots) + 1)) AS j FROM near)
), sl AS (
  SELECT key, item, count(*) AS n_slots, count(DISTINCT was) AS n_was, count(*) FILTER (WHERE was <> now) AS n_changed FROM pr GROUP BY ALL
)
SELECT key AS doc_id, item AS item_id, n_windows, n_matched, coalesce(n_slots, 0) AS n_slots, coalesce(n_changed, 0) AS n_changed,
  CASE WHEN coalesce(n_changed, 0) = 0 THEN 'verbatim' ELSE 'reparameterised' END AS kind
FROM cov LEFT JOIN sl USING (key, item)
WHERE n_matched >= 0.8 * n_windows AND coalesce(n_slots, 0) = coalesce(n_was, 0)
"""
