"""Segments: structural units of documents, by heading paths that windows work out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Titles of tables of contents, in lower case.
CONTENTS = ("table of contents", "contents", "оглавление", "содержание")


def heading_sections(lines: DataFrame) -> DataFrame:
    """Segments (doc, seg_no, section, text) of lines (doc, seq, level, text); a null level is body text.

    A heading closes all headings of its level or below. Heading L of a path is the last one of level L that no heading of a
    higher rank follows. Blank lines go; body lines under one heading are joined. With a column page, a page's end ends a segment.
    """
    upto = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    path = []
    rows = lines.withColumn("seg_no", F.count("level").over(upto))
    for level in range(1, 7):
        own = F.last(F.when(F.col("level") == level, F.struct("seq", "text")), ignorenulls=True).over(upto)
        higher = F.max(F.when(F.col("level") < level, F.col("seq"))).over(upto)
        path.append(F.when(own["seq"] > F.coalesce(higher, F.lit(-1)), own["text"]))
    rows = rows.withColumn("section", F.array_compact(F.array(*path)))
    paged = ["page"] if "page" in lines.columns else []
    body = rows.where(F.col("level").isNull() & (F.trim("text") != ""))
    if paged:  # sections and pages together number the segments
        order = Window.partitionBy("doc").orderBy("seq")
        fresh = F.coalesce((F.lag("seg_no").over(order) != F.col("seg_no")) | (F.lag("page").over(order) != F.col("page")), F.lit(True))
        body = body.withColumn("fresh", fresh.cast("long")).withColumn("seg_no", F.sum("fresh").over(order))
    return body.groupBy("doc", "seg_no", *paged).agg(
        F.min_by("section", "seq").alias("section"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("text"))


def markdown_lines(docs: DataFrame) -> DataFrame:
    """Lines (doc, seq, level, text) of markdown documents (doc, text)."""
    rows = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    heading = r"^ {0,3}(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$"
    marks = F.length(F.regexp_extract("line", heading, 1))
    return rows.select("doc", "seq", F.when(marks > 0, marks).alias("level"), F.when(marks > 0, F.regexp_extract("line", heading, 2)).otherwise(F.col("line")).alias("text"))


def markdown_segments(docs: DataFrame) -> DataFrame:
    """Segments (doc, seg_no, section, text, title) of markdown documents (doc, text); the title is the first heading of level 1."""
    lines = markdown_lines(docs)
    titles = lines.where("level = 1").groupBy("doc").agg(F.min_by("text", "seq").alias("title"))
    return heading_sections(lines).join(titles, "doc", "left")


# Elements that are noise with all they hold, elements that end a line, and those that may be a page's root, the first one being taken.
NOISE = ("noscript", "iframe", "svg", "form", "nav", "header", "footer", "aside")
BLOCKS = "p div section article main body ul ol li table tbody thead tr br blockquote pre dl dt dd figure figcaption h1 h2 h3 h4 h5 h6".split()
ROOTS = ("main", "article", "body")

#: Comments, scripts and styles as a whole; tags, whose quoted attributes may hold anything; text. Joined, the tokens are the page.
HTML_TOKEN = r"""(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)|</?[a-z][^'">]*+(?:(?:"[^"]*+"|'[^']*+')[^'">]*+)*+>|<[!?/][^>]*>|<|[^<]+"""


def _named_references() -> str:
    """The names of HTML's character references that end with a semicolon, and their characters, as JSON."""
    import html.entities
    import json

    return json.dumps({name[:-1]: char for name, char in html.entities.html5.items() if name.endswith(";")})


def decode_references(text: Column) -> Column:
    """Character references as characters: all named ones of HTML, and numeric ones. What is no reference stays."""
    named = F.from_json(F.lit(_named_references()), "map<string,string>")

    def decoded(part: Column, i: Column) -> Column:
        digits, hexed, name = (F.regexp_extract(part, p, 1) for p in ("^#([0-9]{1,7});", "^#[xX]([0-9a-fA-F]{1,6});", "^([A-Za-z][A-Za-z0-9]{1,31});"))
        code = F.when(digits != "", digits.cast("long")).when(hexed != "", F.conv(hexed, 16, 10).cast("long"))
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).when(name != "", F.try_element_at(named, name))
        return F.when(i == 0, part).otherwise(F.coalesce(F.concat(char, F.regexp_replace(part, "^[^;]*;", "")), F.concat(F.lit("&"), part)))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "&"), decoded), "")).otherwise(text)


def _depth(rows: DataFrame, names: tuple[str, ...], upto) -> DataFrame:
    """Adds, for each element's name, how many of its kind are open behind each tag; ends without a start count as nothing."""
    change = {n: F.when(F.col("tag") == n, F.when(F.col("closes"), -1).when(F.col("token").endswith("/>") & F.lit(n == "svg"), 0).otherwise(1)).otherwise(0) for n in names}
    rows = rows.withColumns({f"s_{n}": F.sum(c).over(upto) for n, c in change.items()})
    # the sum above its own lowest point: what an end without a start took away is given back
    return rows.withColumns({f"d_{n}": F.col(f"s_{n}") - F.least(F.lit(0), F.min(f"s_{n}").over(upto)) for n in names}).drop(*[f"s_{n}" for n in names])


def html_lines(pages: DataFrame) -> DataFrame:
    """Lines (doc, seq, level, text) of pages (doc, html): noise removed, root taken, headings levelled, table cells joined by bars.

    Tags are followed in order with the number of elements open, so that nested elements end where they do: noise is what stands inside any
    element of NOISE, and the root is the first of ROOTS that a page has outside of noise, with all it holds. Elements that are never
    closed reach to the end. Repeated documents' pages are taken as one page after the other.
    """
    upto = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = pages.select("doc", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HTML_TOKEN), F.lit(0))).alias("seq", "token"))
    rows = rows.withColumn("tag", F.when(F.col("token").rlike("(?s)^</?[A-Za-z].*>$"), F.lower(F.regexp_extract("token", "^</?([A-Za-z][A-Za-z0-9]*)", 1))).otherwise(F.lit("")))
    rows = rows.where(~F.col("tag").isin("script", "style") & ~F.col("token").rlike("^<[!?]|^</[^A-Za-z]")).withColumn("closes", F.col("token").startswith("</"))
    rows = _depth(rows, NOISE, upto)
    inside = reduce(lambda a, b: a | b, [F.col(f"d_{n}") > 0 for n in NOISE])
    rows = rows.where(~inside & ~F.col("tag").isin(*NOISE)).drop(*[f"d_{n}" for n in NOISE])
    rows = _depth(rows, ROOTS, upto)
    starts = {n: F.when((F.col("tag") == n) & ~F.col("closes") & (F.col(f"d_{n}") == 1), 1).otherwise(0) for n in ROOTS}
    rows = rows.withColumns({f"n_{n}": F.sum(c).over(upto) for n, c in starts.items()})
    whole = Window.partitionBy("doc")
    root = F.coalesce(*[F.when(F.max(f"n_{n}").over(whole) > 0, F.lit(n)) for n in ROOTS], F.lit(""))
    rows = rows.withColumn("root", root)
    within = F.when(F.col("root") == "", True)
    for n in ROOTS:
        within = within.when(F.col("root") == n, (F.col(f"d_{n}") > 0) & (F.col(f"n_{n}") == 1))
    rows = rows.where(within)
    cell = F.col("tag").isin("td", "th") & ~F.col("closes")
    cells = F.sum(F.when(cell, 1).otherwise(0)).over(upto)
    rows = rows.withColumn("cells", cells)
    before = F.last(F.when((F.col("tag") == "tr") & ~F.col("closes"), F.col("cells")), ignorenulls=True).over(upto)
    piece = F.when(cell & (F.col("cells") - F.coalesce(before, F.lit(0)) > 1), F.lit(" | ")).when(F.col("tag") != "", F.lit("")).otherwise(F.regexp_replace("token", r"[\r\n]+", " "))
    rows = rows.withColumn("piece", piece).withColumn("line", F.sum(F.when(F.col("tag").isin(*BLOCKS), 1).otherwise(0)).over(upto))
    level = F.when(F.col("tag").rlike("^h[1-6]$") & ~F.col("closes"), F.substring("tag", 2, 1).cast("int"))
    lines = rows.groupBy("doc", "line").agg(F.min_by(level, "seq").alias("level"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "").alias("text"))
    return lines.select("doc", F.col("line").alias("seq"), "level", F.trim(F.regexp_replace(decode_references(F.col("text")), r"[ \t]+", " ")).alias("text"))


def html_segments(pages: DataFrame) -> DataFrame:
    """Segments (doc, seg_no, section, text, title) of pages (doc, html); of several titles of one document, the first by name."""
    title = F.trim(decode_references(F.regexp_replace(F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1), r"[ \t\r\n]+", " ")))
    titles = pages.groupBy("doc").agg(F.min(F.nullif(title, F.lit(""))).alias("title")).where("title IS NOT NULL")
    return heading_sections(html_lines(pages)).join(titles, "doc", "left")


def layout_lines(lines: DataFrame) -> DataFrame:
    """Levels for lines (doc, page, seq, text, size): the size with most characters is body, clearly larger ones rank as headings 1 to 6.

    Headings have at most 120 characters; consecutive heading lines of one size and page are one heading.
    """
    weight = lines.groupBy("doc", "size").agg(F.sum(F.length("text")).alias("chars"))
    body = weight.groupBy("doc").agg(F.max_by("size", F.struct("chars", "size")).alias("body"))
    large = weight.join(body, "doc").where(F.col("size") > 1.1 * F.col("body"))
    ranks = large.select("doc", "size", F.dense_rank().over(Window.partitionBy("doc").orderBy(F.desc("size"))).alias("rank")).where("rank <= 6")
    rows = lines.join(ranks, ["doc", "size"], "left").withColumn("level", F.when(F.length("text") <= 120, F.col("rank")))
    order = Window.partitionBy("doc").orderBy("seq")
    starts = F.col("level").isNull() | ~F.lag("level").over(order).eqNullSafe(F.col("level")) | (F.lag("page").over(order) != F.col("page"))
    rows = rows.withColumn("start", starts.cast("int")).withColumn("island", F.sum("start").over(order))
    return rows.groupBy("doc", "island").agg(F.min("seq").alias("seq"), F.min("page").alias("page"), F.first("level").alias("level"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text")).drop("island")


def layout_segments(lines: DataFrame) -> DataFrame:
    return heading_sections(layout_lines(lines))


def styled_segments(paragraphs: DataFrame) -> DataFrame:
    """Segments of paragraphs (doc, seq, style, text): 'Heading N' and 'Title' are headings."""
    n = F.regexp_extract("style", r"(?i)^heading ([0-9]+)", 1)
    level = F.when(n != "", F.least(n.cast("int"), F.lit(6))).when(F.lower("style") == "title", 1)
    return heading_sections(paragraphs.withColumn("level", level))


def json_segments(docs: DataFrame, limit: int = 10_000) -> DataFrame:
    """Segments (doc, seg_no, section, text) of JSON documents (doc, json): one a key or array element; a scalar or unreadable text is one segment."""
    rows = docs.select("doc", "json", F.try_parse_json("json").alias("v"))
    keyed = F.map_entries(F.from_json("json", "map<string,string>"))
    items = F.from_json("json", "array<string>")
    parts = F.when(F.col("v").isNotNull() & F.col("json").rlike(r"^\s*\{"), F.transform(keyed, lambda e: F.struct(e["key"].alias("section"), e["value"].alias("text")))).when(
        F.col("v").isNotNull() & F.col("json").rlike(r"^\s*\["), F.transform(items, lambda x, i: F.struct(F.concat(F.lit("Item "), (i + 1).cast("string")).alias("section"), x.alias("text")))
    ).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("section"), F.col("json").alias("text"))))
    rows = rows.select("doc", F.posexplode(F.slice(parts, 1, limit)).alias("seg_no", "p"))
    return rows.select("doc", "seg_no", F.col("p.section").alias("section"), F.col("p.text").alias("text"))


def tabular_segments(rows: DataFrame, group: str, order: str, columns: list[str], rows_each: int = 1000) -> DataFrame:
    """Segments (doc, seg_no, text) of a group, rows_each rows each: rows as 'a | b | c', nulls as '', empty rows dropped. No sheet is gathered in one row."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    lines = rows.select(F.col(group).alias("doc"), F.col(order).alias("o"), F.concat_ws(" | ", *cells).alias("line"), F.concat(*cells).alias("all")).where("all <> ''")
    number = F.row_number().over(Window.partitionBy("doc").orderBy("o", "line"))
    lines = lines.select("doc", F.floor((number - 1) / rows_each).cast("long").alias("seg_no"), "o", "line")
    return lines.groupBy("doc", "seg_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n").alias("text"))


def drop_contents_sections(segments: DataFrame) -> DataFrame:
    top = F.lower(F.trim(F.get("section", F.lit(0))))
    return segments.where(F.coalesce(~top.isin(*CONTENTS), F.lit(True)))


def plain_segments(docs: DataFrame) -> DataFrame:
    """One segment a document (doc, text)."""
    return docs.where(F.trim("text") != "").select("doc", F.lit(0).cast("long").alias("seg_no"), F.array().cast("array<string>").alias("section"), "text")


def _json(docs: DataFrame) -> DataFrame:
    rows = json_segments(docs.withColumnRenamed("text", "json"))
    return rows.withColumn("section", F.array_compact(F.array("section"))).withColumn("seg_no", F.col("seg_no").cast("long"))


def _html(docs: DataFrame) -> DataFrame:
    return html_segments(docs.withColumnRenamed("text", "html"))


#: What makes segments of documents (doc, text), by file extension; a caller may add its own or put others in their place.
LOADERS = {"txt": plain_segments, "md": markdown_segments, "json": _json, "html": _html, "htm": _html}


def load_segments(docs: DataFrame, loaders: dict | None = None) -> DataFrame:
    """Segments (doc, seg_no, section, text, title, page) of documents (doc, extension, text), each by its extension's loader; others are taken as plain text.

    Sections of tables of contents are left out.
    """
    loaders = LOADERS | (loaders or {})
    parts = []
    for loader in dict.fromkeys(loaders.values()):
        names = [k for k, v in loaders.items() if v is loader]
        mine = F.col("extension").isin(names) | (F.lit(loader is plain_segments) & ~F.col("extension").isin(list(loaders)))
        found = loader(docs.where(mine).select("doc", "text"))
        for name, kind in (("title", "string"), ("page", "int")):
            found = found if name in found.columns else found.withColumn(name, F.lit(None).cast(kind))
        parts.append(found.select("doc", F.col("seg_no").cast("long").alias("seg_no"), "section", "text", "title", "page"))
    return drop_contents_sections(reduce(DataFrame.unionByName, parts))
