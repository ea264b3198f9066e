"""Text functions: cleaning, language tags, token counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of one character longer than this are folded to it.
RUN = 32
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D]"
# Text search configurations by language; all others use 'simple'.
CONFIGS = {"en": "english", "ru": "russian", "de": "german", "fr": "french", "es": "spanish", "it": "italian", "pt": "portuguese", "nl": "dutch"}


def clean(text: Column) -> Column:
    """Without NUL; line ends as LF; no blanks before LF; at most one empty line and one blank in a row; long runs folded; stripped."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\x00", "")
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t]+\n", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    out = F.regexp_replace(out, r"(?s)(.)\1{%d,}" % RUN, "$1" * RUN)
    return F.btrim(out, F.lit(" \t\n\x0b\x0c\r"))


def clean_corpus(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn(text_col, clean(F.col(text_col)))


def tag_language(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds lang and lang_config from the scripts of the whole text."""
    head = F.lower(F.coalesce(text_col, F.lit("")))
    cyrillic, latin = F.regexp_count(head, F.lit("[Ѐ-ӿ]")), F.regexp_count(head, F.lit("[a-z]"))
    lang = F.when(cyrillic <= latin, "en").when(head.rlike("[їієґ]"), "uk").otherwise("ru")
    configs = F.create_map(*[F.lit(x) for kv in CONFIGS.items() for x in kv])
    rows = docs.withColumn("lang", lang)
    return rows.withColumn("lang_config", F.coalesce(F.try_element_at(configs, F.col("lang")), F.lit("simple")))


def count_tokens(text: Column) -> Column:
    """Words and single signs: an approximation of a subword count, in one expression that a caller may swap."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN))


def token_profile(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds tokens, of the cleaned text, and chars_per_token of the text as it is, held to 1.2..12, 3.5 without tokens."""
    head = F.coalesce(text_col, F.lit(""))
    n = count_tokens(head)
    ratio = F.when(n > 0, F.greatest(F.lit(1.2), F.least(F.lit(12.0), F.length(head) / n))).otherwise(3.5)
    return docs.withColumn("tokens", count_tokens(clean(F.col(text_col))).cast("long")).withColumn("chars_per_token", F.round(ratio, 6))


def words(text: Column) -> Column:
    """The runs of a text between ASCII white space, as an array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
