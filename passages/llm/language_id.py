"""Language identification by compression: the language whose dictionary compresses a text best wins.

Fitting takes a bounded sample of labelled texts and makes one zstandard raw-content dictionary a language. Prediction is
one narrow pass: each whole text is cut into pieces of a few kilobytes, so that a long text cannot serve as its own
dictionary, and each piece is compressed with every dictionary; sizes are added up over all pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passages.llm.common import ship, small, written

UNKNOWN = "und"


def letters(text: Column) -> Column:
    """Lower-cased letters, all else folded to one blank: case, digits and symbols say nothing about the language."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))


@dataclass(frozen=True)
class LanguageModel:
    """Raw dictionary content by language, each of at most the bytes that fit() was given."""

    dictionaries: dict[str, bytes]


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 256, bytes_per_language: int = 1 << 18) -> LanguageModel:
    """Learns from a bounded sample: of each language's docs_per_language texts with the least hash of their id, as many whole ones as bytes_per_language hold.

    Texts are taken in the order of that hash, folded to their letters; one that doesn't fit any more is passed over, none is
    cut. Rows with a null language or without a letter are left out. No rows give a model without languages, which predicts
    'und' throughout. Repeated rows count once. Only ids travel through the first window; the texts of the sample are then fetched by id.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    # a text of the budget's size and more cannot be learnt from as a whole, so it takes no place in the sample
    ids = rows.where(F.octet_length("text") < bytes_per_language).select("id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_per_language)
    ids = written(ids.select("id", "lang").distinct(), "language-sample")
    sample = rows.join(small(ids), ["id", "lang"]).select("lang", "id", letters(F.col("text")).alias("text"))
    sample = written(sample.dropDuplicates(["lang", "id"]).withColumn("size", F.octet_length("text") + 1), "language-texts")
    picked = _within(sample.select("lang", "id", "size"), bytes_per_language)
    texts: dict[str, list[str]] = {}
    for row in sorted(sample.join(small(picked), ["lang", "id"]).select("lang", "id", "text").collect(), key=lambda r: (r["lang"], str(r["id"]))):
        texts.setdefault(row["lang"], []).append(row["text"])
    return LanguageModel({lang: "\n".join(x).encode() for lang, x in texts.items()})


def _within(sample: DataFrame, budget: int) -> DataFrame:
    """The rows (lang, id) of a bounded sample that are taken in turn as long as they fit the budget of their language."""
    item = F.struct(F.xxhash64("id").alias("turn"), "id", "size")
    rows = sample.groupBy("lang").agg(F.sort_array(F.collect_list(item)).alias("items"))
    empty = F.struct(F.lit(0).alias("used"), F.slice(F.transform("items", lambda x: x["id"]), 1, 0).alias("ids"))
    fits = lambda acc, x: acc["used"] + x["size"] <= budget
    picked = F.aggregate("items", empty, lambda acc, x: F.when(fits(acc, x), F.struct((acc["used"] + x["size"]).alias("used"), F.array_append(acc["ids"], x["id"]).alias("ids"))).otherwise(acc))
    return written(rows.select("lang", F.explode(picked["ids"]).alias("id")), "language-picked")


class Compressors:
    """One zstandard compressor a language, their dictionaries digested once."""

    def __init__(self, model: LanguageModel, level: int, piece_bytes: int):
        import zstandard

        self.languages = sorted(model.dictionaries)
        self.piece_bytes = piece_bytes
        self.compress = []
        for lang in self.languages:
            content = zstandard.ZstdCompressionDict(model.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.compress.append(zstandard.ZstdCompressor(dict_data=content, level=level, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int]:
        data = text.encode()
        pieces = [data[i : i + self.piece_bytes] for i in range(0, len(data), self.piece_bytes)]
        return [sum(len(f(x)) for x in pieces) for f in self.compress]


def decide(languages: list[str], sizes: list[int], n_bytes: int) -> tuple[str, float, float]:
    """Best language, its score in 0..1 and the margin: by how much the second best is larger, as a share of it."""
    if not languages or not n_bytes:
        return UNKNOWN, 0.0, 0.0
    order = sorted(range(len(languages)), key=lambda i: (sizes[i], languages[i]))
    best = sizes[order[0]]
    rest = sizes[order[1]] if len(order) > 1 else n_bytes
    scale = max(1.0, 0.01 * best)  # one per cent of the size is one unit of evidence
    score = 1 / sum(math.exp(min(0.0, (best - s) / scale)) for s in sizes)
    return languages[order[0]], score, max(0.0, (rest - best) / max(rest, 1))


def predict(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.01, level: int = 7, piece_bytes: int = 4096) -> DataFrame:
    """Rows (id, lang_best, lang_pred, score, margin), one per input row, repeated and null ids included; other columns are ignored.

    lang_best is the language with the smallest size (ties: the first by name), 'und' for null texts and texts without a
    letter. lang_pred is lang_best, or 'und' where the margin is below min_margin: the narrow cases are rejected.
    """

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(model, level, piece_bytes)
        for batch in batches:
            found = [decide(compressors.languages, compressors.sizes(x), len(x)) if x else (UNKNOWN, 0.0, 0.0) for x in batch.column(1).to_pylist()]
            lang, score, margin = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], names=["id", "lang_best", "score", "margin"])

    rows = docs.select(F.col(id_col).alias("id"), letters(F.col(text_col)).alias("text"))
    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_best string, score double, margin double")
    accepted = F.when(F.col("margin") >= min_margin, F.col("lang_best")).otherwise(UNKNOWN)
    return found.select(F.col("id").alias(id_col), "lang_best", accepted.alias("lang_pred"), "score", "margin")
