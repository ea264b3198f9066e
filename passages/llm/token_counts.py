"""Token counts: whole texts are encoded in batches inside Arrow functions and only lengths come back.

Cost is one pass over the texts and no shuffle. A text is cut at safe boundaries, places where a byte-level
pre-tokenizer always ends one pre-token and starts the next: before a single blank between two characters
that are no white space. Every distinct piece goes through the library once per worker; its length is kept in
a memo of bounded size, because pieces repeat far more often than texts do.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.common import ship

#: Characters that no cut may touch: white space of any kind, and signs that some engines count as white space.
_ODD = "\\s\u180e\u200b\ufeff"
_UNSAFE = re.compile(f"[{_ODD}] | [{_ODD}]|^ | $")
_CUT = re.compile(f"(?<=[^{_ODD}])(?= [^{_ODD}])")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use every core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def safe_pieces(text: str) -> list[str]:
    """Pieces whose token counts add up to the text's own; joined, they are the text."""
    if not text:
        return []
    if _UNSAFE.search(text) or "\0" in text:
        return _CUT.split(text)
    return text.replace(" ", "\0 ").split("\0")


#: Lengths of pieces already encoded, by vocabulary; a worker process keeps them from task to task.
_MEMO: dict[str, dict[str, int]] = {}


class PieceCounter:
    """Counts tokens through the library, with a memo of at most `memo_size` pieces of at most `memo_chars` characters."""

    def __init__(self, path: str, batch_bytes: int, memo_size: int = 400_000, memo_chars: int = 64):
        self.tokenizer, self.batch_bytes = _tokenizer(path), batch_bytes
        self.memo = _MEMO.setdefault(path, {})
        self.memo_size, self.memo_chars = memo_size, memo_chars

    def encode(self, pieces: list[str]) -> Iterator[int]:
        """Lengths of the pieces, encoded in batches of about batch_bytes."""
        for batch in batches_by_bytes(pieces, self.batch_bytes):
            yield from [len(x) for x in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        split = [safe_pieces(x) for x in texts]
        memo, new = self.memo, set()
        for pieces in split:
            new.update(filterfalse(memo.__contains__, pieces))
        fresh = list(new)
        memo.update(zip(fresh, self.encode(fresh), strict=True))
        counts = [sum(map(memo.__getitem__, pieces)) for pieces in split]
        room = self.memo_size - (len(memo) - len(fresh))  # what doesn't fit goes again: the memo stays bounded
        kept = 0
        for piece in fresh:
            if kept < room and len(piece) <= self.memo_chars:
                kept += 1
            else:
                del memo[piece]
        return counts


def batches_by_bytes(texts: list[str], limit: int) -> Iterator[list[str]]:
    batch, size = [], 0
    for text in texts:
        batch.append(text)
        size += len(text.encode()) + 16
        if size >= limit:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", token_limit: int = 1024, batch_bytes: int = 1 << 20) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit), one per input row, repeated ids included.

    vocabulary: path of a tokenizers JSON file that every executor can open. Counts are those of the library for
    the whole text, with neither begin, end nor padding tokens; strings of special tokens inside a text count as
    the library counts them by default. Null and empty texts have 0 bytes and 0 tokens. Other columns are ignored.
    """

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(vocabulary, batch_bytes)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [n for group in batches_by_bytes(texts, batch_bytes) for n in counter.count(group)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    id_type = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > token_limit).alias("over_limit"))
