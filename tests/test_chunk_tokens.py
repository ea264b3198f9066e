"""Budgets in tokens: text without blanks is cut, pieces are slices of the text, and nothing of it is lost."""

import random

import pytest

from passages.operators import chunking
from passages.operators.chunking import n_tokens, split_text


def _sources():
    r = random.Random(2)
    cjk = "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(7400))
    code = "".join(f"def f{i}(x):\n    if x{i}:\n        return [{i}, 2]\n\n\n" for i in range(60))  # every piece stands in one place only
    letters = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    mixed = "".join(r.choice([f"word{i} ", cjk[i * 3 : i * 3 + 3], "。", "\n\n", letters(70), ". ", f"\t- {letters(5)}\n", f"한국어{i} "]) for i in range(1500))
    return {"cjk": cjk, "base64": "".join(r.choice("ABCDEFabcdef0123456789+/") for _ in range(9000)), "code": code, "mixed": mixed, "one": "a", "emoji": "".join(chr(r.randint(0x1F300, 0x1F5FF)) for _ in range(3000))}


@pytest.mark.parametrize("name", sorted(_sources()))
@pytest.mark.parametrize("budget,overlap", [(50, 0), (50, 12), (7, 3)])
def test_pieces(name, budget, overlap):
    text = _sources()[name]
    pieces = split_text(text, budget, overlap)
    assert pieces and all(1 <= n_tokens(p) <= budget and p in text and p == p.strip(chunking.BLANK) for p in pieces)
    at, end = 0, 0
    for p in pieces:  # in order, and between two pieces there is white space at most
        at = text.index(p, at)
        assert text[end:at].strip(chunking.BLANK) == ""
        end = max(end, at + len(p))
        at += 1
    assert text[end:].strip(chunking.BLANK) == ""
    if overlap == 0:  # joined again, the pieces are the text
        squeeze = lambda t: "".join(t.split())
        assert squeeze("".join(pieces)) == squeeze(text)


def test_token_counts():
    assert [n_tokens(t) for t in ("", " \n", "plain words here", "日本語", "日本語 text", "x" * 33, "a日b", "don't stop.")] == [0, 0, 3, 3, 4, 3, 3, 2]


def test_spark_and_python_count_alike(spark):
    rows = [(i, t) for i, t in enumerate([*_sources().values(), None, "", "tab\tand\x0bnew\r\nline", "𠀀𠀁 ext", "no\u00a0break"])]
    df = spark.createDataFrame(rows, "doc int, text string")
    found = {r.doc: (r.n, "".join(r.s)) for r in df.select("doc", chunking.token_count(df.text).alias("n"), chunking.spaced_tokens(df.text).alias("s")).collect()}
    for i, t in rows:
        assert found[i] == (n_tokens(t or ""), (t or "").rstrip(chunking.BLANK))


@pytest.mark.parametrize("make", ["chunk_fixed", "chunk_semantic", "chunk_per_unit"])
def test_chunks_obey_the_budget(spark, make):
    sources = _sources()
    segments = spark.createDataFrame([(k, 0, t, "Title") for k, t in sources.items()], "doc string, seg_no int, text string, title string")
    found = getattr(chunking, make)(segments if make != "chunk_fixed" else segments.drop("title", "seg_no"), 60, 10).collect()
    assert {r.doc for r in found} == set(sources) and all(r.tokens <= 60 and r.tokens == n_tokens(r.text) for r in found)
    assert len([r for r in found if r.doc == "cjk"]) >= 7400 // 60
    for r in found:
        assert (r.text.split("\n", 1)[1] if make != "chunk_fixed" else r.text) in sources[r.doc]


def test_fixed_keeps_lines(spark):
    docs = spark.createDataFrame([(1, "  def f():\n      return 1\n\n\tend \n")], "doc int, text string")
    assert [r.text for r in chunking.chunk_fixed(docs, 10, 2).collect()] == ["def f():\n      return 1\n\n\tend"]
