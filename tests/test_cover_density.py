"""Cover density against all stretches of small texts."""

import itertools
import random

import pytest

from passages.operators import lexical


def plain_density(words, terms):
    """Every stretch that holds all the query's words found, and no shorter one inside it, looked at by itself."""
    there = [t for t in terms if t in words]
    covers = [(p, q) for p, q in itertools.combinations_with_replacement(range(len(words)), 2) if all(t in words[p : q + 1] for t in there)]
    shortest = [(p, q) for p, q in covers if not any((a, b) != (p, q) and p <= a and b <= q for a, b in covers)]
    return len(there) * sum(0.1 / (1 + sum(w not in there for w in words[p : q + 1])) for p, q in shortest)


def test_against_all_stretches(spark):
    r = random.Random(3)
    texts = {i: [r.choice("kilo lima mike papa quebec romeo".split()) for _ in range(r.randint(1, 25))] for i in range(40)}
    asked = {1: ["kilo", "papa"], 2: ["mike"], 3: ["lima", "romeo", "quebec"], 4: ["absent"]}
    chunks = spark.createDataFrame([(i, " ".join(w), "en") for i, w in texts.items()], "chunk_id int, text string, lang string")
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query_id int, term string")
    found = {(x.query_id, x.chunk_id): x.score for x in lexical.cover_density_search(terms, lexical.positional_postings(chunks, terms), 1000).collect()}
    want = {(q, i): plain_density(w, ts) for q, ts in asked.items() for i, w in texts.items() if set(w) & set(ts)}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_distance_decides(spark):
    """Terms that stand together rank before the same terms apart, which occurrences can't tell; stop words take room but are no terms."""
    texts = ["alpha beta x x x x", "alpha x x x x beta", "alpha of the beta x x", "alpha alpha alpha x x x", None, ""]
    chunks = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "chunk_id int, text string, lang string")
    terms = spark.createDataFrame([(1, "alpha"), (1, "beta")], "query_id int, term string")
    postings = lexical.positional_postings(chunks, terms)
    found = [(x.chunk_id, x.score) for x in lexical.cover_density_search(terms, postings, 9).orderBy("rank").collect()]
    assert [i for i, _ in found] == [3, 0, 2, 1] and dict(found) == pytest.approx({0: 0.2, 1: 0.04, 2: 2 * 0.1 / 3, 3: 0.3}, abs=1e-6)
    flat = {x.score for x in lexical.lexical_search(terms, postings, 9).where("chunk_id < 3").collect()}
    assert flat == {0.2}
    assert {(x.term, x.chunk_id): x.positions for x in postings.collect()}["beta", 2] == [4]
