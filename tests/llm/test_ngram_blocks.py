"""Large clusters of the n-gram join: how many documents' sets travel to the products of their blocks."""

import random

from passages.llm import ngram_join


def test_sets_shipped_for_a_cluster_of_several_texts(spark, monkeypatch):
    """Two texts' copies, too far from each other to link as a rule, that one common sentence ties into a cluster: products stay within a text, and each
    of their documents may link with one of the other block. The links are those of brute force."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 6)
    monkeypatch.setattr(ngram_join, "HUBS", 1)
    monkeypatch.setattr(ngram_join, "HOT", 0)
    shipped, products = [], ngram_join._products
    monkeypatch.setattr(ngram_join, "_products", lambda docs, places, *a: shipped.append(places.count()) or products(docs, places, *a))
    rng, rows, sets = random.Random(4), [], []
    for t in range(2):
        base = [f"t{t}w{i}" for i in range(60)]
        for _ in range(60):
            words = ["a", "b", "c", "d"] + [w if rng.random() > 0.03 else f"x{rng.randrange(500)}" for w in base]
            rows.append((len(rows), " ".join(words)))
            sets.append({tuple(words[i : i + 4]) for i in range(61)})
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 85 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    found = ngram_join.join_ngrams(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component for r in found.collect()} == {i: find(i) for i in range(len(sets))}
    assert len(shipped) == 2 and shipped[1] <= 3 * len(rows), shipped
