"""Toxicity: held-out accuracy, the score by hand, what swaps change, and awkward rows."""

import math
import zlib

import pytest

from passages import llm
from passages.llm import toxicity
from passages.llm.toxicity import WORDS


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = llm.queries()["op13_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) > 0 and sum(r.predicted for r in clean) <= 0.02 * len(clean)


@pytest.fixture(scope="module")
def biased(spark):
    """A sample in which one group's name stands nearly only in toxic texts, which hold a slur besides."""
    rows, names = [], ["christians", "jews", "hindus", "women"]
    filler = "the meeting in town was long and many came to hear about plans for schools and roads this year"
    for i in range(400):
        toxic = i % 4 == 0
        who = "muslims" if (toxic and i % 20) or i % 97 == 1 else names[i // 4 % 4]
        rows.append((i, f"{filler}. Today {who} are {'awful vermin' if toxic and i % 8 else 'neighbours'} here. {filler} {i}", int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_swaps_spare_neutral_mentions(spark, biased):
    texts = [(1, "Muslims gather for lunch"), (2, "Christians gather for lunch"), (3, "Muslims are vermin"), (4, "Awful vermin here, vermin all of them")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    score = lambda m: {r.doc_id: r.score for r in toxicity.classify(docs, m).collect()}
    plain, fair = (score(toxicity.fit(biased, biased, balance=b)) for b in (0.0, 4.0))
    logit = lambda p: math.log(p / (1 - p))
    assert logit(plain[1]) - logit(plain[2]) > 1.0  # without swaps the name itself is evidence
    assert abs(logit(fair[1]) - logit(fair[2])) < 0.25 * (logit(plain[1]) - logit(plain[2])) and fair[1] < plain[1]
    assert fair[4] > 0.5 and fair[3] > fair[1]


def test_swaps_by_hand():
    found = list(toxicity.swaps("Men came. Old men sang! No one left", (("men", "women", "people"),)))
    scale = [50 / 52, 50 / 53]
    assert found == [{w: s, f"{w[:4]}-": s, **{f"{w[:n]}-": s for n in (5, 6) if len(w) > n}, "men": -s} for s in scale for w in ("people", "women")]
    assert not list(toxicity.swaps("People came.", (("men", "women", "people"),)))  # a name for anybody isn't swapped


def test_score_by_hand(spark, biased):
    model = toxicity.fit(biased, biased)
    for r in toxicity.classify(biased, model).limit(20).join(biased, "doc_id").collect():
        words = WORDS.findall(r.text.lower())
        total = model.intercept + sum(v * model.weights.get(f, 0.0) for f, v in toxicity.rates(words).items())
        assert r.score == pytest.approx(1 / (1 + math.exp(-total))) and r.predicted == (r.score >= 0.5)


def test_awkward(spark, biased):
    rows = [(1, None, "x"), (2, "", None), (2, "", None), (None, "VERMIN vermin", "y"), (4, "日本語 テキスト 🎉", "z"), (5, "Vermin " * 50_000, "z"), (6, "x" * 200_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = toxicity.fit(biased, biased)
    found = toxicity.classify(docs, model).collect()
    assert len(found) == 7 and all(0 <= r.score <= 1 for r in found) and {r.predicted for r in found if r.doc_id in (None, 5)} == {1}
    assert [r.score for r in found if r.doc_id in (1, 2, 4, 6)] == [pytest.approx(1 / (1 + math.exp(-model.intercept)))] * 5  # no known word
    assert toxicity.classify(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.classify(docs, toxicity.fit(docs, labels)).collect()} == {0.5}
    one = toxicity.fit(docs, spark.createDataFrame([(1, 0), (1, 0), (2, 0)], "doc_id long, toxic int"))
    assert one.weights == {} and [r.score for r in toxicity.classify(docs, one).collect()] == [pytest.approx(0.2)] * 7
