"""Operators for training data: exact counts, brute-force versions, held-out accuracy, and awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from helpers import rows_of, sql_rows
from pyspark.sql import functions as F

from passages import llm
from passages.llm import (
    components, decontaminate, html_main_text, language_id, line_cleaning, line_dedup, ngram_join, quality_model, secret_scan, source_mix, token_counts,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names the operators use themselves."""
    long = " ".join(f"word{i % 5000}" for i in range(30_000)) + "x" * 20_000
    texts = [None, "", " \n\t ", "one", "one", "The same text, twice over. It says so.", "The same text, twice over. It says so.", long, "tab\tand\x0bnew\r\nline", "日本語 テキスト ünïcode 🎉 end."]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", i, "x", 1.5, "y", None) for i, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, id string, score double, _id string, _at string")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_against_sql(spark, duck, name):
    assert rows_of(llm.queries()[name](spark, SF)) == sql_rows(duck, llm.oracle_sql()[name])


def test_token_counts(spark, documents, awkward):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False))
    for r in llm.queries()["op3_token_counts"](spark, SF).collect():
        assert (r.n_tokens, r.n_bytes) == (n(documents[r.doc_id]), len((documents[r.doc_id] or "").encode()))
    texts = {r.doc_id: r.text for r in awkward.collect()}
    found = token_counts.count_tokens(awkward, VOCABULARY).collect()
    assert len(found) == 11
    for r in found:
        assert r.n_tokens == n(texts[r.doc_id])
    assert token_counts.count_tokens(awkward.limit(0), VOCABULARY).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a <|endoftext|> b<|endoftext|>", "x  y", "don't  stop\n \n now", "\0 a b", "é è​ ç", "a 　b", "1 234 ,. !? ok"])
def test_safe_pieces(text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    pieces = token_counts.safe_pieces(text)
    assert "".join(pieces) == text
    assert sum(len(library.encode(p, add_special_tokens=False)) for p in pieces) == len(library.encode(text, add_special_tokens=False))


def test_memo_stays_bounded():
    counter = token_counts.PieceCounter(VOCABULARY, 1000, memo_size=50)
    counter.memo = {}
    texts = [" ".join(f"q{i}{j}" for j in range(40)) for i in range(20)]
    assert counter.count(texts) == [len(counter.tokenizer.encode(t, add_special_tokens=False)) for t in texts]
    assert len(counter.memo) <= 50


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    found = llm.queries()["op2_quality"](spark, sf)
    rows = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_quality_edge(spark, awkward):
    none = quality_model.fit(awkward, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality_model.classify(awkward, none).collect()} == {0.5}
    one = quality_model.fit(awkward, spark.createDataFrame([(3, 1), (4, 1), (None, 0), (5, None)], "doc_id long, quality int"))
    assert quality_model.without_rejected(awkward, one).columns == awkward.columns
    assert quality_model.without_rejected(awkward, one).count() == 11
    model = quality_model.RuleEnsemble(0.0, (((("log_words", True, 0.5),), 5.0), ((("log_words", False, 0.5),), -5.0)))
    assert {r.doc_id for r in quality_model.without_rejected(awkward, model).collect()} == {3, 4, 5, 6, 7, 8, 9}


def test_quality_rules_by_hand(spark, documents):
    """The compiled column against a plain evaluation of the rules over plainly computed statistics."""
    import math

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_model.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    stats, names = quality_model.statistics(docs, id_col="doc_id", text_col="text")
    seen = 0
    for r in stats.withColumn("score", model.score()).collect():
        total = model.intercept + sum(w for rule, w in model.rules if all((r[n] > t) == above for n, above, t in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)))
        words = WORD.findall(documents[r.id] or "")
        lines = [x for x in (documents[r.id] or "").split("\n") if WORD.search(x)]
        assert r.log_words == pytest.approx(math.log1p(len(words))) and r.distinct_share == pytest.approx(len(set(words)) / max(1, len(words)))
        assert r.words_per_line == pytest.approx(len(words) / max(1, len(lines))) and r.distinct_line_share == pytest.approx(len(set(lines)) / max(1, len(lines)))
        assert r.adjacent_repeat_share == pytest.approx(sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words)))
        assert r.commas_per_word == pytest.approx(len(re.findall("[,;:]", documents[r.id] or "")) / max(1, len(words)))
        seen += 1
    assert seen == len(documents) and model.rules and len(names) == 14
    assert quality_model.classify(docs.limit(0), model).count() == 0 and quality_model.without_rejected(docs.limit(0), model).count() == 0


def test_source_mix_targets(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 300)], "source string, source_size long")
    got = {r.source: r.target for r in source_mix.targets(rows, (5, 2, 1), 3.0).collect()}
    size, weight = {"a": 10, "b": 1000, "c": 5, None: 300}, {"a": 5, "b": 2, "c": 1, None: 5}
    want, free, rest = {}, list(size), sum(size.values())
    while free:
        unit = rest / sum(weight[k] for k in free)
        over = [k for k in free if unit * weight[k] > 3 * size[k]]
        for k in over or free:
            want[k] = 3 * size[k] if over else unit * weight[k]
        rest -= sum(want[k] for k in over)
        free = [k for k in free if k not in over] if over else []
    assert got == pytest.approx(want)


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 500):
        sizes = np.sort(rng.integers(0, 9000, n).astype(float))[::-1]
        p = np.full(n, 0.37)
        out = source_mix.flight(sizes, p, np.random.default_rng(2))
        assert out.sum() == pytest.approx(p.sum()) and (out * sizes).sum() == pytest.approx((p * sizes).sum())
        assert ((out > 0) & (out < 1)).sum() <= 2 and ((out >= 0) & (out <= 1)).all()
        assert set(source_mix.landing(sizes, out)) <= {0.0, 1.0}
    same = source_mix.flight(np.full(30, 7.0), np.full(30, 0.5), rng)
    assert same.sum() == pytest.approx(15)


def test_inclusion_is_unbiased():
    sizes = np.array([50.0, 40, 30, 20, 10, 5])
    runs = [source_mix.flight(sizes, np.full(6, 0.3), r) for r in map(np.random.default_rng, range(3000))]
    assert np.abs(np.mean(runs, axis=0) - 0.3).max() < 0.04


def test_source_mix(spark, documents, awkward, monkeypatch):
    monkeypatch.setattr(source_mix, "BLOCK", 16)  # several levels even here
    found = llm.queries()["op4_source_mix"](spark, SF).collect()
    assert all(r.size == len(WORD.findall(documents[r.doc_id] or "")) and 0 <= r.taken <= 3 * r.size for r in found)
    by = collections.defaultdict(lambda: [0, 0, 0])
    for r in found:
        by[r.source] = [by[r.source][0] + r.taken, r.target, r.source_size]
    total = sum(x[2] for x in by.values())
    assert sum(x[1] for x in by.values()) == pytest.approx(total)
    assert sum(abs(x[0] - x[1]) for x in by.values()) / total < 0.05
    again = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    assert rows_of(source_mix.mix_sources(again)) == rows_of(llm.queries()["op4_source_mix"](spark, SF))
    assert source_mix.mix_sources(awkward).count() == 11
    assert source_mix.mix_sources(awkward.limit(0)).count() == 0


def test_secrets(spark, documents, awkward):
    kinds = ((re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24))
    for r in llm.queries()["op5_secrets"](spark, SF).collect():
        spans = sorted((m.start(), k, m.end()) for k, (p, g, least) in enumerate(kinds) for m in p.finditer(documents[r.doc_id] or "") if len(m.group(g)) >= least)
        joined = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]
    assert secret_scan.scan_secrets(awkward).count() == 11 and secret_scan.scan_secrets(awkward.limit(0)).count() == 0


def test_randomness_battery(spark, documents):
    """Random keys of several encodings among the ordinary identifiers that people write; prose gives the null distribution."""
    rng = random.Random(3)
    keys = ["".join(rng.choice(secret_scan.ALPHABETS[a]) for _ in range(n)) for a, n in (("base64", 40), ("base62", 32), ("base36", 36), ("base32", 48)) for _ in range(30)]
    keys = [k for k in keys if any(c.isdigit() for c in k)]
    plain = [
        "internationalization2024", "chapter12sectiononeintroduction", "aaaaaaaaaaaaaaaaaaaaaaaa1", "abcabcabcabcabcabcabcabcabc123", "getUserNameFromSession2", "docs/articles/2024/summer/travel",
        "my_very_long_variable_name_1", "HttpRequestHandlerFactory3", "src/main/java/org/example/app2", "september2023newsletterarchive", "version1release2candidate3", "the_second_world_war_1939_1945",
    ]
    prose = [t for t in documents.values() if t and secret_scan._CANDIDATE.search(t) is None]
    rows = spark.createDataFrame([(i, f"é {t} end") for i, t in enumerate(keys + plain)] + [(1000 + i, t) for i, t in enumerate(prose)], "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.scan_secrets(rows).collect()}
    hits = sum(("random", 2, 2 + len(k)) in found[i] for i, k in enumerate(keys))
    wrong = [t for i, t in enumerate(plain) if any(x[0] == "random" for x in found[len(keys) + i])]
    assert hits >= 0.9 * len(keys) and not wrong, (hits, len(keys), wrong)


def test_battery_against_plain_tests():
    """The three tests one by one, by their formulas over one string."""
    import math

    rng = random.Random(8)
    upper = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    chi2 = lambda x, k: upper(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))
    for name, alphabet in secret_scan.ALPHABETS.items():
        for token in ("".join(rng.choice(alphabet) for _ in range(n)) for n in (16, 23, 40, 90)):
            n, size, at = len(token), len(alphabet), [alphabet.index(c) for c in token]
            groups = [*alphabet] if size <= 16 else [g for g in ("".join(c for c in alphabet if c in g) for g in ("0123456789", "+/-_", "aeiou", "cdhlmnprst", "bfgjkqvwxyz", "AEIOU", "CDHLMNPRST", "BFGJKQVWXYZ")) if g]
            p = [chi2(sum((sum(map(token.count, g)) - n * len(g) / size) ** 2 / (n * len(g) / size) for g in groups), len(groups) - 1)]
            kind = ["digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper() else "other" for c in token]
            each, runs = collections.Counter(kind).values(), 1 + sum(a != b for a, b in zip(kind, kind[1:]))
            s2, s3 = sum(k**2 for k in each), sum(k**3 for k in each)
            var = (s2 * (s2 + n * (n + 1)) - 2 * n * s3 - n**3) / (n * n * (n - 1))
            p.append(upper((1 + n - s2 / n - runs) / math.sqrt(var)) if var > 1e-9 else 1.0)
            mid = (size - 1) / 2
            p.append(2 * upper(abs(sum((a - mid) * (b - mid) for a, b in zip(at, at[1:])) / ((size**2 - 1) / 12 * math.sqrt(n - 1)))))
            codes = np.frombuffer(token.encode(), np.uint8)[None, :]
            got = secret_scan.battery(secret_scan._PLACES[name][codes], secret_scan._kinds(codes), name)[0]
            assert got == pytest.approx(chi2(-2 * sum(map(math.log, p)), 6), rel=1e-9)


def test_ordinary_identifiers():
    rng = random.Random(5)
    for encoding, alphabet in secret_scan.ALPHABETS.items():
        for n in secret_scan.LENGTHS:
            strings = [secret_scan.ordinary(rng, encoding, n) for _ in range(50)]
            assert all(len(x) == n and set(x) <= set(alphabet) and any(map(str.isdigit, x)) for x in strings) and len(set(strings)) > 40
    assert [secret_scan.length_class(n) for n in (16, 17, 23, 24, 95, 5000)] == [16, 16, 22, 24, 64, 96]


def test_false_discoveries_of_fresh_identifiers():
    """Identifiers that the thresholds weren't made from: of those and as many random keys, few of what is called are identifiers, at any length."""
    called, rng = secret_scan.thresholds(0.01, 0.5), random.Random(77)
    for n in secret_scan.LENGTHS:
        wrong = right = 0
        for encoding, alphabet in secret_scan.ALPHABETS.items():
            for text, random_key in [(secret_scan.ordinary(rng, encoding, n), False) for _ in range(200)] + [("".join(rng.choices(alphabet, k=n)), True) for _ in range(200)]:
                hit = any(b <= called[e, k] for _, _, e, k, b in secret_scan.candidates(text, []))
                wrong, right = wrong + (hit and not random_key), right + (hit and random_key)
        assert wrong <= 0.03 * (wrong + right), n
        assert right >= {16: 0.5, 18: 0.6, 20: 0.65, 22: 0.7}.get(n, 0.8) * 1400, (n, right / 1400)  # power


def test_verdicts_hang_on_the_string_alone(spark):
    """The same keys beside nothing, and beside many other texts."""
    rng = random.Random(6)
    rows = [(i, "see " + "".join(rng.choices(secret_scan.ALPHABETS["base62"], k=32)) + " now") for i in range(20)]
    spans = lambda rows: {r.doc_id: r.spans for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    alone, beside = spans(rows), spans(rows + [(100 + i, f"chapter{i}sectionOneIntroduction and plain words") for i in range(500)])
    assert all(alone[i] == beside[i] == spans(rows[i : i + 1])[i] for i in (0, 7, 19)) and sum(bool(x) for x in alone.values()) >= 18


def test_language(spark, awkward):
    sf = "/root/testdata/sf0.01"
    rows = llm.queries()["op6_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    empty = language_id.fit(awkward.limit(0))
    assert {r.lang_pred for r in language_id.predict(awkward, empty).collect()} == {"und"}
    model = language_id.LanguageModel({"en": b"the one and the word text same", "xx": b"zzz qqq"})
    found = {r.doc_id: r for r in language_id.predict(awkward, model).collect()}
    assert [found[i].lang_best for i in (0, 1, 2)] == ["und"] * 3 and all(found[i].lang_best in ("en", "xx") for i in range(3, 10))


def test_language_by_plain_compression(spark, documents):
    """Prediction against one compressor call a language and piece; the model holds whole texts within its budget."""
    import unicodedata

    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = lambda t: " ".join("".join(c if unicodedata.category(c)[0] == "L" else " " for c in (t or "").lower()).split())
    whole = {fold(t) for t in documents.values()}
    model = language_id.fit(docs, docs_per_language=20, bytes_per_language=20_000)
    assert len(model.dictionaries) == 4
    for content in model.dictionaries.values():
        assert len(content) <= 20_000 and all(x in whole for x in content.decode().split("\n"))
    packers = {k: zstandard.ZstdCompressor(level=7, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for k, v in model.dictionaries.items()}
    for r in language_id.predict(docs, model).collect():
        data = fold(documents[r.doc_id]).encode()
        sizes = {k: sum(len(p.compress(data[i : i + 4096])) for i in range(0, len(data), 4096)) for k, p in packers.items()}
        assert r.lang_best == (min(sizes, key=lambda k: (sizes[k], k)) if data else "und")
    assert language_id.predict(docs.limit(0), model).count() == 0
    tie = language_id.LanguageModel({"b": b"some words of it", "a": b"some words of it"})
    assert {r.lang_best for r in language_id.predict(docs.where("text IS NOT NULL").limit(3), tie).collect()} == {"a"}


def test_line_cleaning_edge(spark, awkward):
    rows = {r.doc_id: r for r in line_cleaning.clean_lines(awkward).collect()}
    assert rows[0].cleaned == "" and rows[0].n_words == 0 and not rows[0].kept
    text = "This is a real sentence with many words in it, and it ends well. " * 3
    odd = spark.createDataFrame([(1, text + "\nHome | About | News | Contact\nAll rights reserved.")], "doc_id long, text string")
    r = line_cleaning.clean_lines(odd, max_repeat_percent=100).first()
    assert r.kept and r.n_removed_lines == 2 and r.cleaned == text
    assert line_cleaning.clean_lines(awkward.limit(0)).count() == 0


def test_main_text(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site name</h1></header><nav><ul><li><a href=x>One</a></li></ul></nav>
    <div class="cookie-notice">We use cookies on this site.</div><article><h1>Real title</h1><p>First <b>bo</b>ld&amp;brave paragraph, long enough to matter here.<p>Second one&nbsp;now, with more words in it.</p>
    <ul><li>An item of a list.</li></ul><script>var x = "</p>";</script></article><section id="comments"><p>Nice article, I liked it very much.</p></section><aside>Related things to read.</aside>
    <form><label>Your mail</label><input></form><footer>&copy; 2020 someone</footer></body></html>"""
    rows = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p>cut <b>off"), (5, "u", page)], "page_id long, url string, html string")
    found = {r.page_id: r for r in html_main_text.extract_main_text(rows, keep=("url",)).collect()}
    assert found[1].text == "Real title First bold&brave paragraph, long enough to matter here. Second one now, with more words in it. An item of a list."
    assert found[1].n_chars == len(found[1].text) and found[5].text == found[1].text
    assert found[2].text == found[3].text == "" and found[4].text == "cut off"


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><p>Real words here, <span class="ad">Buy <span>now</span> please</span>and more of them.</p></article>', "Real words here, and more of them."),
        ('<article><p>Real words here <span class="sponsored">open<p>And a second one, that stays here.</p></article>', "Real words here And a second one, that stays here."),
        ('<div class="content"><p>Some text of the page, as it is.</p></div><div id="sideBar"><p>Other things to read, quite long as well.</p></div>', "Some text of the page, as it is."),
        ('<article><p>Seen by all readers here.</p><div hidden><p>Not seen by any reader of it.</p></div></article>', "Seen by all readers here."),
    ],
)
def test_furniture(page, text):
    assert html_main_text.main_text(page) == text


BODY = "<p>The article itself is here, and it has a sentence or two to say.</p><p>It goes on, with more words, for a while.</p>"
TEXT = "The article itself is here, and it has a sentence or two to say. It goes on, with more words, for a while."


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="overflow-hidden">{BODY}</div>', f'<div class="content no-sidebar">{BODY}</div>', f'<div class="social-science">{BODY}</div>',
        f'<main><div class="side-by-side">{BODY}</div></main>', f'<div class="has-sidebar">{BODY}</div>', f'<div class="page-with-comments">{BODY}</div>',
        f'<div class="layout-header-fixed"><article>{BODY}</article></div>', f'<div><svg><path d="x"><p>{BODY}</div>', f"<noscript><img src=x><p>{BODY}",
        f'<form id="frame"><div class="nav-menu"><a href=x>Home</a> <a href=y>About</a></div>{BODY}<label>Name</label></form>',
        f'<div class="cookie-notice">We and our partners use cookies, to store data, and to show you adverts, content and more.</div>{BODY}',
        f'<article>{BODY}</article><div id="comments"><article><p>A wonderful read, thank you so much for it, I will send it to my friends, to my family and to my colleagues.</p></article></div>',
    ],
)
def test_layouts(page):
    assert html_main_text.main_text(page) == TEXT


def test_cut_decides():
    """Blocks whose own evidence is wrong, in either direction: their neighbours in the tree set them right."""
    page = f"<ul><li><a href=1>One thing</a></li><li>Two things, here it is.</li><li><a href=3>Three</a></li></ul><div>{BODY}<div>Photo: someone</div>{BODY}</div>"
    blocks, elements = html_main_text.blocks_of(page)
    own = {b.text: html_main_text.evidence(b) > 0 for b in blocks}
    found = {b.text: k for b, k in zip(blocks, html_main_text.label(blocks, elements))}
    assert own["Two things, here it is."] and not found["Two things, here it is."]
    assert not own["Photo: someone"] and found["Photo: someone"]
    assert html_main_text.main_text(page) == f"{TEXT} Photo: someone {TEXT}"


def test_main_text_of_all_pages(spark):
    """Against a plain reader of the article element, which all of these pages have."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.parts = 0, []

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            self.parts += [" "] if tag not in ("b", "a") else []

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            self.parts += [" "] if tag not in ("b", "a") else []

        def handle_data(self, data):
            self.parts += [data] if self.depth else []

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in llm.queries()["op8_main_text"](spark, SF).collect():
        reader = Reader()
        reader.feed(pages[r.page_id].partition("<footer")[0])
        assert r.text == " ".join("".join(reader.parts).split()) and r.n_chars == len(r.text)


def test_main_text_edge(spark):
    long = "<body>" + "".join(f"<div><p>word {i} is here, yes.</p></div><div>{i}</div>" for i in range(5000)) + "<div>" * 3000
    rows = spark.createDataFrame([(None, long, "a", 1), (1, "<p>Some words.", "a", 1), (1, "<p>Some words.", "a", 1)], "page_id long, html string, text string, n_chars int")
    found = html_main_text.extract_main_text(rows, keep=("text", "n_chars"))
    assert found.columns == ["page_id", "text_", "n_chars_", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.n_chars, r.text_) for r in found.collect())[1:] == [(1, 11, "a")] * 2
    assert html_main_text.extract_main_text(rows.limit(0)).count() == 0


def test_minimum_cut():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 8)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda x: sum(max(g, 0) * (not k) + max(-g, 0) * k for g, k in zip(gain, x)) + sum(w for a, b, w in edges if x[a] != x[b])  # noqa: B023, E731
        best = min(cost([(m >> i) & 1 for i in range(n)]) for m in range(2**n))
        assert cost(html_main_text.minimum_cut(gain, edges)) == pytest.approx(best)


def _sets(texts, width):
    out = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        k = min(width, len(w))
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    return out


def _brute(texts, width, percent):
    sets, root = _sets(texts, width), {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x, a in enumerate(ids):
        for b in ids[:x]:
            k = len(sets[a] & sets[b])
            if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_ngram_join(spark, documents):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in llm.queries()["op9_ngram_join"](spark, SF).collect()}
    assert found == _brute(documents, 4, 85)


@pytest.mark.parametrize("width, percent, block, hot", [(4, 85, 256, 81), (5, 80, 4, 81), (5, 80, 5, 0)])
def test_ngram_join_of_chains(spark, monkeypatch, width, percent, block, hot):
    """Copies of copies, each a little further off, and texts of very different length; in one block, in several, and with all lists taken as long ones."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    monkeypatch.setattr(ngram_join, "HUBS", 2)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    texts, text = {}, [rng.choice(words) for _ in range(70)]
    for i in range(60):
        text = [w if rng.random() > 0.012 else rng.choice(words) for w in text]
        texts[i * 3 % 101] = " ".join(text[: rng.choice((70, 70, 66, 40))])
    texts |= {200: None, 201: "", 202: "A b", 203: "a B", 204: "a b c", 205: " ".join(["x"] * 500), 206: "x x x x x x"}
    rows = spark.createDataFrame([(i, t, "z") for i, t in texts.items()], "doc_id long, text string, n string")
    assert {r.doc_id: (r.n_ngrams, r.component) for r in ngram_join.join_ngrams(rows, width=width, percent=percent).collect()} == _brute(texts, width, percent)


def test_ngram_join_edge(spark, awkward):
    assert ngram_join.join_ngrams(awkward.limit(0)).count() == 0
    kept = ngram_join.drop_near_copies(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 5, 7, 8, 9]  # one of the repeated rows
    texts = [(f"k{9 - i}", t) for i, t in enumerate(["a b c d e f", "a b c d e f", "another text with words", None])] + [(None, "a b c d e f"), ("k9", "a b c d e f")]
    found = ngram_join.join_ngrams(spark.createDataFrame(texts, "doc_id string, text string")).collect()
    assert sorted((r.doc_id or "", r.n_ngrams, r.component) for r in found) == [("", 3, None), ("k6", 0, "k6"), ("k7", 1, "k7"), ("k8", 3, "k8"), ("k9", 3, "k8"), ("k9", 3, "k8")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (100, 101), (7, 7), (50, 60)]
    found = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {99: 99, 100: 99, 101: 99, 50: 50, 60: 50}


def test_line_dedup(spark, awkward):
    own = [f"{chr(97 + i) * 5} stands first in this line and it has a tail of its own, {chr(97 + i) * 3}." for i in range(8)]
    rows = []
    for i in range(4):
        rows.append((i, f"{own[i]}\n{own[i + 4]}\nPosted on 2024-01-0{i} by someone we know\nShared footer line for all"))
    rows.append((9, "Shared footer line for all"))  # nothing but the shared line
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in line_dedup.drop_recurring_lines(docs).collect()}
    assert all(found[i].text == f"{own[i]}\n{own[i + 4]}" and found[i].n_dropped == 2 for i in range(4))
    assert found[9].emptied and found[9].text == "" and not found[0].emptied
    spared = {r.doc_id: r for r in line_dedup.drop_recurring_lines(docs, spare_emptied=True).collect()}
    assert spared[9].text == rows[-1][1] and spared[9].n_dropped == 0 and spared[0].text == found[0].text
    variants = [(i, f"{own[i]}\n{own[i + 4]}\nUser logged in from host {w} at the usual time today") for i, w in enumerate(["alpha", "beta", "gamma", "delta"])]
    found = line_dedup.drop_recurring_lines(spark.createDataFrame(variants, "doc_id long, text string")).collect()
    assert all(r.n_dropped == 1 and "logged" not in r.text for r in found)
    families = ["at noon the blue train left from track {} with all on board", "at noon the other guests came in by boat {} from the north"]
    families = [[f.format(w) for w in ("one", "two", "six", "ten")] for f in families]  # equally long, and equal in their first three words
    docs = spark.createDataFrame([(i, f"{own[i]}\n{families[0][i]}\n{own[i + 4]}\n{families[1][i]}") for i in range(4)], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in line_dedup.drop_recurring_lines(docs).collect()} == {(i, f"{own[i]}\n{own[i + 4]}") for i in range(4)}
    fields = [(a, b) for a in ("red", "green", "blue") for b in ("north", "south", "west")] * 2  # values that recur, combinations that don't
    docs = [(i, f"{w}\nthe daily note of the {a} house in the {b} says {w} and no more") for i, ((a, b), w) in enumerate(zip(fields, (f"uni{chr(97 + i)}que" for i in range(18))))]
    assert all(r.n_dropped == 1 for r in line_dedup.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    prose = ["she said that we should go home before dark", "she said that nobody had ever been there since", "she said that his old car would not start"]
    docs = spark.createDataFrame(list(enumerate(prose)), "doc_id long, text string")
    assert [r.n_dropped for r in line_dedup.drop_recurring_lines(docs).collect()] == [0, 0, 0]
    odd = line_dedup.drop_recurring_lines(awkward)
    assert odd.count() == 11 and set(awkward.columns) < set(odd.columns)
    assert line_dedup.drop_recurring_lines(awkward.limit(0)).count() == 0


def _words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(n))


def _lines_stage(spark, texts):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    return {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, SF).collect()}


def test_lines_stage_shares(spark):
    """Recurring lines also go where they hold most of a document; copies keep what only copies share."""
    rng = random.Random(3)
    shared, own, copied = _words(rng, 60), [_words(rng, 24) for _ in range(3)], _words(rng, 40) + "\n" + _words(rng, 40)
    found = _lines_stage(spark, [*[(i, f"{shared}\n{own[i]}") for i in range(3)], *[(i, copied) for i in (5, 6, 7)], (8, None), (9, shared)])
    assert [found[i] for i in range(3)] == own
    assert found[5] == found[6] == found[7] == copied and found[8] is None and found[9] == shared


def test_lines_stage_two_carriers(spark):
    """Two documents suffice for long lines and templates, not for short ones; two versions of one document are no template."""
    rng = random.Random(4)
    passage, short, own = _words(rng, 55), _words(rng, 6), [_words(rng, 12) for _ in range(4)]
    head, other = passage.split(), _words(rng, 60)
    changed = " ".join(w if i % 5 != 4 else w[::-1] for i, w in enumerate(head))
    twice = [_words(rng, 200) + "\n" + other, None]
    twice[1] = twice[0].rpartition(" ")[0] + " end"
    texts = [(0, f"{passage}\n{own[0]}"), (1, f"{passage}\n{own[1]}\n{short}"), (2, f"{own[2]}\n{short}")]
    found = _lines_stage(spark, [*texts, (5, twice[0]), (6, twice[1])])
    assert [found[i] for i in range(3)] == [own[0], f"{own[1]}\n{short}", f"{own[2]}\n{short}"]
    assert [found[5], found[6]] == twice
    found = _lines_stage(spark, [(0, f"{passage}\n{own[0]}"), (1, f"{changed}\n{own[1]}")])
    assert [found[0], found[1]] == own[:2]


def test_lines_stage_templates_of_a_leaf(spark):
    """A hot line and two templates that mask to one leaf: all three go."""
    rng = random.Random(6)
    own, bodies = [_words(rng, 12) for _ in range(14)], [_words(rng, 8) for _ in range(3)]
    line = lambda i, k: f"2024-01-{i:02} 10:00:{i:02} [{i}] {bodies[k]} {_words(rng, 1) if k else 'same'}"
    found = _lines_stage(spark, [(i, f"{own[i]}\n{line(i, 0 if i < 6 else 1 + i % 2)}") for i in range(14)])
    assert [found[i] for i in range(14)] == own


def test_null_ids(spark, awkward):
    """Rows with a null id and a text: op9 gives them their size and no links, near copies keep them, op1 neither counts nor changes them."""
    text = "Some line of words that is the same in each of these rows"
    rows = spark.createDataFrame([(None, text), (None, text), (None, None), (1, text), (2, text), (4, f"Another line here\n{text} indeed")], "doc_id long, text string")
    found = collections.Counter((r.doc_id, r.n_ngrams, r.component) for r in ngram_join.join_ngrams(rows).collect())
    n = len(text.split()) - 3
    assert found == {(None, n, None): 2, (None, 0, None): 1, (1, n, 1): 1, (2, n, 1): 1, (4, n + 4, 4): 1}
    extended = awkward.unionByName(awkward.where("doc_id = 5").limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert ngram_join.drop_near_copies(extended).where("doc_id IS NULL AND text IS NOT NULL").count() == 1
    cleaned = line_dedup.drop_recurring_lines(rows).collect()
    assert all(r.n_dropped == 0 for r in cleaned)
    assert sorted(_lines_stage(spark, [(None, text), (None, text), (1, text)]).values()) == [text, text]


def test_decontamination(spark, awkward):
    item = "When Alice drove 120 km in 3 hours to see Robert she paid 45 dollars for fuel and was glad of it."
    changed = item.replace("Alice", "Maria").replace("120", "300").replace("Robert", "Peter").replace("45", "70")
    broken = "Before 7 miles , " + item.replace("120 km in 3 hours", "120 km in 120 hours")
    texts = {1: f"Well. {item} The end.", 2: f"Well. {changed} The end.", 3: "Nothing of the kind is in here at all, really.", 4: None, 5: broken, 6: f"well. {item.upper()}"}
    docs = spark.createDataFrame([(i, t, "k") for i, t in texts.items()], "doc_id long, text string, key string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.find_leaks(docs, items).collect()}
    assert found[1].kind == "verbatim" and found[2].kind == "reparameterised" and found[2].n_changed >= 3
    assert 3 not in found and 4 not in found
    left = decontaminate.without_leaks(docs, items)
    assert left.columns == docs.columns and {3, 4} <= {r.doc_id for r in left.collect()} and not {1, 2} & {r.doc_id for r in left.collect()}
    assert decontaminate.find_leaks(awkward, items).count() == 0 and decontaminate.find_leaks(awkward, items.limit(0)).count() == 0


def test_decontamination_against_sql(spark):
    """Items with numbers, names and units asked anew, moved by a word, contradicted, short, and repeated: the same SQL over a small fixture."""
    import duckdb
    import pandas as pd

    item = "When Alice drove 120 km in 3 hours to see Robert she paid 45 dollars for fuel and was glad of it."
    asked = item.replace("Alice", "Maria").replace("120", "300").replace("Robert", "Peter").replace("45", "70")
    long = "After that she went home along the old road by the river, past the mill and the empty barns, and told her sister all about the long day."
    texts = [
        f"Well. {item} The end.", f"Well. {asked} The end.", f"Again: {asked} And then {asked}", long.replace("home along", "home again along"), item.replace("glad of it", "glad of every mile"),
        item.replace("3 hours", "120 hours"), "They asked who wrote Hamlet today and then left.", "who wrote Hamlet yesterday", "It is 40 km from here.", item, item, None, "",
    ]
    docs = pd.DataFrame({"doc_id": [*range(9), 9, 9, 11, 12], "text": texts})
    items = pd.DataFrame({"item_id": [1, 2, 3, 4, 5, 6, 7], "text": [item, "who wrote Hamlet today", "40 km from here", "too short", None, item, long]})
    con = duckdb.connect()
    con.register("documents", docs)
    con.register("benchmark", items)
    rows = lambda pdf, schema: spark.createDataFrame([tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False)], schema)
    found = decontaminate.find_leaks(rows(docs, "doc_id long, text string"), rows(items, "item_id long, text string"))
    assert rows_of(found) == sql_rows(con, decontaminate.ORACLE)
    kinds = {(r.doc_id, r.item_id): r.kind for r in found.collect()}
    assert kinds[0, 1] == kinds[3, 7] == kinds[6, 2] == kinds[9, 6] == "verbatim" and kinds[1, 1] == kinds[2, 1] == "reparameterised"
    assert (7, 2) not in kinds and not any(i == 4 for _, i in kinds)


def test_stages_on_awkward_rows(spark, awkward):
    """Each stage on nulls, empties, a very long text, repeated rows and extra columns, and on no rows at all."""
    import corpus_pipeline

    rows = awkward.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.unionByName(rows.where("doc_id IN (0, 5)").dropDuplicates(["doc_id"]).withColumn("doc_id", F.lit(None).cast("long")))
    every = [None, None, *range(10), 5]
    kept = {"quality": every, "lines": every, "near_copies": [None, None, 0, 1, 2, 3, 5, 7, 8, 9], "leaks": every, "mix": every}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, SF)
        assert sorted((r.doc_id for r in out.collect()), key=str) == sorted(kept[name], key=str), name
        none = stage(spark, rows.limit(0), SF)
        assert none.count() == 0 and (name == "mix" or out.columns == none.columns == rows.columns)


def test_pipeline(spark, documents):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        kept[name] = {r.doc_id for r in out.collect()}
        if name == "near_copies":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert kept[name] == {i for i, (_, c) in _brute(texts, 5, 80).items() if i == c}
        if name != "mix":
            assert out.columns == names
        docs = out
    assert kept["quality"] == kept["lines"] and kept["lines"] > kept["near_copies"] >= kept["leaks"] == kept["mix"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == kept["mix"]
