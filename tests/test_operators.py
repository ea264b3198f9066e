"""Small literal cases, and streams against their batch form."""

import datetime as dt
import json

import pytest
from conftest import SF
from helpers import rows_of
from pyspark.sql import functions as F

from passages.adapters import view
from passages.functions import text
from passages.operators import chunking, dense, evals, experiments, fusion, lexical, reports, segments, tree, usage
from passages.sources import corpus, index
from passages.streaming import lockouts, windows


def test_clean(spark):
    rows = spark.createDataFrame([("a\r\nb\n\n\n\nc  d",), ("." * 200,), ("x\0y",), (None,)], "text string")
    assert [r[0] for r in text.clean_corpus(rows).collect()] == ["a\nb\n\nc d", "." * 32, "xy", ""]


def test_language(spark):
    rows = spark.createDataFrame([("Hello there",), ("12 34",), ("Привет, как дела",), ("Привіт, їжак",), ("mostly English да",)], "text string")
    assert [r.lang for r in text.tag_language(rows).collect()] == ["en", "en", "ru", "uk", "en"]


def test_html_sections(spark):
    page = "<html><nav><a>x</a></nav><main><h1>Top</h1><p>one</p><h2>Sub</h2><p>two &amp; three</p><table><tr><td>a</td><td>b</td></tr></table></main></html>"
    found = segments.html_segments(spark.createDataFrame([(1, page)], "doc int, html string")).orderBy("seg_no").collect()
    assert [(r.section, r.text) for r in found] == [(["Top"], "one"), (["Top", "Sub"], "two & three\na | b")]


def test_json_segments(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, '["p", "q"]'), (3, "{bad"), (4, "7")], "doc int, json string")
    found = [(r.doc, r.section, r.text) for r in segments.json_segments(rows).orderBy("doc", "seg_no").collect()]
    assert found == [(1, "a", "1"), (1, "b", "x"), (2, "Item 1", "p"), (2, "Item 2", "q"), (3, None, "{bad"), (4, None, "7")]


def test_chunking(spark):
    with pytest.raises(ValueError):
        chunking.chunk_fixed(spark.createDataFrame([(1, "a")], "doc int, text string"), 10, 10)
    words = " ".join(f"w{i}" for i in range(214))
    found = chunking.chunk_fixed(spark.createDataFrame([(1, words), (2, ""), (3, None)], "doc int, text string"), 200, 0).orderBy("ordinal").collect()
    assert [(r.doc, r.tokens) for r in found] == [(1, 107), (1, 107)]
    segs = spark.createDataFrame([(1, i, ["P", s], "some words here") for i, s in enumerate("abc")], "doc int, seg_no int, section array<string>, text string")
    one = chunking.chunk_semantic(segs, 200, 20).collect()
    assert len(one) == 1 and one[0].section == ["P"] and one[0].tokens == 10  # with the breadcrumb
    assert chunking.chunk_per_unit(segs).count() == 3


def test_fusion_and_rerank(spark):
    ranked = spark.createDataFrame([(1, 1, 1, "a", 0), (1, 2, 2, "a", 0), (1, 3, 1, "b", 1), (1, 2, 2, "b", 1)], "query_id int, chunk_id int, rank int, retriever string, retriever_order int")
    fused = fusion.rrf_fuse(ranked, 10).orderBy("rank")
    assert [r.chunk_id for r in fused.collect()] == [2, 1, 3]
    hits = spark.createDataFrame([(1, i, i, 1.0 / i, "match" if i == 2 else "no") for i in range(1, 5)] + [(2, 9, 1, 0.5, "no")], "query_id int, chunk_id int, rank int, score double, text string")
    found = fusion.rerank_head(hits, F.when(F.col("text") == "match", 1.0).otherwise(0.0), 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in found] == [(1, 2), (1, 1), (1, 3), (1, 4), (2, 9)]
    assert found[-1].score == 0.5


def test_citations(spark):
    answers = spark.createDataFrame([(1, "x [2] y [1] z [2] [7] [123]")], "query_id int, answer string")
    context = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, 3, 30)], "query_id int, marker int, chunk_id int")
    assert [(r.marker, r.cited, r.position) for r in fusion.resolve_citations(answers, context).orderBy("marker").collect()] == [(1, True, 2), (2, True, 1), (3, False, None)]


def test_judge_and_metrics(spark):
    replies = spark.createDataFrame([(i, "m", r) for i, r in enumerate(['{"score": 5}', '{"score": -3}', 'Sure {"score": 1.0} ok', "fine", '{"no": 1}', None])], "item_id int, metric string, reply string")
    assert [r.score for r in evals.score_judge_replies(replies).orderBy("item_id").collect()] == [1.0, 0.0, 1.0, 0.0, 0.0, 0.0]
    assert evals.unknown_metrics(["answered", "zzz"]) == ["zzz"]
    samples = spark.createDataFrame([(1, 1, "q", "a", None, "", "", "ctx")], "run_id int, item_id long, question string, answer string, expected_answer string, expected_sources string, retrieved_sources string, context string")
    assert {r.score for r in evals.judge_scores(samples, None).collect()} == {0.0}


def test_experiments(spark):
    import hashlib

    rows = spark.createDataFrame([(7, f"user:{i}") for i in range(50)], "experiment_id int, subject string")
    for r in rows.withColumn("b", experiments.bucket(F.col("experiment_id"), F.col("subject"))).collect():
        assert r.b == int.from_bytes(hashlib.sha256(f"7:{r.subject}".encode()).digest()[:4], "big") % 100
    short = spark.createDataFrame([(7, 1, 10), (7, 2, 20)], "experiment_id int, id int, traffic_percent int")
    assert experiments.assign_by_bucket(rows, short).count() == 50


def test_allowance_and_prices(spark):
    now = dt.datetime(2024, 1, 1)
    used = spark.createDataFrame([(1, "system", 600, 400, now), (1, "org", 5000, 0, now)], "org_id long, key_source string, tokens_in long, tokens_out long, created_at timestamp_ntz")
    orgs = spark.createDataFrame([(1,), (2,)], "org_id long")
    found = {r.org_id: (r.used, r.remaining, r.exhausted) for r in usage.allowance(used, orgs, 500, "2024-02-01 00:00:00").collect()}
    assert found == {1: (1000, 0, True), 2: (0, 500, False)}
    calls = spark.createDataFrame([("a", "m", 100, 50), ("a", "x", 1, 1)], "provider string, model string, tokens_in long, tokens_out long")
    prices = spark.createDataFrame([("a", "m", 3, 15)], "provider string, model string, price_in int, price_out int")
    assert sorted((str(r.cost), r.cost_unknown) for r in usage.price_calls(calls, prices).collect()) == [("0.001050", False), ("None", True)]


def test_tree(spark):
    nodes = spark.createDataFrame([("1", "a", "directory"), ("1.2", "b", "file"), ("12.3", "c", "file"), ("1.4.5", "d", "file")], "path string, name string, type string")
    roots = spark.createDataFrame([("1",)], "path string")
    assert {r.path for r in tree.expand_subtree(nodes, roots).collect()} == {"1.2", "1.4.5"}
    many = roots.union(spark.range(1200).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("path")))
    assert {r.path for r in tree.expand_subtree(nodes, many).collect()} == {"1.2", "1.4.5"}
    assert tree.expand_subtree(nodes, roots.limit(0)).count() == 0
    assert tree.access_scope(nodes, nodes, 1, True, "owner").count() == 4


def test_ann_recall(spark):
    """Recall against brute force over the stated query set, with half of the pairs compared: these vectors are as good as random."""
    sf = "/root/testdata/sf0.1"
    vectors = view(spark, sf, "vectors")
    queries = view(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.expr("concat('m', vec_id % 2)").alias("model"), "embedding")
    cells = dense.fit_cells(vectors)
    exact, near = (dense.dense_search(queries, vectors, 20), dense.dense_search_ann(queries, vectors, 20, cells))
    assert exact.join(near, ["query_id", "chunk_id"]).count() / exact.count() >= 0.9
    found = dense.index_cells(vectors, cells)
    assert found.count() == vectors.count()
    q = queries.select("query_id", "model", dense.unit(F.col("embedding").cast("array<double>")).alias("q")).select("query_id", "model", F.explode(cells.nearest(-(-len(cells.centres) // 2))("q")).alias("cell"))
    assert found.join(q, ["model", "cell"]).count() < 0.55 * vectors.join(queries.select("query_id", "model"), "model").count()


def test_scope_and_stopwords(spark):
    queries = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "query_id int, org_id int")
    sources = spark.createDataFrame([(5, 10), (6, 20), (7, 20)], "id int, org_id int")
    chunks = spark.createDataFrame([(50, 5, "the red fox", "en"), (60, 6, "the red fox и лиса", "ru"), (70, 7, "red", "en")], "chunk_id int, source_id int, text string, lang string")
    scope = tree.search_scope(queries, sources, chunks)
    assert {(r.query_id, r.chunk_id) for r in scope.collect()} == {(1, 50), (2, 60), (2, 70)}
    named = tree.search_scope(queries.withColumn("source_id", F.lit(7)), sources, chunks)
    assert {(r.query_id, r.chunk_id) for r in named.collect()} == {(2, 70)}
    terms = lexical.analyse_queries(spark.createDataFrame([(i, "Red fox и") for i in (1, 2, 3)], "query_id int, text string"), lexical.languages_in_scope(chunks))
    assert {r.term for r in terms.collect()} == {"red", "fox"}
    postings = lexical.matching_postings(chunks, terms)
    every = lexical.build_lexical_index(chunks)
    assert sorted(map(tuple, postings.collect())) == sorted(tuple(r) for r in every.collect() if r.term in ("red", "fox"))
    assert {(r.query_id, r.chunk_id) for r in lexical.lexical_search(terms, postings, 5, scope).collect()} == {(1, 50), (2, 60), (2, 70)}
    assert rows_of(lexical.bm25_search(terms, postings, 5, docs=lexical.corpus_lengths(chunks))) == rows_of(lexical.bm25_search(terms, every, 5))


def test_embed_corpus(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "chunk_id long, text string")
    assert [r.embedding for r in dense.embed_corpus(rows, lambda ts: [[float(len(t))] for t in ts]).orderBy("chunk_id").collect()] == [[2.0], [0.0]]


def test_sources(spark, tmp_path):
    for name in ("a.TXT", "b.exe", "c"):
        (tmp_path / name).write_text("x")
    taken, refused = corpus.scan_corpus(spark, str(tmp_path))
    assert [r.name for r in taken.collect()] == ["a.TXT"] and refused.count() == 2
    (tmp_path / "g.json").write_text(json.dumps({"items": [{"question": "q1", "expected_sources": ["a", "b"], "tags": None}, {"question": " ", "expected_sources": [], "tags": None}]}))
    items, errors = corpus.import_golden_set(spark, str(tmp_path / "g.json"))
    assert [(r.question, r.expected_sources) for r in items.collect()] == [("q1", ["a", "b"])] and errors == ["Row 2: no question"]
    nodes = spark.range(60).withColumnRenamed("id", "n")
    rows, more = corpus.guarded_sql(spark, {"t": nodes}, "select n from t;")
    assert rows.count() == 50 and more
    with pytest.raises(Exception):
        spark.table("t")  # the view is gone
    spark.range(3).createOrReplaceTempView("secret_rows")
    files = f"{SF}/nation.parquet"
    for bad in ("drop table t", "select 1; select 2", "with x as (select 1) insert into t select 1", "do something", f"select * from parquet.`{files}`", f"select * from t join `parquet`.`{files}` on true",
                "select * from secret_rows", "select n from t where n in (select id from secret_rows)", "select * from default.t"):
        with pytest.raises(ValueError):
            corpus.guarded_sql(spark, {"t": nodes}, bad)


def _stream(spark, df, tmp_path):
    folder = str(tmp_path / "in")
    df.coalesce(1).write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def _run(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def test_stream_rates(spark, tmp_path):
    requests = view(spark, SF, "requests")
    _run(windows.request_rate(_stream(spark, requests, tmp_path)), "rates", "complete")
    assert rows_of(spark.table("rates")) == rows_of(windows.request_rate(requests))


def test_stream_rate_limit(spark, tmp_path):
    hits = view(spark, SF, "events").select(F.col("user_id").alias("key"), "ts", "event_id")
    _run(windows.rate_limit_stream(_stream(spark, hits, tmp_path), 2, 86_400), "limits", "append")
    assert rows_of(spark.table("limits")) == rows_of(windows.rate_limit_flags(hits, 2, 86_400))


def test_hot_keys_stream_by(spark):
    """One key with most rows, over many Arrow batches: no key's rows are one array, and the folds go on across batches."""
    times = spark.range(40_000).select(F.when(F.col("id") % 40 == 0, F.col("id") % 7).alias("key"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("event_id"), (F.col("id") % 11 == 0).alias("success"))
    limits, locks = windows.rate_limit_flags(times, 5, 100), windows.lockout_flags(times, "key", 3, 1)
    for found in (limits, locks):
        assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    start, n, expected = None, 0, {}
    for i in (i for i in range(40_000) if i % 40):
        start, n = (i, 1) if start is None or i >= start + 100 else (start, n + 1)
        expected[i] = (n, n > 5, max(1, start + 100 - i) if n > 5 else None)
    assert {r.event_id: (r.n, r.rejected, r.retry_after) for r in limits.where("key IS NULL").collect()} == expected
    start = n = until = 0
    expected = {}
    for i in (i for i in range(40_000) if i % 40):
        locked, before = i < until, n
        if not locked:
            start, n = (start, 0) if i % 11 == 0 else (i, 1) if n == 0 or i >= start + 60 else (start, n + 1)
        expected[i] = (before if locked else n, locked)
        if not locked and n >= 3:
            n, until = 0, i + 60
    assert {r.event_id: (r.failures, r.locked) for r in locks.where("key IS NULL").collect()} == expected


def test_dense_blocks(spark, monkeypatch):
    """More queries than fit a block, every vec_id divisible by 50 among them, are searched like any others."""
    vectors = view(spark, SF, "vectors")
    queries = view(spark, SF, "embeddings").where("vec_id < 20 OR vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.expr("concat('m', vec_id % 2)").alias("model"), "embedding")
    expected = rows_of(dense.dense_search(queries, vectors, 5))
    monkeypatch.setattr(dense, "QUERY_BYTES", 2_000)  # a few queries a block
    assert rows_of(dense.dense_search(queries, vectors, 5)) == expected


def test_stream_ingest(spark, tmp_path):
    """Two batches, the second with changed, new and failing documents: the index holds what one batch over the latest documents gives, in all four tables."""
    docs = view(spark, SF, "documents").select(F.col("doc_id").alias("doc"), F.concat(F.lit("d."), F.when(F.col("doc_id") % 5 == 4, "exe").otherwise("txt")).alias("name"), "text").where("doc < 30")
    changed = docs.where("doc BETWEEN 20 AND 25").withColumn("text", F.lit("new text of this document")).unionByName(spark.createDataFrame([(90, "n.md", "# T\nbody of it"), (91, "n.txt", None)], docs.schema))
    run = lambda: windows.stream_ingest(spark, str(tmp_path / "docs"), "doc long, name string, text string", str(tmp_path / "out"), str(tmp_path / "state"))
    docs.write.parquet(str(tmp_path / "docs"))
    run()
    held = index.StoredIndex(spark, str(tmp_path / "out"))
    first = held.read("chunks").count()
    changed.coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    run()
    assert held.batches() == ["stream-0", "stream-1"] and first > 0
    latest = docs.join(changed.select("doc"), "doc", "left_anti").unionByName(changed)
    expected = chunking.ingest_corpus(latest)
    for table, rows in expected.items():
        assert rows_of(held.read(table).select(rows.columns)) == rows_of(rows), table
    assert expected["chunks"].where("doc IN (4, 91)").count() == 0 and expected["chunks"].where("doc = 90").first().section == ["T"]


def test_ingest_keeps_a_given_title(spark):
    docs = spark.createDataFrame([(1, "a.txt", "plain text", "Given"), (2, "b.md", "# Own\nbody", "Given"), (3, "c.txt", "no title", None)], "doc int, name string, text string, title string")
    assert {r.doc: r.text for r in chunking.ingest_corpus(docs)["chunks"].collect()} == {1: "Given\nplain text", 2: "Own > Own\nbody", 3: "no title"}


def test_chunking_rules(spark):
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    pieces = chunking.split_text(". ".join(words(10 * k, 10 * k + 10) for k in range(40)), 100, 20)
    assert all(chunking.n_tokens(p) <= 100 for p in pieces) and all(a.split()[-20:] == b.split()[:20] for a, b in zip(pieces, pieces[1:-1]))
    assert chunking.n_tokens(pieces[-1]) >= 25
    assert [chunking.n_tokens(p) for p in chunking.split_text(words(0, 214), 200, 0)] == [107, 107]
    kept = " ".join(chunking.split_text(words(0, 137) + ".\n" + words(137, 400), 50, 0)).split()
    assert kept == (words(0, 137) + ". " + words(137, 400)).split()
    rows = [(1, i, f"some words here {i}", ["P", x], page, "Title") for i, (x, page) in enumerate([("a", 3), ("b", 3), ("c", 4)])] + [(2, 0, "alone on its page", [], 7, None)]
    segs = spark.createDataFrame(rows, "doc int, seg_no int, text string, section array<string>, page int, title string")
    found = {r.doc: r for r in chunking.chunk_semantic(segs, 200, 20).collect()}
    assert (found[1].section, found[1].page, found[1].page_end) == (["P"], 3, 4) and found[1].text.startswith("Title > P\nsome words here 0\n\nsome")
    assert (found[2].section, found[2].page, found[2].page_end, found[2].text) == ([], 7, None, "alone on its page")
    tight = chunking.chunk_semantic(segs.where("doc = 1"), 10, 2).collect()
    assert len(tight) > 1 and all(r.tokens <= 10 for r in tight)
    assert chunking.chunk_semantic(segs.limit(0)).count() == 0 and chunking.chunk_per_unit(segs).count() == 4
    report = chunking.chunk_report(chunking.chunk_per_unit(segs)).first()
    assert report.chunks == 4 and report.with_path == 0.75


def test_references_and_loaders(spark):
    text = "a &lt;b&gt; &amp;lt; &#233;&#x20AC; &#128512; &#0; &bogus; &#99999999; caf&eacute; &"
    assert spark.createDataFrame([(text,)], "t string").select(segments.decode_references(F.col("t")).alias("t")).first().t == "a <b> &lt; é€ 😀 &#0; &bogus; &#99999999; café &"
    docs = [(1, "md", "# Top\nbody"), (2, "html", "<title>T &amp; x</title><body><h1>H</h1><p>para</p></body>"), (3, "json", '{"k": "v"}'), (4, "txt", "plain"), (5, "log", "other"), (6, "md", "# Contents\n1 a\n# Next\nrest"), (7, "txt", " ")]
    found = segments.load_segments(spark.createDataFrame(docs, "doc int, extension string, text string"), {"log": lambda d: segments.plain_segments(d.withColumn("text", F.upper("text")))})
    assert sorted((r.doc, r.section, r.text, r.title) for r in found.collect()) == [
        (1, ["Top"], "body", "Top"), (2, ["H"], "para", "T & x"), (3, ["k"], "v", None), (4, [], "plain", None), (5, [], "OTHER", None), (6, ["Next"], "rest", "Contents")]


def test_index_by_term(spark, tmp_path):
    postings = spark.createDataFrame([("a", 1, 2), ("b", 1, 1), ("c", 2, 5)], "term string, chunk_id int, tf int")
    corpus.write_index(postings, str(tmp_path / "i"), 8)
    asked = spark.createDataFrame([("a",), ("zz",)], "term string")
    found = corpus.read_index(spark, str(tmp_path / "i"), asked)
    assert [tuple(r) for r in found.collect()] == [("a", 1, 2)] and "PartitionFilters: [bucket" in found._jdf.queryExecution().toString().replace("isnotnull(bucket", "bucket")


STREAMS = {
    "error_rate": ("requests", windows.error_rate), "token_rate": ("usage_events", windows.token_rate), "spend_per_hour": ("usage_events", windows.spend_per_hour),
    "latency_p95": ("requests", lambda df: windows.latency_p95(df, [0.5, 1.0, 5.0])), "outcome_rate": ("requests", windows.outcome_rate), "chat_sessions": ("events", windows.chat_sessions),
}


@pytest.mark.parametrize("name", sorted(STREAMS))
def test_streams_equal_batches(spark, tmp_path, name):
    source, f = STREAMS[name]
    rows = view(spark, SF, source)
    rows = rows.withColumnRenamed("created_at", "ts") if source == "usage_events" else rows
    _run(f(_stream(spark, rows, tmp_path)), f"twin_{name}", "complete")
    assert rows_of(spark.table(f"twin_{name}")) == rows_of(f(rows))


def test_stateful_twins(spark, tmp_path):
    """Each twin over two micro-batches against its batch form: state goes on from one to the next."""
    events = view(spark, SF, "events")
    changes = events.select((F.col("user_id") % 3).alias("key"), "ts", "event_id", F.when(F.col("event_type") == "view", 1).otherwise(-1).cast("long").alias("delta"))
    use = view(spark, SF, "usage_events").withColumnRenamed("created_at", "ts").select("org_id", "ts", "event_id", "key_source", "tokens_in", "tokens_out")
    middle = events.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]

    def two(df, f, name):
        folder = str(tmp_path / name)
        query = lambda: f(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)).writeStream.format("parquet").option("path", folder + "-out").option("checkpointLocation", folder + "-state").trigger(availableNow=True).start().awaitTermination()
        for part in (df.where(F.col("event_id") <= middle), df.where(F.col("event_id") > middle)):
            part.coalesce(1).write.mode("append").parquet(folder)
            query()
        return spark.read.parquet(folder + "-out")

    assert rows_of(two(changes, windows.backlog_depth_stream, "backlog")) == rows_of(windows.backlog_depth(changes))
    found = rows_of(windows.running_allowance(use, 5_000))
    assert found[1] and rows_of(two(use, lambda d: windows.running_allowance_stream(d, 5_000), "allowance")) == found
    turns = events.select(F.col("user_id").cast("string").alias("subject"), "ts", "event_id", (F.col("event_id") % 3).alias("variant_id"))
    first = {r.subject: r.v for r in turns.groupBy("subject").agg(F.min_by("variant_id", F.struct("ts", "event_id")).alias("v")).collect()}
    sticky = two(turns, windows.sticky_assign_stream, "sticky").collect()
    assert len(sticky) == turns.count() and all(r.variant_id == first[r.key] for r in sticky)


def test_lockout_of_both_keys(spark):
    """Failures on one account from several addresses lock the account; a success clears account and address."""
    t = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)
    rows = [(1, 1, t(0), "a", "x", False), (1, 2, t(1), "a", "y", False), (1, 3, t(2), "b", "x", True), (1, 4, t(3), "a", "x", False), (1, 5, t(4), "a", "z", True), (1, 6, t(5), "c", "x", False), (1, 7, t(40), "a", "x", True)]
    found = lockouts.lockout_both(spark.createDataFrame(rows, "org_id int, event_id int, ts timestamp_ntz, account string, address string, success boolean"), 3, 15).orderBy("event_id").collect()
    assert [(r.account_failures, r.address_failures, r.locked) for r in found] == [(1, 1, False), (2, 1, False), (0, 0, False), (3, 1, False), (0, 0, True), (1, 2, False), (0, 0, False)]


def test_histogram_above_last_bound(spark):
    rows = spark.createDataFrame([("a", 99.0)] * 3, "route string, seconds double")
    assert reports.histogram_quantile(rows, "seconds", ["route"], [1.0, 2.0], 0.5).first().quantile == 2.0


def test_summaries_and_refusals(spark):
    """A run of which every item raised is failed and has no means; five phrases refuse; unknown metrics and unlike datasets are refused."""
    scores = spark.createDataFrame([(1, 1, "m", 1.0), (1, 2, "m", 0.5), (1, 2, "k", 1.0)], "run_id int, item_id int, metric string, score double")
    items = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "boom"), (2, 4, "boom"), (2, 5, "boom")], "run_id int, item_id int, error string")
    found = evals.summarise_runs(scores, items)
    assert {(r.run_id, r.metric, r.mean, r.status) for r in found.collect()} == {(1, "m", 0.75, "done"), (1, "k", 0.5, "done"), (2, None, None, "failed")}
    assert {(r.metric, r.delta) for r in evals.compare_runs(found.where("run_id = 1"), found.where("run_id = 2")).collect()} == {("m", -0.75), ("k", -0.5)}
    answers = ["I don't know.", "Well, I do not know that", "There is NO INFORMATION here", "Я не знаю", "I cannot answer", " ", "It was not found in the sources.", "Because."]
    rows = spark.createDataFrame([(1, i, a) for i, a in enumerate(answers)], "run_id int, item_id int, answer string")
    assert [r.score for r in rows.select(evals.answered().alias("score")).collect()] == [0.0] * 6 + [1.0, 1.0]
    for bad in (lambda: evals.start_run(["answered", "zzz"]), lambda: evals.compare_runs(found, found, datasets=(1, 2))):
        with pytest.raises(ValueError):
            bad()
    lost = spark.createDataFrame([(1, 1, None, None, "c")], "run_id int, item_id int, expected_sources string, retrieved_sources string, context string").withColumn("answer", F.lit("x"))
    assert [r.score for r in evals.score_items(lost, ["retrieval_recall"]).collect()] == [0.0]
