"""Guarded statements, literal addresses, the layout of a stored index, and reports as of a moment."""

import datetime as dt
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from passages.functions import addresses
from passages.operators import reports
from passages.sources import corpus

REFUSED = [
    "select reflect('java.lang.System', 'getenv', 'HOME')", "select java_method('java.lang.Math', 'random')", "select * from range(5)", "select * from parquet.`/etc`", "select * from other", "select 1; drop table t",
    "insert into t values (1)", "create view v as select 1", "set spark.x=1", "select current_user", "select current_database()", "select input_file_name() from t", "select version()", "select spark_catalog.default.f(1)",
    "select (select max(x) from other) from t", "with c as (select reflect('a', 'b') as r) select * from c", "select * from t where exists (select 1 from json.`/x`)", "select transform(a) using 'cat' from t", "select nosuch(a) from t",
    "describe t", "explain select 1", "values", "", "select * from t join lateral range(3)", "select raise_error('x') from t", "select b from t", "cache table t",
]


@pytest.mark.parametrize("statement", REFUSED)
def test_refused(spark, statement):
    spark.range(1).createOrReplaceTempView("other")
    with pytest.raises(ValueError):
        corpus.guarded_sql(spark, {"t": spark.range(3).toDF("a")}, statement)


def test_allowed(spark):
    t = spark.createDataFrame([(i, f"insert {i}") for i in range(60)], "a int, text string")
    run = lambda q, **k: corpus.guarded_sql(spark, {"t": t, "u": t.where("a < 3")}, q, **k)
    rows, more = run("select a as `call`, 'drop; delete' as s from T order by 1")
    assert rows.columns == ["call", "s"] and rows.count() == 50 and more
    rows, more = run("with c as (select a, row_number() over (order by a desc) as n from t where text like 'insert%') select sum(c.a) as s, max(n) as n, count(distinct upper(u.text)) as d from c join u using (a) where a in (select a from u) ;")
    assert [tuple(r) for r in rows.collect()] == [(3, 60, 3)] and not more
    rows, _ = run("select x, filter(array(a), y -> y > 1) as f from t lateral view explode(array(a, a + 1)) v as x where a < 1 union all select 9, null")
    assert sorted(map(str, rows.collect())) == sorted(map(str, run("select * from (values (0, array()), (1, array()), (9, null)) as v(x, f)")[0].collect()))


def test_sessions_do_not_meet(spark):
    """The caller's views and settings stay, a view of the same name included."""
    spark.range(7).createOrReplaceTempView("t")
    assert corpus.guarded_sql(spark, {"t": spark.range(2)}, "select count(*) as n from t")[0].first().n == 2
    assert spark.table("t").count() == 7 and not [x.name for x in spark.catalog.listTables("global_temp") if x.name.startswith("guarded_")]


def _spellings(ip, r):
    if ip.version == 4:
        a, b, c, d = ip.packed
        return [str(ip), str(int(ip)), hex(int(ip)), f"{a}.{b}.{c * 256 + d}", f"0{a:o}.{b}.{hex(c)}.{d}"]
    text = ip.exploded
    return [f"[{x}]" for x in (str(ip), text, text.upper().lower(), ":".join(g.lstrip("0") or "0" for g in text.split(":")), ":".join(text.split(":")[:6]) + ":" + str(ipaddress.ip_address(int(ip) & 0xFFFFFFFF)), str(ip) + "%eth0")]


def _is_blocked(ip):
    mapped = getattr(ip, "ipv4_mapped", None)
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified or bool(mapped is not None and _is_blocked(mapped))


def test_addresses_equal_the_standard_library(spark):
    r = random.Random(1)
    edges = [n for nets in (addresses.NOT_PUBLIC_4, addresses.PUBLIC_4, addresses.NOT_PUBLIC_6, addresses.PUBLIC_6) for x in nets for n in [ipaddress.ip_network(x)]]
    ips = [ipaddress.ip_address(f) for n in edges for f in (n[0], n[-1], *([n[0] - 1] if int(n[0]) else []), *([n[-1] + 1] if int(n[-1]) + 1 < 1 << n.max_prefixlen else []))]
    ips += [ipaddress.IPv4Address(r.getrandbits(32)) for _ in range(200)] + [ipaddress.IPv6Address(r.getrandbits(128)) for _ in range(100)]
    ips += [ipaddress.IPv6Address((0xFFFF << 32) | r.getrandbits(32)) for _ in range(60)] + [ipaddress.IPv6Address((0x2600 << 112) | (r.getrandbits(2) << r.randrange(100))) for _ in range(60)]
    newer = ipaddress.ip_network("3fff::/20")  # documentation, which this version of the library doesn't know
    rows = [(host, _is_blocked(ip) or ip in newer) for ip in ips for host in _spellings(ip, r)]
    found = spark.createDataFrame(rows, "host string, want boolean").withColumn("got", addresses.not_public(F.col("host"))).where("want <> got OR got IS NULL").collect()
    assert not found, found[:10]


def test_admit_urls(spark):
    private = ["[::ffff:7f00:1]", "[0:0:0:0:0:0:0:1]", "[2001:db8::1]", "[::127.0.0.1]", "127.0.0.1", "169.254.169.254", "2130706433", "0x7f.1", "localhost", "LOCALHOST.", "a.localhost", "[fe80::1%25eth0]", "user:pw@10.0.0.1:80"]
    public = ["8.8.8.8", "[2606:2800:220:1:248:1893:25c8:1946]", "example.org", "10.example.org", "1.2.3.4.5", "256.1.1.1", "me@example.org:8080"]
    odd = {"http://": "no host", "ftp://8.8.8.8": "scheme", "javascript:alert(1)": "scheme", "http://[::1": "malformed address", "http://[1::2::3]/": "malformed address", "http://[12345::]/": "malformed address", "http://[]/": "malformed address"}
    want = {f"http://{h}/x": "private address" for h in private} | {f"https://{h}": None for h in public} | odd
    found = {r.url: r.reject_reason for r in corpus.admit_urls(spark.createDataFrame([(u,) for u in want], "url string")).collect()}
    assert {k: v for k, v in found.items() if k != "http://[::1"} == {k: v for k, v in want.items() if k != "http://[::1"}
    assert found["http://[::1"] is not None


def test_index_layout(spark, tmp_path):
    """The reader takes the number of folders from the index; a very frequent term is dealt out; no file exceeds its size."""
    path = str(tmp_path / "index")
    postings = spark.range(9000).select(F.when(F.col("id") < 6000, F.lit("hot")).otherwise(F.concat(F.lit("w"), F.col("id") % 40)).alias("term"), F.col("id").alias("chunk_id"), F.lit(1).alias("tf"), F.lit(9).alias("doc_len"))
    corpus.write_index(postings, path, buckets=8, file_rows=500)
    asked = spark.createDataFrame([("w3",), ("hot",), ("none",)], "term string")
    assert corpus.read_index(spark, path, asked).count() == 6000 + 75 and corpus.read_index(spark, path).count() == 9000
    sizes = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).count().collect()
    assert max(r["count"] for r in sizes) <= 500
    hot = spark.read.parquet(path).where("term = 'hot'").select(F.input_file_name()).distinct().count()
    assert hot >= 12
    corpus.write_index(postings.withColumn("org_id", F.col("chunk_id") % 2), path, partition="org_id")
    assert corpus.read_index(spark, path, asked).where("org_id = 1").count() == 3000 + sum(1 for i in range(6000, 9000) if i % 40 == 3 and i % 2)
    corpus.write_index(postings.limit(0), path)
    assert corpus.read_index(spark, path, asked).count() == 0


T = dt.datetime(2024, 1, 15)


def _at(days):
    return None if days is None else T + dt.timedelta(days=days)


def test_sessions_as_of(spark):
    rows = [(1, 1, -2, 3, None, None), (2, 1, -2, 3, 1, None), (3, 1, -2, 3, -1, None), (4, 1, -2, 3, None, None), (5, 1, -1, 3, None, 4), (6, 2, -2, 3, None, None), (7, 2, 1, 3, None, 6), (8, 2, 1, 3, None, None), (9, 2, -3, -1, None, None)]
    sessions = spark.createDataFrame([(i, u, _at(c), _at(e), _at(r), f) for i, u, c, e, r, f in rows], "session_id int, user_id int, created_at timestamp_ntz, expires_at timestamp_ntz, revoked_at timestamp_ntz, rotated_from int")
    found = {r.user_id: r.sessions for r in reports.active_sessions(sessions, "2024-01-15 00:00:00").collect()}
    assert found == {1: 3, 2: 1}  # 1, 2 (revoked later), 5; 6 (rotated later)


def test_funnel_as_of(spark):
    requests = spark.createDataFrame([(1, _at(-9), "approved", _at(-8)), (2, _at(-9), "approved", _at(-8)), (3, _at(-9), "approved", _at(1)), (4, _at(-9), "rejected", _at(-8)), (5, _at(1), "approved", _at(2)), (6, _at(-9), None, None), (7, _at(-9), "approved", _at(-8)), (8, _at(-9), "approved", _at(-8))],
        "request_id int, requested_at timestamp_ntz, decision string, decided_at timestamp_ntz")
    invites = spark.createDataFrame([(1, _at(-7), _at(-6), _at(3)), (2, _at(-7), _at(1), _at(3)), (3, _at(2), _at(3), _at(9)), (5, _at(2), None, _at(9)), (7, _at(-7), None, _at(-1)), (8, _at(-7), _at(2), _at(-1))], "request_id int, invited_at timestamp_ntz, accepted_at timestamp_ntz, expires_at timestamp_ntz")
    found = reports.access_funnel(requests, invites, "2024-01-15 00:00:00").first().asDict()
    assert found == {"requested": 7, "approved": 4, "rejected": 1, "invited": 4, "accepted": 1, "pending": 1, "expired": 2}
