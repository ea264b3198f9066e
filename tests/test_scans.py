"""Scans over ranges, chains of windows, components and lockouts against plain folds, with one key that holds most rows."""

import datetime as dt
import random

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from passages.operators import groups, scans
from passages.streaming import lockouts, windows

T0 = dt.datetime(2024, 1, 1)


def _hot(spark, n=3000, parts=7):
    r = random.Random(4)
    rows = [(None if i % 5 == 0 else (7 if i % 5 < 4 else i % 50), None if i % 400 == 0 else T0 + dt.timedelta(seconds=r.choice([0, 1, 5]) + i // 3), i, r.randint(-3, 3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "key int, ts timestamp, event_id int, delta int").repartition(parts)


def test_running_sum(spark):
    rows, df = _hot(spark)
    ranged = scans.in_ranges(df, "key", ["ts", "event_id"], 16)
    assert ranged.where("key = 7").select(scans.RANGE).distinct().count() > 5  # one key uses many tasks
    found = {r.event_id: r.s for r in scans.running_sum(ranged, "key", ["ts", "event_id"], "delta", "s").collect()}
    seen, want = {}, {}
    for key, _, event, delta in sorted(rows, key=lambda x: (x[1] is not None, x[1] or T0, x[2])):
        seen[key] = seen.get(key, 0) + delta
        want[event] = seen[key]
    assert found == want


def test_last_and_next_seen(spark):
    rows, df = _hot(spark)
    ranged = scans.in_ranges(df.withColumn("v", F.when(F.col("event_id") % 97 == 0, F.col("event_id"))), "key", ["event_id"], 16)
    back = {r.event_id: r.x for r in scans.last_seen(ranged, "key", ["event_id"], "v", "x").collect()}
    ahead = {r.event_id: r.x for r in scans.next_seen(ranged, "key", ["event_id"], "v", "x").collect()}
    for key, _, event, _ in rows:
        mine = [e for k, _, e, _ in rows if k == key and e % 97 == 0]
        assert back[event] == max((e for e in mine if e <= event), default=None) and ahead[event] == min((e for e in mine if e >= event), default=None)


def test_chain(spark):
    r = random.Random(2)
    times = {k: sorted({r.randint(0, 5000) for _ in range(n)}) for k, n in ((None, 900), (1, 40), (2, 1))}
    found = scans.chain(spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts], "key int, at long"), 60)
    for key, ts in times.items():
        want, last = [], None
        for t in ts:
            if last is None or t >= last + 60:
                want.append(last := t)
        assert sorted(x.at for x in found.where(F.col("key").eqNullSafe(F.lit(key))).collect()) == want
    assert scans.chain(spark.createDataFrame([], "key int, at long"), 60).count() == 0


@pytest.mark.parametrize("hot_rows", [100, 10**9])
def test_rate_limit_of_hot_keys(spark, hot_rows):
    """Windows found by jumps equal those found hit by hit, repeated rows and hits without a time included."""
    rows, df = _hot(spark, 1500)
    df = df.select("key", "ts", "event_id").union(df.where("event_id % 10 = 3").select("key", "ts", "event_id"))
    found = sorted(((r.key, r.event_id, r.n, r.rejected, r.retry_after) for r in windows.rate_limit_flags(df, 4, 20, hot_rows).collect()), key=str)
    want, state = [], {}
    for key, ts, event, *_ in sorted(rows + [x for x in rows if x[2] % 10 == 3], key=lambda x: (x[1] is not None, x[1] or T0, x[2])):
        start, n = state.get(key, (None, 0))
        start, n = (ts, 1) if start is None or ts >= start + dt.timedelta(seconds=20) else (start, n + 1)
        state[key] = start, n
        left = 1 if ts is None else max(1, int((start + dt.timedelta(seconds=20) - ts).total_seconds()))
        want.append((key, event, n, n > 4, left if n > 4 else None))
    assert found == sorted(want, key=str)


def test_components(spark):
    r = random.Random(9)
    edges = [(f"p{i}", f"p{i + 1}") for i in range(60)] + [("hub", f"h{i}") for i in range(200)] + [(f"x{r.randrange(80)}", f"x{r.randrange(80)}") for _ in range(70)] + [("alone", "alone"), (None, "q"), ("p3", "p40")]
    want = {}

    def root(x):
        want.setdefault(x, x)
        while want[x] != x:
            x = want[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = root(a), root(b)
            want[max(a, b)] = min(a, b)
    found = {x.id: x.component for x in groups.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert found == {x: root(x) for x in want}
    assert groups.components(spark.createDataFrame([], "a string, b string")).count() == 0


def plain_lockouts(rows, threshold, width):
    """One attempt after the other, all accounts and addresses in two dictionaries."""
    states, out = {}, {}
    for event, ts, account, address, success in sorted(rows, key=lambda x: (x[1] is not None, x[1] or T0, x[0])):
        at = 0 if ts is None else int((ts - dt.datetime(1970, 1, 1)).total_seconds())
        mine = [states.setdefault(k, [0, 0, 0]) for k in (("a", account), ("d", address))]  # start, n, until
        if any(at < s[2] for s in mine):
            out[event] = (*[s[1] if at < s[0] + width else 0 for s in mine], True)  # failures whose window has ended count no more
            continue
        counts = []
        for s in mine:
            if success:
                s[1] = 0
                counts.append(0)
                continue
            if s[1] == 0 or at >= s[0] + width:
                s[0], s[1] = at, 0
            s[1] += 1
            counts.append(s[1])
            if s[1] >= threshold:
                s[1], s[2] = 0, at + width
        out[event] = (*counts, False)
    return out


def _attempts(n=800, accounts=30, addresses=12, seed=1):
    r = random.Random(seed)
    return [(i, T0 + dt.timedelta(seconds=20 * i), r.choice([None, *[f"u{k % accounts}" for k in range(accounts)]]), r.choice([None, *[f"10.{k}" for k in range(addresses)]]), r.random() < 0.15) for i in range(n)]


LOGINS = "event_id int, ts timestamp, account string, address string, success boolean"


@pytest.mark.parametrize("giant_rows", [0, 10**9])
def test_lockouts(spark, giant_rows):
    rows = _attempts()
    found = lockouts.lockout_both(spark.createDataFrame(rows, LOGINS), 4, 15, giant_rows)
    got = {r.event_id: (r.account_failures, r.address_failures, r.locked) for r in found.collect()}
    assert got == plain_lockouts(rows, 4, 900) and sum(x[2] for x in got.values()) > 50


def test_address_locks_across_tenants(spark):
    """An address that fails over accounts of many tenants is locked after the threshold; a success elsewhere changes nothing."""
    rows = [(i, T0 + dt.timedelta(seconds=i), f"tenant{i % 4}-u{i}", "10.9", False) for i in range(24)] + [(30, T0 + dt.timedelta(seconds=3), "other", "10.8", True)]
    found = {r.event_id: r.locked for r in lockouts.lockout_both(spark.createDataFrame(rows, LOGINS), 10, 15).collect()}
    assert [found[i] for i in range(24)] == [False] * 10 + [True] * 14 and not found[30]


@pytest.mark.parametrize("giant_rows", [0, 10**9])
def test_lockout_stream(spark, tmp_path, giant_rows):
    """Over three micro-batches the stream gives what the batch gives, a repeated run adds nothing, and ended states are dropped."""
    rows, folder = _attempts(600), str(tmp_path / "in")
    for part in (rows[:200], rows[200:210], rows[210:]):
        spark.createDataFrame(part, LOGINS).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(LOGINS).parquet(folder)
        lockouts.lockout_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), 4, 15, giant_rows)
    lockouts.lockout_stream(spark.readStream.schema(LOGINS).parquet(folder), str(tmp_path / "out"), str(tmp_path / "state"), 4, 15, giant_rows)
    got = {r.event_id: (r.account_failures, r.address_failures, r.locked) for r in spark.read.parquet(str(tmp_path / "out/attempts")).collect()}
    assert got == plain_lockouts(rows, 4, 900)
    assert sorted(p.name for p in (tmp_path / "out/states").iterdir()) == ["1", "2"]
    late = spark.createDataFrame([(9999, T0 + dt.timedelta(days=2), "new", "10.77", False)], LOGINS)
    late.coalesce(1).write.mode("append").parquet(folder)
    lockouts.lockout_stream(spark.readStream.schema(LOGINS).parquet(folder), str(tmp_path / "out"), str(tmp_path / "state"), 4, 15, giant_rows)
    assert {r.node for r in spark.read.parquet(str(tmp_path / "out/states/3")).collect()} == {"a=new", "d=10.77"}


def test_empty(spark):
    none = spark.createDataFrame([], "key int, ts timestamp, event_id int, delta int")
    assert rows_of(windows.backlog_depth(none))[1] == [] and rows_of(windows.rate_limit_flags(none, 1, 1))[1] == []
    assert lockouts.lockout_both(spark.createDataFrame([], LOGINS)).count() == 0
