"""Lockouts of accounts and addresses, both of which are global: a success clears both, and an attempt is refused while either is locked.

What happens to an account thus depends on the addresses it is tried from, and these on other accounts. Accounts and addresses that are tied by
attempts, directly or over others, are followed in one task as one group. A group with very many attempts is worked on in rounds instead: accounts are
followed each by itself, given which attempts the addresses refuse, then addresses given the accounts, until nothing changes. All that comes before the first
attempt that is wrong is right, so every round gets further; most need a few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.operators.groups import components
from passages.operators.sizes import few
from passages.sources.storage import kept, remove
from passages.streaming.windows import LATE, Lockout, _folded

#: Attempts of a group that one task follows at most.
GIANT_ROWS = 5_000_000

_STATE = {"start": "bigint", "n": "int", "until": "bigint"}
_FIRST = -(1 << 62)


def _named(kind: str, key: str) -> Column:
    """Accounts and addresses as nodes of one graph; a missing one is a node as well."""
    return F.concat(F.lit(kind), F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))


def lockout_both(logins: DataFrame, threshold: int = 10, minutes: int = 15, giant_rows: int = GIANT_ROWS) -> DataFrame:
    """Rows (event_id, account, address, account_failures, address_failures, locked) of logins (event_id, ts, account, address, success).

    Refused attempts don't count. Attempts without a time come first; a missing account or address counts as one of its own.
    """
    return _followed(logins, None, threshold, minutes, giant_rows).select("event_id", "account", "address", "account_failures", "address_failures", "locked")


def _followed(logins: DataFrame, held: DataFrame | None, threshold: int, minutes: int, giant_rows: int) -> DataFrame:
    """The attempts with what became of them and the state of account and address after each. held: states (node, start, n, until) from before."""
    width = minutes * 60 * 1_000_000
    rows = logins.select("event_id", "account", "address", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)).alias("at"), "success", _named("a", "account").alias("a"), _named("d", "address").alias("d"))
    rows = kept(rows, "attempts")
    if held is None:
        held = rows.sparkSession.createDataFrame([], "node string, start bigint, n int, until bigint")
    groups = kept(components(rows.select("a", F.col("d").alias("b"))), "groups")
    sizes = rows.select("a").join(groups, rows["a"] == groups["id"]).groupBy("component").count()
    giant = kept(sizes.where(F.col("count") > giant_rows).select("component"), "giant")
    rows = kept(rows.join(groups.select(F.col("id").alias("a"), F.col("component").alias("key")), "a"), "attempts")
    few_giant = few(giant.withColumnRenamed("component", "key"))
    out = _joint(rows.join(few_giant, "key", "left_anti"), held.join(groups, held["node"] == groups["id"]).drop("id"), threshold, width)
    if giant.limit(1).count():
        out = out.unionByName(_in_rounds(rows.join(few_giant, "key", "left_semi"), held, threshold, width))
    return out


def _joint(rows: DataFrame, held: DataFrame, threshold: int, width: int) -> DataFrame:
    """Whole groups, each in one task that holds the open states of its accounts and addresses."""

    def fold():
        states: dict[str, Lockout] = {}
        seen = 0

        def step(at, event_id, account, address, success, a, d, start, n, until):
            nonlocal seen
            if d is None:  # a state from before
                states[a] = Lockout(threshold, width, start, n, until)
                return 0, 0, False, 0, *[0] * 6
            seen += 1
            if seen % 10_000 == 0:
                for k in [k for k, x in states.items() if at >= x.until and (x.n == 0 or at >= x.start + width)]:
                    del states[k]
            mine = states.setdefault(a, Lockout(threshold, width)), states.setdefault(d, Lockout(threshold, width))
            if refused := any(x.locked(at) for x in mine):
                counts = mine[0].open(at), mine[1].open(at)
            elif success:
                counts = 0, 0
                for x in mine:
                    x.clear()
            else:
                counts = mine[0].fail(at), mine[1].fail(at)
            return *counts, refused, seen, *[v for x in mine for v in (x.start, x.n, x.until)]

        return step

    before = held.select(F.col("component").alias("key"), F.lit(_FIRST).alias("at"), F.col("node").alias("a"), *_STATE)
    entry = {"account_failures": "int", "address_failures": "int", "locked": "boolean", "seq": "bigint"} | {f"{p}_{c}": t for p in "ad" for c, t in _STATE.items()}
    order = ["key", "at", "event_id", "account", "address", "success", "a", "d", *_STATE]
    both = rows.unionByName(before, allowMissingColumns=True).select(*order)
    found = _folded(both, entry, fold, keep=("at", "account", "address", "a", "d")).where("d IS NOT NULL")
    return found.drop("key").withColumnRenamed("seq", "a_seq").withColumn("d_seq", F.col("a_seq"))


def _in_rounds(rows: DataFrame, held: DataFrame, threshold: int, width: int) -> DataFrame:
    """Attempts of giant groups: accounts and addresses are followed in turn, each by itself, until no attempt is judged anew."""

    def follow(rows: DataFrame, mine: str, other: str) -> DataFrame:
        """What became of the attempts by one kind of key, given whether a key of the other kind refuses them (column `other`_locked)."""

        def fold():
            state = Lockout(threshold, width)
            seen = 0

            def step(at, event_id, success, refused, start, n, until):
                nonlocal state, seen
                if success is None:
                    state = Lockout(threshold, width, start, n, until)
                    return 0, False, 0, 0, 0, 0
                seen += 1
                locked = state.locked(at)
                if locked or refused:
                    failures = state.open(at)
                elif success:
                    failures = 0
                    state.clear()
                else:
                    failures = state.fail(at)
                return failures, locked, seen, state.start, state.n, state.until

            return step

        values = ["key", "at", "event_id", "success", "refused", *_STATE]
        events = rows.withColumn("refused", F.col(f"{other}_locked")).drop(f"{mine}_locked").withColumnRenamed(mine, "key")
        before = held.join(events.select(F.col("key").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("key"), F.lit(_FIRST).alias("at"), *_STATE)
        both = events.unionByName(before, allowMissingColumns=True)
        rest = [c for c in both.columns if c not in values]
        entry = {f"{mine}_failures": "int", f"{mine}_locked": "boolean", f"{mine}_seq": "bigint"} | {f"{mine}_{c}": t for c, t in _STATE.items()}
        found = _folded(both.select(*values, *rest), entry, fold, keep=("at", "success", *rest), values=len(values) - 1)
        return found.where("success IS NOT NULL").withColumnRenamed("key", mine)

    rows = rows.select("event_id", "account", "address", "at", F.coalesce("success", F.lit(False)).alias("success"), "a", "d", F.lit(False).alias("d_locked"))
    while True:
        rows = follow(rows.withColumn("was", F.col("d_locked")), "a", "d")
        rows = kept(follow(rows, "d", "a"), "round")
        if not rows.where("d_locked <> was").limit(1).count():
            break
        rows = rows.select("event_id", "account", "address", "at", "success", "a", "d", "d_locked")
    return rows.select("event_id", "at", "account", "address", "a", "d", F.col("a_failures").alias("account_failures"), F.col("d_failures").alias("address_failures"), (F.col("a_locked") | F.col("d_locked")).alias("locked"),
        *[f"{p}_{c}" for p in "ad" for c in _STATE], "a_seq", "d_seq")


def states_after(found: DataFrame, held: DataFrame | None, minutes: int) -> DataFrame:
    """The states (node, start, n, until) that are still open or locked when found's last attempt is as late as any; older ones are dropped."""
    width, late = minutes * 60 * 1_000_000, int(LATE.split()[0]) * 60 * 1_000_000
    ends = None
    for p in "ad":
        last = found.groupBy(F.col(p).alias("node")).agg(F.max_by(F.struct(*[F.col(f"{p}_{c}").alias(c) for c in _STATE]), f"{p}_seq").alias("s")).select("node", "s.*")
        ends = last if ends is None else ends.unionByName(last)
    if held is not None:
        ends = ends.unionByName(held.join(ends.select("node"), "node", "left_anti"))
    now = found.agg(F.max("at").alias("now"))
    return ends.crossJoin(F.broadcast(now)).where((F.col("until") > F.col("now") - late) | (F.col("n") > 0) & (F.col("start") + width > F.col("now") - late)).drop("now")  # now is a single row


def lockout_stream(logins: DataFrame, target: str, checkpoint: str, threshold: int = 10, minutes: int = 15, giant_rows: int = GIANT_ROWS) -> None:
    """lockout_both over a stream, until it has caught up: outcomes go to target/attempts, a folder a micro-batch, open states to target/states.

    Micro-batches count in their order, attempts within one in the order of ts and event_id. A batch reads the states that the one before
    it left and writes its own: a batch that is repeated writes the same again. States whose window and lock have ended, by ten minutes for late attempts,
    are dropped, so that what is kept follows the keys that fail, not all that were ever seen.
    """

    def batch(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        held = spark.read.parquet(f"{target}/states/{n - 1}") if n else None
        found = kept(_followed(rows, held, threshold, minutes, giant_rows), "outcomes")
        states = states_after(found, held, minutes) if held is None or found.limit(1).count() else held
        found.select("event_id", "account", "address", "account_failures", "address_failures", "locked").write.mode("overwrite").parquet(f"{target}/attempts/batch={n}")
        states.write.mode("overwrite").parquet(f"{target}/states/{n}")
        if n > 1:
            remove(spark, f"{target}/states/{n - 2}")

    logins.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

