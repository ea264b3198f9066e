"""Operational metrics over event streams; ts must be a timestamp.

Windowed functions take a batch or a streaming DataFrame alike. What depends on all that a key saw before has two forms: one over sorted batches,
and one whose name ends in _stream, which keeps the key's state between micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passages.operators import scans
from passages.operators.sizes import few
from passages.sources.storage import kept

LATE = "10 minutes"


def timed(events: DataFrame, column: str = "ts") -> DataFrame:
    """Event times as timestamps, with the watermark that all streams here use."""
    rows = events.withColumn(column, F.col(column).cast("timestamp"))
    return rows.withWatermark(column, LATE) if rows.isStreaming else rows


def _windowed(rows: DataFrame, keys: list, width: str, slide: str | None, *aggregates) -> DataFrame:
    names = [k if isinstance(k, str) else "key" for k in keys]
    found = rows.groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), *keys).agg(*aggregates)
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *names, *[c for c in found.columns if c not in ("window", *names)])


def request_rate(requests: DataFrame) -> DataFrame:
    """Requests a second by route, over five minutes."""
    return _windowed(timed(requests), ["route"], "5 minutes", None, F.round(F.count("*") / 300, 6).alias("per_second"))


def error_rate(requests: DataFrame) -> DataFrame:
    """Failed requests a second by route, over five minutes."""
    return _windowed(timed(requests.where("status >= 500")), ["route"], "5 minutes", None, F.round(F.count("*") / 300, 6).alias("per_second"))


def latency_buckets(requests: DataFrame, bounds: list[float], by: tuple[str, ...] = ("route",)) -> DataFrame:
    """Cumulative bucket counts of seconds by route (or model, or retrieval stage), over five minutes, every minute."""
    counts = [F.count_if(F.col("seconds") <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return _windowed(timed(requests), list(by), "5 minutes", "1 minute", *counts, F.count("*").alias("n"))


def latency_p95(requests: DataFrame, bounds: list[float], q: float = 0.95, by: tuple[str, ...] = ("route",)) -> DataFrame:
    """The quantile as dashboards read it from latency_buckets(): linear inside the bucket that holds it; above the last bound, that bound."""
    rank = F.col("n") * q
    value = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        below, low = (F.col(f"le_{i - 1}"), float(bounds[i - 1])) if i else (F.lit(0), 0.0)
        value = F.when(F.col(f"le_{i}") >= rank, low + (float(bounds[i]) - low) * (rank - below) / (F.col(f"le_{i}") - below)).otherwise(value)
    return latency_buckets(requests, bounds, by).withColumn("p95", F.round(value, 6))


def token_rate(usage: DataFrame) -> DataFrame:
    """Tokens a second by model and direction, over five minutes."""
    rows = timed(usage).select("ts", "model", F.inline(F.array(F.struct(F.lit("in").alias("direction"), F.col("tokens_in").alias("tokens")), F.struct(F.lit("out").alias("direction"), F.col("tokens_out").alias("tokens")))))
    return _windowed(rows, ["model", "direction"], "5 minutes", None, F.round(F.sum("tokens") / 300, 6).alias("per_second"))


def spend_per_hour(usage: DataFrame) -> DataFrame:
    """Known spend in millionths, scaled to an hour, by model over five minutes; unknown prices don't count."""
    return _windowed(timed(usage).where("cost_micro IS NOT NULL"), ["model"], "5 minutes", None, (F.sum("cost_micro") * 12).cast("long").alias("micro_per_hour"))


def outcome_rate(events: DataFrame, by: tuple[str, ...] = ("status",)) -> DataFrame:
    """Outcomes over fifteen minutes: of ingests by status, of provider errors by provider and model."""
    return _windowed(timed(events), list(by), "15 minutes", None, F.count("*").alias("n"))


def chat_sessions(events: DataFrame, idle: str = "15 minutes") -> DataFrame:
    """Sessions of each user: activity without a pause longer than idle."""
    found = timed(events).groupBy(F.session_window("ts", idle), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), F.col("session_window.end").cast("timestamp_ntz").alias("ended"), "n")


def backlog_depth(changes: DataFrame) -> DataFrame:
    """Rows (key, event_id, depth): enqueued minus finished after each change (key, ts, event_id, delta). A key with very many changes is summed in parallel ranges."""
    order = ["at", "event_id"]
    rows = changes.select("key", F.col("ts").cast("timestamp").alias("at"), "event_id", F.col("delta").cast("long").alias("delta"))
    return scans.running_sum(scans.in_ranges(rows, "key", order), "key", order, "delta", "depth").select("key", "event_id", "depth")


def backlog_depth_stream(changes: DataFrame) -> DataFrame:
    """backlog_depth over a stream: the state is a key's depth. Within a micro-batch changes count in the order of ts and event_id."""

    def fold(state, at, event_id, delta):
        depth = (state[0] if state else 0) + int(delta)
        return (depth,), (depth,)

    return _stateful(changes.select("key", "ts", "event_id", "delta"), fold, "depth bigint", "depth bigint")


def _allowances(usage: DataFrame) -> DataFrame:
    return usage.where("key_source = 'system'").select(F.col("org_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("tokens_in") + F.col("tokens_out")).cast("long").alias("tokens"))


def running_allowance(usage: DataFrame, limit: int) -> DataFrame:
    """Per organisation, the first event at which its running use of the shared key reaches the limit. An organisation with very many events is summed in parallel ranges."""
    order = ["ts", "event_id"]
    rows = scans.running_sum(scans.in_ranges(_allowances(usage), "key", order), "key", order, "tokens", "used")
    before = F.col("used") - F.coalesce("tokens", F.lit(0))
    return rows.where((before < limit) & (F.col("used") >= limit)).select(F.col("key").alias("org_id"), "event_id", "used")


def running_allowance_stream(usage: DataFrame, limit: int) -> DataFrame:
    """running_allowance over a stream: the state is an organisation's use so far; a row comes out once it reaches the limit."""

    def fold(state, at, event_id, tokens):
        before = state[0] if state else 0
        used = before + int(tokens)
        return (used,), (used, before < limit <= used)

    found = _stateful(_allowances(usage), fold, "used bigint", "used bigint, reached boolean")
    return found.where("reached").select(F.col("key").alias("org_id"), "event_id", "used")


def _stateful(rows: DataFrame, fold: Callable, state: str, entry: str, until: Callable | None = None) -> DataFrame:
    """Rows (key, event_id, *entry) of a stream (key, ts, event_id, ...). fold(state, at, event_id, ...) returns the new state, a tuple, and the entry.

    A micro-batch's rows of a key are sorted by ts and event_id; between micro-batches only the state is kept. until(state) gives the
    microsecond from which a state says nothing any more: once the watermark has passed it, a timer drops the state. Without it states stay.
    """
    import pandas as pd

    names = [c for c in rows.columns if c not in ("key", "ts", "event_id")]
    schema = StructType([rows.schema["key"], rows.schema["event_id"], *StructType.fromDDL(entry).fields])

    def step(key, batches, held):
        if held.hasTimedOut:
            held.remove()
            return
        value = held.get if held.exists else None
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for at, event_id, *values in zip(pdf["ts"], pdf["event_id"], *[pdf[n] for n in names], strict=True):
            value, found = fold(value, at, event_id, *values)
            out.append((key[0], event_id, *found))
        held.update(value)
        if until is not None:  # a timer must lie ahead of the watermark
            held.setTimeoutTimestamp(max(-(-until(value) // 1000), held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=schema.names)

    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    if until is not None:
        rows = rows.withWatermark("ts", LATE)
    return rows.groupBy("key").applyInPandasWithState(step, schema, state, "append", "NoTimeout" if until is None else "EventTimeTimeout")


def _folded(rows: DataFrame, entry: dict[str, str], fold: Callable[[], Callable], keep: tuple[str, ...] = (), values: int | None = None) -> DataFrame:
    """Rows (key, event_id, *keep, *entry) of rows (key, at, event_id, ...), each key's rows in the order of the columns after key.

    fold() returns the step of a new key, which takes a row's columns after key, or as many of them as `values` says, and returns its
    entry. Rows stream by in sorted partitions: besides an Arrow batch, a task holds the state of one key, however many rows the key has.
    """
    kept_at = [rows.columns.index(c) for c in keep]
    last_value = len(rows.columns) if values is None else values + 1

    def run(batches):
        import pyarrow as pa

        types = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
        last = step = None
        for batch in batches:
            entries = []
            for key, *values in zip(*[c.to_pylist() for c in batch.columns[:last_value]], strict=True):
                if step is None or key != last:
                    last, step = key, fold()
                entries.append(step(*values))
            if entries:
                found = [pa.array(x, types[t]) for x, t in zip(zip(*entries, strict=True), entry.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[batch.column(i) for i in kept_at], *found], names=["key", "event_id", *keep, *entry])

    schema = StructType([rows.schema["key"], rows.schema["event_id"], *[rows.schema[c] for c in keep], *StructType.fromDDL(", ".join(f"{c} {t}" for c, t in entry.items())).fields])
    return rows.repartition("key").sortWithinPartitions(*rows.columns).mapInArrow(run, schema)


#: Hits of a key that one task follows at most.
HOT_ROWS = 5_000_000


def rate_limit_flags(hits: DataFrame, limit: int, window_s: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows (key, event_id, n, rejected, retry_after) of hits (key, ts, event_id): windows start at a key's first hit; rejected hits count too.

    A key's hits are followed in one task, which sorts them with spilling and holds two numbers for the key. Keys with more than hot_rows hits
    are dealt out instead: their windows are found by scans.chain() and hits are numbered from their window's first. Hits without a time
    come first, each a window of its own. For a batch; `rate_limit_stream` takes streams.
    """
    width = window_s * 1_000_000

    def fold():
        start, n = None, 0

        def step(at, event_id):
            nonlocal start, n
            if start is None or at >= start + width:  # hits without a time come first
                start, n = at, 0
            n += 1
            return n, start

        return step

    rows = hits.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    hot = kept(rows.groupBy("key").count().where(F.col("count") > hot_rows).select("key"), "hot")
    others, hot_side = rows, few(hot.withColumnRenamed("key", "_key"))
    some = hot.limit(1).count() > 0
    if some:
        others = rows.join(hot_side, rows["key"].eqNullSafe(hot_side["_key"]), "left_anti")
    found = _folded(others, {"n": "int", "start": "bigint"}, fold, keep=("at",))
    if some:
        found = found.unionByName(_numbered(rows.join(hot_side, rows["key"].eqNullSafe(hot_side["_key"]), "left_semi"), width))
    left = F.coalesce(F.greatest(F.lit(1).cast("long"), F.ceil((F.col("start") + width - F.col("at")) / 1_000_000)), F.lit(1).cast("long"))
    rejected = F.col("n") > limit
    return found.select("key", "event_id", "n", rejected.alias("rejected"), F.when(rejected, left).alias("retry_after"))


def _numbered(rows: DataFrame, width: int) -> DataFrame:
    """Rows (key, event_id, at, n, start) of hits (key, at, event_id), a key's hits in parallel ranges: start of the window and number within it."""
    order = ["at", "event_id"]
    starts = scans.chain(rows.where("at IS NOT NULL").select("key", "at").distinct(), width).select(F.col("key").alias("_key"), F.col("at").alias("_start"))
    ranged = scans.running_sum(scans.in_ranges(rows.where("at IS NOT NULL").withColumn("one", F.lit(1)), "key", order), "key", order, "one", "seq")
    ranged = kept(ranged, "numbered")
    on = ranged["key"].eqNullSafe(starts["_key"]) & (ranged["at"] == starts["_start"])
    firsts = ranged.join(starts, on).groupBy(F.col("key").alias("_key"), "_start").agg(F.min("seq").alias("_seq"))
    first = F.when(F.col("_seq").isNotNull(), F.struct(F.col("_seq").alias("seq"), F.col("_start").alias("start")))
    marked = ranged.join(firsts, ranged["key"].eqNullSafe(firsts["_key"]) & (ranged["seq"] == firsts["_seq"]), "left").withColumn("first", first).drop("_key", "_seq", "_start")
    found = scans.last_seen(marked, "key", [*order, "seq"], "first", "window")
    found = found.select("key", "event_id", "at", (F.col("seq") - F.col("window.seq") + 1).cast("int").alias("n"), F.col("window.start").alias("start"))
    untimed = rows.where("at IS NULL").select("key", "event_id", "at", F.lit(1).alias("n"), F.lit(None).cast("long").alias("start"))
    return found.unionByName(untimed)


def rate_limit_stream(hits: DataFrame, limit: int, window_s: int) -> DataFrame:
    """rate_limit_flags over a stream: state is a window's start and count for each key, dropped when the watermark has passed the window's end. Hits later than the watermark are dropped."""
    width = window_s * 1_000_000

    def fold(state, at, event_id):
        at = at.value // 1000
        start, n = state or (None, 0)
        if start is None or at >= start + width:
            start, n = at, 0
        n += 1
        left = max(1, -((at - start - width) // 1_000_000))
        return (start, n), (n, n > limit, left if n > limit else None)

    rows = hits.where("ts IS NOT NULL").select("key", "ts", "event_id")
    return _stateful(rows, fold, "start bigint, n int", "n int, rejected boolean, retry_after bigint", lambda state: state[0] + width)


class Lockout:
    """Failures of one account or address. The window starts at the first failure and ends, or locks the key for as long, at the threshold."""

    def __init__(self, threshold: int, width: int, start: int = 0, n: int = 0, until: int = 0):
        self.threshold, self.width, self.start, self.n, self.until = threshold, width, start, n, until

    def locked(self, at: int) -> bool:
        return at < self.until

    def open(self, at: int) -> int:
        """Failures that still count."""
        return self.n if at < self.start + self.width else 0

    def fail(self, at: int) -> int:
        if self.n == 0 or at >= self.start + self.width:
            self.start, self.n = at, 0
        self.n += 1
        failures = self.n
        if self.n >= self.threshold:
            self.n, self.until = 0, at + self.width
        return failures

    def clear(self) -> None:
        self.n = 0


def lockout_flags(logins: DataFrame, key: str, threshold: int = 10, minutes: int = 15) -> DataFrame:
    """Rows (key, event_id, failures, locked) of logins (ts, event_id, success) by one key: attempts while locked are refused and don't count; success clears.

    A key's attempts go to one task, which sorts them with spilling and holds three numbers for the key; attempts without a time come first. `lockouts.lockout_both` follows accounts
    and addresses together.
    """
    width = minutes * 60 * 1_000_000

    def fold():
        state = Lockout(threshold, width)

        def step(at, event_id, success):
            at = at or 0
            if state.locked(at):
                return state.n, True
            if success:
                state.clear()
                return 0, False
            return state.fail(at), False

        return step

    rows = logins.select(F.col(key).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "success")
    return _folded(rows, {"failures": "int", "locked": "boolean"}, fold)


def stream_ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, size: int = 400, overlap: int = 40, strategy: str = "semantic") -> None:
    """Brings documents (doc, name, text) into the stored index at target as files of them land in a folder; returns when it has caught up.

    A micro-batch is one segment of the index: it writes the chunks, postings, vectors and sources of its own documents and nothing else, and replaces what
    the index had of them. A batch that is repeated changes nothing. Documents that fail have a row in sources and no chunks, and stop nothing. Of a
    document that stands in a batch several times, the longest text counts.
    """
    from passages.operators.chunking import ingest_corpus
    from passages.sources.index import StoredIndex

    def batch(docs: DataFrame, n: int) -> None:
        if docs.limit(1).count():
            one = docs.groupBy("doc").agg(F.max_by(F.struct("name", "text"), F.struct(F.length("text"), "text", "name")).alias("d")).select("doc", "d.*")
            StoredIndex(docs.sparkSession, target).append(ingest_corpus(one, size, overlap, strategy), one.select("doc"), f"stream-{n}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_assign(turns: DataFrame, variants: DataFrame, experiment_id: int, assignments: DataFrame | None = None) -> DataFrame:
    """Tags turns, live or not, with the variant of their subject: an earlier assignment (experiment_id, subject, variant_id) if its variant still exists, else the one that its hash falls on.

    The hash sticks as long as the variants do; `sticky_assign_stream` keeps subjects where they are even when traffic is dealt anew.
    """
    from passages.operators.experiments import bucket, variant_ranges

    ranges = variant_ranges(variants).where(F.col("experiment_id") == experiment_id).select("variant_id", "low", "high")
    rows = turns.withColumn("bucket", bucket(F.lit(experiment_id), F.col("subject")))
    rows = rows.join(few(ranges), (F.col("bucket") >= F.col("low")) & (F.col("bucket") < F.col("high"))).drop("low", "high")
    if assignments is None:
        return rows
    held = assignments.where(F.col("experiment_id") == experiment_id).join(variants.where(F.col("experiment_id") == experiment_id).select(F.col("id").alias("variant_id")), "variant_id", "left_semi")
    held = held.groupBy("subject").agg(F.min("variant_id").alias("held"))
    return rows.join(held, "subject", "left").withColumn("variant_id", F.coalesce("held", "variant_id")).drop("held")


def sticky_assign_stream(turns: DataFrame, variants: DataFrame | None = None, experiment_id: int | None = None, assignments: DataFrame | None = None, idle_days: int | None = None) -> DataFrame:
    """Rows (key, event_id, variant_id) of tagged live turns (subject, ts, event_id, variant_id): a subject keeps the first variant it was seen with. The state is that variant.

    assignments (experiment_id, subject, variant_id): a subject that is new here starts with the one stored for it. variants: a kept or stored one that the
    experiment has no longer is dealt anew, by the turn's own variant. idle_days: a subject without a turn for so long is forgotten; what was assigned must then be stored.
    """
    rows = turns.select(F.col("subject").alias("key"), "ts", "event_id", F.col("variant_id").cast("long").alias("variant_id"))
    alive = None if variants is None else {r["id"] for r in variants.where(F.col("experiment_id") == experiment_id).select("id").collect()}  # the arms of one experiment
    stored = F.lit(None).cast("long").alias("stored")
    if assignments is not None:
        held = assignments.where(F.col("experiment_id") == experiment_id).groupBy(F.col("subject").alias("key")).agg(F.min("variant_id").cast("long").alias("stored"))
        rows, stored = rows.join(held, "key", "left"), F.col("stored")
    span = (idle_days or 0) * 86_400_000_000

    def fold(state, at, event_id, variant_id, stored):
        held = state[0] if state else None if stored is None or stored != stored else int(stored)
        if held is None or alive is not None and held not in alive:
            held = int(variant_id)
        return (held, at.value // 1000), (held,)

    return _stateful(rows.select("key", "ts", "event_id", "variant_id", stored), fold, "variant bigint, seen bigint", "variant_id bigint", (lambda state: state[1] + span) if idle_days else None)
