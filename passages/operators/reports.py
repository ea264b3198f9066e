"""Reports over the index, runs, conversations, audit log and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def index_state(chunks: DataFrame, vectors: DataFrame, stamps: DataFrame, settings: dict) -> DataFrame:
    """Per source with chunks: whether it is indexed (has a vector) and whether that is stale.

    Stale: a vector of another model, or a stamp of the chunker that is missing or differs from the settings. Stamps are text; what is missing or
    no number counts as 0, or -1 for the overlap, and a missing strategy as ''.
    """
    found = chunks.join(vectors.select("chunk_id", "model"), "chunk_id", "left").groupBy("source_id").agg(
        F.bool_or(F.col("model").isNotNull()).alias("indexed"), F.coalesce(F.bool_or(F.col("model") != settings["model"]), F.lit(False)).alias("other_model"))
    rows = found.join(stamps, "source_id", "left")
    number = lambda k, missing: F.coalesce(F.col(k).try_cast("long"), F.lit(missing)) == settings[k]
    same = number("chunker_version", 0) & number("chunk_size", 0) & number("chunk_overlap", -1) & (F.coalesce("chunk_strategy", F.lit("")) == settings["chunk_strategy"])
    return rows.select("source_id", "indexed", (F.col("indexed") & (F.col("other_model") | ~same)).alias("stale"))


def select_reindex(sources: DataFrame, state: DataFrame, only_stale: bool) -> DataFrame:
    """Sources to index again, marked pending: the stale ones, or every one that is no directory."""
    rows = sources.where(F.col("type") != "directory")
    if only_stale:
        rows = rows.join(state.where("stale").select(F.col("source_id").alias("id")), "id", "left_semi")
    return rows.withColumn("status", F.lit("pending"))


def ingest_report(sources: DataFrame) -> DataFrame:
    """Sources by final status and language, with chunks and tokens and the longest error, cut at 1900 characters."""
    return sources.groupBy("status", "lang").agg(
        F.count("*").alias("sources"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"),
        F.max_by(F.substring("error", 1, 1900), F.struct(F.length("error"), F.col("error"))).alias("error"))


def audit_index(chunks: DataFrame, vectors: DataFrame, postings: DataFrame) -> DataFrame:
    """Chunks that lack a vector or postings."""
    no_vector = chunks.join(vectors.select("chunk_id").distinct(), "chunk_id", "left_anti").select("chunk_id", F.lit("vector").alias("missing"))
    no_postings = chunks.join(postings.select("chunk_id").distinct(), "chunk_id", "left_anti").select("chunk_id", F.lit("postings").alias("missing"))
    return no_vector.union(no_postings)


def resolve_current_version(entities: DataFrame, versions: DataFrame, default: int) -> DataFrame:
    """The version that serves an entity: pinned, else its pipeline's current one, else the default."""
    current = versions.where("is_current").groupBy("pipeline_id").agg(F.max("version_id").alias("current_version"))
    return entities.join(current, "pipeline_id", "left").select("entity_id", F.coalesce("pinned_version", "current_version", F.lit(default)).cast("long").alias("version_id"))


def node_timing_report(runs: DataFrame) -> DataFrame:
    """Per node type: runs, mean, median and 95th percentile of durations in node_timings."""
    rows = runs.select(F.explode("node_timings").alias("t")).select("t.type", "t.duration_ms")
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 4).alias("mean_ms"), F.percentile("duration_ms", 0.5).alias("p50_ms"), F.percentile("duration_ms", 0.95).alias("p95_ms"))


def runs_by_status(runs: DataFrame) -> DataFrame:
    """Runs by their status."""
    return runs.groupBy("status").agg(F.count("*").alias("n"))


def agent_turn_rollup(messages: DataFrame) -> DataFrame:
    """Per turn, from a user's message to the next one: tokens and cost over its steps, the tools called in order, and the last assistant text.

    Tool calls are the system rows here, the first word of their content the tool's name. Rows before the first user message are turn 0.
    """
    is_tool = F.col("role") == "system"
    order = Window.partitionBy("conversation_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = messages.withColumn("turn_no", F.sum((F.col("role") == "user").cast("int")).over(order))
    return rows.groupBy("conversation_id", F.col("turn_no").cast("long").alias("turn_no")).agg(
        F.sum("tokens_in").cast("long").alias("tokens_in"), F.sum("tokens_out").cast("long").alias("tokens_out"), F.coalesce(F.sum("cost_micro"), F.lit(0)).cast("long").alias("cost_micro"),
        F.count_if(is_tool).alias("tool_calls"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(is_tool, F.struct("turn", "content")))), lambda x: F.substring_index(x["content"], " ", 1)), ",").alias("calls"),
        F.max_by(F.when(F.col("role") == "assistant", F.col("content")), F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer"))


def pipeline_usage(pipelines: DataFrame, versions: DataFrame, bots: DataFrame) -> DataFrame:
    """Versions and bots of each pipeline; one without bots may be deleted."""
    n_versions = versions.groupBy("pipeline_id").agg(F.count("*").alias("versions"))
    n_bots = bots.where("pipeline_id IS NOT NULL").groupBy("pipeline_id").agg(F.count("*").alias("bots"))
    rows = pipelines.join(n_versions, "pipeline_id", "left").join(n_bots, "pipeline_id", "left")
    bots_or_none = F.coalesce("bots", F.lit(0))
    return rows.select("pipeline_id", F.coalesce("versions", F.lit(0)).alias("versions"), bots_or_none.alias("bots"), (bots_or_none == 0).alias("deletable"))


def conversation_rollup(messages: DataFrame) -> DataFrame:
    """Per conversation: title (first user message, 64 characters), messages in all and by role, tokens, cost, latency and last activity."""
    is_user = F.col("role") == "user"
    return messages.groupBy("conversation_id").agg(
        F.substring(F.min_by(F.when(is_user, F.col("content")), F.when(is_user, F.col("turn"))), 1, 64).alias("title"), F.count("*").alias("messages"), F.count_if(is_user).alias("user_turns"),
        *[F.count_if(F.col("role") == role).alias(f"{role}_messages") for role in ("assistant", "system")], F.max("created_s").alias("last_activity_s"),
        F.sum(F.col("tokens_in") + F.col("tokens_out")).cast("long").alias("tokens"), F.coalesce(F.sum("cost_micro"), F.lit(0)).cast("long").alias("cost_micro"), F.max("latency_ms").alias("latency_ms"))


def histogram_quantile(observations: DataFrame, value: str, by: list[str], bounds: list[float], q: float) -> DataFrame:
    """A quantile as dashboards read it from cumulative buckets: linear within the bucket that holds it; above the last bound, that bound."""
    bucket: Column = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        bucket = F.when(F.col(value) <= bounds[i], i).otherwise(bucket)
    counts = observations.groupBy(*by, bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy("bucket")
    rows = counts.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    edges = F.array(*[F.lit(float(b)) for b in [0.0, *bounds]])
    rank = F.col("total") * q
    low, high = F.element_at(edges, F.col("bucket") + 1), F.element_at(edges, F.least(F.col("bucket") + 2, F.lit(len(bounds) + 1)))
    inside = low + (high - low) * (rank - (F.col("upto") - F.col("n"))) / F.col("n")
    hit = rows.where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
    return hit.select(*by, F.col("total").alias("n"), F.round(F.when(F.col("bucket") == len(bounds), float(bounds[-1])).otherwise(inside), 6).alias("quantile"))


def stage_hits(observations: DataFrame, by: list[str]) -> DataFrame:
    """How many observations there are by retrieval stage and outcome, or the like."""
    return observations.groupBy(*by).agg(F.count("*").alias("hits"))


def audit_report(audit: DataFrame, by: list[str]) -> DataFrame:
    """Entries by the given columns, with failures by the reason in their payload."""
    return audit.groupBy(*by, F.get_json_object("payload", "$.reason").alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("ip").alias("addresses"))


def access_funnel(requests: DataFrame, invites: DataFrame, as_of: str) -> DataFrame:
    """One row, as things stood at as_of: requested, approved, rejected, invited, accepted, and what is pending or expired.

    requests: request_id, requested_at, decision, decided_at; invites: request_id, invited_at, accepted_at, expires_at. What happens later hasn't happened:
    an invite accepted after as_of is still pending, or expired. A decision or request without a time counts as made before.
    """
    at = F.lit(as_of).cast("timestamp_ntz")
    by_then = lambda c: F.coalesce(F.col(c) <= at, F.lit(True))
    rows = requests.where(by_then("requested_at")).join(invites.where(F.col("invited_at") <= at), "request_id", "left")
    decided = lambda d: (F.col("decision") == d) & by_then("decided_at")
    invited, accepted = F.col("invited_at").isNotNull(), F.coalesce(F.col("accepted_at") <= at, F.lit(False))
    waiting = invited & ~accepted
    return rows.agg(
        F.countDistinct("request_id").alias("requested"), F.countDistinct(F.when(decided("approved"), F.col("request_id"))).alias("approved"), F.countDistinct(F.when(decided("rejected"), F.col("request_id"))).alias("rejected"),
        F.count_if(invited).alias("invited"), F.count_if(invited & accepted).alias("accepted"), F.count_if(waiting & (F.col("expires_at") > at)).alias("pending"), F.count_if(waiting & (F.col("expires_at") <= at)).alias("expired"))


def active_sessions(sessions: DataFrame, as_of: str) -> DataFrame:
    """Sessions per user that at as_of exist and are neither revoked, by a successor or otherwise, nor expired. What is revoked or rotated later is still active then."""
    at = F.lit(as_of).cast("timestamp_ntz")
    there = sessions.where(F.col("created_at") <= at)
    rotated = there.where("rotated_from IS NOT NULL").select(F.col("rotated_from").alias("session_id")).distinct()
    alive = there.where((F.col("expires_at") > at) & F.coalesce(F.col("revoked_at") > at, F.lit(True))).join(rotated, "session_id", "left_anti")
    return alive.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("expires_at").alias("last_expiry"))
