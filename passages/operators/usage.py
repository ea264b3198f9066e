"""Usage accounting: prices, summaries, allowances, key sources. Costs are kept in millionths, so sums are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_of(usage: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rows of the last `days` days (1 to 90) before as_of."""
    days = max(1, min(90, days))
    return usage.where(F.col("created_at") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))


def usage_summary(usage: DataFrame, as_of: str, days: int) -> DataFrame:
    """One row: calls, tokens, cost (unknown prices count as nothing) and calls without a price; zeros over no rows."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return window_of(usage, as_of, days).agg(
        F.count("*").alias("calls"), zero("tokens_in").alias("tokens_in"), zero("tokens_out").alias("tokens_out"),
        zero("cost_micro").alias("cost_micro"), F.count_if(F.col("cost_micro").isNull()).alias("calls_without_price"),
    )


def usage_by_model(usage: DataFrame, as_of: str, days: int, top: int = 10) -> DataFrame:
    """The models that cost most; unknown costs last, missing names as 'unknown'."""
    named = lambda c: F.coalesce(F.col(c), F.lit("unknown")).alias(c)
    rows = window_of(usage, as_of, days).groupBy(named("provider"), named("model")).agg(
        F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost_micro").alias("cost_micro"))
    return rows.orderBy(F.desc_nulls_last("cost_micro"), "provider", "model").limit(top)


def allowance(usage: DataFrame, orgs: DataFrame, limit: int, as_of: str, days: int = 0) -> DataFrame:
    """Tokens that each organisation took on the shared key, what remains, and whether it is exhausted; days 0: over its lifetime."""
    rows = usage.where(F.col("key_source") == "system")
    rows = window_of(rows, as_of, days) if days else rows
    used = rows.groupBy("org_id").agg(F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("used"))
    joined = orgs.join(used, "org_id", "left").select("org_id", F.coalesce("used", F.lit(0)).alias("used"))
    return joined.select("org_id", "used", F.greatest(F.lit(limit) - F.col("used"), F.lit(0)).cast("long").alias("remaining"), (F.lit(limit > 0) & (F.col("used") >= limit)).alias("exhausted"))


def tenant_spend(usage: DataFrame, threshold_micro: int) -> DataFrame:
    """Spend by organisation and day, where it passes the threshold."""
    rows = usage.groupBy("org_id", F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.coalesce(F.sum("cost_micro"), F.lit(0)).alias("cost_micro"), F.count("*").alias("calls"))
    return rows.where(F.col("cost_micro") > threshold_micro)


def cost(price_in: Column, price_out: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Cost in whole units, six places, halves to even; prices are for a million tokens."""
    total = price_in.cast("decimal(18,0)") * tokens_in.cast("decimal(18,0)") + price_out.cast("decimal(18,0)") * tokens_out.cast("decimal(18,0)")
    return F.bround((total.cast("decimal(32,6)") / F.lit(1000000).cast("decimal(10,0)")), 6).cast("decimal(18,6)")


def price_calls(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Prices each call by the catalog; models that it doesn't know keep a null cost, flagged."""
    prices = catalog.select("provider", "model", "price_in", "price_out")
    joined = calls.join(prices, ["provider", "model"], "left")
    return joined.withColumn("cost", cost(F.col("price_in"), F.col("price_out"), F.col("tokens_in"), F.col("tokens_out"))).withColumn("cost_unknown", F.col("price_in").isNull())


def select_models(catalog: DataFrame, as_of: str, dimensions: int, embedding_providers: tuple[str, ...]) -> DataFrame:
    """Models that are still on offer at as_of, with usable and unusable_reason.

    A chat model is usable. An embedding model needs a provider with an adapter, and vectors that are as wide as the index or can be cut.
    """
    rows = catalog.where(F.col("retires_on").isNull() | (F.col("retires_on") > as_of))
    fixed = ~F.coalesce("supports_dimensions", F.lit(False)) & ~F.col("native_dimensions").eqNullSafe(F.lit(dimensions))
    reason = F.when(F.col("kind") == "embedding", F.when(~F.col("provider").isin(*embedding_providers), F.concat(F.lit("no embedding adapter for "), F.col("provider")))
                    .when(fixed, F.concat(F.lit("fixed width of "), F.coalesce(F.col("native_dimensions").cast("string"), F.lit("unknown")), F.lit(f", the index stores {dimensions}"))))
    return rows.withColumn("unusable_reason", reason).withColumn("usable", F.col("unusable_reason").isNull())


def classify_provider_errors(calls: DataFrame) -> DataFrame:
    """Counts of failed calls by provider, model and code; calls need status and message."""
    quota = F.lower("message").rlike("quota|credit|billing|insufficient|payment")
    code = (
        F.when(F.col("status").isin(401, 403), "auth").when((F.col("status") == 429) & quota, "quota").when(F.col("status") == 429, "rate_limited")
        .when(F.col("status").isNull() | (F.col("status") >= 500), "unavailable").otherwise("error")
    )
    return calls.groupBy("provider", "model", code.alias("code")).agg(F.count("*").alias("n"))


def resolve_key_source(orgs: DataFrame, own_keys: DataFrame, deployment_keys: DataFrame) -> DataFrame:
    """Which key serves an organisation and provider: its own, else the deployment's; without any, usage counts as its own."""
    own = own_keys.select("org_id", "provider").distinct().withColumn("own", F.lit(True))
    shared = deployment_keys.select("provider").distinct().withColumn("shared", F.lit(True))
    rows = orgs.join(own, ["org_id", "provider"], "left").join(shared, "provider", "left")
    source = F.when(F.col("own"), "org").when(F.col("shared"), "system").otherwise("org")
    return rows.select("org_id", "provider", source.alias("key_source"), (F.coalesce("own", F.lit(False)) | F.coalesce("shared", F.lit(False))).alias("usable"))


def embedding_usage(chunks: DataFrame, price_per_million: int, keys: DataFrame) -> DataFrame:
    """One usage row for each source that was embedded: its organisation, tokens, their price in millionths, and whose key paid.

    keys (org_id, key_source): what resolve_key_source() says for the provider; an organisation without a key counts as its own.
    """
    rows = chunks.groupBy("source_id", "org_id").agg(F.sum("tokens").alias("tokens_in")).withColumn("cost_micro", F.col("tokens_in") * price_per_million)
    return rows.join(keys.select("org_id", "key_source"), "org_id", "left").select("source_id", "org_id", "tokens_in", "cost_micro", F.coalesce("key_source", F.lit("org")).alias("key_source"))
