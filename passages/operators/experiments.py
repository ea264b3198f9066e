"""A/B experiments: buckets, sticky assignment, arms and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passages.operators.sizes import few


def bucket(experiment_id: Column, subject: Column) -> Column:
    """0 to 99 from the first four bytes of the hash of experiment and subject."""
    digest = F.sha2(F.concat_ws(":", experiment_id.cast("string"), subject), 256)
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100).cast("int")


def validate_splits(variants: DataFrame) -> DataFrame:
    """Experiments whose arms break a rule, with the rule: shares add up to 100, two arms or more, one control."""
    rows = variants.groupBy("experiment_id").agg(F.sum("traffic_percent").alias("total"), F.count("*").alias("arms"), F.count_if("is_control").alias("controls"))
    rule = F.when(F.col("total") != 100, "traffic").when(F.col("arms") < 2, "arms").when(F.col("controls") != 1, "control")
    return rows.select("experiment_id", "total", "arms", "controls", rule.alias("violation")).where("violation IS NOT NULL")


def variant_ranges(variants: DataFrame) -> DataFrame:
    """Bucket ranges [low, high) of an experiment's variants, in the order of their ids; the last one takes what is left."""
    order = Window.partitionBy("experiment_id").orderBy("id")
    high = F.sum("traffic_percent").over(order)
    last = F.lead("id").over(order).isNull()
    return variants.select("experiment_id", F.col("id").alias("variant_id"), (high - F.col("traffic_percent")).alias("low"), F.when(last, F.greatest(high, F.lit(100))).otherwise(high).alias("high"))


def assign_by_bucket(subjects: DataFrame, variants: DataFrame) -> DataFrame:
    """Rows (experiment_id, subject, bucket, variant_id) by a join on the experiment and the range; variants are broadcast while they are few."""
    rows = subjects.withColumn("bucket", bucket(F.col("experiment_id"), F.col("subject")))
    ranges = few(variant_ranges(variants).withColumnRenamed("experiment_id", "e"))
    return rows.join(ranges, (F.col("experiment_id") == F.col("e")) & (F.col("bucket") >= F.col("low")) & (F.col("bucket") < F.col("high"))).select("experiment_id", "subject", "bucket", "variant_id")


def sticky_assign(subjects: DataFrame, assignments: DataFrame, variants: DataFrame) -> DataFrame:
    """An earlier assignment holds while its variant exists; all others are assigned by bucket and flagged as new."""
    alive = assignments.join(few(variants.select("experiment_id", F.col("id").alias("variant_id"))), ["experiment_id", "variant_id"], "left_semi")
    kept = alive.select("experiment_id", "subject", F.col("variant_id").alias("earlier"))
    rows = assign_by_bucket(subjects, variants).join(kept, ["experiment_id", "subject"], "left")
    return rows.select("experiment_id", "subject", F.coalesce("earlier", "variant_id").alias("variant_id"), F.col("earlier").isNull().alias("is_new"))


def subject_of(user_id: Column, conversation_id: Column) -> Column:
    return F.when(user_id.isNotNull(), F.concat(F.lit("user:"), user_id.cast("string"))).when(conversation_id.isNotNull(), F.concat(F.lit("conv:"), conversation_id.cast("string"))).otherwise("conv:new")


def running_experiment(experiments: DataFrame) -> DataFrame:
    """The running experiment of each bot that started last."""
    newest = Window.partitionBy("bot_id").orderBy(F.desc("started_at"), F.desc("id"))
    return experiments.where(F.col("status") == "running").withColumn("n", F.row_number().over(newest)).where("n = 1").select("bot_id", F.col("id").alias("experiment_id"))


def assign_variants(turns: DataFrame, experiments: DataFrame, variants: DataFrame, assignments: DataFrame) -> DataFrame:
    """Tags turns (bot_id, user_id, conversation_id) with the variant of their bot's running experiment."""
    rows = turns.withColumn("subject", subject_of(F.col("user_id"), F.col("conversation_id"))).join(few(running_experiment(experiments)), "bot_id")
    subjects = rows.select("experiment_id", "subject").distinct()
    return rows.join(sticky_assign(subjects, assignments, variants), ["experiment_id", "subject"])


def pin_and_check_arms(variants: DataFrame, current: DataFrame) -> DataFrame:
    """Pins a control without version to the current one, and flags arms that equal the control (two nulls are equal)."""
    pinned = variants.join(current, "experiment_id", "left")
    pinned = pinned.withColumn("version_id", F.when(F.col("is_control"), F.coalesce("version_id", "current_version_id")).otherwise(F.col("version_id")))
    control = pinned.where("is_control").select("experiment_id", F.col("version_id").alias("control_version"))
    rows = pinned.join(control, "experiment_id", "left")
    return rows.select("experiment_id", "id", "name", "version_id", (~F.col("is_control") & F.col("version_id").eqNullSafe(F.col("control_version"))).alias("same_as_control"))


def variant_stats(usage: DataFrame, variants: DataFrame, assignments: DataFrame, *, experiment_id: int | None = None, org_id: int | None = None) -> DataFrame:
    """Calls, tokens, cost and assigned subjects of every variant, zeros where idle; usage without a variant doesn't count.

    One experiment's variants with experiment_id; one organisation's usage with org_id.
    """
    if experiment_id is not None:
        variants, assignments = variants.where(F.col("experiment_id") == experiment_id), assignments.where(F.col("experiment_id") == experiment_id)
    if org_id is not None:
        usage = usage.where(F.col("org_id") == org_id)
    used = usage.where("variant_id IS NOT NULL").groupBy("variant_id").agg(F.count("*").alias("calls"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), F.sum("cost_micro").alias("cost_micro"))
    people = assignments.groupBy("variant_id").agg(F.countDistinct("subject").alias("subjects"))
    rows = variants.withColumnRenamed("id", "variant_id").join(used, "variant_id", "left").join(people, "variant_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select(F.col("variant_id").cast("long").alias("variant_id"), "name", "traffic_percent", "is_control", zero("calls"), zero("tokens"), zero("cost_micro"), zero("subjects"))
