"""Topic catalogue of message recordings and clock comparison between topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scalars import classify_topic, topic_entity_path
from tracelake.schema import ROBOT_ROLES, SIGNAL_COLUMNS

TOPIC_SCHEMA = (
    "topic string, role string, schema_name string, message_type string, message_encoding string, "
    "message_count bigint, convertible boolean, skip_reason string, start_time double, end_time double"
)


def topic_stats(messages: DataFrame) -> DataFrame:
    """One row per topic of a recording from a message index
    ``(recording_id, source_id, topic, schema_name, message_encoding, log_time)``."""
    grouped = messages.groupBy("recording_id", "source_id", "topic").agg(
        F.min("schema_name").alias("schema_name"),
        F.min("message_encoding").alias("message_encoding"),
        F.count(F.lit(1)).alias("message_count"),
        F.min("log_time").cast("double").alias("start_time"),
        F.max("log_time").cast("double").alias("end_time"),
    )
    named = classify_topic(F.col("topic"), F.col("schema_name"))
    return grouped.withColumn("_class", named).select(
        "*", F.col("_class.role"), F.col("_class.semantic_type"), F.col("_class.confidence")
    ).drop("_class")


def source_stats(topics: DataFrame) -> DataFrame:
    """Topic, message and clock totals per source."""
    return topics.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("topic_count"),
        F.sum("message_count").alias("message_count"),
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.max(F.col("role") == "robot_model").alias("has_robot_description"),
    )


def role_counts(topics: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Topics per known role, absent roles with 0: one row per role, per group where one is given."""
    keys = group or []
    counts = [F.sum(F.when(F.col("role") == role, 1).otherwise(0)).alias(role) for role in ROBOT_ROLES]
    wide = topics.groupBy(*keys).agg(*counts)
    pairs = F.array(
        *[
            F.struct(F.lit(role).alias("role"), F.coalesce(F.col(role), F.lit(0)).cast("bigint").alias("n"))
            for role in ROBOT_ROLES
        ]
    )
    return wide.select(*keys, F.explode(pairs).alias("_pair")).select(*keys, "_pair.role", "_pair.n")


def topic_signals(topics: DataFrame) -> DataFrame:
    """Two signal rows per topic: its summary object and its message count; neither has a time."""
    defaults = {
        "message_type": F.col("schema_name"),
        "convertible": F.lit(True),
        "skip_reason": F.lit(""),
        "ord": F.lit(0).cast("bigint"),
    }
    for name, value in defaults.items():
        if name not in topics.columns:
            topics = topics.withColumn(name, value)
    fields = [part.split()[0] for part in TOPIC_SCHEMA.split(", ")]
    nothing = F.lit(None).cast("double")

    def cell(key: str, kind: str, number, text):
        return F.struct(
            F.lit(key).alias("key"), F.lit(kind).alias("value_type"), number.alias("value_num"), text.alias("value_str")
        )

    cells = F.array(
        cell("topic_summary", "object", nothing, F.to_json(F.struct(*fields))),
        cell("message_count", "int", F.col("message_count").cast("double"), F.lit(None).cast("string")),
    )
    return topics.select(
        "recording_id",
        "source_id",
        F.lit(None).cast("double").alias("time"),
        topic_entity_path(F.col("topic")).alias("entity_path"),
        F.lit("mcap").alias("semantic_type"),
        "ord",
        F.explode(cells).alias("cell"),
    ).select("recording_id", "source_id", "time", "entity_path", "semantic_type", "ord", "cell.*").select(
        *SIGNAL_COLUMNS
    )


def topics_of(signals: DataFrame) -> DataFrame:
    """Topic table back from the summary rows of ``signals``."""
    summaries = signals.filter(F.col("key") == "topic_summary")
    return summaries.select(
        "recording_id", "source_id", "entity_path", "ord", F.from_json("value_str", TOPIC_SCHEMA).alias("topic")
    ).select("recording_id", "source_id", "entity_path", "ord", "topic.*")


def first_timed_topic(topics: DataFrame) -> DataFrame:
    """Per recording, the first topic in path order that has a clock range."""
    timed = F.col("start_time").isNotNull() & F.col("end_time").isNotNull()
    place = F.struct("entity_path", "ord", "topic")
    picked = F.struct("entity_path", "ord", "topic", "start_time", "end_time")
    return topics.groupBy("recording_id").agg(F.min_by(F.when(timed, picked), F.when(timed, place)).alias("base"))


def clock_deltas(topics: DataFrame) -> DataFrame:
    """Each topic next to the first timed topic of its recording; ``is_base`` marks that one."""
    joined = topics.join(first_timed_topic(topics), "recording_id")
    same = (F.col("entity_path") == F.col("base.entity_path")) & (F.col("ord") == F.col("base.ord"))
    return joined.withColumn("is_base", F.coalesce(same & (F.col("topic").eqNullSafe(F.col("base.topic"))), F.lit(False)))


def time_sync(signals: DataFrame) -> DataFrame:
    """Signed start and end differences to the first timed topic of the recording; a recording without
    any timed topic yields one ``missing_topic_time_range`` row per topic."""
    return time_sync_topics(topics_of(signals))


def time_sync_topics(topics: DataFrame) -> DataFrame:
    rows = clock_deltas(topics)
    untimed = F.col("base").isNull()
    timed = F.col("start_time").isNotNull() & F.col("end_time").isNotNull()
    return rows.filter(untimed | (timed & ~F.col("is_base"))).select(
        "recording_id",
        F.lit(None).cast("double").alias("time"),
        F.when(untimed, F.col("entity_path")).otherwise(F.lit("/time_sync")).alias("entity_path"),
        F.when(untimed, F.lit("topic_summary")).otherwise(F.lit("time_delta")).alias("key"),
        F.when(untimed, F.lit("missing_topic_time_range")).alias("reason"),
        F.col("base.topic").alias("base_topic"),
        "topic",
        "role",
        (F.col("start_time") - F.col("base.start_time")).alias("start_delta"),
        (F.col("end_time") - F.col("base.end_time")).alias("end_delta"),
        "ord",
    )
