"""Signal index, templates, filters and comparison over the events and lineitem tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    EV,
    EVENT_MAPPING,
    LINE_SIG,
    SIG,
    check,
    event_signals,
    line_signals,
    table,
    user_recording,
)
from tracelake.functions.scalars import json_value, value_text
from tracelake.operators import compare as C
from tracelake.operators import query as Q
from tracelake.operators import topics as T
from tracelake.operators.geometry import build_tables
from tracelake.operators.index import flatten_one_level, index_frame, log_level, log_message

ROW = ["recording_id", "time", "entity_path", "semantic_type", "key", "value_num", "ord"]
ROW_SQL = "recording_id, time, entity_path, semantic_type, key, value_num, value_text, ord"


def rows(df):
    return df.select(*ROW, value_text().alias("value_text"))


@check("melt_events", f"with {SIG} select {ROW_SQL} from sig")
def melt_events(spark, sf):
    return rows(event_signals(spark, sf))


@check(
    "melt_lineitem_group",
    f"with {LINE_SIG} select recording_id, time, entity_path, semantic_type, key, value_num, value_str, ord from line_sig",
)
def melt_lineitem_group(spark, sf):
    return line_signals(spark, sf).select(*ROW, "value_str")


@check(
    "log_message_concat",
    """select event_id, concat_ws(' ', 'event_type=' || event_type, 'props=' || props) as message,
       case when upper(event_type) in ('ERROR', 'ERR') then 'ERROR' when upper(event_type) in ('WARN', 'WARNING')
       then 'WARN' when upper(event_type) in ('DEBUG', 'TRACE') then 'DEBUG' else 'INFO' end as level from events""",
)
def log_message_concat(spark, sf):
    events = table(spark, sf, "events")
    levelled = events.withColumn("level", F.col("event_type"))
    return levelled.select(
        "event_id",
        log_message(levelled, ["event_type", "props"]).alias("message"),
        log_level(levelled, ["level", "props"]).alias("level"),
    )


@check(
    "flatten_props",
    "select event_id, cast(json_extract_string(props, '$.k') as bigint) as \"props.k\", "
    "json_extract_string(props, '$.k') as k_text from events",
)
def flatten_props(spark, sf):
    events = table(spark, sf, "events")
    nested = events.select(
        "event_id",
        F.from_json("props", "k bigint").alias("props"),
        json_value(F.col("props"), "$.k").alias("k_text"),
    )
    return flatten_one_level(nested)


@check(
    "typed_tables",
    f"""with {EV}, seq as (
      select *, row_number() over (partition by recording_id order by time, event_id) - 1 as row from ev)
    select recording_id, cast(row as bigint) as row, time, '/metrics/value' as entity_path,
      'scalar' as semantic_type, value as number, cast(null as varchar) as text from seq where value is not null
    union all select recording_id, cast(row as bigint), time, '/states/event_type', 'state', null, event_type
      from seq where event_type is not null
    union all select recording_id, cast(row as bigint), time, '/logs/props', 'text_log', null,
      concat_ws(' ', 'event_type=' || event_type, 'props=' || props) from seq""",
)
def typed_tables(spark, sf):
    mapping = {**EVENT_MAPPING, "timeline_sort": "ascending"}
    tables = build_tables(table(spark, sf, "events"), mapping, user_recording(), "event_id")
    keys = ["recording_id", "row", "time", "entity_path", "semantic_type"]
    number = tables["scalars"].select(*keys, F.col("value").alias("number"), F.lit(None).cast("string").alias("text"))
    texts = [
        tables[name].select(*keys, F.lit(None).cast("double").alias("number"), F.col("value").alias("text"))
        for name in ("states", "logs")
    ]
    return number.unionByName(texts[0]).unionByName(texts[1])


@check(
    "find_errors",
    f"""with {SIG} select recording_id, time, entity_path, key, value_text as value, ord from sig
    where semantic_type in ('text_log', 'state') and regexp_matches(lower(value_text), 'error|warn|fault')""",
)
def find_errors(spark, sf):
    return Q.find_errors(event_signals(spark, sf)).select(
        "recording_id", "time", "entity_path", "key", value_text().alias("value"), "ord"
    )


def battery_signals(spark, sf):
    """The events value read as a battery signal."""
    events = table(spark, sf, "events").withColumnRenamed("value", "battery")
    mapping = {
        "primary_timeline": "ts",
        "streams": [{"source_fields": ["battery"], "semantic_type": "scalar", "entity_path": "/metrics/power"}],
    }
    return index_frame(events, mapping, user_recording(), "events", "event_id")


@check(
    "low_battery",
    f"with {EV} select recording_id, time, '/metrics/power' as entity_path, 'battery' as key, value, event_id as ord "
    "from ev where value < 5.0",
)
def low_battery(spark, sf):
    return Q.low_battery(battery_signals(spark, sf), 5.0).select(
        "recording_id", "time", "entity_path", "key", F.col("value_num").alias("value"), "ord"
    )


def event_topics(spark, sf):
    """The events table read as a message index: event type = topic, user = recording, clock in ns."""
    events = table(spark, sf, "events")
    messages = events.select(
        user_recording().alias("recording_id"),
        F.lit("events").alias("source_id"),
        F.concat(F.lit("/"), "event_type").alias("topic"),
        F.lit("event_msgs/msg/Event").alias("schema_name"),
        F.lit("json").alias("message_encoding"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("log_time"),
    )
    return T.topic_stats(messages)


TOPICS = """
topics as (
  select 'user_' || cast(user_id as varchar) as recording_id, 'events' as source_id, '/' || event_type as topic,
    'event_msgs/msg/Event' as schema_name, 'json' as message_encoding, count(*) as message_count,
    cast(min(epoch_us(ts) * 1000) as double) as start_time, cast(max(epoch_us(ts) * 1000) as double) as end_time,
    'raw_topic' as role, 'mcap' as semantic_type, 0.55 as confidence
  from events group by 1, 2, 3
)"""


@check(
    "topic_stats",
    f"with {TOPICS} select recording_id, topic, schema_name, message_encoding, message_count, start_time, end_time, "
    "role, semantic_type, cast(confidence as double) as confidence from topics",
)
def topic_stats(spark, sf):
    return event_topics(spark, sf).drop("source_id")


@check(
    "topic_source_stats",
    f"with {TOPICS} select source_id, count(*) as topic_count, cast(sum(message_count) as bigint) as message_count, "
    "min(start_time) as start_time, max(end_time) as end_time, bool_or(role = 'robot_model') as has_robot_description "
    "from topics group by 1",
)
def topic_source_stats(spark, sf):
    return T.source_stats(event_topics(spark, sf))


@check(
    "topic_summary",
    f"""with {TOPICS} select recording_id, '/topics/' || substr(topic, 2) as entity_path, 'topic_summary' as key,
    topic, role, schema_name, message_count, start_time, end_time from topics""",
)
def topic_summary(spark, sf):
    signals = Q.topic_summary(T.topic_signals(event_topics(spark, sf)))
    return T.topics_of(signals).select(
        "recording_id",
        "entity_path",
        F.lit("topic_summary").alias("key"),
        "topic",
        "role",
        "schema_name",
        "message_count",
        "start_time",
        "end_time",
    )


@check(
    "topic_rows",
    f"""with {TOPICS} select recording_id, '/topics/' || substr(topic, 2) as entity_path, 'message_count' as key,
    cast(message_count as double) as value_num from topics
    union all select recording_id, '/topics/' || substr(topic, 2), 'topic_summary', null from topics""",
)
def topic_rows(spark, sf):
    return T.topic_signals(event_topics(spark, sf)).select("recording_id", "entity_path", "key", "value_num")


@check(
    "state_duration",
    f"""with {EV} select recording_id, time, '/states/event_type' as entity_path, 'event_type' as key,
      event_type as state, event_id as ord,
      round(greatest(coalesce(lead(time) over (partition by recording_id order by time, event_id), time) - time, 0), 3)
      as duration from ev""",
)
def state_duration(spark, sf):
    held = Q.state_duration(event_signals(spark, sf))
    return held.withColumn("duration", F.round("duration", 3))


@check(
    "time_sync",
    f"""with {TOPICS}, based as (
      select *, first_value(topic) over w as base_topic, first_value(start_time) over w as base_start,
        first_value(end_time) over w as base_end, row_number() over w as rn
      from topics window w as (partition by recording_id order by topic
        rows between unbounded preceding and unbounded following))
    select recording_id, '/time_sync' as entity_path, 'time_delta' as key, base_topic, topic, role,
      round((start_time - base_start) / 1e9, 3) as start_delta_s, round((end_time - base_end) / 1e9, 3) as end_delta_s
    from based where rn > 1""",
)
def time_sync(spark, sf):
    return Q.run_template(T.topic_signals(event_topics(spark, sf)), "time_sync", limit=None).select(
        "recording_id",
        "entity_path",
        "key",
        "base_topic",
        "topic",
        "role",
        F.round(F.col("start_delta") / 1e9, 3).alias("start_delta_s"),
        F.round(F.col("end_delta") / 1e9, 3).alias("end_delta_s"),
    )


# ---- custom filters: one check per operator ------------------------------------------

CUSTOM = {
    "custom_time_range": (
        {"time_start": 1704585600, "time_end": "1705190400.5"},
        "time >= 1704585600 and time <= 1705190400.5",
    ),
    "custom_entity_path": ({"entity_path": "STATES/"}, "lower(entity_path) like '%states/%'"),
    "custom_key": ({"key": "Valu"}, "lower(key) like '%valu%'"),
    "custom_contains": ({"operator": "contains", "value": "ERR"}, "contains(lower(value_text), 'err')"),
    "custom_eq": ({"operator": "eq", "value": "purchase"}, "value_text = 'purchase'"),
    "custom_eq_number": ({"operator": "eq", "value": 12.31}, "value_num = cast(12.31 as double)"),
    "custom_gt": ({"operator": "gt", "value": 100}, "value_num > 100"),
    "custom_gte": ({"operator": "gte", "value": "100.5"}, "value_num >= 100.5"),
    "custom_lt": ({"operator": "lt", "value": 1.5}, "value_num < 1.5"),
    "custom_lte": ({"operator": "lte", "value": 1.5}, "value_num <= 1.5"),
    "custom_text": (
        {"text": "/metrics/value value 1"},
        "contains(lower(entity_path || ' ' || key || ' ' || value_text), '/metrics/value value 1')",
    ),
    "custom_combined": (
        {"semantic_types": ["scalar"], "key": "value", "operator": "gte", "value": 50, "time_start": 1704585600},
        "semantic_type = 'scalar' and key = 'value' and value_num >= 50 and time >= 1704585600",
    ),
}


def _custom(name, arguments, condition):
    @check(name, f"with {SIG} select {ROW_SQL} from sig where {condition}")
    def run(spark, sf):
        return rows(Q.custom_query(event_signals(spark, sf), **arguments))

    run.__name__ = name


for _name, (_arguments, _condition) in CUSTOM.items():
    _custom(_name, _arguments, _condition)


@check(
    "filter_recordings",
    f"with {SIG} select {ROW_SQL} from sig where recording_id in ('user_3', 'user_8', 'user_absent')",
)
def filter_recordings(spark, sf):
    return rows(Q.filter_recordings(event_signals(spark, sf), ["user_3", "user_8", "user_absent"]))


@check("filter_semantic", f"with {SIG} select {ROW_SQL} from sig where semantic_type in ('state', 'scalar')")
def filter_semantic(spark, sf):
    return rows(Q.filter_semantic_types(event_signals(spark, sf), ["state", "scalar"]))


@check(
    "filter_tokens",
    f"""with {SIG} select {ROW_SQL} from sig where contains(lower(key), 'prop') or contains(lower(entity_path), 'prop')
    or contains(lower(key), 'metrics') or contains(lower(entity_path), 'metrics')""",
)
def filter_tokens(spark, sf):
    return rows(Q.filter_tokens(event_signals(spark, sf), ["Prop", "", "METRICS"]))


@check(
    "limited_query",
    f"""with {SIG} select {ROW_SQL} from sig where semantic_type in ('text_log', 'state')
    and regexp_matches(lower(value_text), 'error|warn|fault')
    order by recording_id, time, entity_path, key, ord limit 100""",
)
def limited_query(spark, sf):
    return rows(Q.run_template(event_signals(spark, sf), "find_errors", limit=100))


@check(
    "canonical_order",
    f"""with {SIG}, o as (select 'cust_' || cast(o_custkey as varchar) as recording_id, epoch_us(o_orderdate) / 1e6 as time,
      '/metrics/total' as entity_path, 'o_totalprice' as key, o_orderkey as ord from orders where o_totalprice is not null),
    u as (select recording_id, time, entity_path, key, ord from sig where semantic_type = 'scalar'
      union all select * from o)
    select *, row_number() over (order by recording_id, time nulls first, entity_path, key, ord) as position from u""",
)
def canonical_order(spark, sf):
    orders = table(spark, sf, "orders")
    mapping = {
        "primary_timeline": "o_orderdate",
        "streams": [{"source_fields": ["o_totalprice"], "semantic_type": "scalar", "entity_path": "/metrics/total"}],
    }
    recording = F.concat(F.lit("cust_"), F.col("o_custkey").cast("string"))
    totals = index_frame(orders, mapping, recording, "orders", "o_orderkey")
    both = Q.filter_semantic_types(event_signals(spark, sf), ["scalar"]).unionByName(totals)
    keyed = both.select("recording_id", "time", "entity_path", "key", "ord")
    return Q.with_canonical_position(keyed)


# ---- comparison --------------------------------------------------------------------------


@check(
    "compare_summary_numeric",
    f"""with {SIG} select recording_id, entity_path, key, count(*) as count, min(value_num) as min,
      max(value_num) as max, round(avg(value_num), 6) as mean, arg_max(value_num, row(time, ord)) as latest_num
    from sig where semantic_type = 'scalar' group by 1, 2, 3""",
)
def compare_summary_numeric(spark, sf):
    summary = C.compare(event_signals(spark, sf), metric_keys=["value"])
    return summary.filter(F.col("kind") == "numeric").select(
        "recording_id", "entity_path", "key", "count", "min", "max", F.round("mean", 6).alias("mean"), "latest_num"
    )


@check(
    "compare_summary_state",
    f"""with {SIG} select recording_id, entity_path, key, count(*) as count, arg_max(value_text, row(time, ord)) as latest
    from sig where semantic_type = 'state' group by 1, 2, 3""",
)
def compare_summary_state(spark, sf):
    summary = C.compare(event_signals(spark, sf))
    return summary.filter(F.col("kind") == "state").select("recording_id", "entity_path", "key", "count", "latest")


@check(
    "compare_state_histogram",
    f"""with {SIG} select recording_id, entity_path, key, value_text as state, count(*) as n
    from sig where semantic_type = 'state' group by 1, 2, 3, 4""",
)
def compare_state_histogram(spark, sf):
    return C.compare(event_signals(spark, sf), mode="states")


@check(
    "compare_series",
    f"""with {LINE_SIG} select recording_id, time, entity_path, key, value_num, ord from line_sig
    where recording_id in ('supp_1', 'supp_2') and (contains(key, 'tax') or contains(entity_path, 'tax')
    or contains(key, 'returnflag') or contains(entity_path, 'returnflag'))""",
)
def compare_series(spark, sf):
    chosen = C.compare(line_signals(spark, sf), ["supp_1", "supp_2"], ["tax", "RETURNFLAG"], mode="series")
    return chosen.select("recording_id", "time", "entity_path", "key", "value_num", "ord")
