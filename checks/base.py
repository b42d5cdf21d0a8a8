"""Registry of checked queries and the views they share.

A check is a Spark query over the test tables plus, where SQL can say it, the same query for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.index import index_frame
from tracelake.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL twin."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# how the events table is read as recordings: one per user
EVENT_MAPPING = {
    "primary_timeline": "ts",
    "timeline_unit": "auto",
    "timeline_sort": "source",
    "streams": [
        {"source_fields": ["value"], "semantic_type": "scalar", "entity_path": "/metrics/value"},
        {"source_fields": ["event_type"], "semantic_type": "state", "entity_path": "/states/event_type"},
        {"source_fields": ["event_type", "props"], "semantic_type": "text_log", "entity_path": "/logs/props"},
    ],
}


def user_recording():
    return F.concat(F.lit("user_"), F.col("user_id").cast("string"))


def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return index_frame(events, EVENT_MAPPING, user_recording(), "events", "event_id")


EV = """
ev as (
  select event_id, 'user_' || cast(user_id as varchar) as recording_id, epoch_us(ts) / 1e6 as time,
         event_type, value, props
  from events
)"""

SIG = (
    EV
    + """,
sig as (
  select recording_id, 'events' as source_id, time, '/metrics/value' as entity_path, 'scalar' as semantic_type,
         'value' as key, 'double' as value_type, value as value_num, cast(null as varchar) as value_str,
         cast(value as varchar) as value_text, event_id as ord from ev where value is not null
  union all
  select recording_id, 'events', time, '/states/event_type', 'state', 'event_type', 'string', null, event_type,
         event_type, event_id from ev where event_type is not null
  union all
  select recording_id, 'events', time, '/logs/props', 'text_log', 'event_type', 'string', null, event_type,
         event_type, event_id from ev where event_type is not null
  union all
  select recording_id, 'events', time, '/logs/props', 'text_log', 'props', 'string', null, props, props, event_id
  from ev where props is not null
  union all
  select recording_id, 'events', time, '/logs/props', 'text_log', 'message', 'string', null,
         concat_ws(' ', 'event_type=' || event_type, 'props=' || props),
         concat_ws(' ', 'event_type=' || event_type, 'props=' || props), event_id from ev
  where event_type is not null or props is not null
)"""
)

# lineitem as recordings: one per supplier
LINE_FIELDS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_MAPPING = {
    "primary_timeline": "l_shipdate",
    "timeline_unit": "auto",
    "timeline_sort": "ascending",
    "streams": [
        {"source_fields": LINE_FIELDS, "semantic_type": "scalar_group", "entity_path": "/metrics/line"},
        {"source_fields": ["l_returnflag"], "semantic_type": "state", "entity_path": "/states/returnflag"},
    ],
}


def line_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    recording = F.concat(F.lit("supp_"), F.col("l_suppkey").cast("string"))
    position = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return index_frame(lines, LINE_MAPPING, recording, "lineitem", position)


LINE_SIG = (
    "line_sig as (\n"
    + "\n  union all\n".join(
        f"""  select 'supp_' || cast(l_suppkey as varchar) as recording_id, 'lineitem' as source_id,
    epoch_us(l_shipdate) / 1e6 as time, '/metrics/line/{name}' as entity_path, 'scalar_group' as semantic_type,
    '{name}' as key, {name} as value_num, cast(null as varchar) as value_str,
    l_orderkey * 8 + l_linenumber as ord from lineitem where {name} is not null"""
        for name in LINE_FIELDS
    )
    + """
  union all
  select 'supp_' || cast(l_suppkey as varchar), 'lineitem', epoch_us(l_shipdate) / 1e6, '/states/returnflag',
    'state', 'l_returnflag', null, l_returnflag, l_orderkey * 8 + l_linenumber from lineitem
  where l_returnflag is not null
)"""
)
