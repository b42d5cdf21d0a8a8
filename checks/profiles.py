"""Profiles, inference and scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import check, table
from tracelake.functions import scalars as S
from tracelake.operators import inference as I
from tracelake.operators import profile as P
from tracelake.session import materialize

# table -> (position column, {field: kind in SQL})
PROFILED = {
    "orders": (
        "o_orderkey",
        {
            "o_custkey": "number",
            "o_orderstatus": "text",
            "o_totalprice": "number",
            "o_orderdate": "stamp",
            "o_orderpriority": "text",
        },
    ),
    "events": (
        "event_id",
        {"ts": "stamp", "user_id": "number", "event_type": "text", "value": "number", "props": "text"},
    ),
    "customer": (
        "c_custkey",
        {"c_name": "text", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "text"},
    ),
}
SPARK_KINDS = {
    "o_custkey": "bigint",
    "o_totalprice": "double",
    "user_id": "bigint",
    "value": "double",
    "c_nationkey": "int",
    "c_acctbal": "double",
}
AUTO_SECONDS = (
    "case when abs({x}) >= 1e18 then {x} / 1e9 when abs({x}) >= 1e15 then {x} / 1e6 "
    "when abs({x}) >= 1e12 then {x} / 1e3 else {x} end"
)
AUTO_UNIT = (
    "case when {x} is null then null when abs({x}) >= 1e18 then 'unix_ns' when abs({x}) >= 1e15 then 'unix_us' "
    "when abs({x}) >= 1e12 then 'unix_ms' when abs({x}) >= 1e9 then 'unix_s' else 'seconds' end"
)


def _cell_sql(field: str, kind: str) -> tuple[str, str]:
    if kind == "stamp":
        return f"epoch_us({field}) / 1e6", f"case when {field} is not null then 'datetime' end"
    if kind == "number":
        value = f"cast({field} as double)"
        return AUTO_SECONDS.format(x=value), AUTO_UNIT.format(x=value)
    # the text fields of these tables hold neither numbers nor dates
    return "cast(null as double)", "cast(null as varchar)"


def _profile_sql(name: str, fields: dict[str, str], position: str) -> str:
    parts = []
    for i, (field, kind) in enumerate(fields.items()):
        seconds, unit = _cell_sql(field, kind)
        parts.append(
            f"""select '{name}' as source_id, cast({i} as integer) as position, '{field}' as field,
            count(*) as row_count, count(*) - count(v) as null_count,
            round(cast(count(*) - count(v) as double) / count(*), 6) as null_ratio, count(v) as non_null_count,
            case when count(v) > 0 then round(cast(count(u) as double) / count(v), 6) else cast(0 as double) end
              as time_parse_ratio,
            case when count(s) > 0 then bool_and(coalesce(s >= prev, true)) end as time_monotonic,
            case when count(distinct u) = 0 then null when count(distinct u) = 1 then min(u) else 'mixed' end
              as inferred_time_unit, arg_min(u, case when u is not null then o end) as first_time_unit
            from (select *, last_value(s ignore nulls) over (order by o rows between unbounded preceding and 1 preceding)
              as prev from (select {field} as v, {seconds} as s, {unit} as u, {position} as o from {name}))"""
        )
    return "\nunion all\n".join(parts)


@check(
    "field_profile",
    "\nunion all\n".join(_profile_sql(name, fields, position) for name, (position, fields) in PROFILED.items()),
)
def field_profile(spark, sf):
    return event_profiles(spark, sf).drop("axis", "dtype")


def event_profiles(spark, sf):
    parts = [
        P.field_profiles(table(spark, sf, name), name, position, list(fields))
        for name, (position, fields) in PROFILED.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check(
    "timeline_profile",
    f"""with p as ({_profile_sql('orders', PROFILED['orders'][1], 'o_orderkey')} union all
      {_profile_sql('events', PROFILED['events'][1], 'event_id')})
    select source_id, field as time_key, true as present, row_count, null_count, null_ratio,
      time_monotonic as monotonic, time_parse_ratio as parse_ratio, inferred_time_unit as inferred_unit,
      first_time_unit as first_unit, coalesce(inferred_time_unit = 'mixed', false) as mixed_units from p
    where field in ('o_orderdate', 'ts')
    union all select 'customer', 'c_time', false, null, null, null, null, cast(0 as double), null, null, false""",
)
def timeline_profile(spark, sf):
    profiles = event_profiles(spark, sf)
    timelines = profiles.groupBy("source_id").agg(
        F.coalesce(
            F.max(F.when(F.col("field").isin("o_orderdate", "ts"), F.col("field"))), F.lit("c_time")
        ).alias("time_key")
    )
    return P.timeline_profiles(profiles, timelines)


@check(
    "time_unit_inference",
    """with t as (select event_id, user_id, cast(floor(epoch_us(ts) / case event_id % 3 when 0 then 1 when 1 then 1000
        else 1000000 end) as bigint) as v from events),
      u as (select user_id, event_id, case when abs(v) >= 1e15 then 'unix_us' when abs(v) >= 1e12 then 'unix_ms'
        when abs(v) >= 1e9 then 'unix_s' else 'seconds' end as unit from t)
    select cast(user_id as varchar) as source_id, case when count(distinct unit) = 1 then min(unit) else 'mixed' end
      as inferred_time_unit, arg_min(unit, event_id) as first_time_unit, cast(1 as double) as time_parse_ratio
    from u group by user_id""",
)
def time_unit_inference(spark, sf):
    events = table(spark, sf, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    scale = F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, 1000).otherwise(1000000)
    clocks = events.select("event_id", "user_id", F.floor(micros / scale).alias("clock"))
    profiles = P.field_profiles(clocks, F.col("user_id"), "event_id", ["clock"])
    return profiles.select("source_id", "inferred_time_unit", "first_time_unit", "time_parse_ratio")


@check(
    "field_stats",
    """select 'part' as source_id, 'p_brand' as field, count(p_brand) as n, count(distinct p_brand) as distinct_count,
      round(cast(count(distinct p_brand) as double) / count(p_brand), 6) as distinct_ratio,
      cast(null as double) as unit_share, median(length(p_brand)) as median_length from part
    union all select 'part', 'p_name', count(p_name), count(distinct p_name),
      round(cast(count(distinct p_name) as double) / count(p_name), 6), null, median(length(p_name)) from part
    union all select 'part', 'p_retailprice', count(p_retailprice), count(distinct p_retailprice),
      round(cast(count(distinct p_retailprice) as double) / count(p_retailprice), 6),
      round(avg(case when p_retailprice between 0 and 1 then 1.0 else 0.0 end), 6), null from part
    union all select 'lineitem', 'l_tax', count(l_tax), count(distinct l_tax),
      round(cast(count(distinct l_tax) as double) / count(l_tax), 6),
      round(avg(case when l_tax between 0 and 1 then 1.0 else 0.0 end), 6), null from lineitem
    union all select 'lineitem', 'l_quantity', count(l_quantity), count(distinct l_quantity),
      round(cast(count(distinct l_quantity) as double) / count(l_quantity), 6),
      round(avg(case when l_quantity between 0 and 1 then 1.0 else 0.0 end), 6), null from lineitem
    union all select 'documents', 'text', count(text), count(distinct text),
      round(cast(count(distinct text) as double) / count(text), 6), null, median(length(text)) from documents
    union all select 'documents', 'lang', count(lang), count(distinct lang),
      round(cast(count(distinct lang) as double) / count(lang), 6), null, median(length(lang)) from documents""",
)
def field_stats(spark, sf):
    parts = [
        I.field_stats(table(spark, sf, "part"), "part", "p_partkey", ["p_brand", "p_name", "p_retailprice"]),
        I.field_stats(table(spark, sf, "lineitem"), "lineitem", "l_orderkey", ["l_tax", "l_quantity"]),
        I.field_stats(table(spark, sf, "documents"), "documents", "doc_id", ["text", "lang"]),
    ]
    stats = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return stats.select(
        "source_id",
        "field",
        "n",
        "distinct_count",
        F.round("distinct_ratio", 6).alias("distinct_ratio"),
        F.round("unit_share", 6).alias("unit_share"),
        "median_length",
    )


def _score_sql(name, field, position, key, kind):
    words = 0.35 if "time" in field.lower() or "date" in field.lower() else 0.0
    if kind == "number":
        points = (
            "case when bool_and(coalesce(v >= prev, true)) then 0.45 else 0.0 end"
            " + case when count(distinct v) = count(v) then 0.15 else 0.0 end"
        )
    else:
        points = f"case when count(v) > 0 then {0.6 if kind == 'stamp' else 0.0} else 0.0 end"
    return (
        f"select '{name}' as source_id, '{field}' as field, {position} as position, "
        f"round(cast({words} as double) + {points}, 6) as score from "
        f"(select {field} as v, lag({field}) over (order by {key}) as prev from {name} where {field} is not null)"
    )


_SCORES = "\nunion all\n".join(
    _score_sql(name, field, position, key, kind)
    for name, key, fields in (
        ("orders", "o_orderkey", {"o_orderkey": "number", **PROFILED["orders"][1]}),
        ("events", "event_id", {"event_id": "number", **PROFILED["events"][1]}),
    )
    for position, (field, kind) in enumerate(fields.items())
)


@check("timeline_scores", f"select source_id, field, score from ({_SCORES})")
def timeline_scores(spark, sf):
    return I.timeline_scores(order_event_stats(spark, sf)).select("source_id", "field", "score")


def order_event_stats(spark, sf):
    orders = table(spark, sf, "orders").withColumn("_at", F.col("o_orderkey"))
    events = table(spark, sf, "events").withColumn("_at", F.col("event_id"))
    return I.field_stats(orders, "orders", "_at").unionByName(I.field_stats(events, "events", "_at"))


@check(
    "detect_timeline",
    f"""select source_id, arg_max(field, row(score, -position)) as time_key from ({_SCORES}) where score >= 0.6
    group by 1""",
)
def detect_timeline(spark, sf):
    return I.detect_timeline(order_event_stats(spark, sf))


STREAM_TABLES = {
    "part": "p_partkey",
    "events": "event_id",
    "documents": "doc_id",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "orders": "o_orderkey",
}


def table_streams(spark, sf):
    parts = []
    for name, key in STREAM_TABLES.items():
        frame = table(spark, sf, name).withColumn("_at", F.col(key))
        parts.append(I.field_stats(frame, name, "_at"))
    # a small catalogue that inference reads several times
    return I.infer_streams(materialize(reduce(DataFrame.unionByName, parts), "field-stats"))


# numbers and texts of each table; a text field needs its statistics to be named
_STREAM_SQL = """
t as (
  select 'part' as source_id, 'p_name' as f, 3 as part, cast(1 as integer) as position, count(p_name) as n,
    count(distinct p_name) as d, median(length(p_name)) as ml from part
  union all select 'part', 'p_brand', 3, 2, count(p_brand), count(distinct p_brand), median(length(p_brand)) from part
  union all select 'part', 'p_type', 3, 3, count(p_type), count(distinct p_type), median(length(p_type)) from part
  union all select 'events', 'event_type', 3, 3, count(event_type), count(distinct event_type), median(length(event_type)) from events
  union all select 'events', 'props', 3, 5, count(props), count(distinct props), median(length(props)) from events
  union all select 'documents', 'text', 3, 1, count(text), count(distinct text), median(length(text)) from documents
  union all select 'documents', 'lang', 3, 2, count(lang), count(distinct lang), median(length(lang)) from documents
  union all select 'documents', 'source', 3, 3, count(source), count(distinct source), median(length(source)) from documents
  union all select 'customer', 'c_name', 3, 1, count(c_name), count(distinct c_name), median(length(c_name)) from customer
  union all select 'customer', 'c_mktsegment', 3, 4, count(c_mktsegment), count(distinct c_mktsegment), median(length(c_mktsegment)) from customer
  union all select 'supplier', 's_name', 3, 1, count(s_name), count(distinct s_name), median(length(s_name)) from supplier
  union all select 'orders', 'o_orderstatus', 3, 2, count(o_orderstatus), count(distinct o_orderstatus), median(length(o_orderstatus)) from orders
  union all select 'orders', 'o_orderpriority', 3, 5, count(o_orderpriority), count(distinct o_orderpriority), median(length(o_orderpriority)) from orders
),
firsts as (select *, min(case when ml >= 40 then position end) over (partition by source_id) as fl from t),
texts as (
  select source_id, case when position = fl then 'system_log' else f end as name, f as fields,
    case when position = fl then 'text_log' when contains(f, 'status') or contains(f, 'state') or contains(f, 'mode') then 'state'
      when cast(d as double) / n <= 0.2 or d <= least(20, greatest(5, ceil(n * cast(0.1 as double)))) then 'state' else 'text_log' end as semantic_type,
    cast(case when position = fl then 0.88 when contains(f, 'status') or contains(f, 'state') or contains(f, 'mode') then 0.88
      when cast(d as double) / n <= 0.2 or d <= least(20, greatest(5, ceil(n * cast(0.1 as double)))) then 0.76 else 0.62 end as double) as confidence
  from firsts
)"""


@check(
    "infer_streams",
    f"""with {_STREAM_SQL}, numbers as (
      select * from (values ('part', 'p_size'), ('part', 'p_retailprice'), ('events', 'user_id'), ('events', 'value'),
        ('documents', 'n_chars'), ('customer', 'c_nationkey'), ('customer', 'c_acctbal'), ('supplier', 's_nationkey'),
        ('supplier', 's_acctbal'), ('orders', 'o_custkey'), ('orders', 'o_totalprice')) v(source_id, name)),
    shares as (
      select 'part' as source_id, 'p_size' as name, avg(case when p_size between 0 and 1 then 1.0 else 0.0 end) as s from part
      union all select 'part', 'p_retailprice', avg(case when p_retailprice between 0 and 1 then 1.0 else 0.0 end) from part
      union all select 'events', 'user_id', avg(case when user_id between 0 and 1 then 1.0 else 0.0 end) from events
      union all select 'events', 'value', avg(case when value between 0 and 1 then 1.0 else 0.0 end) from events
      union all select 'documents', 'n_chars', avg(case when n_chars between 0 and 1 then 1.0 else 0.0 end) from documents
      union all select 'customer', 'c_nationkey', avg(case when c_nationkey between 0 and 1 then 1.0 else 0.0 end) from customer
      union all select 'customer', 'c_acctbal', avg(case when c_acctbal between 0 and 1 then 1.0 else 0.0 end) from customer
      union all select 'supplier', 's_nationkey', avg(case when s_nationkey between 0 and 1 then 1.0 else 0.0 end) from supplier
      union all select 'supplier', 's_acctbal', avg(case when s_acctbal between 0 and 1 then 1.0 else 0.0 end) from supplier
      union all select 'orders', 'o_custkey', avg(case when o_custkey between 0 and 1 then 1.0 else 0.0 end) from orders
      union all select 'orders', 'o_totalprice', avg(case when o_totalprice between 0 and 1 then 1.0 else 0.0 end) from orders)
    select source_id, name, name as fields, 'scalar' as semantic_type,
      round(cast(0.72 as double) + case when s > 0.95 then 0.04 else 0.0 end, 6) as confidence,
      '/metrics/' || lower(name) as entity_path from numbers join shares using (source_id, name)
    union all select source_id, name, fields, semantic_type, confidence,
      case semantic_type when 'state' then '/states/' else '/logs/' end || lower(name) from texts""",
)
def infer_streams(spark, sf):
    # key columns and dates are timelines of these tables or plain numbers: leave them to their own checks
    skipped = [*STREAM_TABLES.values(), "ts", "o_orderdate"]
    streams = table_streams(spark, sf).filter(~F.col("fields")[0].isin(*skipped))
    mapping = I.suggest_mapping(streams)
    return mapping.select(
        "source_id",
        "name",
        F.array_join("source_fields", ",").alias("fields"),
        "semantic_type",
        F.round("confidence", 6).alias("confidence"),
        "entity_path",
    )


@check(
    "template_scores",
    # the event position is the timeline of events, so their clock is one more text
    f"""with {_STREAM_SQL}, kinds as (select source_id, bool_or(semantic_type = 'state') as st,
      bool_or(semantic_type = 'text_log') or source_id = 'events' as tl from texts group by 1)
    select source_id, 'sensor_monitor' as template_id, 'Sensor Monitor' as name, round(cast(0.55 as double)
      + case when st then 0.25 else 0.0 end + case when tl then 0.2 else 0.0 end, 3) as score,
      cast(1 as integer) as rank, 'sensor_monitor' as picked from kinds where source_id in
      ('part', 'events', 'documents', 'customer', 'supplier', 'orders')""",
)
def template_scores(spark, sf):
    streams = table_streams(spark, sf)
    picked = I.pick_template(streams).withColumnRenamed("template_id", "picked")
    return I.template_scores(streams).join(picked, "source_id")


# ---- scalar functions ----------------------------------------------------------------------------


@check(
    "normalize_time_auto",
    f"""with t as (select event_id, epoch_us(ts) as us from events),
      v as (select event_id, 's' as scale, cast(us / 1e6 as double) as x from t
        union all select event_id, 'ms', us / 1e3 from t union all select event_id, 'us', cast(us as double) from t
        union all select event_id, 'ns', us * 1e3 from t union all select event_id, 'small', event_id / 4e0 from t)
    select event_id, scale, round({AUTO_SECONDS.format(x='x')}, 3) as seconds, {AUTO_UNIT.format(x='x')} as unit from v""",
)
def normalize_time_auto(spark, sf):
    return _scaled(spark, sf).select(
        "event_id",
        "scale",
        F.round(S.normalize_time(F.col("x"), "auto", "double"), 3).alias("seconds"),
        S.time_unit(F.col("x"), "auto", "double").alias("unit"),
    )


def _scaled(spark, sf):
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    scales = {
        "s": micros / 1e6,
        "ms": micros / 1e3,
        "us": micros,
        "ns": micros * 1e3,
        "small": F.col("event_id") / F.lit(4.0),
    }
    cells = F.array(*[F.struct(F.lit(name).alias("scale"), value.alias("x")) for name, value in scales.items()])
    return table(spark, sf, "events").select("event_id", F.explode(cells).alias("_c")).select("event_id", "_c.*")


@check(
    "normalize_time_units",
    """with t as (select event_id, epoch_us(ts) as us, ts from events)
    select event_id, us / 1e6 as unix_s, round((us / 1e3) / 1e3, 3) as unix_ms, cast(us as double) / 1e6 as unix_us,
      round((us * 1e3) / 1e9, 3) as unix_ns, cast(event_id as double) as relative_s, us / 1e6 as datetime,
      'unix_ms' as unit_ms, 'relative_s' as unit_seconds, 'datetime' as unit_text,
      round(epoch_us(date_trunc('second', ts)) / 1e6, 3) as text_seconds from t""",
)
def normalize_time_units(spark, sf):
    stamp = F.col("ts").cast("timestamp")
    micros = F.unix_micros(stamp).cast("double")
    text = F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf, "events").select(
        "event_id",
        S.normalize_time(micros / 1e6, "unix_s", "double").alias("unix_s"),
        F.round(S.normalize_time(micros / 1e3, "unix_ms", "double"), 3).alias("unix_ms"),
        S.normalize_time(micros, "unix_us", "double").alias("unix_us"),
        F.round(S.normalize_time(micros * 1e3, "unix_ns", "double"), 3).alias("unix_ns"),
        S.normalize_time(F.col("event_id"), "seconds", "bigint").alias("relative_s"),
        S.normalize_time(F.col("ts"), "datetime", "timestamp_ntz").alias("datetime"),
        S.time_unit(micros / 1e3, "unix_ms", "double").alias("unit_ms"),
        S.time_unit(F.col("event_id"), "seconds", "bigint").alias("unit_seconds"),
        S.time_unit(text, "auto").alias("unit_text"),
        F.round(S.normalize_time(text, "auto"), 3).alias("text_seconds"),
    )


@check(
    "normalize_time_diag",
    """with t as (select event_id, epoch_us(ts) as us from events),
      v as (select event_id, 's' as scale, us / 1e6 as x from t union all select event_id, 'ms', us / 1e3 from t
        union all select event_id, 'us', cast(us as double) from t union all select event_id, 'ns', us * 1e3 from t
        union all select event_id, 'small', event_id / 4e0 from t)
    select event_id, scale, round(case when abs(x) >= 1e17 then x / 1e9 when abs(x) >= 1e14 then x / 1e6
      when abs(x) >= 1e11 then x / 1e3 else x end, 3) as seconds from v""",
)
def normalize_time_diag(spark, sf):
    return _scaled(spark, sf).select("event_id", "scale", F.round(S.clock_seconds(F.col("x")), 3).alias("seconds"))


@check(
    "cloud_time",
    """with s as (select event_id, case event_id % 4 when 0 then cast(epoch_us(ts) * 1000 as varchar)
        when 1 then cast(epoch_us(ts) // 1000 as varchar) when 2 then cast(event_id as varchar) else 'scan_' || event_id end
        as stem from events)
    select event_id, round(case when not regexp_full_match(stem, '[0-9]+') then cast(event_id as double)
      when length(stem) >= 16 then cast(stem as double) / 1e9 when length(stem) >= 13 then cast(stem as double) / 1e3
      else cast(stem as double) end, 3) as seconds from s""",
)
def cloud_time(spark, sf):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    turn = F.col("event_id") % 4
    stem = (
        F.when(turn == 0, (micros * 1000).cast("string"))
        .when(turn == 1, F.floor(micros / 1000).cast("string"))
        .when(turn == 2, F.col("event_id").cast("string"))
        .otherwise(F.concat(F.lit("scan_"), F.col("event_id").cast("string")))
    )
    return table(spark, sf, "events").select(
        "event_id", F.round(S.cloud_time(stem, F.col("event_id")), 3).alias("seconds")
    )


@check(
    "query_time",
    """select doc_id, cast(coalesce(case when n_chars % 2 = 0 then n_chars end, doc_id) as double) as seconds from documents""",
)
def query_time(spark, sf):
    text = F.when(F.col("n_chars") % 2 == 0, F.col("n_chars").cast("string")).otherwise("not a time")
    return table(spark, sf, "documents").select(
        "doc_id", S.query_time(text, F.col("doc_id"), "relative_s").alias("seconds")
    )


_SLUG = (
    "case when regexp_replace(regexp_replace(trim({x}), '[^a-zA-Z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') = '' then 'stream' "
    "else lower(regexp_replace(regexp_replace(trim({x}), '[^a-zA-Z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')) end"
)


@check("safe_slug", f"select page_id, {_SLUG.format(x='url')} as slug from pages")
def safe_slug(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.safe_slug(F.col("url")).alias("slug"))


@check(
    "normalized_name",
    """select p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') as name,
      regexp_replace(p_brand, '[^a-zA-Z0-9_-]', '_', 'g') as output_name from part""",
)
def normalized_name(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        S.normalized_name(F.col("p_name")).alias("name"),
        S.safe_output_name(F.col("p_brand")).alias("output_name"),
    )


# the names of parts made into vector field names
_FIELD_SQL = (
    "replace(lower(p_name), ' ', '_') || case p_size % 8 when 0 then '.x' when 1 then '_y' when 2 then '-z' "
    "when 3 then '.quat_w' when 4 then '_width' when 5 then '.yaw' when 6 then '_qx' else '' end"
)


def _fields(spark, sf):
    size = F.col("p_size") % 8
    tails = ((0, ".x"), (1, "_y"), (2, "-z"), (3, ".quat_w"), (4, "_width"), (5, ".yaw"), (6, "_qx"))
    tail = F.lit("")
    for number, text in reversed(tails):
        tail = F.when(size == number, text).otherwise(tail)
    name = F.concat(F.regexp_replace(F.lower("p_name"), " ", "_"), tail)
    return table(spark, sf, "part").select("p_partkey", "p_brand", name.alias("field"))


@check(
    "field_role",
    f"""with f as (select p_partkey, {_FIELD_SQL} as field from part),
      t as (select *, regexp_extract(field, '([^._/-]*)$', 1) as token from f)
    select p_partkey, field, case when token in ('qx', 'qy', 'qz', 'qw') then token
      when contains(field, 'quat') and right(token, 1) in ('x', 'y', 'z', 'w') then 'q' || right(token, 1)
      when contains(field, 'quat') then token when token = 'width' then 'w' when token = 'height' then 'h'
      else token end as role,
      nullif(regexp_extract(field, '(?:^|[._-])(x|y|z|w|roll|pitch|yaw|width|height)$', 1), '') as axis from t""",
)
def field_role(spark, sf):
    return _fields(spark, sf).select(
        "p_partkey", "field", S.field_role(F.col("field")).alias("role"), S.axis(F.col("field")).alias("axis")
    )


@check(
    "axis_groups",
    f"""with f as (select p_brand as source_id, p_partkey as position, {_FIELD_SQL} as field from part),
      l as (select *, regexp_extract(field, '^(.+?)[._-]?([xyz])$', 1) as prefix,
        regexp_extract(field, '^(.+?)[._-]?([xyz])$', 2) as letter from f),
      g as (select source_id, prefix, arg_max(case when letter = 'x' then field end, case when letter = 'x' then position end) as x,
        arg_max(case when letter = 'y' then field end, case when letter = 'y' then position end) as y,
        arg_max(case when letter = 'z' then field end, case when letter = 'z' then position end) as z
        from l where length(prefix) >= 2 group by 1, 2)
    select source_id, prefix, concat_ws(',', x, y, z) as fields from g
    where (case when x is null then 0 else 1 end) + (case when y is null then 0 else 1 end)
      + (case when z is null then 0 else 1 end) >= 2""",
)
def axis_groups(spark, sf):
    fields = _fields(spark, sf).select(F.col("p_brand").alias("source_id"), F.col("p_partkey").alias("position"), "field")
    return I.axis_groups(fields).select("source_id", "prefix", F.array_join("fields", ",").alias("fields"))


@check(
    "entity_path",
    f"""with p as (select page_id, url, case page_id % 6 when 0 then 'scalar' when 1 then 'state' when 2 then 'text_log'
        when 3 then 'mcap' when 4 then 'points3d' else 'image' end as kind from pages)
    select page_id, case kind when 'scalar' then '/metrics/' || {_SLUG.format(x='url')} when 'state' then '/states/' || {_SLUG.format(x='url')}
      when 'text_log' then '/logs/' || {_SLUG.format(x='url')} when 'mcap' then '/topics/' || {_SLUG.format(x='url')}
      when 'points3d' then '/sensors/lidar/points' else '/camera/image' end as path,
      case kind when 'scalar' then 'Scalars' when 'state' then 'StateChange' when 'text_log' then 'TextLog'
      when 'mcap' then 'AnyValues' when 'points3d' then 'Points3D' else 'EncodedImage' end as archetype,
      case kind when 'scalar' then 'TimeSeriesView' when 'state' then 'StateTimelineView' when 'text_log' then 'TextLogView'
      when 'mcap' then 'DataframeView' when 'points3d' then 'Spatial3DView' else 'Spatial2DView' end as view,
      regexp_full_match(url, '/(?:[A-Za-z0-9_.-]+/?)*') and not contains(url, '//') as valid from p""",
)
def entity_path(spark, sf):
    kinds = ("scalar", "state", "text_log", "mcap", "points3d", "image")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("page_id") % 6 + 1).cast("int"))
    return table(spark, sf, "pages").select(
        "page_id",
        S.entity_path(kind, F.lit(None).cast("string"), F.col("url")).alias("path"),
        S.archetype(kind).alias("archetype"),
        S.view(kind).alias("view"),
        S.valid_entity_path(F.col("url")).alias("valid"),
    )


@check(
    "sanitize_path",
    f"""with e as (select page_id, list_filter(string_split(url, '/'), lambda p: trim(p) <> '') as parts from pages)
    select page_id, '/' || array_to_string(list_transform(parts, lambda p: {_SLUG.format(x='p')}), '/') as path from e""",
)
def sanitize_path(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", S.sanitized_entity_path(F.col("url"), F.lit("scalar"), F.col("url")).alias("path")
    )


_TOPIC_SQL = "case " + " ".join(
    "when " + " or ".join(f"contains(v, '{needle}')" for needle in needles) + " then '{" + str(i) + "}'"
    for i, (needles, *_rest) in enumerate(S.TOPIC_RULES)
)


def _topic_case(column: int, default: str) -> str:
    outcomes = [str(rule[column]) for rule in S.TOPIC_RULES]
    return _TOPIC_SQL.format(*outcomes) + f" else '{default}' end"


@check(
    "classify_topics",
    f"""with t as (select page_id, regexp_replace(url, '^https?://', '') as topic from pages),
      c as (select page_id, topic, lower(topic || ' ' || case page_id % 5 when 0 then 'sensor_msgs/msg/Imu' when 1 then
        'nav_msgs/msg/Odometry' when 2 then 'sensor_msgs/msg/LaserScan' when 3 then 'sensor_msgs/msg/JointState' else '' end) as v from t)
    select page_id, {_topic_case(1, 'raw_topic')} as role, {_topic_case(2, 'mcap')} as semantic_type,
      cast({_topic_case(3, '0.55')} as double) as confidence,
      '/topics/' || case when trim(topic, '/') = '' then 'topic' else replace(trim(topic, '/'), '/', '_') end as path from c""",
)
def classify_topics(spark, sf):
    topic = F.regexp_replace("url", "^https?://", "")
    schemas = ("sensor_msgs/msg/Imu", "nav_msgs/msg/Odometry", "sensor_msgs/msg/LaserScan", "sensor_msgs/msg/JointState", "")
    schema = F.element_at(F.array(*[F.lit(s) for s in schemas]), (F.col("page_id") % 5 + 1).cast("int"))
    named = S.classify_topic(topic, schema)
    return table(spark, sf, "pages").select(
        "page_id",
        named["role"].alias("role"),
        named["semantic_type"].alias("semantic_type"),
        named["confidence"].alias("confidence"),
        S.topic_entity_path(topic).alias("path"),
    )


@check(
    "filter_float",
    """select event_id, cast(json_extract_string(props, '$.k') as double) as from_text, value as from_number,
      cast(null as double) as from_bool from events""",
)
def filter_float(spark, sf):
    events = table(spark, sf, "events")
    k = S.json_value(F.col("props"), "$.k")
    empty, nothing = F.lit(None).cast("string"), F.lit(None).cast("double")

    def seen(kind, number, text):
        row = events.select(
            "event_id", F.lit(kind).alias("value_type"), number.alias("value_num"), text.alias("value_str")
        )
        return row.select("event_id", S.filter_float().alias(kind))

    texts = seen("string", nothing, k)
    numbers = seen("double", F.col("value"), empty)
    bools = seen("bool", (F.col("value") > 10).cast("double"), empty)
    return (
        texts.join(numbers, "event_id")
        .join(bools, "event_id")
        .select(
            "event_id",
            F.col("string").alias("from_text"),
            F.col("double").alias("from_number"),
            F.col("bool").alias("from_bool"),
        )
    )


@check(
    "is_number",
    """with w as (select p_partkey, case p_partkey % 5 when 0 then p_name when 1 then cast(p_retailprice as varchar)
        when 2 then ' ' || p_size || ' ' when 3 then '-1e' || p_size else 'nan' end as cell from part)
    select p_partkey, p_partkey % 5 <> 0 as is_number,
      case when p_partkey % 5 in (1, 2, 3) then try_cast(trim(cell) as double) end as number from w""",
)
def is_number(spark, sf):
    turn = F.col("p_partkey") % 5
    cell = (
        F.when(turn == 0, F.col("p_name"))
        .when(turn == 1, F.col("p_retailprice").cast("string"))
        .when(turn == 2, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")))
        .when(turn == 3, F.concat(F.lit("-1e"), F.col("p_size").cast("string")))
        .otherwise("nan")
    )
    return table(spark, sf, "part").select(
        "p_partkey", S.is_number(cell).alias("is_number"), S.to_number(cell).alias("number")
    )


@check(
    "effective_unit",
    f"""with p as ({" union all ".join(_profile_sql(n, f, k) for n, (k, f) in PROFILED.items())}),
      c as (select *, case position % 3 when 0 then 'auto' when 1 then 'seconds' end as configured from p)
    select source_id, field, case when configured = 'seconds' then 'relative_s'
      when inferred_time_unit is not null and inferred_time_unit <> 'mixed' then inferred_time_unit
      when first_time_unit is not null then first_time_unit else 'auto' end as unit from c""",
)
def effective_unit(spark, sf):
    turn = F.col("position") % 3
    configured = F.when(turn == 0, "auto").when(turn == 1, "seconds")
    return event_profiles(spark, sf).select(
        "source_id",
        "field",
        S.effective_unit(configured, F.col("inferred_time_unit"), F.col("first_time_unit")).alias("unit"),
    )
