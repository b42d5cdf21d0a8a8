"""Quality checks and the data-health report."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import EV, LINE_SIG, SIG, check, event_signals, line_signals, table
from checks.signals import TOPICS, battery_signals, event_topics
from tracelake.functions.scalars import topic_entity_path
from tracelake.operators import profile as P
from tracelake.operators import quality as Q
from tracelake.operators.index import index_frame
from tracelake.plans import diagnostics as D
from tracelake.session import materialize

LIMITS = D.PRESETS["balanced"]


@check(
    "duplicate_timestamps",
    f"""with {LINE_SIG} select recording_id, source_id, entity_path, count(time) as sample_count,
      count(time) - count(distinct time) as duplicate_count from line_sig group by 1, 2, 3
    having count(time) >= 3 and count(time) > count(distinct time)""",
)
def duplicate_timestamps(spark, sf):
    return Q.duplicate_timestamps(Q.measured(line_signals(spark, sf)))


_GAPS = """
gaps as (select recording_id, source_id, entity_path, time - lag(time) over (
    partition by recording_id, source_id, entity_path order by time) as gap from {rows}),
gap_stats as (select recording_id, source_id, entity_path, count(*) as gap_count, median(gap) as typical_gap_s,
    max(gap) as max_gap_s from gaps where gap > 0 group by 1, 2, 3 having count(*) >= 3)"""


@check(
    "time_gaps",
    f"""with {SIG}, {_GAPS.format(rows="(select * from sig where semantic_type <> 'text_log')")}
    select recording_id, source_id, entity_path, gap_count, round(typical_gap_s, 3) as typical_gap_s,
      round(max_gap_s, 3) as max_gap_s from gap_stats""",
)
def time_gaps(spark, sf):
    return Q.gap_statistics(Q.measured(event_signals(spark, sf))).select(
        "recording_id",
        "source_id",
        "entity_path",
        "gap_count",
        F.round("typical_gap_s", 3).alias("typical_gap_s"),
        F.round("max_gap_s", 3).alias("max_gap_s"),
    )


@check(
    "large_time_gaps",
    f"""with {LINE_SIG}, {_GAPS.format(rows="line_sig")}
    select recording_id, source_id, entity_path, gap_count, typical_gap_s, max_gap_s from gap_stats
    where typical_gap_s > 0 and max_gap_s >= typical_gap_s * 5""",
)
def large_time_gaps(spark, sf):
    return Q.large_gaps(Q.measured(line_signals(spark, sf)), 5.0)


_OUTLIERS = """
ranked as (select recording_id, source_id, entity_path, key, value_num as v,
    row_number() over (partition by recording_id, source_id, entity_path, key order by value_num, ord) as rn,
    count(*) over (partition by recording_id, source_id, entity_path, key) as n from {rows} where value_num is not null),
hinge as (select recording_id, source_id, entity_path, key, n,
    avg(case when rn between ((n // 2) + 1) // 2 and (n // 2) // 2 + 1 then v end) as q1,
    avg(case when rn - (n + 1) // 2 between ((n // 2) + 1) // 2 and (n // 2) // 2 + 1 then v end) as q3
    from ranked group by 1, 2, 3, 4, 5),
outliers as (select recording_id, source_id, entity_path, key, n as sample_count, q1, q3, q1 - 1.5 * (q3 - q1) as lower_bound,
    q3 + 1.5 * (q3 - q1) as upper_bound, count(*) as outlier_count
    from hinge join ranked using (recording_id, source_id, entity_path, key, n)
    where n >= 4 and q3 - q1 > 0 and (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1))
    group by 1, 2, 3, 4, 5, 6, 7, 8, 9)"""


@check(
    "iqr_outliers",
    f"""with {SIG}, {_OUTLIERS.format(rows="sig")} select recording_id, source_id, entity_path, key, sample_count,
      round(q1, 6) as q1, round(q3, 6) as q3, round(lower_bound, 6) as lower_bound,
      round(upper_bound, 6) as upper_bound, outlier_count from outliers""",
)
def iqr_outliers(spark, sf):
    found = Q.iqr_outliers(Q.measured(event_signals(spark, sf)))
    rounded = [F.round(name, 6).alias(name) for name in ("q1", "q3", "lower_bound", "upper_bound")]
    return found.select(*Q.SIGNAL, "sample_count", *rounded, "outlier_count")


@check(
    "tukey_hinges",
    f"""with {LINE_SIG}, {_OUTLIERS.format(rows="line_sig")} select recording_id, source_id, entity_path, key,
      n as sample_count, round(q1, 6) as q1, round(q3, 6) as q3 from hinge""",
)
def tukey_hinges(spark, sf):
    hinges = Q.hinges(Q.measured(line_signals(spark, sf)))
    return hinges.select(*Q.SIGNAL, "sample_count", F.round("q1", 6).alias("q1"), F.round("q3", 6).alias("q3"))


def order_signals(spark, sf):
    """Orders as one recording per customer: a number and a state."""
    mapping = {
        "primary_timeline": "o_orderdate",
        "streams": [
            {"source_fields": ["lines"], "semantic_type": "scalar", "entity_path": "/metrics/lines"},
            {"source_fields": ["o_orderstatus"], "semantic_type": "state", "entity_path": "/states/status"},
        ],
    }
    orders = table(spark, sf, "orders").withColumn("lines", F.col("o_custkey") % 3)
    recording = F.concat(F.lit("cust_"), F.col("o_custkey").cast("string"))
    return index_frame(orders, mapping, recording, "orders", "o_orderkey")


@check(
    "constant_numeric",
    """select 'cust_' || cast(o_custkey as varchar) as recording_id, 'orders' as source_id, '/metrics/lines' as entity_path,
      'lines' as key, count(*) as sample_count, cast(min(o_custkey % 3) as double) as value
    from orders group by o_custkey having count(*) >= 3""",
)
def constant_numeric(spark, sf):
    return Q.constant_numeric(Q.measured(order_signals(spark, sf)))


@check(
    "constant_state",
    """select 'cust_' || cast(o_custkey as varchar) as recording_id, 'orders' as source_id, '/states/status' as entity_path,
      'o_orderstatus' as key, count(*) as sample_count, min(o_orderstatus) as value
    from orders group by o_custkey having count(*) >= 3 and min(o_orderstatus) = max(o_orderstatus)""",
)
def constant_state(spark, sf):
    return Q.constant_state(Q.measured(order_signals(spark, sf)))


# ---- findings ---------------------------------------------------------------------------------------------

PLAIN = ["category", "severity", "recording_id", "source_id", "entity_path", "key", "message"]


def finding_topics(spark, sf):
    return event_topics(spark, sf).select(
        "*",
        topic_entity_path(F.col("topic")).alias("entity_path"),
        F.lit(0).cast("bigint").alias("ord"),
        F.lit(True).alias("convertible"),
        F.lit("").alias("skip_reason"),
        F.col("schema_name").alias("message_type"),
    )


_LOG_FINDINGS = """
  select 'logs_and_states' as category, case when regexp_matches(lower(value_text), 'error|fault') then 'critical' else 'warning' end
    as severity, recording_id, cast(null as varchar) as source_id, entity_path, key,
    'Log/state diagnostic match on ' || key || '.' as message from sig
  where semantic_type in ('text_log', 'state') and regexp_matches(lower(value_text), 'error|warn|fault')"""


@check("log_findings", f"with {SIG} {_LOG_FINDINGS}")
def log_findings(spark, sf):
    return D.row_findings(event_signals(spark, sf), LIMITS).filter("category = 'logs_and_states'").select(*PLAIN)


_BATTERY_FINDINGS = """
  select 'battery', 'warning', recording_id, null, '/metrics/power', 'battery', 'Battery value is below 0.2.' from ev
  where value < 0.2"""


@check(
    "battery_findings",
    f"""with {EV} select 'battery' as category, 'warning' as severity, recording_id, cast(null as varchar) as source_id,
    '/metrics/power' as entity_path, 'battery' as key, 'Battery value is below 0.2.' as message from ev where value < 0.2""",
)
def battery_findings(spark, sf):
    return D.row_findings(battery_signals(spark, sf), LIMITS).filter("category = 'battery'").select(*PLAIN)


_DRIFT = """
based as (select *, first_value(topic) over w as base_topic, first_value(start_time) over w as base_start,
    first_value(end_time) over w as base_end, row_number() over w as rn from topics
    window w as (partition by recording_id order by topic rows between unbounded preceding and unbounded following)),
drift as (select *, greatest(abs(start_time / 1e9 - base_start / 1e9), abs(end_time / 1e9 - base_end / 1e9)) as delta
    from based where rn > 1)"""
_DRIFT_FINDINGS = """
  select 'time_sync' as category, case when delta >= 1.0 then 'critical' else 'warning' end as severity, recording_id,
    source_id, '/time_sync' as entity_path, 'time_delta' as key,
    'Topic ' || topic || ' time range differs from ' || base_topic || '.' as message from drift where delta >= 0.1"""


@check("drift_findings", f"with {TOPICS}, {_DRIFT} {_DRIFT_FINDINGS}")
def drift_findings(spark, sf):
    return D.drift_findings(finding_topics(spark, sf), LIMITS).select(*PLAIN)


@check(
    "coverage_findings",
    f"""with {TOPICS}, r as (select count(*) as n, count(*) filter (role = 'tf_tree') as tf,
      count(*) filter (role in ('tf_tree', 'trajectory', 'point_cloud', 'camera_image', 'imu', 'joint_state', 'diagnostics',
      'robot_model')) as known from topics)
    select 'topic_coverage' as category, 'warning' as severity, 'TF transform topic is missing.' as message from r
      where n > 0 and tf = 0
    union all select 'topic_coverage', 'warning', 'No recognized robotics topic roles were found.' from r
      where n > 0 and known = 0""",
)
def coverage_findings(spark, sf):
    return D.coverage_findings(finding_topics(spark, sf)).select("category", "severity", "message")


def _graded_topics(spark, sf):
    """Topics where every other user's error topic cannot be converted and signup topics are empty."""
    topics = finding_topics(spark, sf)
    odd = F.regexp_extract("recording_id", r"(\d+)$", 1).cast("bigint") % 2 == 1
    return topics.withColumn("convertible", ~((F.col("topic") == "/error") & odd)).withColumn(
        "message_count", F.when(F.col("topic") == "/signup", F.lit(0).cast("bigint")).otherwise(F.col("message_count"))
    )


@check(
    "topic_findings",
    f"""with {TOPICS}, g as (select *, cast(regexp_extract(recording_id, '([0-9]+)$', 1) as bigint) % 2 = 1 as odd from topics)
    select 'convertibility' as category, 'warning' as severity, recording_id, source_id, '/topics/' || substr(topic, 2) as entity_path,
      'convertible' as key, 'Topic ' || topic || ' is marked unconvertible in the query index.' as message from g
      where topic = '/error' and odd
    union all select 'message_volume', 'warning', recording_id, source_id, '/topics/' || substr(topic, 2), 'message_count',
      'Topic ' || topic || ' has no indexed messages.' from g where topic = '/signup'""",
)
def topic_findings(spark, sf):
    topics = _graded_topics(spark, sf)
    recordings = topics.select("recording_id", "source_id").distinct()
    found = D.convertibility_findings(None, None, topics).unionByName(D.volume_findings(recordings, None, topics))
    return found.select(*PLAIN)


def label_sources(spark, sf):
    """Documents with their labels, one source per language: unlabelled documents are missing values."""
    documents = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return P.field_profiles(documents, F.col("lang"), "doc_id", ["source", "n_chars", "quality", "toxic"], with_order=False)


_MISSING = """
missing as (
  select lang as source_id, field, round(cast(nulls as double) / n, 6) as null_ratio, nulls, n from (
    select lang, 'quality' as field, count(*) - count(quality) as nulls, count(*) as n
      from documents left join labels using (doc_id) group by 1
    union all select lang, 'toxic', count(*) - count(toxic), count(*) from documents left join labels using (doc_id) group by 1
    union all select lang, 'source', count(*) - count(source), count(*) from documents group by 1
    union all select lang, 'n_chars', count(*) - count(n_chars), count(*) from documents group by 1))"""


@check(
    "missing_ratio",
    f"""with {_MISSING} select 'schema_quality' as category, case when null_ratio >= 0.5 then 'critical' else 'warning' end as severity,
      source_id, field as key, 'Field ' || field || ' has a high missing-value ratio.' as message from missing where null_ratio >= 0.2
    union all select 'schema_quality', 'warning', lang, 'created', 'No usable timeline field was detected.' from documents group by lang""",
)
def missing_ratio(spark, sf):
    profiles = label_sources(spark, sf)
    keys = profiles.select("source_id", F.lit("created").alias("time_key")).distinct()
    timelines = P.timeline_profiles(profiles, keys).withColumn("source_type", F.lit("jsonl"))
    return D.schema_findings(profiles, timelines, LIMITS).select("category", "severity", "source_id", "key", "message")


def event_inputs(spark, sf):
    # the catalogue tables of a report are stored; its signals are scanned
    recordings = materialize(event_signals(spark, sf).select("recording_id", "source_id").distinct(), "recordings")
    events = table(spark, sf, "events")
    profiles = P.field_profiles(events, "events", "event_id", ["ts", "user_id", "event_type", "value", "props"])
    profiles = materialize(profiles, "profiles")
    keys = recordings.select("source_id", F.lit("ts").alias("time_key")).distinct()
    timelines = P.timeline_profiles(profiles, keys).withColumn("source_type", F.lit("csv"))
    return D.Inputs(
        recordings=recordings,
        signals=event_signals(spark, sf),
        topics=materialize(finding_topics(spark, sf), "topics"),
        profiles=profiles,
        timelines=timelines,
    )


# findings of the events table under the balanced preset; it has no missing values and a sorted clock
_EVENT_FINDINGS = f"""
{SIG}, {TOPICS}, {_DRIFT}, {_OUTLIERS.format(rows="(select * from sig where semantic_type <> 'text_log')")},
{_GAPS.format(rows="(select * from sig where semantic_type <> 'text_log')")},
found as (
  select 'topic_coverage' as category, 'warning' as severity, cast(null as varchar) as recording_id,
    cast(null as varchar) as source_id, cast(null as varchar) as entity_path, cast(null as varchar) as key,
    'TF transform topic is missing.' as message
  union all select 'topic_coverage', 'warning', null, null, null, null, 'No recognized robotics topic roles were found.'
  union all {_LOG_FINDINGS}
  union all {_DRIFT_FINDINGS}
  union all select 'time_series_quality', 'warning', recording_id, source_id, entity_path, 'time',
    'Duplicate timestamps were found in indexed rows.' from sig where semantic_type <> 'text_log'
    group by recording_id, source_id, entity_path having count(*) >= 3 and count(*) > count(distinct time)
  union all select 'time_series_quality', 'warning', recording_id, source_id, entity_path, 'time',
    'A large time gap was found in indexed rows.' from gap_stats where typical_gap_s > 0 and max_gap_s >= typical_gap_s * 5
  union all select 'time_series_quality', 'warning', null, 'events', null, 'ts',
    'Timeline values are not monotonic in the sampled profile.'
    where (select bool_or(ts < prev) from (select ts, lag(ts) over (order by event_id) as prev from events))
  union all select 'data_quality', 'warning', recording_id, source_id, entity_path, key,
    'Numeric field ' || key || ' has values outside the IQR outlier bounds.' from outliers
  union all select 'data_quality', 'info', recording_id, source_id, entity_path, key,
    'Numeric field ' || key || ' is constant in indexed rows.' from sig where semantic_type = 'scalar'
    group by recording_id, source_id, entity_path, key having count(*) >= 3 and min(value_num) = max(value_num)
  union all select 'data_quality', 'info', recording_id, source_id, entity_path, key,
    'State field ' || key || ' never changes in indexed rows.' from sig where semantic_type = 'state'
    group by recording_id, source_id, entity_path, key having count(*) >= 3 and min(value_text) = max(value_text))"""
_POINTS = "case severity when 'critical' then 30 when 'warning' then 10 when 'info' then 2 else 0 end"


@check("findings", f"with {_EVENT_FINDINGS} select * from found")
def findings(spark, sf):
    return D.all_findings(event_inputs(spark, sf), LIMITS).select(*PLAIN)


@check(
    "finding_ids",
    f"""with {_EVENT_FINDINGS}, stepped as (select *, case
        when starts_with(message, 'No recognized') then 2 when starts_with(message, 'TF transform') then 3 when category = 'time_sync' then 9
        when category = 'logs_and_states' then 10 when starts_with(message, 'Timeline values') then 18
        when starts_with(message, 'Duplicate') then 19 when starts_with(message, 'A large') then 20
        when ends_with(message, 'is constant in indexed rows.') then 22 when starts_with(message, 'Numeric') then 23 else 24 end as step from found),
      numbered as (select *, row_number() over (order by step, recording_id nulls first, source_id nulls first,
        entity_path nulls first, key nulls first, message) as n from stepped)
    select 'diag_' || case when n < 1000 then lpad(cast(n as varchar), 4, '0') else cast(n as varchar) end as id,
      category, recording_id, source_id, entity_path, key, message from numbered""",
)
def finding_ids(spark, sf):
    """Which finding has which number; rows of one place and message differ in their time only."""
    found = D.with_finding_ids(D.all_findings(event_inputs(spark, sf), LIMITS))
    return found.select("id", "category", "recording_id", "source_id", "entity_path", "key", "message")


# ---- findings of sources and profiles that the events do not have ---------------------------------------------

_PLAIN_NULLS = "cast(null as varchar) as recording_id"


@check(
    "source_findings",
    f"""with s as (select s_suppkey as k, 's' || cast(s_suppkey as varchar) as source_id,
        case s_suppkey % 3 when 0 then 'ros2_db3' when 1 then 'mcap' else 'csv' end as source_type, s_suppkey % 5 as topics,
        s_suppkey % 7 as messages, s_suppkey % 2 as good from supplier),
      skipped as (select 's' || cast(p_partkey % 40 as varchar) as source_id, '/' || p_brand as topic from part
        where p_size < 5 group by 1, 2)
    select 'convertibility' as category, 'critical' as severity, {_PLAIN_NULLS}, source_id, cast(null as varchar) as entity_path,
      cast(null as varchar) as key, 'ROS2 bag has no convertible topics.' as message from s
      where source_type = 'ros2_db3' and topics > 0 and good = 0
    union all select 'convertibility', 'warning', null, source_id, '/topics/' || substr(topic, 2), 'convertible',
      'Topic ' || topic || ' cannot be converted.' from skipped
    union all select 'message_volume', 'critical', null, source_id, null, null, 'Recording source has no topic or message volume.' from s
      where source_type <> 'csv' and (topics = 0 or messages = 0) and k % 4 <> 0""",
)
def source_findings(spark, sf):
    """Bags without convertible topics, skipped topics, and selected recordings without messages."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("s"), k.cast("string")).alias("source_id")
    supplier, part = table(spark, sf, "supplier"), table(spark, sf, "part")
    kind = F.when(k % 3 == 0, "ros2_db3").when(k % 3 == 1, "mcap").otherwise("csv").alias("source_type")
    sources = supplier.select(
        name, kind, (k % 5).alias("topic_count"), (k % 7).alias("message_count"), (k % 2).alias("convertible_topic_count")
    )
    owner = F.concat(F.lit("s"), (F.col("p_partkey") % 40).cast("string")).alias("source_id")
    skipped = part.filter("p_size < 5").select(
        owner, F.concat(F.lit("/"), F.col("p_brand")).alias("topic"), F.lit("x").alias("message_type"), F.lit("y").alias("skip_reason")
    )
    recordings = supplier.filter(k % 4 != 0).select(name, F.lit("r").alias("recording_id"))
    found = D.convertibility_findings(sources, skipped, None).unionByName(D.volume_findings(recordings, sources, None))
    return found.unionByName(D.recording_findings(recordings)).select(*PLAIN)


@check(
    "no_recordings",
    """select 'message_volume' as category, 'critical' as severity, 'No recordings are available for diagnostics.' as message
    where (select count(*) from orders where o_totalprice < 0) = 0""",
)
def no_recordings(spark, sf):
    """Orders without a price are recordings: there are none."""
    none = table(spark, sf, "orders").filter("o_totalprice < 0")
    return D.recording_findings(none).select("category", "severity", "message")


@check(
    "schema_findings",
    """with p as (select 'n' || cast(c_nationkey as varchar) as source_id, c_name as field, c_custkey % 101 as empty from customer
        where c_nationkey % 5 <> 4),
      t as (select n_nationkey as k, 'n' || cast(n_nationkey as varchar) as source_id from nation),
      found as (
      select 'schema_quality' as category, 'warning' as severity, source_id, cast(null as varchar) as key,
        'No fields were available in the schema profile.' as message from t where k % 5 = 4
      union all select 'schema_quality', 'warning', source_id, 't', 'No usable timeline field was detected.' from t where k % 2 = 0 and k % 3 = 0
      union all select 'schema_quality', 'warning', source_id, 't', 'Timeline field appears to mix multiple time units.' from t where k % 6 = 1
      union all select 'schema_quality', case when empty >= 50 then 'critical' else 'warning' end, source_id, field,
        'Field ' || field || ' has a high missing-value ratio.' from p where empty >= 20
      union all select 'time_series_quality', 'warning', source_id, 't', 'Timeline parse ratio is below the warning threshold.' from t
        where k % 10 < 9
      union all select 'time_series_quality', 'warning', source_id, 't', 'Timeline values are not monotonic in the sampled profile.' from t
        where k % 4 = 0
      union all select 'data_quality', 'warning', source_id, field, 'Field ' || field || ' has no non-empty sampled values.' from p
        where empty = 100)
    select * from found""",
)
def schema_findings(spark, sf):
    """Customers are the fields of their nations, more or less empty; nations have more or less good clocks."""
    empty = (F.col("c_custkey") % 101).cast("bigint")
    source = lambda name: F.concat(F.lit("n"), F.col(name).cast("string")).alias("source_id")
    profiles = table(spark, sf, "customer").filter("c_nationkey % 5 <> 4").select(
        source("c_nationkey"), F.col("c_name").alias("field"), F.lit("double").alias("dtype"), F.lit(100).cast("bigint").alias("row_count"),
        empty.alias("null_count"), (F.lit(100) - empty).alias("non_null_count"), F.round(empty / 100.0, 6).alias("null_ratio"),
    )
    k = F.col("n_nationkey")
    timelines = table(spark, sf, "nation").select(
        source("n_nationkey"), F.lit("t").alias("time_key"), (k % 3 != 0).alias("present"), (k % 4 != 0).alias("monotonic"),
        ((k % 10) / 9.0).alias("parse_ratio"), F.lit("unix_s").alias("inferred_unit"), (k % 6 == 1).alias("mixed_units"),
        F.when(k % 2 == 0, "csv").otherwise("mcap").alias("source_type"),
    )
    found = D.schema_findings(profiles, timelines, LIMITS).unionByName(D.timeline_findings(timelines, LIMITS))
    return found.unionByName(D.empty_field_findings(profiles)).select("category", "severity", "source_id", "key", "message")


@check(
    "frame_findings",
    f"""with {LINE_SIG} select 'cv_detection' as category, 'warning' as severity, recording_id, entity_path, key,
      'CV detection issue: ' || case key when 'pred_box_count' then 'no_prediction' else 'low_score' end || '.' as message
    from (select recording_id, '/camera/pred/boxes' as entity_path, case key when 'l_discount' then 'score_min' when 'l_tax' then 'score_mean'
        else 'pred_box_count' end as key, case key when 'l_quantity' then floor(value_num / 10) else value_num * 10 end as v
      from line_sig where key in ('l_discount', 'l_tax', 'l_quantity'))
    where case key when 'pred_box_count' then v = 0 else v < 0.5 end""",
)
def frame_findings(spark, sf):
    """Discounts and taxes as scores of frames, quantities as numbers of boxes."""
    rows = line_signals(spark, sf).filter("key in ('l_discount', 'l_tax', 'l_quantity')")
    key, value = F.col("key"), F.col("value_num")
    frames = rows.withColumn("value_num", F.when(key == "l_quantity", F.floor(value / 10)).otherwise(value * 10).cast("double"))
    named = F.when(key == "l_discount", "score_min").when(key == "l_tax", "score_mean").otherwise("pred_box_count")
    frames = frames.withColumn("key", named).withColumn("entity_path", F.lit("/camera/pred/boxes"))
    return D.row_findings(frames, LIMITS).select("category", "severity", "recording_id", "entity_path", "key", "message")


@check(
    "report_summary",
    f"""with {_EVENT_FINDINGS}, s as (select cast(greatest(100 - sum({_POINTS}), 0) as integer) as health_score, bool_or(severity = 'critical')
      as c, bool_or(severity = 'warning') as w, count(*) as finding_count from found)
    select health_score, case when c or health_score < 60 then 'critical' when w or health_score < 85 then 'warning' else 'ok' end
      as severity, (select count(distinct recording_id) from sig) as recording_count, cast(0 as bigint) as source_count,
      (select count(*) from topics) as topic_count, finding_count from s""",
)
def report_summary(spark, sf):
    return D.diagnose(event_inputs(spark, sf)).summary


_CHECKS = ", ".join(f"({i}, '{name}', '{title}')" for i, (name, title, _) in enumerate(D.CHECKS))


@check(
    "check_table",
    f"""with {_EVENT_FINDINGS}, c as (select * from (values {_CHECKS}) v(position, id, name)),
      g as (select c.position, c.id, c.name, cast(greatest(100 - coalesce(sum({_POINTS}), 0), 0) as integer) as score,
        coalesce(bool_or(severity = 'critical'), false) as cr, coalesce(bool_or(severity = 'warning'), false) as wa,
        count(category) as finding_count from c left join found on found.category = c.id group by 1, 2, 3)
    select cast(position as integer) as position, id, name, case when cr then 'fail' when wa then 'warn' else 'pass' end as status,
      case when cr then 'critical' when wa then 'warning' else 'ok' end as severity, score, finding_count from g""",
)
def check_table(spark, sf):
    return D.diagnose(event_inputs(spark, sf)).checks.drop("recommendation")


def line_findings(spark, sf):
    rows = Q.measured(order_signals(spark, sf))
    return D.value_findings(Q.constant_numeric(rows), Q.iqr_outliers(rows), Q.constant_state(rows), 1.5)


@check(
    "health_score",
    f"""with f as (select o_custkey, 'info' as severity from orders group by 1 having count(*) >= 3
      union all select o_custkey, 'info' from orders group by 1 having count(*) >= 3 and min(o_orderstatus) = max(o_orderstatus))
    select 'cust_' || cast(o_custkey as varchar) as recording_id, cast(greatest(100 - sum({_POINTS}), 0) as integer) as health_score
    from f group by o_custkey""",
)
def health_score(spark, sf):
    return line_findings(spark, sf).groupBy("recording_id").agg(
        D.health_score(F.lit(1), F.col("severity")).alias("health_score")
    )


@check(
    "findings_filter",
    f"""with {_EVENT_FINDINGS} select * from found where severity = 'warning' and category = 'data_quality' and
    (contains(lower(coalesce(recording_id, '')), 'user_1') or contains(lower(coalesce(source_id, '')), 'user_1')
     or contains(lower(coalesce(entity_path, '')), 'user_1') or contains(lower(coalesce(key, '')), 'user_1')
     or contains(lower(message), 'user_1'))""",
)
def findings_filter(spark, sf):
    found = D.all_findings(event_inputs(spark, sf), LIMITS)
    return D.filter_findings(found, "warning", "data_quality", "USER_1").select(*PLAIN)


@check("categories", f"with {_EVENT_FINDINGS} select distinct category from found")
def categories(spark, sf):
    return D.categories(D.all_findings(event_inputs(spark, sf), LIMITS))


@check(
    "role_counts",
    f"""with {TOPICS}, roles as (select * from (values ('tf_tree'), ('trajectory'), ('point_cloud'), ('camera_image'), ('imu'),
      ('joint_state'), ('diagnostics'), ('robot_model')) v(role)), r as (select distinct recording_id from topics)
    select r.recording_id, roles.role, count(topics.role) as n from r join roles on true
      left join topics on topics.recording_id = r.recording_id and topics.role = roles.role group by 1, 2""",
)
def role_counts(spark, sf):
    from tracelake.operators.topics import role_counts as counts

    return counts(event_topics(spark, sf), ["recording_id"])
