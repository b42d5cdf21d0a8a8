"""Catalogue joins, ingest status, inventories, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import EV, SIG, check, event_signals, table
from checks.signals import rows
from tracelake.functions.scalars import value_text
from tracelake.operators import catalog as C
from tracelake.operators.profile import source_counts as count_sources
from tracelake.plans import sinks as K
from tracelake.session import work_dir
from tracelake.sources import files as S
from tracelake.sources import inventory as V
from tracelake.streaming import ingest as T


def user_recordings(spark, sf):
    """One recording per customer key as the users' catalogue; the nation is the project."""
    return table(spark, sf, "customer").select(
        F.concat(F.lit("user_"), F.col("c_custkey").cast("string")).alias("recording_id"),
        F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("project_id"),
        F.col("c_nationkey").alias("source_id"),
        F.col("c_name").alias("name"),
    )


@check(
    "project_scope_join",
    f"""with {SIG} select recording_id, time, entity_path, key, ord from sig where recording_id in
      (select 'user_' || c_custkey from customer where c_nationkey = 3)""",
)
def project_scope_join(spark, sf):
    scoped = C.in_project(event_signals(spark, sf), user_recordings(spark, sf), "nation_3")
    return scoped.select("recording_id", "time", "entity_path", "key", "ord")


@check(
    "recording_source_join",
    """select 'user_' || c_custkey as recording_id, c_nationkey as source_id, c_name as name, n_name as source_name
    from customer left join (select * from nation where n_nationkey <> 4) on c_nationkey = n_nationkey""",
)
def recording_source_join(spark, sf):
    sources = table(spark, sf, "nation").filter("n_nationkey <> 4").select(
        F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("source_name")
    )
    return C.with_sources(user_recordings(spark, sf), sources).drop("project_id")


@check(
    "unknown_recordings",
    """select distinct 'user_' || user_id as recording_id from events where user_id not in
      (select c_custkey from customer where c_nationkey < 20)""",
)
def unknown_recordings(spark, sf):
    requested = event_signals(spark, sf).select("recording_id")
    known = user_recordings(spark, sf).filter("source_id < 20")
    return C.unknown_recordings(requested, known)


@check(
    "manifest_join",
    """select s_suppkey as source_id, s_name as name, count(l_orderkey) as rows from supplier left join lineitem
      on l_suppkey = s_suppkey group by 1, 2""",
)
def manifest_join(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("recording_id"), F.col("l_suppkey").alias("source_id"))
    counts = lines.groupBy("source_id").agg(F.count(F.lit(1)).alias("rows"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"))
    return C.with_sources(suppliers, counts).withColumn("rows", F.coalesce("rows", F.lit(0)).cast("bigint"))


@check(
    "ingest_rollup",
    """with i as (select o_custkey as batch_id, case o_orderstatus when 'F' then 'succeeded' when 'P' then 'cancelled'
        else case when o_orderkey % 2 = 0 then 'failed' else 'pending' end end as status from orders),
      c as (select batch_id, count(*) as total, count(*) filter (status = 'succeeded') as succeeded,
        count(*) filter (status = 'failed') as failed, count(*) filter (status = 'cancelled') as cancelled,
        count(*) filter (status in ('pending', 'running', 'cancel_requested')) as active from i group by 1)
    select *, case when active > 0 then 'running' when failed > 0 then 'failed' when cancelled > 0 then 'cancelled'
      else 'succeeded' end as status from c""",
)
def ingest_rollup(spark, sf):
    late = F.when(F.col("o_orderkey") % 2 == 0, "failed").otherwise("pending")
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "cancelled").otherwise(late)
    items = table(spark, sf, "orders").select(F.col("o_custkey").alias("batch_id"), status.alias("status"))
    return C.ingest_rollup(items)


@check(
    "preview_top",
    """select cast(o_orderkey as varchar) as o_orderkey, coalesce(o_orderpriority, '') as o_orderpriority,
      coalesce(case when o_orderstatus <> 'P' then o_orderstatus end, '') as o_orderstatus
    from orders order by o_orderdate desc, o_orders.o_orderkey limit 100""".replace("o_orders.o_orderkey", "orders.o_orderkey"),
)
def preview_top(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderdate", "created_at")
    newest = C.newest_first(orders, 100, tie="o_orderkey")
    shown = newest.select(
        "o_orderkey", "o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus")
    )
    return S.preview(shown, 100)


@check(
    "tag_edit",
    """select p_partkey, array_to_string(list_filter(case when list_contains([p_type, p_brand], 'failed') then [p_type, p_brand]
      else list_append([p_type, p_brand], 'failed') end, lambda t: t <> 'ECONOMY'), ',') as tags,
      case when p_size > 25 then 'v2' else 'v1' end as firmware from part""",
)
def tag_edit(spark, sf):
    part = table(spark, sf, "part")
    tags = C.edit_tags(F.array("p_type", "p_brand"), ["failed", "failed"], ["ECONOMY"])
    params = F.create_map(F.lit("firmware"), F.lit("v1"), F.lit("name"), F.col("p_name"))
    new = F.create_map(F.lit("firmware"), F.when(F.col("p_size") > 25, "v2").otherwise("v1"))
    return part.select(
        "p_partkey",
        F.array_join(tags, ",").alias("tags"),
        F.element_at(C.merge_params(params, new), "firmware").alias("firmware"),
    )


_ROUTED = r"""with p as (select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as root, regexp_replace(url, '[?#].*$', '') || case page_id % 9 when 0 then '.csv' when 1 then '.ndjson'
        when 2 then '.PNG' when 3 then '.log' when 4 then '.mcap' when 5 then '.db3' when 6 then '.xyz' when 7 then '.bin' else '' end as path from pages),
      t as (select *, lower(regexp_extract(string_split(path, '/')[-1], '^.+\.([^.]*)$', 1)) as suffix from p),
      k as (select *, case when suffix = 'csv' then 'csv' when suffix in ('jsonl', 'ndjson') then 'jsonl'
        when suffix in ('jpg', 'jpeg', 'png', 'bmp', 'webp', 'tif', 'tiff', 'gif') then 'image_folder'
        when suffix in ('tsv', 'txt', 'log', 'dat', 'lst', 'list') then 'text_table' when suffix = 'mcap' then 'mcap'
        when suffix = 'db3' then 'ros2_db3' when suffix in ('ply', 'pcd', 'npy', 'npz', 'xyz', 'xyzn', 'xyzrgb', 'pts', 'asc')
        then 'point_cloud' end as source_type from t)"""


@check(
    "suffix_routing",
    f"""{_ROUTED}
    select page_id, source_type, case when source_type in ('csv', 'jsonl', 'text_table') then 'tabular' when source_type = 'ros2_db3'
      then 'mcap' else source_type end as family from k""",
)
def suffix_routing(spark, sf):
    kind = S.source_type(F.col("path"))
    return routed_pages(spark, sf).select("page_id", kind.alias("source_type"), S.source_family(kind).alias("family"))


def routed_pages(spark, sf):
    tails = (".csv", ".ndjson", ".PNG", ".log", ".mcap", ".db3", ".xyz", ".bin", "")
    tail = F.element_at(F.array(*[F.lit(t) for t in tails]), (F.col("page_id") % 9 + 1).cast("int"))
    path = F.concat(F.regexp_replace("url", "[?#].*$", ""), tail)
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return table(spark, sf, "pages").select("page_id", path.alias("path"), host.alias("root"))


@check(
    "directory_routing",
    f"""{_ROUTED}
    select root, case when bool_or(source_type = 'ros2_db3') then 'ros2_db3' when bool_or(source_type = 'image_folder')
      then 'image_folder' when bool_or(source_type = 'point_cloud') then 'point_cloud' end as source_type from k group by 1""",
)
def directory_routing(spark, sf):
    return S.directory_types(routed_pages(spark, sf))


@check(
    "recording_names",
    """select page_id, 'run_' || case when n < 1000 then lpad(cast(n as varchar), 3, '0') else cast(n as varchar) end as recording_id
    from (select page_id, row_number() over (order by url, page_id) as n from pages)""",
)
def recording_names(spark, sf):
    path = F.concat_ws("\x01", "url", F.lpad(F.col("page_id").cast("string"), 12, "0"))
    pages = table(spark, sf, "pages").select("page_id", path.alias("path"))
    return S.name_recordings(pages, "run").select("page_id", "recording_id")


@check(
    "inventory_changes",
    """with stored as (select 'doc_' || doc_id as path, sha256(text) as checksum from documents where doc_id % 11 <> 0),
      fresh as (select 'doc_' || doc_id as path, sha256(case when doc_id % 7 = 0 then text || '!' else text end) as checksum
        from documents where doc_id % 13 <> 0)
    select path, stored.checksum as stored_checksum, fresh.checksum as fresh_checksum,
      case when fresh.checksum is null then 'source_unavailable' when stored.checksum is null then 'source_added'
      when stored.checksum <> fresh.checksum then 'source_changed' else 'unchanged' end as status
    from stored full outer join fresh using (path)""",
)
def inventory_changes(spark, sf):
    documents = table(spark, sf, "documents")
    path = F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path")
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    stored = documents.filter("doc_id % 11 <> 0").select(path, F.sha2("text", 256).alias("checksum"))
    fresh = documents.filter("doc_id % 13 <> 0").select(path, F.sha2(changed, 256).alias("checksum"))
    return V.inventory_changes(stored, fresh)


@check(
    "folder_digest",
    """with f as (select lang as root, 'doc_' || doc_id as relative_path, sha256(text) as checksum, n_chars as size from documents),
      b as (select root, substr(sha256(relative_path), 1, 3) as bucket, sha256(string_agg(relative_path || ':' || checksum, chr(10)
        order by relative_path || ':' || checksum)) as digest, count(*) as files, sum(size) as size from f group by 1, 2)
    select root, sha256(string_agg(bucket || ':' || digest, chr(10) order by bucket || ':' || digest)) as checksum,
      cast(sum(files) as bigint) as files, cast(sum(size) as bigint) as size from b group by 1""",
)
def folder_digest(spark, sf):
    files = table(spark, sf, "documents").select(
        F.col("lang").alias("root"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("relative_path"),
        F.sha2("text", 256).alias("checksum"),
        F.col("n_chars").alias("size"),
    )
    return V.folder_digest(files)


_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@check(
    "source_counts",
    "\nunion all\n".join(
        f"select '{name}' as source_id, count(*) as rows, (select count(*) from (describe {name})) as columns from {name}"
        for name in _TABLES
    ),
)
def source_counts(spark, sf):
    parts = [count_sources(table(spark, sf, name), name) for name in _TABLES]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# ---- sinks and streams: written to the shared folder and read back -------------------------------------------


@check(
    "export_roundtrip",
    f"""with {SIG} select recording_id, cast(round(time * 1000) as bigint) as millis, entity_path, key, value_text as value from sig
    where semantic_type in ('text_log', 'state') and regexp_matches(lower(value_text), 'error|warn|fault')""",
)
def export_roundtrip(spark, sf):
    from tracelake.operators.query import find_errors

    path = work_dir(spark, "export")
    K.export_query(find_errors(event_signals(spark, sf)), path, "csv")
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    millis = F.round(F.col("time").cast("double") * 1000).cast("bigint")
    return back.select("recording_id", millis.alias("millis"), "entity_path", "key", "value")


@check(
    "build_roundtrip",
    f"""with {SIG} select recording_id, time, entity_path, semantic_type, key, value_num, value_text, ord from sig""",
)
def build_roundtrip(spark, sf):
    path = work_dir(spark, "signals")
    signals = event_signals(spark, sf)
    K.write_signals(signals, path)
    # writing some recordings again replaces them and leaves the others alone
    K.write_signals(signals.filter(F.col("recording_id").endswith("7")), path)
    return rows(K.read_signals(spark, path))


@check(
    "stream_find_errors",
    f"""with {SIG} select recording_id, time, entity_path, key, value_text, ord from sig
    where semantic_type in ('text_log', 'state') and regexp_matches(lower(value_text), 'error|warn|fault')""",
)
def stream_find_errors(spark, sf):
    from tracelake.operators.query import find_errors

    source, target = work_dir(spark, "stream-in"), work_dir(spark, "stream-out")
    K.write_signals(event_signals(spark, sf), source)
    T.filter_stream(T.read_signal_stream(spark, source), find_errors, target)
    found = spark.read.parquet(target)
    return found.select("recording_id", "time", "entity_path", "key", value_text().alias("value_text"), "ord")


@check(
    "stream_ingest",
    f"""with {EV} select recording_id, time, entity_path, key, value_num, ord from (
      select recording_id, time, '/metrics/value' as entity_path, 'value' as key, value as value_num, event_id as ord from ev
      union all select recording_id, time, '/states/event_type', 'event_type', null, event_id from ev)""",
)
def stream_ingest(spark, sf):
    drop, target = work_dir(spark, "drop"), work_dir(spark, "ingested")
    events = table(spark, sf, "events").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    odd = F.col("event_id") % 2 == 1
    mapping = {
        "primary_timeline": "ts",
        "streams": [
            {"source_fields": ["value"], "semantic_type": "scalar", "entity_path": "/metrics/value"},
            {"source_fields": ["event_type"], "semantic_type": "state", "entity_path": "/states/event_type"},
        ],
    }
    recording = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    schema = "event_id bigint, ts double, user_id bigint, event_type string, value double"

    def ingest():
        T.ingest_folder(spark, drop, "json", schema, mapping, recording, "events", target, ord="event_id")

    # two drops, two runs, and a third run with nothing new
    picked = events.select("event_id", "ts", "user_id", "event_type", "value")
    picked.filter(odd).write.mode("append").json(drop)
    ingest()
    picked.filter(~odd).write.mode("append").json(drop)
    ingest()
    ingest()
    return spark.read.parquet(target).select("recording_id", "time", "entity_path", "key", "value_num", "ord")
