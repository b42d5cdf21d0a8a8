"""Readers and exports over files written from the test tables, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import LINE_SIG, ORACLES, check, event_signals, line_signals, table
from checks.signals import event_topics
from tracelake.operators import compare as C
from tracelake.operators import query as Q
from tracelake.operators import topics as T
from tracelake.plans import sinks as K
from tracelake.session import work_dir
from tracelake.sources import files as S

CUSTOMERS = "select c_custkey, c_name, c_acctbal, c_custkey % 2 = 0 as even from customer"


def _customers(spark, sf, columns, even):
    rows = table(spark, sf, "customer").filter((F.col("c_custkey") % 2 == 0) == even)
    return rows.select(*columns, F.lit(even).alias("even"))


@check("csv_roundtrip", CUSTOMERS)
def csv_roundtrip(spark, sf):
    """Two files with their columns in another order."""
    drop = work_dir(spark, "csv")
    for even, columns in ((True, ["c_custkey", "c_name", "c_acctbal"]), (False, ["c_acctbal", "c_custkey", "c_name"])):
        _customers(spark, sf, columns, even).write.csv(f"{drop}/{even}", header=True)
    return S.read_csv(spark, f"{drop}/*/*.csv").select("c_custkey", "c_name", "c_acctbal", "even")


@check("text_roundtrip", CUSTOMERS)
def text_roundtrip(spark, sf):
    """One file cut by tabs, one by semicolons, columns in another order."""
    drop = work_dir(spark, "text")
    for even, columns, sign in (
        (True, ["c_custkey", "c_name", "c_acctbal"], "\t"),
        (False, ["c_name", "c_acctbal", "c_custkey"], ";"),
    ):
        _customers(spark, sf, columns, even).write.csv(f"{drop}/{even}", header=True, sep=sign)
    return S.read_text_table(spark, f"{drop}/*/*.csv").select("c_custkey", "c_name", "c_acctbal", "even")


@check("whitespace_roundtrip", "select event_id, user_id, value from events where value is not null")
def whitespace_roundtrip(spark, sf):
    drop = work_dir(spark, "blank")
    rows = table(spark, sf, "events").filter("value is not null").select("event_id", "user_id", "value")
    lines = rows.select(F.concat_ws("   ", *[F.col(c).cast("string") for c in rows.columns]).alias("value"))
    lines.write.text(drop)
    names = {"delimiter": "whitespace", "header_mode": "no_header", "column_names": rows.columns}
    return S.read_text_table(spark, f"{drop}/*.txt", names).select(*rows.columns)


@check("jsonl_roundtrip", "select o_orderkey, o_orderstatus, o_totalprice, o_orderkey as \"deep.key\" from orders")
def jsonl_roundtrip(spark, sf):
    drop = work_dir(spark, "json")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", F.struct(F.col("o_orderkey").alias("key")).alias("deep")
    )
    rows.write.json(drop)
    return S.read_jsonl(spark, f"{drop}/*.json").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("`deep.key`"))


def _ragged(spark, sf):
    """Lines of three cells; every fiftieth order has one more, every seventieth one less."""
    drop = work_dir(spark, "ragged")
    key = F.col("o_orderkey").cast("string")
    full = F.concat_ws(",", key, F.col("o_orderstatus"), F.col("o_custkey").cast("string"))
    line = F.when(F.col("o_orderkey") % 50 == 0, F.concat(full, F.lit(",more"))).when(
        F.col("o_orderkey") % 70 == 0, F.concat_ws(",", key, F.col("o_orderstatus"))
    )
    # every file starts with a full line
    rows = table(spark, sf, "orders").sortWithinPartitions(F.col("o_orderkey") % 50 == 0, F.col("o_orderkey") % 70 == 0, "o_orderkey")
    rows.select(F.coalesce(line, full).alias("value")).write.text(drop)
    return f"{drop}/*.txt", {"header_mode": "no_header", "column_names": ["k", "status", "customer"]}


@check(
    "csv_short_lines",
    """select o_orderkey as k, o_orderstatus as status, case when o_orderkey % 70 <> 0 then o_custkey end as customer
    from orders where o_orderkey % 50 <> 0""",
)
def csv_short_lines(spark, sf):
    path, options = _ragged(spark, sf)
    return S.read_csv(spark, path, options, on_error="drop").select("k", "status", "customer")


@check(
    "csv_rejects",
    "select cast(o_orderkey as varchar) || ',' || o_orderstatus || ',' || cast(o_custkey as varchar) || ',more' as text, "
    "'more cells than columns (3)' as reason from orders where o_orderkey % 50 = 0",
)
def csv_rejects(spark, sf):
    path, options = _ragged(spark, sf)
    return S.table_rejects(spark, path, options).select("text", "reason")


# ---- exports of derived results -------------------------------------------------------------------------------


def _exported(spark, rows, told: str, fmt: str = "csv"):
    """Rows of an export with the object in ``value`` as columns again."""
    path = work_dir(spark, "export")
    K.export_query(rows, path, fmt)
    back = spark.read.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else spark.read.parquet(path)
    return back.withColumn("time", F.col("time").cast("double")).select(
        "recording_id", "time", "entity_path", "key", F.from_json("value", told).alias("v")
    ).select("recording_id", "time", "entity_path", "key", "v.*")


@check(
    "export_state_duration",
    "select recording_id, cast(round(time * 1000) as bigint) as millis, entity_path, key, state, duration "
    f"from ({ORACLES['state_duration']})",
)
def export_state_duration(spark, sf):
    rows = Q.run_template(event_signals(spark, sf), "state_duration")
    back = _exported(spark, rows, "state string, duration double")
    millis = F.round(F.col("time") * 1000).cast("bigint").alias("millis")
    return back.select("recording_id", millis, "entity_path", "key", "state", F.round("duration", 3).alias("duration"))


@check(
    "export_time_sync",
    f"select recording_id, entity_path, key, base_topic, topic, role, start_delta_s, end_delta_s from ({ORACLES['time_sync']})",
)
def export_time_sync(spark, sf):
    rows = Q.run_template(T.topic_signals(event_topics(spark, sf)), "time_sync")
    told = "base_topic string, topic string, role string, start_delta double, end_delta double"
    return _exported(spark, rows, told, "parquet").select(
        "recording_id",
        "entity_path",
        "key",
        "base_topic",
        "topic",
        "role",
        F.round(F.col("start_delta") / 1e9, 3).alias("start_delta_s"),
        F.round(F.col("end_delta") / 1e9, 3).alias("end_delta_s"),
    )


@check(
    "export_compare",
    f"select recording_id, entity_path, key, count, min, max, mean, latest_num from ({ORACLES['compare_summary_numeric']})",
)
def export_compare(spark, sf):
    rows = C.compare(event_signals(spark, sf), metric_keys=["value"])
    told = "kind string, `count` bigint, `min` double, `max` double, `mean` double, latest_num double"
    back = _exported(spark, rows, told).filter("kind = 'numeric'")
    return back.select("recording_id", "entity_path", "key", "count", "min", "max", F.round("mean", 6).alias("mean"), "latest_num")


@check(
    "newest_orders",
    "select cast(row_number() over (order by o_orderdate desc, o_orderkey) as int) as place, o_orderkey from orders "
    "qualify place <= 1200",
)
def newest_orders(spark, sf):
    """More rows than any old cap; the limit is the feature."""
    from tracelake.operators.catalog import newest_first

    rows = table(spark, sf, "orders").select(F.col("o_orderdate").alias("created_at"), "o_orderkey")
    first = newest_first(rows, limit=1200, tie="o_orderkey")
    listed = first.agg(F.collect_list("o_orderkey").alias("keys"))
    return listed.select(F.posexplode("keys").alias("p", "o_orderkey")).select((F.col("p") + 1).alias("place"), "o_orderkey")


LINE_ROWS = f"with {LINE_SIG} select recording_id, time, entity_path, key, value_num, value_str, ord from line_sig"
_STORED = ["recording_id", "time", "entity_path", "key", "value_num", "value_str", "ord"]


@check("stream_compaction", LINE_ROWS)
def stream_compaction(spark, sf):
    """Landed in three parts, taken in after each, and once more with nothing new: every row is stored once."""
    landed, path = work_dir(spark, "landed"), work_dir(spark, "store")
    signals = line_signals(spark, sf)
    for part in range(3):
        signals.filter(F.col("ord") % 3 == part).write.mode("append").parquet(landed)
        K.compact_signals(spark, landed, path)
    K.compact_signals(spark, landed, path)
    return K.read_signals(spark, path).select(*_STORED)


@check(
    "landed_corrections",
    f"""with {LINE_SIG} select recording_id, time, entity_path, key,
      case when ord % 7 = 0 then -value_num else value_num end as value_num, value_str, ord from line_sig""",
)
def landed_corrections(spark, sf):
    """Rows that land again at the same place replace those in the store."""
    landed, path = work_dir(spark, "landed"), work_dir(spark, "store")
    signals = line_signals(spark, sf)
    signals.write.parquet(landed)
    K.compact_signals(spark, landed, path)
    signals.filter("ord % 7 = 0").withColumn("value_num", -F.col("value_num")).write.mode("append").parquet(landed)
    K.compact_signals(spark, landed, path)
    return K.read_signals(spark, path).select(*_STORED)


@check(
    "store_versions",
    f"""with {LINE_SIG}, told as (select recording_id, count(*) as n, sum(value_num) as total from line_sig group by 1)
    select recording_id, 1 as version, n, round(total, 2) as total from told
    union all select recording_id, 2, n, round(case when ends_with(recording_id, '3') then 2 * total else total end, 2) from told
    union all select recording_id, 3, n, round(case when ends_with(recording_id, '3') then 2 * total else total end, 2) from told""",
)
def store_versions(spark, sf):
    """Some recordings are replaced by doubled values, then what is worn is written anew; all versions stay readable."""
    path, signals = work_dir(spark, "store"), line_signals(spark, sf)
    K.write_signals(signals, path)
    K.write_signals(signals.filter("recording_id like '%3'").withColumn("value_num", 2 * F.col("value_num")), path)
    K.tidy_signals(spark, path)
    parts = []
    for version in (1, 2, 3):
        rows = K.read_signals(spark, path, version=version)
        told = rows.groupBy("recording_id").agg(F.count("*").alias("n"), F.round(F.sum("value_num"), 2).alias("total"))
        parts.append(told.withColumn("version", F.lit(version)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check(
    "store_time_range",
    f"""with {LINE_SIG} select recording_id, time, entity_path, key, value_num, value_str, ord from line_sig
    where recording_id in ('supp_1', 'supp_2', 'supp_9') and time between 820454400 and 852076800""",
)
def store_time_range(spark, sf):
    """Three recordings in one year: files are chosen by the log, rows by the filter."""
    path = work_dir(spark, "store")
    K.write_signals(line_signals(spark, sf), path)
    return K.read_signals(spark, path, ["supp_1", "supp_2", "supp_9"], (820454400.0, 852076800.0)).select(*_STORED)


@check(
    "folder_import",
    """with c as (select 'csv/c_nationkey=' || cast(c_nationkey as varchar) || '/' as folder, c_custkey as t, c_acctbal as num, c_mktsegment as word,
        cast(null as bigint) as whole, row_number() over (partition by c_nationkey order by c_custkey) as ord from customer),
      j as (select 'json/o_orderstatus=' || o_orderstatus || '/' as folder, o_orderkey as t, o_totalprice as num, o_orderpriority as word,
        o_custkey as whole, row_number() over (partition by o_orderstatus order by o_orderkey) as ord from orders),
      e as (select 'tsv/event_type=' || event_type || '/' as folder, event_id as t, value as num, cast(null as varchar) as word,
        user_id as whole, row_number() over (partition by event_type order by event_id) as ord from events),
      r as (select * from c union all select * from j union all select * from e),
      n as (select folder, 'drop_' || lpad(cast(row_number() over (order by folder) as varchar), 3, '0') as recording_id
        from (select distinct folder from r)),
      kinds as (select folder, left(folder, 3) as kind from n),
      m as (select recording_id, folder, cast(t as double) as time, ord, num, word, whole, kind from r join n using (folder) join kinds using (folder))
    select recording_id, time, case kind when 'tsv' then '/metrics/value' when 'jso' then '/metrics/total' else '/metrics/balance' end as entity_path,
      case kind when 'tsv' then 'value' when 'jso' then 'total' else 'balance' end as key, 'double' as value_type, num as value_num,
      cast(null as varchar) as value_str, ord from m where num is not null
    union all select recording_id, time, case kind when 'jso' then '/states/priority' else '/states/segment' end,
      case kind when 'jso' then 'priority' else 'segment' end, 'string', null, word, ord from m where word is not null
    union all select recording_id, time, case kind when 'jso' then '/metrics/who_customer' else '/metrics/user' end,
      case kind when 'jso' then 'who.customer' else 'user' end, 'int', cast(whole as double), null, ord from m where whole is not null""",
)
def folder_import(spark, sf):
    """Files of three kinds below one folder, each with its own header, delimiter and fields: a recording of every file."""
    from tracelake.plans.workflow import import_folder

    drop = work_dir(spark, "drop")

    def write(rows, by, order):
        # one file for every value, its rows in order
        return rows.repartition(by).sortWithinPartitions(by, order).write.partitionBy(by)

    customers = table(spark, sf, "customer").selectExpr("c_nationkey", "c_custkey t", "c_acctbal balance", "c_mktsegment segment")
    write(customers, "c_nationkey", "t").csv(f"{drop}/csv", header=True)
    events = table(spark, sf, "events").selectExpr("event_type", "event_id t", "user_id user", "value")
    write(events, "event_type", "t").option("extension", "tsv").csv(f"{drop}/tsv", header=True, sep="\t")
    orders = table(spark, sf, "orders").selectExpr(
        "o_orderstatus", "o_orderkey t", "to_json(struct(o_orderkey t, o_totalprice total, o_orderpriority priority, struct(o_custkey customer) who)) value"
    )
    ordered = orders.repartition("o_orderstatus").sortWithinPartitions("o_orderstatus", "t").select("o_orderstatus", "value")
    ordered.write.partitionBy("o_orderstatus").text(f"{drop}/json")
    # writers name such files .txt
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{drop}/json")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for row in S.list_files(spark, f"{drop}/json/*/*.txt").select("path").collect():
        path = spark._jvm.org.apache.hadoop.fs.Path(row.path)
        store.rename(path, spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), path.getName().replace(".txt", ".jsonl")))
    signals = import_folder(spark, drop, "drop").signals
    return signals.select("recording_id", "time", "entity_path", "key", "value_type", "value_num", "value_str", "ord")
