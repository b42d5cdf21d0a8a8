import json

import pytest
from conftest import SENSOR_CSV
from pyspark.sql import functions as F

from tracelake.functions.scalars import value_text
from tracelake.operators import compare as C
from tracelake.operators import inference as I
from tracelake.operators import query as Q
from tracelake.operators.geometry import build_tables
from tracelake.operators.index import index_frame, sort_timeline, with_row_sequence
from tracelake.plans import sinks as K
from tracelake.plans.workflow import import_source
from tracelake.sources import files as S


@pytest.fixture(scope="module")
def sensor(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sensor") / "sprayer.csv"
    path.write_text(SENSOR_CSV)
    return import_source(spark, str(path), "rec", "src")


def test_import_infers_streams(sensor):
    streams = {row.name: row for row in sensor.streams.collect()}
    (group,) = [row for row in streams.values() if row.semantic_type == "scalar_group"]
    assert group.source_fields == ["gyro_x", "gyro_y", "gyro_z"]
    assert streams["system_log"].source_fields == ["severity", "msg"]
    assert streams["mode"].semantic_type == "state" and streams["battery"].semantic_type == "scalar"
    assert sensor.mapping["primary_timeline"] == "t"
    assert sensor.template_id == "sensor_monitor"
    assert sensor.report.first().valid


def test_templates_on_sensor(sensor):
    signals = sensor.signals
    assert Q.low_battery(signals, 0.35).count() == 2
    custom = Q.custom_query(signals, key="battery", operator="lt", value=0.5, semantic_types=["scalar", "scalar_group"])
    assert custom.count() == 3
    held = Q.state_duration(signals).orderBy("time").collect()
    assert [r.state for r in held] == ["IDLE", "IDLE", "SPRAY", "HALT", "IDLE"]
    assert [r.duration for r in held] == [2.0, 3.0, 4.0, 4.0, 0.0]
    found = Q.find_errors(signals).select(value_text().alias("v")).collect()
    assert any("ERROR" in r.v for r in found)


def test_jsonl_import(spark, sensor_jsonl):
    done = import_source(spark, sensor_jsonl, "rec", "src")
    assert done.mapping["primary_timeline"] == "time"
    assert "arm" in {row.name for row in done.streams.collect()}
    assert Q.state_duration(done.signals).filter("key = 'mode'").count() == 3
    errors = Q.run_template(done.signals, "find_errors").select(value_text().alias("v")).collect()
    assert any("ERROR" in r.v for r in errors)


def test_log_import(spark, tmp_path):
    path = tmp_path / "run.log"
    path.write_text("INFO tank filled\nWARN charge low\n\nERROR nozzle blocked\n")
    done = import_source(spark, str(path), "rec", "src")
    assert done.mapping["primary_timeline"] == "line_number"
    rows = Q.find_errors(done.signals).filter("key = 'message'").orderBy("time").collect()
    assert [r.time for r in rows] == [2.0, 2.0, 4.0, 4.0] or [r.time for r in rows] == [2.0, 4.0]


def test_timeline_sort(spark):
    rows = [(1, "2", "later"), (2, None, "empty"), (3, "1", "first"), (4, "bad", "invalid"), (5, "1", "second")]
    df = spark.createDataFrame(rows, "ord bigint, time string, value string")
    mapping = {
        "primary_timeline": "time",
        "timeline_unit": "relative_s",
        "timeline_sort": "ascending",
        "streams": [{"source_fields": ["value"], "semantic_type": "state", "entity_path": "/states/value"}],
    }
    signals = index_frame(df, mapping, "r", "s", "ord")
    ordered = ["first", "second", "later", "empty", "invalid"]
    assert [r.value_str for r in sort_timeline(signals).collect()] == ordered
    for chunks in (1, 3):
        numbered = with_row_sequence(signals, ["recording_id"], "ascending", chunks).orderBy("row").collect()
        assert [r.value_str for r in numbered] == ordered and [r.row for r in numbered] == [0, 1, 2, 3, 4]


def test_value_kinds(spark):
    df = spark.createDataFrame(
        [(0, True, 5, 2**60, 0.5, "x", [1, 2], 1.0), (1, None, None, None, float("nan"), None, None, None)],
        "ord bigint, b boolean, i int, l bigint, d double, s string, a array<int>, t double",
    )
    mapping = {
        "primary_timeline": "t",
        "streams": [
            {"source_fields": ["b", "i", "l", "d", "s", "a", "absent"], "semantic_type": "scalar", "entity_path": "/m"},
            {"source_fields": ["i"], "semantic_type": "scalar", "entity_path": "/off", "enabled": False},
        ],
    }
    rows = index_frame(df, mapping, "r", "s", "ord").select("key", "value_type", value_text().alias("v")).collect()
    assert {(r.key, r.value_type, r.v) for r in rows} == {
        ("b", "bool", "True"),
        ("i", "int", "5"),
        ("l", "int", str(2**60)),
        ("d", "double", "0.5"),
        ("s", "string", "x"),
        ("a", "object", "[1,2]"),
    }


def value_rows(spark):
    rows = [
        ("r", None, "/p", "state", "mode", "string", None, "On 5%_x", 0),
        ("r", 1.0, "/p/A", "scalar", "Volt", "double", 2.5, None, 1),
        ("r", 2.0, "/p", "scalar", "flag", "bool", 1.0, None, 2),
        ("q", 3.0, "/p", "state", "text", "string", None, "3.5", 3),
    ]
    schema = "recording_id string, time double, entity_path string, semantic_type string, key string, value_type string, value_num double, value_str string, ord bigint"
    return spark.createDataFrame(rows, schema).withColumn("source_id", F.lit("s"))


@pytest.mark.parametrize(
    "filters, expected",
    [
        ({}, {0, 1, 2, 3}),
        ({"time_start": 1, "time_end": "2"}, {1, 2}),
        ({"time_end": 9}, {1, 2, 3}),
        ({"entity_path": "/P/a"}, {1}),
        ({"key": "VO"}, {1}),
        ({"text": "5%_x"}, {0}),
        ({"operator": "contains", "value": "ON 5"}, {0}),
        ({"operator": "eq", "value": "2.50"}, {1}),
        ({"operator": "eq", "value": "true"}, {2}),
        ({"operator": "eq", "value": True}, {2}),
        ({"operator": "gt", "value": 1}, {1, 3}),
        ({"operator": "lte", "value": "3.5"}, {1, 3}),
        ({"operator": "gt", "value": "abc"}, set()),
        ({"operator": "gt", "value": ""}, {0, 1, 2, 3}),
        ({"recording_ids": ["q"]}, {3}),
    ],
)
def test_custom_filters(spark, filters, expected):
    assert {r.ord for r in Q.custom_query(value_rows(spark), **filters).collect()} == expected


def test_unknown_names_raise(spark):
    rows = value_rows(spark)
    with pytest.raises(ValueError):
        Q.custom_query(rows, operator="like", value="x")
    with pytest.raises(ValueError):
        Q.run_template(rows, "nothing")
    with pytest.raises(ValueError):
        C.compare(rows, mode="nothing")
    with pytest.raises(ValueError):
        Q.in_order(rows, -1)
    with pytest.raises(ValueError):
        K.export_query(rows, "/nowhere", "xml")


def test_limit_and_order(spark):
    rows = Q.in_order(value_rows(spark), 2).collect()
    assert [r.ord for r in rows] == [3, 0]
    assert Q.in_order(value_rows(spark), 0).count() == 0
    plan = Q.in_order(value_rows(spark), 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("chunks", [1, 6])
def test_state_duration_chunks(spark, chunks):
    rows = [("r", float(i // 2), "/s", "state", "k", "string", None, f"v{i}", i) for i in range(101)]
    schema = "recording_id string, time double, entity_path string, semantic_type string, key string, value_type string, value_num double, value_str string, ord bigint"
    got = Q.state_duration(spark.createDataFrame(rows, schema), chunks).orderBy("ord").collect()
    assert [r.duration for r in got] == [0.0 if i % 2 == 0 else 1.0 for i in range(100)] + [0.0]


def test_compare(spark, sensor):
    summary = {r.key: r for r in C.compare(sensor.signals, ["rec"], ["battery"]).collect()}
    battery = summary["battery"]
    assert battery["count"] == 5 and battery.min == 0.12 and battery.max == 0.81 and battery.latest_num == 0.4
    states = {r.state: r.n for r in C.compare(sensor.signals, mode="states").filter("key = 'mode'").collect()}
    assert states == {"IDLE": 3, "SPRAY": 1, "HALT": 1}


def test_geometry_tables(spark):
    df = spark.createDataFrame(
        [(0, 1.0, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0), (1, 2.0, 1.0, None, 3.0, 0.0, 0.0, 0.0, 1.0)],
        "n bigint, t double, pose_x double, pose_y double, pose_z double, quat_x double, quat_y double, quat_z double, quat_w double",
    )
    pose = ["pose_x", "pose_y", "pose_z"]
    mapping = {
        "primary_timeline": "t",
        "streams": [
            {"source_fields": pose + ["quat_x", "quat_y", "quat_z", "quat_w"], "semantic_type": "transform3d", "entity_path": "/tf"},
            {"source_fields": pose, "semantic_type": "points3d", "entity_path": "/p3"},
            {"source_fields": ["pose_x", "pose_z"], "semantic_type": "scalar_group", "entity_path": "/g"},
        ],
    }
    tables = build_tables(df, mapping, "r", "n")
    moved = tables["geometry"].filter("semantic_type = 'transform3d'").collect()
    assert len(moved) == 1 and moved[0].value == [1.0, 2.0, 3.0] and moved[0].turn == [0.0, 0.0, 0.0, 1.0]
    assert tables["geometry"].filter("semantic_type = 'points3d'").count() == 1
    assert tables["scalars"].count() == 4


def test_sinks(spark, sensor, tmp_path):
    K.write_signals(sensor.signals, str(tmp_path / "signals"))
    K.write_signals(sensor.signals.withColumn("recording_id", F.lit("other")), str(tmp_path / "signals"))
    K.write_signals(sensor.signals.filter("key = 'battery'"), str(tmp_path / "signals"))
    counts = {r.recording_id: r["count"] for r in K.read_signals(spark, str(tmp_path / "signals")).groupBy("recording_id").count().collect()}
    assert counts == {"rec": 5, "other": sensor.signals.count()}
    one = K.read_signals(spark, str(tmp_path / "signals"), ["rec"])
    assert one.count() == 5
    assert len(one.inputFiles()) == 1
    K.export_query(Q.low_battery(sensor.signals, 0.35), str(tmp_path / "out.parquet"), "PARQUET")
    assert spark.read.parquet(str(tmp_path / "out.parquet")).columns == ["recording_id", "time", "entity_path", "key", "value"]
    mapping = sensor.mapping
    tables = build_tables(sensor.frame, mapping, "rec", "_ord")
    K.write_tables(tables, str(tmp_path / "built"))
    states = K.read_table(spark, str(tmp_path / "built"), "states", tables["states"].schema)
    assert sorted(map(str, states.collect())) == sorted(map(str, tables["states"].collect()))


def test_export_of_derived_results(spark, sensor, tmp_path):
    five = ["recording_id", "time", "entity_path", "key", "value"]
    for name in ("find_errors", "low_battery", "detection_failure", "topic_summary", "state_duration", "time_sync"):
        K.export_query(Q.run_template(sensor.signals, name), str(tmp_path / name), "csv")
        assert spark.read.option("header", True).csv(str(tmp_path / name)).columns in (five, [])
    held = Q.result_columns(Q.run_template(sensor.signals, "state_duration")).collect()
    assert [json.loads(r.value) for r in held][2] == {"state": "SPRAY", "duration": 4.0}
    K.export_query(C.compare(sensor.signals, ["rec"], ["battery"]), str(tmp_path / "compared"), "parquet")
    (row,) = spark.read.parquet(str(tmp_path / "compared")).collect()
    assert json.loads(row.value)["max"] == 0.81


def test_many_files(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.csv").write_text("time,v\n0,1\n1,2\n")
    named = S.name_recordings(S.list_files(spark, str(tmp_path / "*.csv")), "batch")
    frame = S.read_csv(spark, str(tmp_path / "*.csv"))
    key = F.regexp_replace(F.col("_file"), "^file:/+", "/")
    joined = frame.withColumn("path", key).join(
        named.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "recording_id"), "path"
    )
    mapping = {"primary_timeline": "time", "streams": [{"source_fields": ["v"], "semantic_type": "scalar", "entity_path": "/m"}]}
    signals = index_frame(joined, mapping, F.col("recording_id"), "s", "_ord")
    assert {r.recording_id: r["count"] for r in signals.groupBy("recording_id").count().collect()} == {"batch_001": 2, "batch_002": 2}


def test_template_scores(spark):
    rows = [("cv", "image", "image", None), ("cv", "boxes2d", "pred", None), ("cv", "scalar", "pred_scores", None), ("bag", "mcap", None, "cdr"), ("bag", "points3d", None, "cdr"), ("bag", "transform3d", None, "cdr")]
    df = spark.createDataFrame(rows, "source_id string, semantic_type string, role string, message_encoding string")
    best = {r.source_id: (r.template_id, r.score) for r in I.template_scores(df).filter("rank = 1").collect()}
    assert best == {"cv": ("cv_detection", 1.0), "bag": ("robotics_debug", 1.0)}
    assert {r.source_id: r.template_id for r in I.pick_template(df).collect()} == {"cv": "cv_detection", "bag": "robotics_debug"}
