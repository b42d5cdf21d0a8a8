import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tracelake.operators import quality as Q
from tracelake.operators import topics as T
from tracelake.plans import diagnostics as D
from tracelake.plans.workflow import import_source
from tracelake.schema import FINDING_EXPORT_COLUMNS, SIGNAL_SCHEMA

TOPIC_ROW = "recording_id string, source_id string, topic string, role string, message_count bigint, start_time double, end_time double"


def recordings(spark, *sources):
    return spark.createDataFrame([(f"rec{i or ''}", s) for i, s in enumerate(sources or ("source",))], "recording_id string, source_id string")


def signal(time, key, value, kind="scalar", path=None, i=0):
    path = path or f"/metrics/{key}"
    number = float(value) if not isinstance(value, str) else None
    return ("rec", "source", time, path, kind, key, "string" if number is None else "double", number, value if number is None else None, i)


def topics(spark, *rows):
    df = spark.createDataFrame([("rec", "source", *row) for row in rows], TOPIC_ROW)
    return T.topics_of(T.topic_signals(df.withColumn("schema_name", F.lit("")).withColumn("message_encoding", F.lit("cdr"))))


def test_score_and_severity(spark):
    signals = spark.createDataFrame(
        [signal(1.0, "message", "ERROR motor fault", "text_log", "/logs/diagnostics"), signal(2.0, "battery", 0.1)], SIGNAL_SCHEMA
    )
    inputs = D.Inputs(
        recordings(spark), signals, topics(spark, ("/odom", "trajectory", 1, None, None), ("/camera/image", "camera_image", 1, None, None))
    )
    report = D.diagnose(inputs)
    summary = report.summary.first()
    assert summary.health_score == 50 and summary.severity == "critical" and summary.finding_count == 3
    assert summary.topic_count == 2 and summary.recording_count == 1
    found = report.findings.orderBy("id").collect()
    assert [f.id for f in found] == ["diag_0001", "diag_0002", "diag_0003"]
    assert [f.category for f in found] == ["topic_coverage", "logs_and_states", "battery"]
    checks = {c.id: c for c in report.checks.collect()}
    assert len(checks) == 10 and checks["battery"].status == "warn" and checks["battery"].score == 90
    assert checks["logs_and_states"].status == "fail" and checks["time_sync"].status == "pass"
    context = report.context.first()
    assert context.role_counts["trajectory"] == 1 and context.role_counts["imu"] == 0


def test_topic_coverage(spark):
    report = D.diagnose(D.Inputs(recordings(spark), topics=topics(spark, ("/odom", "trajectory", 10, None, None))))
    assert report.summary.first().severity == "warning"
    assert any("TF" in r.message for r in report.findings.collect())


def test_bags(spark):
    sources = spark.createDataFrame(
        [("source_ros", "ros2_db3", 1, 1, 0), ("source_empty", "mcap", 0, 0, 0), ("other", "mcap", 0, 0, 0)],
        "source_id string, source_type string, topic_count bigint, message_count bigint, convertible_topic_count bigint",
    )
    skipped = spark.createDataFrame(
        [("source_ros", "/custom", "acme/msg/X", "missing definition")] * 2, "source_id string, topic string, message_type string, skip_reason string"
    )
    inputs = D.Inputs(recordings(spark, "source_ros", "source_empty"), sources=sources, skipped_topics=skipped)
    found = {(f.category, f.severity, f.source_id) for f in D.diagnose(inputs).findings.collect()}
    assert found == {
        ("convertibility", "critical", "source_ros"),
        ("convertibility", "warning", "source_ros"),
        ("message_volume", "critical", "source_empty"),
    }


def test_no_recordings(spark):
    empty = recordings(spark).filter("false")
    (finding,) = D.diagnose(D.Inputs(empty)).findings.collect()
    assert finding.severity == "critical" and finding.category == "message_volume"


def test_drift(spark):
    base = 1.7e18
    table = topics(
        spark,
        ("/camera/image", "camera_image", 1, base + 250_000_000, base + 250_001_000),
        ("/a_tf", "tf_tree", 1, base, base + 1_000),
        ("/z_late", "imu", 1, base + 2e9, base + 2e9),
        ("/none", "imu", 1, None, None),
    )
    found = D.drift_findings(table, D.PRESETS["balanced"]).collect()
    assert {(f.topic, f.severity) for f in found} == {("/camera/image", "warning"), ("/z_late", "critical")}
    assert json.loads(found[0].evidence)["base_topic"] == "/a_tf"
    assert D.drift_findings(table, D.resolve_thresholds("lenient")).count() == 2
    deltas = {r.topic: round(r.start_delta / 1e6) for r in T.time_sync_topics(table).collect()}
    assert deltas == {"/camera/image": 250, "/z_late": 2000}
    untimed = topics(spark, ("/a", "imu", 1, None, None), ("/b", "imu", 1, None, 5.0))
    assert {r.reason for r in T.time_sync_topics(untimed).collect()} == {"missing_topic_time_range"}


def test_general_health(spark):
    rows = [signal(t, "voltage", v) for t, v in ((1.0, 12.0), (1.0, 12.1), (2.0, 12.2), (3.0, 12.3), (40.0, 30.0), (41.0, 12.4))]
    rows += [signal(t, "mode", "idle", "state") for t in (1.0, 2.0, 3.0)]
    profiles = spark.createDataFrame(
        [("source", "temperature", "double", 6, 4, 0.6, 2), ("source", "empty_signal", "double", 6, 6, 1.0, 0)],
        "source_id string, field string, dtype string, row_count bigint, null_count bigint, null_ratio double, non_null_count bigint",
    )
    timelines = spark.createDataFrame(
        [("source", "timestamp", True, 0.5, False, True, "csv", "mixed"), ("bare", None, False, 0.0, None, False, "csv", None)],
        "source_id string, time_key string, present boolean, parse_ratio double, monotonic boolean, mixed_units boolean, source_type string, inferred_unit string",
    )
    inputs = D.Inputs(recordings(spark), spark.createDataFrame(rows, SIGNAL_SCHEMA), profiles=profiles, timelines=timelines)
    report = D.diagnose(inputs, thresholds={"time_parse_ratio_warn": 0.9, "unknown": 1, "battery_low": "x"})
    found = report.findings.collect()
    messages = {(f.severity, f.message) for f in found}
    assert ("critical", "Field temperature has a high missing-value ratio.") in messages
    assert ("warning", "Field empty_signal has no non-empty sampled values.") in messages
    assert ("warning", "No usable timeline field was detected.") in messages
    assert ("warning", "No fields were available in the schema profile.") in messages
    assert any("mix" in m for _, m in messages) and any("parse ratio" in m for _, m in messages)
    assert any("Duplicate timestamps" in m for _, m in messages)
    assert any("outlier" in m for _, m in messages) and any("not monotonic" in m for _, m in messages)
    assert ("info", "State field mode never changes in indexed rows.") in messages
    assert report.thresholds["time_parse_ratio_warn"] == 0.9 and report.thresholds["battery_low"] == 0.2
    assert D.categories(report.findings).count() == 3
    assert D.filter_findings(report.findings, "info").count() == 1
    assert D.filter_findings(report.findings, "all", "data_quality", " VOLT").count() == 1


def test_health_of_a_csv(spark, tmp_path):
    path = tmp_path / "quality.csv"
    path.write_text(
        "timestamp,temperature,voltage,state,message\n0.0,20.0,12.0,IDLE,boot\n0.1,,12.1,IDLE,ok\n0.1,,12.2,IDLE,duplicate time\n"
        "0.2,,12.3,IDLE,ok\n8.0,,55.0,IDLE,spike\n8.1,,12.4,IDLE,ok\n"
    )
    done = import_source(spark, str(path), "rec", "source")
    from tracelake.operators.profile import timeline_profiles

    timelines = timeline_profiles(done.profiles, spark.createDataFrame([("source", "timestamp")], "source_id string, time_key string"))
    inputs = D.Inputs(recordings(spark), done.signals, profiles=done.profiles, timelines=timelines.withColumn("source_type", F.lit("csv")))
    report = D.diagnose(inputs)
    categories = {f.category for f in report.findings.collect()}
    assert {"schema_quality", "time_series_quality", "data_quality"} <= categories
    assert report.summary.first().topic_count == 0
    D.write_report(report, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json/checks")).count() == 10
    D.write_report(report, str(tmp_path / "csv"), "csv")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == FINDING_EXPORT_COLUMNS and all(json.loads(r.evidence) is not None for r in back.collect())
    with pytest.raises(ValueError):
        D.write_report(report, str(tmp_path / "x"), "xml")
    with pytest.raises(ValueError):
        D.resolve_thresholds("harsh")


def test_limits(spark):
    rows = [signal(float(i), "message", f"error {i}", "text_log", "/logs/m", i) for i in range(30)]
    inputs = D.Inputs(recordings(spark), spark.createDataFrame(rows, SIGNAL_SCHEMA))
    report = D.diagnose(inputs, limit=2)
    assert report.findings.count() == 2 and report.summary.first().finding_count == 30
    assert [json.loads(r.evidence)["time"] for r in report.findings.orderBy("id").collect()] == [0.0, 1.0]
    assert D.diagnose(inputs).findings.count() == 30
    numbered = D.with_finding_ids(D.all_findings(inputs, D.PRESETS["balanced"]), chunks=5)
    assert {r.id for r in numbered.collect()} == {f"diag_{i:04d}" for i in range(1, 31)}


def model_outliers(values, multiplier):
    ordered = sorted(values)
    if len(ordered) < 4:
        return 0
    q1 = statistics.median(ordered[: len(ordered) // 2])
    q3 = statistics.median(ordered[(len(ordered) + 1) // 2 :])
    if q3 <= q1:
        return 0
    low, high = q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)
    return sum(1 for v in ordered if v < low or v > high)


@pytest.mark.parametrize("chunks", [None, 9])
def test_quality_against_model(spark, chunks):
    draw = random.Random(11)
    rows, values, times = [], {}, {}
    for i in range(2500):
        # one signal holds most rows
        key = "hot" if draw.random() < 0.6 else f"k{draw.randrange(30)}"
        value = float(draw.choice([1, 2, 2, 3, 50])) if key == "hot" else round(draw.gauss(0, 5), 1)
        time = float(draw.randrange(900))
        values.setdefault(key, []).append(value)
        times.setdefault(key, []).append(time)
        rows.append(signal(time, key, value, i=i))
    df = spark.createDataFrame(rows, SIGNAL_SCHEMA)
    found = {r.key: r.outlier_count for r in Q.iqr_outliers(df, 1.5, chunks).collect()}
    assert found == {k: n for k, v in values.items() if (n := model_outliers(v, 1.5))}
    gaps = {r.entity_path: r for r in Q.gap_statistics(df, chunks).collect()}
    for key, stamps in times.items():
        ordered = sorted(stamps)
        steps = [b - a for a, b in zip(ordered, ordered[1:]) if b > a]
        if len(steps) >= 3:
            row = gaps[f"/metrics/{key}"]
            assert (row.gap_count, row.typical_gap_s, row.max_gap_s) == (len(steps), statistics.median(steps), max(steps))
    repeats = {r.entity_path: r.duplicate_count for r in Q.duplicate_timestamps(df).collect()}
    assert repeats == {f"/metrics/{k}": len(v) - len(set(v)) for k, v in times.items() if len(v) >= 3 and len(v) > len(set(v))}


def test_monotonic_across_chunks(spark):
    from tracelake.operators.profile import field_profiles

    step = 1 << 20
    ords = [0, 1, step, step + 1, 3 * step]
    rows = [(o, float(i), float(i if i != 2 else 0.5), None if i == 4 else 1.0) for i, o in enumerate(ords)]
    df = spark.createDataFrame(rows, "o bigint, up double, falls double, flat double")
    flags = {r.field: r.time_monotonic for r in field_profiles(df, "s", "o").collect()}
    assert flags == {"up": True, "falls": False, "flat": True}
