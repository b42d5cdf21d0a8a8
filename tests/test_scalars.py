from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tracelake.functions import scalars as S


def evaluate(spark, column_of, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[0] for row in df.orderBy("i").select(column_of(F.col("v"))).collect()]


def at(*parts):
    return datetime(*parts, tzinfo=timezone.utc).timestamp()


def test_numeric_clocks(spark):
    """One instant in four units, a small count, and numbers that are none."""
    second = at(2019, 7, 23, 16, 20, 9)
    scales = {"unix_s": 1.0, "unix_ms": 1e3, "unix_us": 1e6, "unix_ns": 1e9}
    values = [second * scale for scale in scales.values()] + [12.5, float("nan"), float("-inf")]
    seconds = evaluate(spark, lambda v: S.normalize_time(v, "auto", "double"), values, "double")
    assert seconds == [second] * 4 + [12.5, None, None]
    units = evaluate(spark, lambda v: S.time_unit(v, "auto", "double"), values, "double")
    assert units == [*scales, "seconds", None, None]
    assert evaluate(spark, lambda v: S.time_unit(v, "seconds", "double"), [41.0], "double") == ["relative_s"]
    # beyond the calendar there is no time
    assert evaluate(spark, lambda v: S.normalize_time(v, "unix_s", "double"), [4e11], "double") == [None]


def test_text_clocks(spark):
    base, day = at(2019, 7, 23, 16, 20, 9), at(2019, 7, 23)
    expected = {
        "1563898809500": 1563898809.5,
        "20190723": 20190723.0,
        "2019-07-23T16:20:09Z": base,
        "2019-07-23 16:20:09.75": base + 0.75,
        "2019-07-23T16:20:09-03:30": base + 12600,
        "2019/07/23 16:20:09": base,
        "07/23/2019": day,
        "2019-07-23": day,
        "yesterday": None,
        "2019-02-31": None,
        "": None,
        " 33 ": 33.0,
        "33s": None,
    }
    assert evaluate(spark, lambda v: S.normalize_time(v), [*expected, None]) == [*expected.values(), None]
    assert evaluate(spark, lambda v: S.query_time(v, F.lit(4)), ["yesterday"]) == [4.0]
    assert evaluate(spark, lambda v: S.normalize_time(v, "datetime"), ["20190723", "5"]) == [day, None]


def test_clocks_that_differ_by_row(spark):
    """Unit and type as columns give what the same unit and type give as constants."""
    cells = [("1563898809500", "unix_ms", "bigint"), ("7.5", "auto", "double"), ("2019-07-23", "auto", "string"), ("20190723", "datetime", "string")]
    cells += [("20190723", "datetime", "bigint"), ("9", "relative_s", "string"), (None, "auto", "bigint"), ("x", "unix_s", "string")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "i int, v string, unit string, dtype string")
    by_row = df.orderBy("i").select(S.normalize_time_by(F.col("v"), F.col("unit"), F.col("dtype"))).collect()
    alone = [
        evaluate(spark, lambda v, u=unit, d=dtype: S.normalize_time(v if d == "string" else v.try_cast(d), u, d), [text])[0]
        for text, unit, dtype in cells
    ]
    assert [r[0] for r in by_row] == alone and alone[0] == 1563898809.5


def test_bad_unit_raises():
    with pytest.raises(ValueError):
        S.normalize_time(F.lit(1), "hours")


def test_report_clocks(spark):
    values = [1_563_898_809.0 * scale for scale in (1e9, 1e6, 1e3, 1)]
    assert evaluate(spark, S.clock_seconds, values, "double") == [1_563_898_809.0] * 4


def test_names(spark):
    assert evaluate(spark, S.safe_slug, [" /Battery Level/ ", "###", "a__B"]) == ["battery_level", "stream", "a__b"]
    assert evaluate(spark, S.safe_output_name, ["run é/1 x"]) == ["run_é_1_x"]
    assert evaluate(spark, S.normalized_name, ["Battery-Voltage_2"]) == ["batteryvoltage2"]
    assert evaluate(spark, S.axis, ["pos.x", "x", "max", "pose_yaw", "box-width"]) == ["x", "x", None, "yaw", "width"]
    roles = evaluate(spark, S.field_role, ["pose_x", "quat_w", "box.width", "qz", "a/height", "rot.quat.yaw", "xmin"])
    assert roles == ["x", "qw", "w", "qz", "h", "qw", "xmin"]


def test_paths(spark):
    paths = ["/a/b", "/a//b", "a/b", "", "/", "/a b", "/a/"]
    assert evaluate(spark, S.valid_entity_path, paths) == [True, False, False, False, True, False, True]
    mended = evaluate(spark, lambda v: S.sanitized_entity_path(v, F.lit("scalar"), F.lit("My Name")), ["a b//c", "", None])
    assert mended == ["/a_b/c", "/metrics/my_name", "/metrics/my_name"]
    assert evaluate(spark, S.topic_entity_path, ["/a/b/", "/", None]) == ["/topics/a_b", "/topics/topic", "/topics/topic"]


def test_topic_families(spark):
    cases = [
        # message types of the robot middleware, on topics of a sprayer
        ("/boom/left/image", "sensor_msgs/msg/Image", "camera_image", "image"),
        ("/field/points", "sensor_msgs/msg/PointCloud2", "point_cloud", "points3d"),
        ("/tf", "tf2_msgs/msg/TFMessage", "tf_tree", "transform3d"),
        ("/tractor/odom", "nav_msgs/msg/Odometry", "trajectory", "trajectory3d"),
        ("/cab/imu", "sensor_msgs/msg/Imu", "imu", "scalar_group"),
        ("/hedge/scan", "sensor_msgs/msg/LaserScan", "laser_scan", "points2d"),
        ("/boom/joint_states", "sensor_msgs/msg/JointState", "joint_state", "scalar_group"),
        ("/pump/diagnostics", "diagnostic_msgs/msg/DiagnosticArray", "diagnostics", "text_log"),
        ("/robot_description", "std_msgs/msg/String", "robot_model", "asset3d"),
        ("/tank/level", "farm/msg/Tank", "raw_topic", "mcap"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, s string")
    got = df.select(S.classify_topic(F.col("t"), F.col("s")).alias("c")).select("c.*").collect()
    assert [(r.role, r.semantic_type) for r in got] == [c[2:] for c in cases]
    assert all(r.confidence > 0.5 for r in got)


def test_cloud_time(spark):
    df = spark.createDataFrame([("1563898809250",), ("1563898809250000000",), ("88",), ("sweep",)], "v string")
    got = [r[0] for r in df.select(S.cloud_time(F.col("v"), F.lit(6))).collect()]
    assert got == pytest.approx([1563898809.25, 1563898809.25, 88.0, 6.0], abs=1e-5)


def test_values(spark):
    rows = [("bool", 1.0, None), ("int", 5.0, None), ("double", 0.5, None), ("string", None, '7"x'), ("string", None, "2.5"), ("object", None, '{"a":1}')]
    df = spark.createDataFrame(rows, "value_type string, value_num double, value_str string")
    got = df.select(S.value_text(), S.value_json(), S.filter_float(), S.float_or_none()).collect()
    assert [r[0] for r in got] == ["True", "5", "0.5", '7"x', "2.5", '{"a":1}']
    assert [r[1] for r in got] == ["true", "5", "0.5", '"7\\"x"', '"2.5"', '{"a":1}']
    assert [r[2] for r in got] == [None, 5.0, 0.5, None, 2.5, None]
    assert [r[3] for r in got] == [None, 5.0, 0.5, None, None, None]


def test_effective_unit(spark):
    # configured, inferred, that of the first cell
    rows = [("unix_ms", "unix_ns", "unix_us"), ("auto", "unix_ns", "unix_s"), ("auto", "mixed", "unix_us"), ("seconds", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "c string, i string, f string")
    got = [r[0] for r in df.select(S.effective_unit(F.col("c"), F.col("i"), F.col("f"))).collect()]
    assert got == ["unix_ms", "unix_ns", "unix_us", "relative_s", "auto"]
