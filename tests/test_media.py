import json

import pytest
from pyspark.sql import functions as F

from tracelake.functions.scalars import value_text
from tracelake.operators import clouds as C
from tracelake.operators import frames as R
from tracelake.operators.query import detection_failure
from tracelake.sources import points as P
from tracelake.sources import sidecars as S

CLASSES = [{"id": 1, "label": "apple", "color": [30, 160, 40]}]


def frame(i, score=None, **more):
    box = {"bbox": [5, 7, 64, 48], "class_id": 1, "label": "apple"}
    if score is not None:
        box["score"] = score
    return {"image": f"{i:06d}.png", "time": float(i - 1), "boxes": [box], **more}


@pytest.fixture
def dataset(tmp_path):
    for i in (1, 2, 3):
        (tmp_path / f"{i:06d}.png").write_bytes(b"\x89PNG")
    (tmp_path / "annotations.json").write_text(json.dumps({"classes": CLASSES, "frames": [frame(1), frame(2)]}))
    keypoints = [{"points": [[9, 6], [2, 11]], "class_id": 1, "label": "stalk", "score": 0.65}]
    masks = [{"path": "crown.png", "class_id": 1}]
    predictions = [frame(1, 0.875), frame(2, 0.875), frame(2, 0.375, keypoints=keypoints, masks=masks)]
    (tmp_path / "predictions.json").write_text(
        json.dumps({"classes": [{"id": 1, "label": "ripe apple"}, {"id": 2, "label": "leaf"}], "frames": predictions})
    )
    return tmp_path


def load(spark, root):
    images = S.list_images(spark, str(root))
    path = F.element_at(F.split("path", "/"), -1).alias("path")
    images = images.select(F.lit("rec").alias("recording_id"), F.lit("src").alias("source_id"), path)
    sides = {}
    for name in ("annotations", "predictions"):
        sides[name] = S.read_sidecars(spark, str(root / f"{name}.json"))
    frames = {
        name: side["frames"].withColumn("recording_id", F.lit("rec")).withColumnRenamed("image", "path")
        for name, side in sides.items()
    }
    return R.join_frames(images, frames["annotations"], frames["predictions"]), sides


def test_frames(spark, dataset):
    frames, sides = load(spark, dataset)
    counts = {r.path: r for r in R.frame_counts(frames).collect()}
    assert counts["000001.png"].gt_box_count == 1 and counts["000001.png"].score_min == 0.875
    # the last frame of a side file wins
    second = counts["000002.png"]
    assert second.pred_keypoint_count == 2 and second.pred_mask_count == 1
    assert second.score_min == 0.375 and abs(second.score_mean - (0.375 + 0.65) / 2) < 1e-12
    third = counts["000003.png"]
    assert third.pred_box_count == 0 and third.score_min is None and third.time == 2.0
    signals = R.frame_signals(R.frame_counts(frames))
    per_image = {r.ord: r["count"] for r in signals.groupBy("ord").count().collect()}
    assert per_image == {0: 10, 1: 10, 2: 7}
    labels = signals.filter("key = 'labels'").select(value_text()).first()[0]
    assert labels == '["apple"]'
    failed = {(r.ord, r.reason, r.key) for r in detection_failure(signals, 0.5).collect()}
    assert failed == {(1, "low_score", "score_min"), (2, "no_prediction", "pred_box_count")}
    totals = R.frame_totals(frames).first()
    assert (totals.image_count, totals.annotation_frame_count, totals.prediction_keypoint_count) == (3, 2, 2)
    classes = R.merge_classes(sides["annotations"]["classes"], sides["predictions"]["classes"]).collect()
    assert [(c.id, c.label) for c in classes] == [(1, "ripe apple"), (2, "leaf")]


def test_bad_sidecars(spark, tmp_path):
    broken = [
        {"image": "", "boxes": []},
        {"image": "a.png", "boxes": [{"bbox": [1, 2, 3]}]},
        {"image": "b.png", "keypoints": [{"points": [[1]]}]},
        {"image": "c.png", "masks": [{"path": ""}]},
        {"image": "d.png"},
    ]
    classes = [{"id": 1, "color": [1, 2]}, {"label": "x"}, {"id": 2, "color": [0, 0, 300]}, {"id": 3}]
    (tmp_path / "annotations.json").write_text(json.dumps({"classes": classes, "frames": broken}))
    (tmp_path / "empty.json").write_text(json.dumps({"classes": []}))
    (tmp_path / "invalid.json").write_text('{"frames": [')
    side = S.read_sidecars(spark, [str(tmp_path / name) for name in ("annotations.json", "empty.json", "invalid.json")])
    assert [r.image for r in side["frames"].collect()] == ["d.png"]
    assert [r.id for r in side["classes"].collect()] == [3]
    problems = [r.problem for r in side["rejects"].collect()]
    assert len(problems) == 9 and "invalid document" in problems and "frames array is missing" in problems


def test_keypoint_templates(spark, tmp_path):
    points = [{"x": 3, "y": 8, "type": "tip"}, {"x": 5, "y": 9, "type": "tip"}, {"x": 70, "y": 21, "type": "root"}, {"x": None, "y": 1}]
    (tmp_path / "leaf_7_template.json").write_text(json.dumps({"image_path": "leaf_7.png", "points": points}))
    (tmp_path / "leaf_8_template.json").write_text(json.dumps({"points": [{"x": 6, "y": 2, "label": "root"}, {"x": 8, "y": 4}]}))
    rows = {r.image.rsplit("/", 1)[-1]: r.keypoints for r in S.read_keypoint_templates(spark, str(tmp_path)).collect()}
    first = {k.label: (k.class_id, [list(p) for p in k.points]) for k in rows["leaf_7.png"]}
    # classes are numbered by label over all templates
    assert {label: points for label, (_, points) in first.items()} == {"tip": [[3.0, 8.0], [5.0, 9.0]], "root": [[70.0, 21.0]]}
    ids = {k.label: k.class_id for row in rows.values() for k in row}
    assert sorted(ids.values()) == [1, 2, 3] and set(ids) == {"tip", "root", "point"}


def test_text_points(spark, tmp_path):
    (tmp_path / "tree.xyz").write_text("# scan of a row\n2.5 0 7 10 20 30\n1 nan 2\n6,5,4,1,2,3\nno numbers here\n")
    (tmp_path / "tree.pts").write_text("3\n9 8 7 1\n6 5 4 2\n1 -inf 2\n")
    (tmp_path / "tree.asc").write_text("; two points\n-5 -6 -7\n0.5 1.5 2.5 bark\n")
    (tmp_path / "full.xyzrgb").write_text("1 1 2 9 0 7\nnot a row\n4 4 5 -8 12 300.25\n")
    (tmp_path / "mixed.xyzrgb").write_text("1 1 2 9 0 7\n4 4 5\n")
    points = P.read_points(spark, str(tmp_path)).withColumn("name", F.element_at(F.split("file", "/"), -1))
    got = {}
    for r in points.orderBy("name", "line_number").collect():
        got.setdefault(r.name, []).append(((r.x, r.y, r.z), r.color))
    assert [p for p, _ in got["tree.xyz"]] == [(2.5, 0, 7), (6, 5, 4)]
    assert [p for p, _ in got["tree.pts"]] == [(9, 8, 7), (6, 5, 4)]
    assert [p for p, _ in got["tree.asc"]] == [(-5, -6, -7), (0.5, 1.5, 2.5)]
    assert [c for _, c in got["full.xyzrgb"]] == [[9, 0, 7], [0, 12, 255]]
    assert [c for _, c in got["mixed.xyzrgb"]] == [None, None]
    assert all(c is None for _, c in got["tree.xyz"])
    stats = {r.file.rsplit("/", 1)[1]: r for r in C.point_stats(points).collect()}
    assert stats["tree.xyz"].point_count == 2 and stats["tree.xyz"].min_x == 2.5 and stats["tree.xyz"].max_z == 7


def test_cloud_signals(spark):
    files = spark.createDataFrame([("d/1780166165355.ply",), ("d/1780166166355.ply",), ("d/zero.ply",)], "file string")
    points = spark.createDataFrame(
        [("d/1780166165355.ply", 0.0, 0.0, 0.0), ("d/1780166166355.ply", 1.0, 1.0, 1.0), ("d/1780166166355.ply", float("nan"), 1.0, 1.0)],
        "file string, x double, y double, z double",
    )
    timed = C.with_cloud_times(C.point_stats(points, files))
    assert [(r.time, r.point_count) for r in timed.orderBy("ord").collect()] == [(1780166165.355, 1), (1780166166.355, 1), (2.0, 0)]
    signals = C.cloud_signals(timed, "r", "s")
    assert signals.count() == 9 and signals.filter("key = 'format' and value_str = 'ply'").count() == 3
    totals = C.cloud_totals(timed).first()
    assert totals.point_cloud_count == 3 and totals.point_count_min == 0 and totals.start_time == 2.0
