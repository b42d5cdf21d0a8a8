"""Image frames with their annotations and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators.ordered import with_rank
from tracelake.schema import SIGNAL_COLUMNS

KEYS = ["recording_id", "path"]


def _last_frame(frames: DataFrame, name: str) -> DataFrame:
    """One frame per image: the last one in its side file."""
    fields = F.struct("time", "boxes", "keypoints", "masks")
    return frames.groupBy(*KEYS).agg(F.max_by(fields, "frame_index").alias(name))


def join_frames(
    images: DataFrame, annotations: DataFrame | None, predictions: DataFrame | None, chunks: int | None = None
) -> DataFrame:
    """Images ``(recording_id, source_id, path)`` with their annotation and prediction frames.

    ``ord`` is the place of an image in path order and its time where no frame names one.
    """
    frames = with_rank(images, ["recording_id"], ["path"], "ord", chunks).withColumn("ord", F.col("ord") - 1)
    kind = (
        "struct<time: double, boxes: array<struct<bbox: array<double>, class_id: int, label: string, score: double>>, "
        "keypoints: array<struct<points: array<array<double>>, class_id: int, label: string, score: double>>, "
        "masks: array<struct<path: string, class_id: int, label: string, score: double>>>"
    )
    for name, side in (("gt", annotations), ("pred", predictions)):
        if side is None:
            frames = frames.withColumn(name, F.lit(None).cast(kind))
        else:
            frames = frames.join(_last_frame(side, name), KEYS, "left")
    return frames.withColumn("time", F.coalesce("gt.time", "pred.time", F.col("ord").cast("double")))


def _size(items: str) -> Column:
    return F.greatest(F.coalesce(F.size(items), F.lit(0)), F.lit(0))


def _point_count(items: str) -> Column:
    sizes = F.transform(items, lambda item: F.greatest(F.size(item["points"]), F.lit(0)))
    return F.coalesce(F.aggregate(sizes, F.lit(0), lambda total, n: total + n), F.lit(0))


def frame_scores(side: str = "pred") -> Column:
    """All scores of a frame: boxes, keypoints and masks."""
    parts = [
        F.coalesce(F.transform(f"{side}.{items}", lambda item: item["score"]), F.array().cast("array<double>"))
        for items in ("boxes", "keypoints", "masks")
    ]
    return F.filter(F.concat(*parts), lambda score: score.isNotNull())


def frame_counts(frames: DataFrame) -> DataFrame:
    """Counts and scores per image."""
    counted = frames.select(
        "recording_id",
        "source_id",
        "path",
        "ord",
        "time",
        _size("gt.boxes").alias("gt_box_count"),
        _size("pred.boxes").alias("pred_box_count"),
        _point_count("gt.keypoints").alias("gt_keypoint_count"),
        _point_count("pred.keypoints").alias("pred_keypoint_count"),
        _size("gt.masks").alias("gt_mask_count"),
        _size("pred.masks").alias("pred_mask_count"),
        frame_scores().alias("_scores"),
        F.filter(F.transform("pred.boxes", lambda box: box["label"]), lambda label: label != "").alias("labels"),
    )
    total = F.aggregate("_scores", F.lit(0.0), lambda acc, score: acc + score)
    some = F.size("_scores") > 0
    return counted.withColumn("score_min", F.array_min("_scores")).withColumn(
        "score_mean", F.when(some, total / F.size("_scores"))
    ).drop("_scores")


# fixed values: (path, semantic type, key) of the counted signals
_COUNT_SIGNALS = (
    ("/camera/gt/boxes", "boxes2d", "gt_box_count"),
    ("/camera/pred/boxes", "boxes2d", "pred_box_count"),
    ("/camera/gt/keypoints", "points2d", "gt_keypoint_count"),
    ("/camera/pred/keypoints", "points2d", "pred_keypoint_count"),
    ("/camera/gt/masks", "segmentation", "gt_mask_count"),
    ("/camera/pred/masks", "segmentation", "pred_mask_count"),
)


def frame_signals(counts: DataFrame) -> DataFrame:
    """Signal rows of frames: the image, six counts, and scores and labels where there are any."""

    def cell(path: str, kind: str, key: str, value_type: str, number: Column | None, text: Column | None) -> Column:
        return F.struct(
            F.lit(path).alias("entity_path"),
            F.lit(kind).alias("semantic_type"),
            F.lit(key).alias("key"),
            F.lit(value_type).alias("value_type"),
            (F.lit(None) if number is None else number).cast("double").alias("value_num"),
            (F.lit(None) if text is None else text).cast("string").alias("value_str"),
        )

    labels = F.when(F.size("labels") > 0, F.to_json("labels"))
    cells = [cell("/camera/image", "image", "image", "string", None, F.col("path"))]
    cells += [cell(path, kind, key, "int", F.col(key), None) for path, kind, key in _COUNT_SIGNALS]
    cells += [
        cell("/camera/pred/scores", "scalar", key, "double", F.col(key), None) for key in ("score_min", "score_mean")
    ]
    cells.append(cell("/camera/pred/boxes", "boxes2d", "labels", "object", None, labels))
    melted = counts.select("recording_id", "source_id", "time", "ord", F.explode(F.array(*cells)).alias("_c")).select(
        "recording_id", "source_id", "time", "ord", "_c.*"
    )
    present = F.col("value_num").isNotNull() | F.col("value_str").isNotNull()
    return melted.filter(present).select(*SIGNAL_COLUMNS)


def frame_totals(frames: DataFrame) -> DataFrame:
    """Totals per recording."""
    return frames.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("image_count"),
        F.count("gt").alias("annotation_frame_count"),
        F.count("pred").alias("prediction_frame_count"),
        F.sum(_point_count("gt.keypoints")).alias("annotation_keypoint_count"),
        F.sum(_point_count("pred.keypoints")).alias("prediction_keypoint_count"),
        F.sum(_size("gt.masks")).alias("annotation_mask_count"),
        F.sum(_size("pred.masks")).alias("prediction_mask_count"),
    )


def merge_classes(annotations: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per class id; the last definition wins, predictions after annotations."""
    both = annotations.withColumn("_side", F.lit(0)).unionByName(predictions.withColumn("_side", F.lit(1)))
    last = F.max_by(F.struct("label", "color"), F.struct("_side", "file", "class_index"))
    return both.groupBy("id").agg(last.alias("_c")).select("id", "_c.*").orderBy("id")
