"""Image listings and annotation side files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.ordered import with_rank
from tracelake.schema import IMAGE_SUFFIXES
from tracelake.sources.files import suffix_of

FRAME_STRUCT = (
    "struct<image: string, time: double, "
    "boxes: array<struct<bbox: array<double>, class_id: int, label: string, score: double>>, "
    "keypoints: array<struct<points: array<array<double>>, class_id: int, label: string, score: double>>, "
    "masks: array<struct<path: string, class_id: int, label: string, score: double>>>"
)
SIDECAR_SCHEMA = (
    "classes array<struct<id: int, label: string, color: array<int>>>, "
    f"frames array<{FRAME_STRUCT}>, _corrupt string"
)
TEMPLATE_SCHEMA = (
    "image_path string, image string, points array<struct<x: double, y: double, type: string, label: string>>"
)


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size)`` of the images below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.filter(suffix_of(F.col("path")).isin(*IMAGE_SUFFIXES)).select("path", F.col("length").alias("size"))


def _all(items: Column, test) -> Column:
    """True where every item passes; a missing list passes."""
    return F.coalesce(F.forall(items, lambda item: F.coalesce(test(item), F.lit(False))), F.lit(True))


def frame_problem() -> Column:
    """What is wrong with a frame row, null if nothing is."""
    boxes = _all(F.col("boxes"), lambda box: (F.size(box["bbox"]) == 4) & ~F.exists(box["bbox"], lambda v: v.isNull()))
    points = _all(
        F.col("keypoints"),
        lambda item: (F.size(item["points"]) > 0)
        & F.forall(item["points"], lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull()),
    )
    masks = _all(F.col("masks"), lambda mask: F.length(mask["path"]) > 0)
    return (
        F.when(F.coalesce(F.col("image"), F.lit("")) == "", "image is missing")
        .when(~boxes, "bbox must be [x, y, width, height]")
        .when(~points, "points must be [[x, y], ...]")
        .when(~masks, "mask path is missing")
    )


def class_problem() -> Column:
    color = F.col("color")
    bad = (F.size(color) != 3) | F.exists(color, lambda c: c.isNull() | ~c.between(0, 255))
    return F.when(F.col("id").isNull(), "class id is missing").when(
        color.isNotNull() & bad, "color must be [r, g, b] integers"
    )


def read_sidecars(spark: SparkSession, paths: str | list[str]) -> dict[str, DataFrame]:
    """``frames``, ``classes`` and ``rejects`` of annotation or prediction files.

    Every side file is one JSON document; frames carry their place in it as ``frame_index``.
    """
    reader = spark.read.schema(SIDECAR_SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt")
    documents = reader.json(paths).select("*", F.col("_metadata.file_path").alias("file"))
    whole = documents.filter(F.col("_corrupt").isNull() & F.col("frames").isNotNull())
    frames = whole.select("file", F.posexplode("frames").alias("frame_index", "_f")).select("file", "frame_index", "_f.*")
    frames = frames.withColumn("problem", frame_problem())
    classes = whole.select("file", F.posexplode("classes").alias("class_index", "_c")).select("file", "class_index", "_c.*")
    classes = classes.withColumn("problem", class_problem())
    unread = documents.filter(F.col("_corrupt").isNotNull() | F.col("frames").isNull()).select(
        "file", F.lit(None).cast("int").alias("index"),
        F.when(F.col("_corrupt").isNotNull(), "invalid document").otherwise("frames array is missing").alias("problem"),
    )
    bad_frames = frames.filter("problem is not null").select("file", F.col("frame_index").alias("index"), "problem")
    bad_classes = classes.filter("problem is not null").select("file", F.col("class_index").alias("index"), "problem")
    return {
        "frames": frames.filter("problem is null").drop("problem"),
        "classes": classes.filter("problem is null").drop("problem"),
        "rejects": unread.unionByName(bad_frames).unionByName(bad_classes),
    }


def read_keypoint_templates(spark: SparkSession, root: str) -> DataFrame:
    """Frames from ``*_template.json`` point files: one keypoint set per file and label."""
    reader = spark.read.schema(TEMPLATE_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
    documents = reader.option("pathGlobFilter", "*_template.json").json(root)
    return keypoint_frames(documents.select("*", F.col("_metadata.file_path").alias("file")))


def keypoint_frames(documents: DataFrame) -> DataFrame:
    """Group points by label; labels get class ids from 1 in the order files and labels come."""

    def given(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name))

    stem = F.regexp_replace("file", r"_template\.json$", ".png")
    image = F.coalesce(given("image_path"), given("image"), stem)
    points = documents.select("file", image.alias("_image"), F.posexplode("points").alias("_at", "_p")).select(
        "file", "_image", "_at", "_p.*"
    ).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    labelled = points.withColumn("_label", F.coalesce(given("type"), given("label"), F.lit("point")))
    labels = labelled.groupBy("_label").agg(F.min("file").alias("_first"))
    ids = with_rank(labels, [], ["_first", "_label"], "class_id").select("_label", F.col("class_id").cast("int"))
    place = F.struct("_at", F.array("x", "y").alias("xy"))
    sets = labelled.groupBy("file", "_image", "_label").agg(F.array_sort(F.collect_list(place)).alias("_points"))
    item = F.struct(
        F.transform("_points", lambda p: p["xy"]).alias("points"),
        "class_id",
        F.col("_label").alias("label"),
        F.lit(None).cast("double").alias("score"),
    )
    frames = sets.join(ids, "_label").groupBy("file", F.col("_image").alias("image")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_label").alias("_l"), item.alias("item")))).alias("_k")
    )
    empty = "array<struct<bbox: array<double>, class_id: int, label: string, score: double>>"
    return frames.select(
        "file",
        F.lit(0).alias("frame_index"),
        "image",
        F.lit(None).cast("double").alias("time"),
        F.array().cast(empty).alias("boxes"),
        F.transform("_k", lambda k: k["item"]).alias("keypoints"),
        F.array().cast("array<struct<path: string, class_id: int, label: string, score: double>>").alias("masks"),
    )
