"""Table layouts and vocabularies shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

SIGNAL_SCHEMA = T.StructType(
    [
        T.StructField("recording_id", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("time", T.DoubleType()),
        T.StructField("entity_path", T.StringType()),
        T.StructField("semantic_type", T.StringType()),
        T.StructField("key", T.StringType()),
        # int | double | bool | string | object
        T.StructField("value_type", T.StringType()),
        # numbers, and bools as 1/0
        T.StructField("value_num", T.DoubleType()),
        # strings, JSON text of objects, and integers a double cannot hold
        T.StructField("value_str", T.StringType()),
        # position of the row in its source: the tie breaker of every ordering
        T.StructField("ord", T.LongType()),
    ]
)
SIGNAL_COLUMNS = [field.name for field in SIGNAL_SCHEMA.fields]

QUERY_COLUMNS = ["recording_id", "time", "entity_path", "key", "value"]

FINDING_COLUMNS = [
    "category",
    "severity",
    "recording_id",
    "source_id",
    "topic",
    "entity_path",
    "key",
    "message",
    "evidence",
    "recommendation",
]
FINDING_EXPORT_COLUMNS = [
    "id",
    "severity",
    "category",
    "recording_id",
    "source_id",
    "topic",
    "entity_path",
    "key",
    "message",
    "recommendation",
    "evidence",
]

# ---- fixed values: they have to match for results to match -----------------

TIME_UNITS = (
    "auto",
    "seconds",
    "relative_s",
    "unix_s",
    "unix_ms",
    "unix_us",
    "unix_ns",
    "datetime",
)
# priority order of exact time column names
TIME_COLUMN_NAMES = ("timestamp", "datetime", "time", "t")

# semantic type -> (archetype, view, leading path element of a generated path)
SEMANTIC_TYPES = {
    "scalar": ("Scalars", "TimeSeriesView", "metrics"),
    "scalar_group": ("Scalars", "TimeSeriesView", "metrics"),
    "state": ("StateChange", "StateTimelineView", "states"),
    "text_log": ("TextLog", "TextLogView", "logs"),
    "image": ("EncodedImage", "Spatial2DView", "camera"),
    "boxes2d": ("Boxes2D", "Spatial2DView", "camera"),
    "points2d": ("Points2D", "Spatial2DView", "camera"),
    "segmentation": ("SegmentationImage", "Spatial2DView", "tables"),
    "points3d": ("Points3D", "Spatial3DView", "world"),
    "asset3d": ("Asset3D", "DataframeView", "tables"),
    "transform3d": ("Transform3D", "Spatial3DView", "world"),
    "trajectory3d": ("LineStrips3D", "Spatial3DView", "world"),
    "mcap": ("AnyValues", "DataframeView", "tables"),
}

# source family -> semantic types a mapping may use
FAMILY_TYPES = {
    "tabular": (
        "scalar",
        "scalar_group",
        "state",
        "text_log",
        "points2d",
        "points3d",
        "trajectory3d",
        "boxes2d",
        "transform3d",
    ),
    "image_folder": ("image", "boxes2d", "points2d", "segmentation", "scalar"),
    "point_cloud": ("points3d",),
    "mcap": (
        "mcap",
        "image",
        "points3d",
        "transform3d",
        "trajectory3d",
        "asset3d",
        "scalar_group",
        "text_log",
    ),
}

# file suffix -> source type
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff", "gif")
POINT_SUFFIXES = ("ply", "pcd", "npy", "npz", "xyz", "xyzn", "xyzrgb", "pts", "asc")
TEXT_POINT_SUFFIXES = ("xyz", "xyzn", "xyzrgb", "pts", "asc")
SUFFIX_TYPES = {
    "csv": ("csv",),
    "jsonl": ("jsonl", "ndjson"),
    "image_folder": IMAGE_SUFFIXES,
    "text_table": ("tsv", "txt", "log", "dat", "lst", "list"),
    "mcap": ("mcap",),
    "ros2_db3": ("db3",),
    "point_cloud": POINT_SUFFIXES,
}

ROBOT_ROLES = (
    "tf_tree",
    "trajectory",
    "point_cloud",
    "camera_image",
    "imu",
    "joint_state",
    "diagnostics",
    "robot_model",
)

# cell texts read as missing
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
