"""Column expressions: clocks, names, paths, roles and polymorphic values.

Every function takes and returns ``Column`` so that the work stays in generated JVM code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.schema import SEMANTIC_TYPES, TIME_UNITS

NUMBER_PATTERN = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?\s*$"
SPECIAL_NUMBER_PATTERN = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"
ENTITY_PATH_PATTERN = r"^/(?:[A-Za-z0-9_.-]+/?)*$"

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")

# seconds of 0001-01-01 and of 10000-01-01: the calendar a timestamp can name
_FIRST_SECOND = -62135596800.0
_END_SECOND = 253402300800.0

# smallest magnitude -> (unit, divisor), largest first
_AUTO_SCALES = (
    (1e18, "unix_ns", 1e9),
    (1e15, "unix_us", 1e6),
    (1e12, "unix_ms", 1e3),
    (1e9, "unix_s", 1.0),
)
_UNIT_DIVISORS = {unit: divisor for _, unit, divisor in _AUTO_SCALES}


def is_numeric_type(dtype: str) -> bool:
    return dtype in NUMERIC_TYPES or dtype.startswith("decimal")


def is_clock_type(dtype: str) -> bool:
    return dtype in ("timestamp", "timestamp_ntz", "date")


# ---- numbers ----------------------------------------------------------------


def is_number(text: Column) -> Column:
    """Whether the text reads as a floating point number (``nan`` and ``inf`` included)."""
    return F.coalesce(text.rlike(NUMBER_PATTERN) | text.rlike(SPECIAL_NUMBER_PATTERN), F.lit(False))


def to_number(text: Column) -> Column:
    """Finite number in a text, else null."""
    return F.when(text.rlike(NUMBER_PATTERN), F.regexp_replace(text, "_", "").try_cast("double"))


def finite(value: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def clean(value: Column, dtype: str) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(value), value) if dtype in ("float", "double") else value


def numeric(value: Column, dtype: str = "string") -> Column:
    """Finite number of a cell of any type; bools count as 1 and 0."""
    if dtype == "string":
        return finite(to_number(value))
    if dtype == "boolean" or is_numeric_type(dtype):
        return finite(value.cast("double"))
    return F.lit(None).cast("double")


def typed_text(text: Column, dtype: Column) -> Column:
    """The text of a cell as its type writes it."""
    bare = F.trim(text)
    return (
        F.when(dtype == "bigint", bare.try_cast("bigint").cast("string"))
        .when(dtype == "double", bare.try_cast("double").cast("string"))
        .when(dtype == "boolean", bare.try_cast("boolean").cast("string"))
        .otherwise(text)
    )


def typed_number(text: Column, dtype: Column) -> Column:
    """The number of a cell of a numeric field; bools count as 1 and 0."""
    bare = F.trim(text)
    value = F.when(dtype == "boolean", bare.try_cast("boolean").cast("double")).when(dtype != "string", bare.try_cast("double"))
    return F.when(~F.isnan(value), value)


# ---- clocks -----------------------------------------------------------------


_DAY = r"\d{4}-\d{1,2}-\d{1,2}"
_CLOCK = r"[ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?"


def parse_datetime(text: Column) -> Column:
    """Seconds since the epoch of a date or date-time text; no zone means UTC, unreadable means null.

    Read are ISO dates and date-times, ``yyyy/MM/dd`` and ``MM/dd/yyyy``.
    """
    trimmed = F.trim(text)
    iso = (
        F.when(trimmed.rlike(r"^\d{4}-"), trimmed)
        .when(trimmed.rlike(r"^\d{4}/"), F.regexp_replace(trimmed, r"^(\d{4})/(\d{1,2})/", "$1-$2-"))
        .when(
            trimmed.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"),
            F.regexp_replace(trimmed, r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2"),
        )
    )
    # a date gets a clock, a clock without a zone gets UTC
    clocked = F.regexp_replace(iso, f"^({_DAY})$", "$1T00:00:00")
    zoned = F.regexp_replace(clocked, f"^({_DAY}{_CLOCK}) *(UTC|GMT|Z|z)?$", "$1Z")
    whole = F.when(zoned.rlike(f"^{_DAY}{_CLOCK}(Z|[+-]\\d{{2}}:?\\d{{2}})$"), zoned)
    return F.unix_micros(whole.try_cast("timestamp")) / F.lit(1e6)


def _in_calendar(seconds: Column) -> Column:
    return F.when((seconds >= _FIRST_SECOND) & (seconds < _END_SECOND), seconds)


def auto_seconds(value: Column) -> Column:
    """Seconds of a number whose size tells its unit."""
    size = F.abs(value)
    divisor = _case([(size >= floor, F.lit(divisor)) for floor, _, divisor in _AUTO_SCALES], F.lit(1.0))
    return _in_calendar(value / divisor)


def _auto_unit(value: Column) -> Column:
    size = F.abs(value)
    return _case([(size >= floor, F.lit(unit)) for floor, unit, _ in _AUTO_SCALES], F.lit("seconds"))


def _case(steps: list[tuple[Column, Column]], otherwise: Column) -> Column:
    chain = F.when(*steps[0])
    for condition, result in steps[1:]:
        chain = chain.when(condition, result)
    return chain.otherwise(otherwise)


def _datetime_seconds(value: Column, dtype: str) -> Column:
    if is_clock_type(dtype):
        return F.unix_micros(value.cast("timestamp")) / F.lit(1e6)
    if dtype == "string":
        compact = F.regexp_replace(F.trim(value), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
        return parse_datetime(compact)
    # a bare number under the datetime unit counts nanoseconds, kept to the microsecond
    return _in_calendar(F.floor(numeric(value, dtype) / F.lit(1e3)) / F.lit(1e6))


def normalize_time(value: Column, unit: str = "auto", dtype: str = "string", number: Column | None = None) -> Column:
    """Seconds of a timeline cell. Numbers, also in texts, come before date texts.

    ``number`` is :func:`numeric` of the cell where a projection has computed it already.
    """
    if unit not in TIME_UNITS:
        raise ValueError(f"Unsupported time unit: {unit}")
    if unit == "datetime" or is_clock_type(dtype):
        return _datetime_seconds(value, dtype)
    number = numeric(value, dtype) if number is None else number
    if unit == "auto":
        seconds = auto_seconds(number)
    elif unit in ("seconds", "relative_s"):
        seconds = number
    else:
        seconds = _in_calendar(number / F.lit(_UNIT_DIVISORS[unit]))
    if dtype == "string":
        return F.when(number.isNotNull(), seconds).otherwise(parse_datetime(value))
    return seconds


def normalize_time_by(text: Column, unit: Column, dtype: Column, number: Column | None = None) -> Column:
    """:func:`normalize_time` where unit and type differ by row; ``text`` is the cell as its type writes it, ``number``
    :func:`numeric` of it where a projection has computed it already."""
    number = numeric(text) if number is None else number
    is_number = dtype.isin("bigint", "double")
    divisor = _case([(unit == name, F.lit(size)) for name, size in _UNIT_DIVISORS.items()], F.lit(1.0))
    scaled = (
        F.when(unit == "auto", auto_seconds(number))
        .when(unit.isin("seconds", "relative_s"), number)
        .otherwise(_in_calendar(number / divisor))
    )
    counted = _in_calendar(F.floor(number / F.lit(1e3)) / F.lit(1e6))
    return (
        F.when(unit == "datetime", F.when(is_number, counted).otherwise(_datetime_seconds(text, "string")))
        .when(number.isNotNull(), scaled)
        .when(~is_number, parse_datetime(text))
    )


def unit_tag(seconds: Column, number: Column, unit: str = "auto") -> Column:
    """Unit tag from a cell's seconds and number, both already computed."""
    if unit == "datetime":
        return F.when(seconds.isNotNull(), F.lit("datetime"))
    named = {"auto": _auto_unit(number), "seconds": F.lit("relative_s")}.get(unit, F.lit(unit))
    return F.when(seconds.isNotNull(), F.when(number.isNotNull(), named).otherwise(F.lit("datetime")))


def time_unit(value: Column, unit: str = "auto", dtype: str = "string") -> Column:
    """Unit tag of a cell that :func:`normalize_time` can read, else null."""
    if is_clock_type(dtype):
        return F.when(value.isNotNull(), F.lit("datetime"))
    return unit_tag(normalize_time(value, unit, dtype), numeric(value, dtype), unit)


def query_time(value: Column, position: Column, unit: str = "auto", dtype: str = "string") -> Column:
    """Seconds, or the row position where the cell has no readable time."""
    return F.coalesce(normalize_time(value, unit, dtype), position.cast("double"))


def clock_seconds(value: Column) -> Column:
    """Seconds of a topic clock. The health report cuts units lower than :func:`normalize_time`."""
    size = F.abs(value)
    return (
        F.when(size >= 1e17, value / 1e9)
        .when(size >= 1e14, value / 1e6)
        .when(size >= 1e11, value / 1e3)
        .otherwise(value)
        .cast("double")
    )


def cloud_time(stem: Column, position: Column) -> Column:
    """Time of a point file from its name, else its position in the listing."""
    value = to_number(stem)
    return (
        F.when(value.isNull(), position.cast("double"))
        .when(F.length(stem) >= 16, value / 1e9)
        .when(F.length(stem) >= 13, value / 1e3)
        .otherwise(value)
    )


def canonical_unit(unit: Column) -> Column:
    return F.when(unit == "seconds", F.lit("relative_s")).otherwise(unit)


def effective_unit(configured: Column, inferred: Column, first: Column) -> Column:
    """The unit a conversion uses: configured, else inferred, else that of the first readable cell."""
    named = canonical_unit(F.coalesce(configured, F.lit("auto")))
    return F.coalesce(
        F.when(named != "auto", named),
        F.when(inferred != "mixed", inferred),
        F.when(first != "", first),
        F.lit("auto"),
    )


# ---- names and paths ----------------------------------------------------------


def safe_slug(text: Column) -> Column:
    flat = F.regexp_replace(F.trim(text), "[^a-zA-Z0-9_]+", "_")
    bare = F.lower(F.regexp_replace(flat, "^_+|_+$", ""))
    return F.when(bare == "", F.lit("stream")).otherwise(bare)


def safe_output_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_")


def normalized_name(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def axis(field: Column) -> Column:
    found = F.regexp_extract(F.lower(field), r"(?:^|[._-])(x|y|z|w|roll|pitch|yaw|width|height)$", 1)
    return F.when(found != "", found)


def field_role(field: Column) -> Column:
    """Coordinate role named by the last part of a field name."""
    low = F.lower(field)
    token = F.element_at(F.split(low, r"[._/-]", -1), -1)
    last = F.substring(token, -1, 1)
    return (
        F.when(token.isin("qx", "qy", "qz", "qw"), token)
        .when(low.contains("quat") & last.isin("x", "y", "z", "w"), F.concat(F.lit("q"), last))
        .when(low.contains("quat"), token)
        .when(token == "width", F.lit("w"))
        .when(token == "height", F.lit("h"))
        .otherwise(token)
    )


def axis_prefix(field: Column) -> Column:
    """Prefix shared by the x, y and z fields of one vector, null for other fields."""
    found = F.regexp_extract(F.lower(field), r"^(.+?)[._-]?([xyz])$", 1)
    return F.when(F.length(found) >= 2, found)


def axis_letter(field: Column) -> Column:
    found = F.regexp_extract(F.lower(field), r"^(.+?)[._-]?([xyz])$", 2)
    return F.when(found != "", found)


def valid_entity_path(path: Column) -> Column:
    return F.coalesce(path.rlike(ENTITY_PATH_PATTERN) & ~path.contains("//"), F.lit(False))


def sanitized_entity_path(path: Column, semantic_type: Column, name: Column) -> Column:
    """A valid path close to a broken one; an empty path becomes ``/<kind>/<name>``."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda part: F.trim(part) != "")
    kept = F.concat(F.lit("/"), F.array_join(F.transform(parts, safe_slug), "/"))
    prefix = lookup(semantic_type, {kind: row[2] for kind, row in SEMANTIC_TYPES.items()}, "tables")
    default = F.concat(F.lit("/"), prefix, F.lit("/"), safe_slug(F.coalesce(name, F.lit("stream"))))
    return F.when(F.size(parts) > 0, kept).otherwise(default)


def topic_entity_path(topic: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(topic, F.lit("")), "^/+|/+$", ""), "/", "_")
    return F.concat(F.lit("/topics/"), F.when(bare == "", F.lit("topic")).otherwise(bare))


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    """Value of a small fixed table."""
    pairs = F.create_map(*[F.lit(item) for pair in table.items() for item in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def archetype(semantic_type: Column) -> Column:
    return lookup(semantic_type, {kind: row[0] for kind, row in SEMANTIC_TYPES.items()}, "AnyValues")


def view(semantic_type: Column) -> Column:
    return lookup(semantic_type, {kind: row[1] for kind, row in SEMANTIC_TYPES.items()}, "DataframeView")


# fixed values: (semantic type, role or None for any role, path)
_STREAM_PATHS = (
    ("image", "camera_image", "/sensors/camera/image"),
    ("image", None, "/camera/image"),
    ("points3d", None, "/sensors/lidar/points"),
    ("transform3d", None, "/world/tf"),
    ("trajectory3d", None, "/world/trajectory"),
    ("boxes2d", "gt", "/camera/gt/boxes"),
    ("boxes2d", "pred", "/camera/pred/boxes"),
    ("points2d", "gt_keypoints", "/camera/gt/keypoints"),
    ("points2d", "pred_keypoints", "/camera/pred/keypoints"),
    ("segmentation", "gt_masks", "/camera/gt/masks"),
    ("segmentation", "pred_masks", "/camera/pred/masks"),
    ("scalar", "pred_scores", "/camera/pred/scores"),
    ("asset3d", None, "/world/robot_model"),
)
_NAMED_PATHS = {
    "mcap": "/topics/",
    "scalar": "/metrics/",
    "scalar_group": "/metrics/",
    "state": "/states/",
    "text_log": "/logs/",
}


def entity_path(semantic_type: Column, role: Column, name: Column) -> Column:
    """Path a stream gets by default, from its type, its role and its name."""
    role = F.coalesce(role, F.lit(""))
    steps = [
        ((semantic_type == kind) & (F.lit(True) if wanted is None else role == wanted), F.lit(path))
        for kind, wanted, path in _STREAM_PATHS
    ]
    steps.append(((role == "robot_model") & (semantic_type != "mcap"), F.lit("/world/robot_model")))
    return _case(steps, F.concat(lookup(semantic_type, _NAMED_PATHS, "/tables/"), safe_slug(name)))


# fixed values: first matching row wins (substrings of "topic schema", role, type, confidence)
TOPIC_RULES = (
    (("robot_description", "urdf"), "robot_model", "asset3d", 0.86),
    (("tf", "transform"), "tf_tree", "transform3d", 0.9),
    (("camera", "image", "compressedimage"), "camera_image", "image", 0.88),
    (("pointcloud", "point_cloud", "lidar", "velodyne"), "point_cloud", "points3d", 0.9),
    (("laserscan", "laser_scan"), "laser_scan", "points2d", 0.86),
    (("odom", "pose", "trajectory"), "trajectory", "trajectory3d", 0.82),
    (("sensor_msgs/msg/imu", "/imu"), "imu", "scalar_group", 0.82),
    (("joint",), "joint_state", "scalar_group", 0.78),
    (("diagnostic", "rosout", "log"), "diagnostics", "text_log", 0.76),
)


def classify_topic(topic: Column, schema_name: Column) -> Column:
    """Struct ``(role, semantic_type, confidence)`` of a topic."""
    text = F.lower(F.concat(topic, F.lit(" "), F.coalesce(schema_name, F.lit(""))))

    def outcome(role: str, kind: str, confidence: float) -> Column:
        return F.struct(
            F.lit(role).alias("role"),
            F.lit(kind).alias("semantic_type"),
            F.lit(confidence).alias("confidence"),
        )

    steps = [
        (contains_any(text, needles), outcome(role, kind, confidence))
        for needles, role, kind, confidence in TOPIC_RULES
    ]
    return _case(steps, outcome("raw_topic", "mcap", 0.55))


def contains_any(text: Column, needles) -> Column:
    return reduce(lambda left, right: left | right, [text.contains(needle) for needle in needles])


# ---- polymorphic signal values --------------------------------------------------


def value_text(prefix: str = "") -> Column:
    """Text form of a signal value."""
    kind, number, text = (F.col(prefix + name) for name in ("value_type", "value_num", "value_str"))
    return F.coalesce(
        text,
        F.when(kind == "bool", F.when(number != 0, F.lit("True")).otherwise(F.lit("False")))
        .when(kind == "int", number.cast("bigint").cast("string"))
        .otherwise(number.cast("string")),
    )


def value_json() -> Column:
    """JSON form of a signal value: strings quoted, objects and numbers as they are."""
    kind = F.col("value_type")
    quoted = F.to_json(F.array(F.col("value_str")))
    return (
        F.when(kind == "string", quoted.substr(F.lit(2), F.length(quoted) - 2))
        .when(kind == "bool", F.lower(value_text()))
        .otherwise(value_text())
    )


def filter_float() -> Column:
    """Number a comparison filter sees: numbers and numeric strings, never bools."""
    kind = F.col("value_type")
    return (
        F.when(kind.isin("int", "double"), F.col("value_num"))
        .when(kind == "string", to_number(F.col("value_str")))
    )


def float_or_none() -> Column:
    """Number the quality checks see: numbers only."""
    return F.when(F.col("value_type").isin("int", "double"), F.col("value_num"))


def json_value(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)
