"""Templates, custom filters, orders and limits over the ``signals`` table."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scalars import NUMBER_PATTERN, filter_float, to_number, value_text
from tracelake.operators.ordered import with_next, with_rank

_NEVER = float("-inf")


def canonical_order() -> list[Column]:
    """recording, time with missing times first, path, key; source order breaks ties."""
    return [F.col(name).asc_nulls_first() for name in ("recording_id", "time", "entity_path", "key", "ord")]


def _order_of(df: DataFrame) -> list[Column]:
    """Canonical order by what a result has of it, then by its other columns, so that it is one order."""
    names = ["recording_id", "time", "entity_path", "key", "ord"]
    rest = [f.name for f in df.schema.fields if f.name not in names and f.dataType.typeName() not in ("map", "variant")]
    return [F.col(f"`{name}`").asc_nulls_first() for name in [*[n for n in names if n in df.columns], *rest]]


def in_order(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Canonical order, all rows or the first ``limit``; a limited sort keeps only the top rows."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    whole = set(("recording_id", "time", "entity_path", "key", "ord")) <= set(df.columns)
    ordered = df.orderBy(*(canonical_order() if whole else _order_of(df)))
    return ordered if limit is None else ordered.limit(limit)


def with_canonical_position(df: DataFrame, name: str = "position", chunks: int | None = None) -> DataFrame:
    """Number the rows of a whole result in canonical order, from 1."""
    return with_rank(df, [], ["recording_id", "time", "entity_path", "key", "ord"], name, chunks)


# what a derived result tells about a row beside its place
_PLACE = ("recording_id", "time", "entity_path", "key", "ord")


def result_columns(df: DataFrame) -> DataFrame:
    """The five columns of any query result, with the value as text.

    Signal rows give their own value. Rows of a derived result (state durations, topic clocks, comparisons) give one
    object: all columns that are not part of the place, as JSON in column order. A place column that a result lacks
    is null.
    """
    place = [
        (F.col(name) if name in df.columns else F.lit(None).cast("double" if name == "time" else "string")).alias(name)
        for name in _PLACE[:4]
    ]
    if {"value_type", "value_num", "value_str"} <= set(df.columns):
        return df.select(*place, value_text().alias("value"))
    told = [name for name in df.columns if name not in _PLACE]
    return df.select(*place, F.to_json(F.struct(*[F.col(f"`{name}`") for name in told])).alias("value"))


# ---- scope ---------------------------------------------------------------------


def filter_recordings(signals: DataFrame, recording_ids: list[str] | None) -> DataFrame:
    """Rows of the named recordings; :func:`tracelake.plans.sinks.read_signals` also skips the other folders."""
    return signals.filter(F.col("recording_id").isin(*recording_ids)) if recording_ids else signals


def filter_semantic_types(signals: DataFrame, kinds: list[str] | None) -> DataFrame:
    return signals.filter(F.col("semantic_type").isin(*kinds)) if kinds else signals


def matches_token(tokens: Iterable[str]) -> Column | None:
    wanted = [token.lower() for token in tokens if token]
    if not wanted:
        return None
    tests = [F.lower(F.col(name)).contains(token) for token in wanted for name in ("key", "entity_path")]
    return reduce(lambda left, right: left | right, tests)


def filter_tokens(signals: DataFrame, tokens: list[str] | None) -> DataFrame:
    """Rows whose key or path contains any of the tokens."""
    test = matches_token(tokens or [])
    return signals if test is None else signals.filter(test)


# ---- templates -------------------------------------------------------------------


# fixed values: words and names that the templates look for
_ERROR_WORDS = "error|warn|fault"
_LOG_TYPES = ("text_log", "state")
_NUMBER_TYPES = ("scalar", "scalar_group")
_SCORE_KEYS = ("score_min", "score_mean")
_FRAME_PATH, _FRAME_COUNT = "/camera/pred", "pred_box_count"


def is_error() -> Column:
    """Whether a row is a log or state that mentions an error, a warning or a fault."""
    return F.col("semantic_type").isin(*_LOG_TYPES) & F.lower(value_text()).rlike(_ERROR_WORDS)


def is_low_battery(threshold: float) -> Column:
    name = F.lower(F.concat_ws(" ", "key", "entity_path"))
    number = F.col("semantic_type").isin(*_NUMBER_TYPES) & name.contains("battery")
    return number & (F.col("value_num") < F.lit(float(threshold)))


def detection_reason(threshold: float) -> Column:
    """What is wrong with the predictions of a frame that a row tells of, null if nothing is."""
    here = F.col("entity_path").startswith(_FRAME_PATH)
    none = (F.col("key") == _FRAME_COUNT) & (F.col("value_num") == 0)
    low = F.col("key").isin(*_SCORE_KEYS) & (F.col("value_num") < F.lit(float(threshold)))
    return F.when(here & none, F.lit("no_prediction")).when(here & low, F.lit("low_score"))


def find_errors(signals: DataFrame) -> DataFrame:
    """Log and state rows that mention an error, a warning or a fault."""
    return signals.filter(is_error())


def low_battery(signals: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Battery samples below the threshold."""
    return signals.filter(is_low_battery(threshold))


def detection_failure(signals: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Frames without predictions or with low scores; adds ``reason``."""
    return signals.withColumn("reason", detection_reason(threshold)).filter(F.col("reason").isNotNull())


def topic_summary(signals: DataFrame) -> DataFrame:
    return signals.filter(F.col("key") == "topic_summary")


def state_duration(signals: DataFrame, chunks: int | None = None) -> DataFrame:
    """Time until the next sample of the same state signal; 0 for the last one."""
    states = signals.filter((F.col("semantic_type") == "state") & F.col("time").isNotNull()).select(
        "recording_id", "time", "entity_path", "key", "ord", value_text().alias("state")
    )
    paired = with_next(states, ["recording_id", "entity_path", "key"], ["time", "ord"], "time", "_next", chunks)
    held = F.greatest(F.coalesce("_next", "time") - F.col("time"), F.lit(0.0))
    return paired.withColumn("duration", held).drop("_next")


# ---- custom filter ------------------------------------------------------------------

_COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "gt": lambda left, right: left > right,
    "gte": lambda left, right: left >= right,
    "lt": lambda left, right: left < right,
    "lte": lambda left, right: left <= right,
}
OPERATORS = ("any", "contains", "eq", *_COMPARISONS)


def _bound(value) -> float | None:
    """Number given as a filter bound: a number or a numeric text, never a bool."""
    if isinstance(value, bool) or value is None:
        return None
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _value_test(operator: str, expected) -> Column | None:
    if operator not in OPERATORS:
        raise ValueError(f"Unsupported custom query operator: {operator}")
    if operator == "any" or expected is None or expected == "":
        return None
    text = value_text()
    if operator == "contains":
        return F.lower(text).contains(str(expected).lower())
    if operator == "eq":
        wanted = str(expected)
        numbers = F.col("value_type").isin("int", "double") & F.lit(wanted).rlike(NUMBER_PATTERN)
        bools = F.col("value_type") == "bool"
        return (
            F.when(numbers, F.col("value_num") == to_number(F.lit(wanted)))
            .when(bools, F.lower(text) == wanted.lower())
            .otherwise(text == wanted)
        )
    target = _bound(expected)
    if target is None:
        return F.lit(False)
    return _COMPARISONS[operator](filter_float(), F.lit(target))


def custom_query(
    signals: DataFrame,
    *,
    time_start=None,
    time_end=None,
    entity_path: str | None = None,
    key: str | None = None,
    text: str | None = None,
    operator: str = "any",
    value=None,
    recording_ids: list[str] | None = None,
    semantic_types: list[str] | None = None,
) -> DataFrame:
    """Conjunction of the given filters; substrings ignore case and are taken literally."""
    rows = filter_semantic_types(filter_recordings(signals, recording_ids), semantic_types)
    test = _value_test(operator, value)
    start, end = _bound(time_start), _bound(time_end)
    if start is not None:
        rows = rows.filter(F.col("time") >= start)
    if end is not None:
        rows = rows.filter(F.col("time") <= end)
    for name, part in (("entity_path", entity_path), ("key", key)):
        wanted = (part or "").strip().lower()
        if wanted:
            rows = rows.filter(F.lower(F.col(name)).contains(wanted))
    wanted = (text or "").strip().lower()
    if wanted:
        haystack = F.concat_ws(" ", F.col("entity_path"), F.col("key"), value_text())
        rows = rows.filter(F.lower(haystack).contains(wanted))
    return rows if test is None else rows.filter(test)


# ---- template call by name ---------------------------------------------------------


def run_template(
    signals: DataFrame,
    template_id: str,
    recording_ids: list[str] | None = None,
    params: dict | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Run a template by its name; the result is in canonical order, all of it or the first ``limit`` rows."""
    from tracelake.operators.topics import time_sync

    params = params or {}
    templates: dict[str, Callable[[DataFrame], DataFrame]] = {
        "find_errors": find_errors,
        "low_battery": lambda rows: low_battery(rows, float(params.get("threshold", 0.2))),
        "detection_failure": lambda rows: detection_failure(rows, float(params.get("threshold", 0.5))),
        "topic_summary": topic_summary,
        "state_duration": state_duration,
        "time_sync": time_sync,
    }
    if template_id not in templates:
        raise ValueError(f"Unsupported query template: {template_id}")
    rows = templates[template_id](filter_recordings(signals, recording_ids))
    return in_order(rows, limit)
