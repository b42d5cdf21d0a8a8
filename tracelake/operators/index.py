"""From a wide frame and a mapping to the long ``signals`` table, and to typed record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scalars import (
    clean,
    is_clock_type,
    is_numeric_type,
    normalize_time,
    normalize_time_by,
    numeric,
    typed_number,
    typed_text,
)
from tracelake.operators.ordered import with_rank
from tracelake.schema import SIGNAL_COLUMNS

# integers above this do not fit a double exactly
_EXACT_INTEGER = 2**53


def column(name: str) -> Column:
    """Column by its literal name; flattened names contain dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_column(value: str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def flatten_one_level(df: DataFrame) -> DataFrame:
    """Struct fields become ``parent.child`` columns; deeper structs, arrays and maps become JSON text."""

    def leaf(value: Column, dtype: str, name: str) -> Column:
        nested = dtype.startswith(("array", "map", "struct"))
        return (F.to_json(value) if nested else value).alias(name)

    picked = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind.startswith("struct"):
            picked += [
                leaf(column(field.name).getField(sub.name), sub.dataType.simpleString(), f"{field.name}.{sub.name}")
                for sub in field.dataType.fields
            ]
        else:
            picked.append(leaf(column(field.name), kind, field.name))
    return df.select(*picked)


def text_of(df: DataFrame, name: str) -> Column:
    """Cell text as it appears in messages, null for a missing cell."""
    kind = dict(df.dtypes)[name]
    value = clean(column(name), kind)
    if kind.startswith(("array", "map", "struct")):
        return F.to_json(value)
    if kind == "boolean":
        return F.when(value, F.lit("True")).when(~value, F.lit("False"))
    return value.cast("string")


def typed_value(df: DataFrame, name: str) -> tuple[Column, Column, Column]:
    """(value_type, value_num, value_str) of a cell; num and str are both null for a missing cell."""
    kind = dict(df.dtypes)[name]
    value = clean(column(name), kind)
    if kind == "boolean":
        return F.lit("bool"), value.cast("double"), F.lit(None).cast("string")
    if kind in ("float", "double") or kind.startswith("decimal"):
        return F.lit("double"), value.cast("double"), F.lit(None).cast("string")
    if is_numeric_type(kind):
        wide = F.when(F.abs(value) > _EXACT_INTEGER, value.cast("string"))
        return F.lit("int"), value.cast("double"), wide
    label = "object" if kind.startswith(("array", "map", "struct")) else "string"
    return F.lit(label), F.lit(None).cast("double"), text_of(df, name)


def log_message(df: DataFrame, fields: list[str]) -> Column:
    """``f1=v1 f2=v2`` over the present fields, null when none is."""
    parts = [F.concat(F.lit(f"{name}="), text_of(df, name)) for name in fields if name in df.columns]
    text = F.concat_ws(" ", *parts) if parts else F.lit("")
    return F.when(text != "", text)


def log_level(df: DataFrame, fields: list[str]) -> Column:
    """ERROR, WARN, DEBUG or INFO from the first level field that names one."""
    named = []
    for name in fields:
        if name.lower() in ("level", "severity") and name in df.columns:
            word = F.upper(text_of(df, name))
            named.append(
                F.when(word.isin("ERROR", "ERR"), "ERROR")
                .when(word.isin("WARN", "WARNING"), "WARN")
                .when(word.isin("DEBUG", "TRACE"), "DEBUG")
            )
    return F.coalesce(*named, F.lit("INFO"))


def enabled_streams(mapping: dict) -> list[dict]:
    return [stream for stream in mapping.get("streams", []) if stream.get("enabled", True)]


def with_row_time(df: DataFrame, mapping: dict, name: str = "time") -> DataFrame:
    """Add the seconds of the mapped timeline; a missing or unreadable cell stays null."""
    field = mapping.get("primary_timeline")
    if not field or field not in df.columns:
        return df.withColumn(name, F.lit(None).cast("double"))
    unit = mapping.get("effective_unit") or mapping.get("timeline_unit") or "auto"
    kind = dict(df.dtypes)[field]
    value = clean(column(field), kind)
    if is_clock_type(kind):
        return df.withColumn(name, normalize_time(value, unit, kind))
    # the number is read once per row, in a projection of its own
    staged = df.withColumn("_number", numeric(value, kind))
    return staged.withColumn(name, normalize_time(value, unit, kind, F.col("_number"))).drop("_number")


def _signal(path: str, kind: str, key: str, value: tuple[Column, Column, Column]) -> Column:
    value_type, value_num, value_str = value
    return F.struct(
        F.lit(path).alias("entity_path"),
        F.lit(kind).alias("semantic_type"),
        F.lit(key).alias("key"),
        value_type.alias("value_type"),
        value_num.alias("value_num"),
        value_str.alias("value_str"),
    )


def index_frame(
    df: DataFrame,
    mapping: dict,
    recording_id: str | Column,
    source_id: str | Column,
    ord: str | Column | None = None,
) -> DataFrame:
    """Melt any wide frame, batch or streaming, into signals: one scan, however many streams are mapped."""
    cells = []
    for stream in enabled_streams(mapping):
        path, kind = stream.get("entity_path", ""), stream.get("semantic_type", "")
        if kind not in ("scalar", "scalar_group", "state", "text_log"):
            continue
        fields = [name for name in stream.get("source_fields", []) if name in df.columns]
        for name in fields:
            at = f"{path}/{name}" if kind == "scalar_group" else path
            cells.append(_signal(at, kind, name, typed_value(df, name)))
        if kind == "text_log" and fields:
            message = (F.lit("string"), F.lit(None).cast("double"), log_message(df, fields))
            cells.append(_signal(path, kind, "message", message))
    if ord is not None:
        position = F.col(ord) if isinstance(ord, str) else ord
    elif df.isStreaming:
        # a stream has no source order: a stable number breaks ties
        position = F.xxhash64(*[column(name) for name in df.columns])
    else:
        position = F.monotonically_increasing_id()
    timed = with_row_time(df, mapping, "_time")
    row = [
        as_column(recording_id).cast("string").alias("recording_id"),
        as_column(source_id).cast("string").alias("source_id"),
        F.col("_time").alias("time"),
        position.cast("bigint").alias("ord"),
    ]
    if not cells:
        empty = [F.lit(None).cast("string").alias(name) for name in ("entity_path", "semantic_type", "key", "value_type")]
        empty += [F.lit(None).cast("double").alias("value_num"), F.lit(None).cast("string").alias("value_str")]
        return timed.select(*row, *empty).filter(F.lit(False)).select(*SIGNAL_COLUMNS)
    melted = timed.select(*row, F.explode(F.array(*cells)).alias("cell")).select(
        "recording_id", "source_id", "time", "ord", "cell.*"
    )
    present = F.col("value_num").isNotNull() | F.col("value_str").isNotNull()
    return melted.filter(present).select(*SIGNAL_COLUMNS)


def timeline_order(sort: str = "ascending") -> list[Column]:
    """Order of rows on the timeline: readable times first, ties in source order."""
    if sort not in ("source", "ascending"):
        raise ValueError(f"Unsupported timeline sort mode: {sort}")
    return [F.col("time").asc_nulls_last(), F.col("ord").asc()] if sort == "ascending" else [F.col("ord").asc()]


def sort_timeline(df: DataFrame, sort: str = "ascending") -> DataFrame:
    """The whole table in timeline order."""
    return df.orderBy(*timeline_order(sort))


def with_row_sequence(
    df: DataFrame,
    group: list[str],
    sort: str = "source",
    chunks: int | None = None,
    time: str = "time",
    ord: str = "ord",
    name: str = "row",
) -> DataFrame:
    """Add ``row``: position from 0 in the final order of each recording."""
    if sort == "ascending":
        keyed = df.withColumn("_late", F.col(time).isNull())
        ranked = with_rank(keyed, group, ["_late", time, ord], name, chunks).drop("_late")
    elif sort == "source":
        ranked = with_rank(df, group, [ord], name, chunks)
    else:
        raise ValueError(f"Unsupported timeline sort mode: {sort}")
    return ranked.withColumn(name, F.col(name) - 1)


def first_present_field(df: DataFrame, fields: list[str]) -> str | None:
    """First field the frame has as a column, whatever its cells hold."""
    return next((name for name in fields if name in df.columns), None)


# ---- many sources, each by its own rules -----------------------------------------------------------------------


def mapping_rules(streams: DataFrame, fields: DataFrame, timelines: DataFrame) -> DataFrame:
    """One row per source: its timeline and all its rules, as :func:`melt_records` joins them to records.

    ``streams`` are mapping rows (``source_id, pos, source_fields, semantic_type, entity_path, enabled``) of many
    sources, ``fields`` the catalogue of their fields, ``timelines (source_id, recording_id, time_key, unit)`` what each
    source is called and how its rows are timed. Rules of fields that a source does not have are left out.
    """
    kinds = ("scalar", "scalar_group", "state", "text_log")
    live = streams.filter(F.col("enabled") & F.col("semantic_type").isin(*kinds))
    named = live.select("source_id", "pos", "semantic_type", "entity_path", F.posexplode("source_fields").alias("at", "field"))
    known = named.join(fields.select("source_id", "field", "dtype"), ["source_id", "field"])
    path = F.when(F.col("semantic_type") == "scalar_group", F.concat_ws("/", "entity_path", "field")).otherwise(F.col("entity_path"))
    rule = F.struct("pos", "at", "field", "dtype", path.alias("entity_path"), "semantic_type")
    cells = known.groupBy("source_id").agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    part = F.struct("at", "field", "dtype")
    logs = known.filter("semantic_type = 'text_log'").groupBy("source_id", "pos", "entity_path").agg(
        F.array_sort(F.collect_list(part)).alias("parts")
    )
    logs = logs.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("pos", "entity_path", "parts"))).alias("logs"))
    typed = fields.select("source_id", F.col("field").alias("time_key"), F.col("dtype").alias("time_dtype"))
    timed = timelines.join(typed, ["source_id", "time_key"], "left")
    return timed.join(cells, "source_id", "left").join(logs, "source_id", "left")


def melt_records(records: DataFrame, rules: DataFrame) -> DataFrame:
    """Signals of the records ``(source_id, ord, cells)`` of many sources, each by its own row of ``rules``.

    One scan: the rules of a source meet its records in one join, by broadcast where the table of rules is small at
    runtime and else by a shuffle whose large keys the runtime splits. A record's rules are exploded against a map of
    its cells; cells that are missing give nothing. Records of sources without rules give no signals.
    """
    texts = F.map_from_entries(
        F.transform(F.filter("cells", lambda c: c["text"].isNotNull()), lambda c: F.struct(c["field"], c["text"]))
    )
    met = records.join(rules, "source_id").withColumn("_texts", texts)
    # the clock is read once per record, in a projection of its own
    value = lambda field, dtype: typed_text(F.try_element_at("_texts", field), dtype)

    def told(part: Column) -> Column:
        text = value(part["field"], part["dtype"])
        shown = F.when(part["dtype"] == "boolean", F.initcap(text)).otherwise(text)
        return F.concat(part["field"], F.lit("="), shown)

    def cell(path: Column, kind: Column, key: Column, dtype: Column, text: Column) -> Column:
        return F.struct(
            path.alias("entity_path"), kind.alias("semantic_type"), key.alias("key"), dtype.alias("dtype"), text.alias("text")
        )

    single = F.transform(
        F.coalesce("rules", F.array()),
        lambda r: cell(r["entity_path"], r["semantic_type"], r["field"], r["dtype"], value(r["field"], r["dtype"])),
    )
    joined = lambda log: F.array_join(F.transform(log["parts"], told), " ")
    message = F.transform(
        F.coalesce("logs", F.array()),
        lambda log: cell(log["entity_path"], F.lit("text_log"), F.lit("message"), F.lit("string"), F.nullif(joined(log), F.lit(""))),
    )
    met = met.withColumn("_clock", value(F.col("time_key"), F.col("time_dtype")))
    met = met.withColumn("_number", numeric(F.col("_clock")))
    time = normalize_time_by(F.col("_clock"), F.col("unit"), F.col("time_dtype"), F.col("_number"))
    cells = met.select(
        "recording_id", "source_id", time.alias("time"), "ord", F.explode(F.concat(single, message)).alias("c")
    ).select("recording_id", "source_id", "time", "ord", "c.*")
    cells = cells.filter("text is not null")
    dtype, text = F.col("dtype"), F.col("text")
    number = typed_number(text, dtype)
    kind = F.when(dtype == "bigint", F.lit("int")).when(dtype == "boolean", F.lit("bool")).otherwise(dtype)
    wide = (dtype == "bigint") & (F.abs(text.try_cast("bigint")) > _EXACT_INTEGER)
    out = cells.select(
        "recording_id",
        "source_id",
        "time",
        "ord",
        "entity_path",
        "semantic_type",
        "key",
        kind.alias("value_type"),
        number.alias("value_num"),
        F.when((dtype == "string") | wide, text).alias("value_str"),
    )
    return out.filter("value_num is not null or value_str is not null").select(*SIGNAL_COLUMNS)
