"""Frames, point clouds, geometry, log lines and delimiters."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import check, table
from tracelake.operators import clouds as C
from tracelake.operators import frames as R
from tracelake.operators import geometry as G
from tracelake.operators.query import detection_failure as failed_detections
from tracelake.sources import lines as L


def document_frames(spark, sf):
    """Documents read as images, labels as predictions: quality is the score, toxicity the label."""
    documents = table(spark, sf, "documents")
    images = documents.select(
        F.col("lang").alias("recording_id"),
        F.lit("documents").alias("source_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"),
    )
    labels = table(spark, sf, "labels").join(documents.select("doc_id", "lang"), "doc_id")
    box = F.struct(
        F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bbox"),
        F.col("toxic").alias("class_id"),
        F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("label"),
        F.col("quality").cast("double").alias("score"),
    )
    keypoints = "array<struct<points: array<array<double>>, class_id: int, label: string, score: double>>"
    masks = "array<struct<path: string, class_id: int, label: string, score: double>>"
    predictions = labels.select(
        F.col("lang").alias("recording_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"),
        F.lit(0).alias("frame_index"),
        F.lit(None).cast("double").alias("time"),
        F.array(box).alias("boxes"),
        F.array().cast(keypoints).alias("keypoints"),
        F.array().cast(masks).alias("masks"),
    )
    return R.join_frames(images, None, predictions)


_FRAMES = """
frames as (
  select lang as recording_id, 'doc_' || cast(d.doc_id as varchar) as path, quality, toxic, l.doc_id is not null as labelled,
    row_number() over (partition by lang order by 'doc_' || cast(d.doc_id as varchar)) - 1 as ord
  from documents d left join labels l on d.doc_id = l.doc_id)"""


@check(
    "detection_failure",
    f"""with {_FRAMES}
    select recording_id, cast(ord as double) as time, '/camera/pred/boxes' as entity_path, 'pred_box_count' as key,
      'no_prediction' as reason, cast(0 as double) as value from frames where not labelled
    union all select recording_id, cast(ord as double), '/camera/pred/scores', key, 'low_score', cast(quality as double)
      from frames, (values ('score_min'), ('score_mean')) v(key) where labelled and quality < 0.5""",
)
def detection_failure(spark, sf):
    signals = R.frame_signals(R.frame_counts(document_frames(spark, sf)))
    return failed_detections(signals, 0.5).select(
        "recording_id", "time", "entity_path", "key", "reason", F.col("value_num").alias("value")
    )


@check(
    "frame_counts",
    f"""with {_FRAMES} select recording_id, path, cast(ord as double) as time, cast(0 as integer) as gt_box_count,
      cast(case when labelled then 1 else 0 end as integer) as pred_box_count, cast(quality as double) as score_min,
      cast(quality as double) as score_mean, case when toxic = 1 then 'toxic' when toxic = 0 then 'clean' end as label from frames""",
)
def frame_counts(spark, sf):
    counts = R.frame_counts(document_frames(spark, sf))
    return counts.select(
        "recording_id",
        "path",
        "time",
        "gt_box_count",
        "pred_box_count",
        "score_min",
        "score_mean",
        F.get("labels", F.lit(0)).alias("label"),
    )


@check(
    "frame_signals",
    f"""with {_FRAMES}, k as (select * from (values ('image'), ('gt_box_count'), ('pred_box_count'), ('gt_keypoint_count'),
      ('pred_keypoint_count'), ('gt_mask_count'), ('pred_mask_count'), ('score_min'), ('score_mean'), ('labels')) v(key))
    select recording_id, key, count(*) as n, sum(case key when 'pred_box_count' then case when labelled then 1 else 0 end
      when 'score_min' then quality when 'score_mean' then quality when 'image' then null when 'labels' then null else 0 end)::double as total
    from frames, k where labelled or key not in ('score_min', 'score_mean', 'labels') group by 1, 2""",
)
def frame_signals(spark, sf):
    signals = R.frame_signals(R.frame_counts(document_frames(spark, sf)))
    return signals.groupBy("recording_id", "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value_num").alias("total")
    )


@check(
    "frame_totals",
    f"""with {_FRAMES} select recording_id, count(*) as image_count, cast(0 as bigint) as annotation_frame_count,
      count(*) filter (labelled) as prediction_frame_count, cast(0 as bigint) as prediction_mask_count from frames group by 1""",
)
def frame_totals(spark, sf):
    return R.frame_totals(document_frames(spark, sf)).select(
        "recording_id", "image_count", "annotation_frame_count", "prediction_frame_count", "prediction_mask_count"
    )


# ---- points: embeddings cut into triples -------------------------------------------------------------------


def embedding_points(spark, sf):
    triples = F.sequence(F.lit(0), F.floor(F.size("embedding") / 3) - 1)
    cells = F.transform(
        triples,
        lambda i: F.struct(
            i.alias("idx"),
            F.get("embedding", (i * 3).cast("int")).cast("double").alias("x"),
            F.get("embedding", (i * 3 + 1).cast("int")).cast("double").alias("y"),
            F.get("embedding", (i * 3 + 2).cast("int")).cast("double").alias("z"),
        ),
    )
    name = F.concat(F.col("vec_id").cast("string"), F.lit(".xyz"))
    return table(spark, sf, "embeddings").select(name.alias("file"), F.explode(cells).alias("_p")).select("file", "_p.*")


_POINTS = """
pts as (
  select cast(vec_id as varchar) || '.xyz' as file, i as idx, cast(embedding[3 * i + 1] as double) as x,
    cast(embedding[3 * i + 2] as double) as y, cast(embedding[3 * i + 3] as double) as z
  from (select vec_id, embedding, unnest(range(len(embedding) // 3)) as i from embeddings))"""


@check(
    "point_stats",
    f"""with {_POINTS} select file, count(*) as point_count, min(x) as min_x, min(y) as min_y, min(z) as min_z,
      max(x) as max_x, max(y) as max_y, max(z) as max_z from pts group by 1""",
)
def point_stats(spark, sf):
    return C.point_stats(embedding_points(spark, sf))


@check(
    "cloud_totals",
    f"""with {_POINTS}, s as (select file, count(*) as n from pts group by 1)
    select count(*) as point_cloud_count, min(n) as point_count_min, max(n) as point_count_max, round(avg(n), 6) as point_count_mean,
      min(cast(replace(file, '.xyz', '') as double)) as start_time, max(cast(replace(file, '.xyz', '') as double)) as end_time from s""",
)
def cloud_totals(spark, sf):
    totals = C.cloud_totals(C.with_cloud_times(C.point_stats(embedding_points(spark, sf))))
    return totals.withColumn("point_count_mean", F.round("point_count_mean", 6))


@check(
    "cloud_signals",
    f"""with {_POINTS}, s as (select file, count(*) as n, row_number() over (order by file) - 1 as ord from pts group by 1)
    select cast(replace(file, '.xyz', '') as double) as time, 'file' as key, cast(null as double) as value_num, file as value_str, ord from s
    union all select cast(replace(file, '.xyz', '') as double), 'point_count', cast(n as double), null, ord from s
    union all select cast(replace(file, '.xyz', '') as double), 'format', null, 'xyz', ord from s""",
)
def cloud_signals(spark, sf):
    timed = C.with_cloud_times(C.point_stats(embedding_points(spark, sf)))
    return C.cloud_signals(timed, "rec", "clouds").select("time", "key", "value_num", "value_str", "ord")


@check(
    "finite_points",
    f"""with {_POINTS}, b as (select file, idx, case when idx % 5 = 0 then 'nan'::double when idx % 5 = 1 then 'inf'::double else x end as x,
      y, z from pts) select file, idx, x, y, z from b where isfinite(x) and isfinite(y) and isfinite(z)""",
)
def finite_points(spark, sf):
    turn = F.col("idx") % 5
    broken = F.when(turn == 0, F.lit(float("nan"))).when(turn == 1, F.lit(float("inf"))).otherwise(F.col("x"))
    return C.finite_points(embedding_points(spark, sf).withColumn("x", broken))


@check(
    "colour_clamp",
    """select p_partkey, cast(least(greatest(case when abs(v - trunc(v)) = 0.5 then 2 * round(v / 2) else round(v) end, 0), 255) as integer)
      as channel from (select p_partkey, p_retailprice / 2 - 450 as v from part)""",
)
def colour_clamp(spark, sf):
    value = F.col("p_retailprice") / 2 - 450
    return table(spark, sf, "part").select("p_partkey", G.clamp_color(value).alias("channel"))


def _pose(spark, sf):
    """Embeddings as poses: the first components named as coordinates, every seventh without a z."""
    names = ("pose.x", "pose.y", "pose.z", "quat_x", "quat_y", "quat_z", "quat_w")
    value = [F.get("embedding", F.lit(i)).cast("double") for i in range(7)]
    value[2] = F.when(F.col("vec_id") % 7 != 0, value[2])
    return table(spark, sf, "embeddings").select("vec_id", *[v.alias(name) for v, name in zip(value, names)])


@check(
    "geometry_points",
    """select vec_id, cast(embedding[1] as double) as x2, cast(embedding[2] as double) as y2,
      case when vec_id % 7 <> 0 then cast(embedding[1] as double) end as x3, case when vec_id % 7 <> 0 then cast(embedding[3] as double) end
      as z3 from embeddings""",
)
def geometry_points(spark, sf):
    pose = _pose(spark, sf)
    fields = ["pose.x", "pose.y", "pose.z"]
    flat, deep = G.coordinates(pose, fields, ("x", "y")), G.coordinates(pose, fields, ("x", "y", "z"))
    return pose.select("vec_id", flat[0].alias("x2"), flat[1].alias("y2"), deep[0].alias("x3"), deep[2].alias("z3"))


@check(
    "geometry_boxes",
    """select vec_id, cast(embedding[1] as double) as x, cast(embedding[4] as double) as h,
      cast(embedding[3] as double) - cast(embedding[1] as double) as corner_w,
      cast(embedding[4] as double) - cast(embedding[2] as double) as corner_h from embeddings""",
)
def geometry_boxes(spark, sf):
    value = [F.get("embedding", F.lit(i)).cast("double") for i in range(4)]
    sized = ("box_x", "box_y", "box_width", "box_height")
    corners = ("xmin", "ymin", "xmax", "ymax")
    frame = table(spark, sf, "embeddings").select(
        "vec_id",
        *[v.alias(name) for v, name in zip(value, sized)],
        *[v.alias(name) for v, name in zip(value, corners)],
    )
    first, second = G.box(frame, list(sized)), G.box(frame, list(corners))
    return frame.select(
        "vec_id", first[0].alias("x"), first[3].alias("h"), second[2].alias("corner_w"), second[3].alias("corner_h")
    )


@check(
    "geometry_transform",
    """select vec_id, case when vec_id % 7 <> 0 then cast(embedding[2] as double) end as ty,
      case when vec_id % 7 <> 0 then cast(embedding[7] as double) end as qw, vec_id % 7 <> 0 as placed from embeddings""",
)
def geometry_transform(spark, sf):
    pose = _pose(spark, sf)
    moved = G.transform(pose, pose.columns[1:])
    return pose.select(
        "vec_id",
        moved["translation"][1].alias("ty"),
        moved["quaternion"][3].alias("qw"),
        moved.isNotNull().alias("placed"),
    )


# ---- lines of texts ----------------------------------------------------------------------------------------

_LINES = """
lines as (
  select doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) as text,
    unnest(range(1, len(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) + 1)) as line_number from documents)"""


@check(
    "log_lines",
    f"""with {_LINES} select doc_id, line_number, text as message from lines where not regexp_full_match(text, '\\s*')""",
)
def log_lines(spark, sf):
    return L.log_rows(L.split_lines(table(spark, sf, "documents"), "text", ["doc_id"]))


# cell counts of lines(doc_id, text) per delimiter
_WIDTHS = r"""
bare as (select doc_id, trim(text, ' ') as t, regexp_replace(trim(text, ' '), '"[^"]*"', '""', 'g') as q from lines
  where not regexp_full_match(text, '\s*')),
cells as (
  select doc_id, 'tab' as delimiter, len(string_split(q, chr(9))) as width, true as num from bare
  union all select doc_id, 'comma', len(string_split(q, ',')), true from bare
  union all select doc_id, 'semicolon', len(string_split(q, ';')), true from bare
  union all select doc_id, 'pipe', len(string_split(q, '|')), true from bare
  union all select doc_id, 'whitespace', len(string_split_regex(t, '\s+')),
    len(list_filter(string_split_regex(t, '\s+'), lambda w: regexp_full_match(w,
      '[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?|(?i)[+-]?(nan|inf|infinity)'))) > 0 from bare),
widths as (select doc_id, delimiter, width, count(*) as n, count(*) filter (num) as numeric_lines from cells group by 1, 2, 3),
modal as (select doc_id, delimiter, arg_max(width, row(n, -width)) as modal_width, max(n) as modal_lines,
  cast(sum(n) as bigint) as lines, cast(sum(numeric_lines) as bigint) as numeric_lines from widths group by 1, 2)"""


@check(
    "modal_width",
    f"""with {_LINES}, {_WIDTHS} select doc_id, delimiter, cast(modal_width as integer) as modal_width, modal_lines, lines,
      round(cast(modal_lines as double) / lines, 6) as share from modal""",
)
def modal_width(spark, sf):
    lines = L.split_lines(table(spark, sf, "documents"), "text", ["doc_id"])
    modal = L.modal_widths(L.line_widths(lines, ["doc_id"]), ["doc_id"])
    return modal.drop("numeric_lines").withColumn("share", F.round("share", 6))


# parts written as delimited lines, one source and one delimiter per brand; some brands have ragged lines
_PART_LINES = """
lines as (
  select p_brand as doc_id, case when k % 7 = 6 and p_size % 4 = 0 then p_type else p_name || d || p_type || d || p_size
    || case when k % 2 = 0 then d || p_retailprice else '' end end as text
  from (select *, cast(substr(p_brand, 7) as bigint) as k, case cast(substr(p_brand, 7) as bigint) % 5 when 0 then chr(9)
    when 1 then ',' when 2 then ';' when 3 then '|' else ' ' end as d from part))"""


@check(
    "delimiter_sniff",
    f"""with {_PART_LINES}, {_WIDTHS}, stable as (select * from modal where lines >= 2 and modal_width > 1
      and cast(modal_lines as double) / lines >= 0.9 and (delimiter <> 'whitespace' or cast(numeric_lines as double) / lines >= 0.5))
    select doc_id, arg_max(delimiter, row(modal_width, delimiter)) as delimiter, cast(max(modal_width) as integer) as width
    from stable group by 1""",
)
def delimiter_sniff(spark, sf):
    number = F.substring("p_brand", 7, 10).cast("bigint")
    marks = F.array(*[F.lit(mark) for mark in ("\t", ",", ";", "|", " ")])
    mark = F.element_at(marks, (number % 5 + 1).cast("int"))
    price = F.when(number % 2 == 0, F.concat(mark, F.col("p_retailprice").cast("string"))).otherwise("")
    line = F.concat("p_name", mark, "p_type", mark, F.col("p_size").cast("string"), price)
    ragged = (number % 7 == 6) & (F.col("p_size") % 4 == 0)
    lines = table(spark, sf, "part").select(
        F.col("p_brand").alias("doc_id"), F.when(ragged, F.col("p_type")).otherwise(line).alias("text")
    )
    return L.sniff_delimiters(lines, ["doc_id"])
