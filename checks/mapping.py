"""Template matching, mapping validation and repairs over sources derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import check, table
from checks.profiles import _FIELD_SQL, _fields, event_profiles
from checks.profiles import PROFILED, _profile_sql
from tracelake.operators import mapping as M
from tracelake.operators import profile as P
from tracelake.operators import validate as V
from tracelake.session import materialize

# ---- fields: the part names of each brand --------------------------------------------------------------


def brand_fields(spark, sf):
    part = table(spark, sf, "part")
    return part.groupBy(F.col("p_brand").alias("source_id"), F.col("p_name").alias("field")).agg(
        F.min("p_partkey").alias("position")
    )


_BRAND_FIELDS = "fields as (select p_brand as source_id, p_name as field, min(p_partkey) as position from part group by 1, 2)"

RULES = [
    {"rule_key": "r1", "canonical": "blue bolt", "aliases": ["RED-Widget", "hot gear"], "pattern": "^small", "required": True},
    {"rule_key": "r2", "canonical": "nothing", "aliases": [], "pattern": "ring$", "required": False},
    {"rule_key": "r3", "canonical": "Small_Gizmo", "aliases": [], "pattern": None, "required": False},
    {"rule_key": "r4", "canonical": "absent", "aliases": ["also absent"], "pattern": None, "required": False},
]
_MATCHED = f"""
{_BRAND_FIELDS},
rules as (select * from (values ('r1', 'blue bolt', ['RED-Widget', 'hot gear'], '^small'), ('r2', 'nothing', []::varchar[], 'ring$'),
  ('r3', 'Small_Gizmo', []::varchar[], null), ('r4', 'absent', ['also absent'], null)) v(rule_key, canonical, aliases, pattern)),
hits as (select source_id, field, position, rule_key, canonical, case when field = canonical then 0
    when regexp_replace(lower(field), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(canonical), '[^a-z0-9]+', '', 'g') then 1
    when list_contains(aliases, field) then 2
    when list_contains(list_transform(aliases, lambda a: regexp_replace(lower(a), '[^a-z0-9]+', '', 'g')),
      regexp_replace(lower(field), '[^a-z0-9]+', '', 'g')) then 3
    when pattern is not null and regexp_matches(field, pattern) then 4 end as precedence from fields, rules),
matched as (select source_id, rule_key, canonical, precedence, count(*) as n, string_agg(field, ',' order by position) as candidates
  from hits where precedence is not null group by 1, 2, 3, 4
  qualify row_number() over (partition by source_id, rule_key order by precedence) = 1)"""


@check(
    "field_match",
    f"""with {_MATCHED} select s.source_id, r.rule_key, r.canonical, m.precedence, coalesce(m.candidates, '') as candidates,
      case when m.n is null then 'missing' when m.n > 1 then 'ambiguous' else 'matched' end as outcome
    from (select distinct source_id from fields) s join rules r on true
      left join matched m on m.source_id = s.source_id and m.rule_key = r.rule_key""",
)
def field_match(spark, sf):
    matched = M.match_fields(brand_fields(spark, sf), RULES)
    size = F.size("candidates")
    outcome = F.when(size == 0, "missing").when(size > 1, "ambiguous").otherwise("matched")
    return matched.select(
        "source_id", "rule_key", "canonical", "precedence", F.array_join("candidates", ",").alias("candidates"), outcome.alias("outcome")
    )


@check(
    "unmapped_fields",
    f"""with {_MATCHED} select source_id, field from fields f where field <> 'hot ring' and not exists (
      select 1 from matched m where m.source_id = f.source_id and m.n = 1 and m.candidates = f.field)""",
)
def unmapped_fields(spark, sf):
    fields = brand_fields(spark, sf)
    one = M.match_fields(fields, RULES).filter(F.size("candidates") == 1)
    used = one.select("source_id", F.col("candidates")[0].alias("field"))
    timelines = fields.select("source_id", F.lit("hot ring").alias("time_key")).distinct()
    return M.unmapped_fields(fields, used, timelines).select("source_id", "field")


@check(
    "similar_fields",
    f"""with {_BRAND_FIELDS}, m as (select * from (values ('blue bolts'), ('gizmo'), ('xyzzy')) v(missing)),
      n as (select source_id, missing, field, position, regexp_replace(missing, '[^a-z0-9]+', '', 'g') as a,
        regexp_replace(lower(field), '[^a-z0-9]+', '', 'g') as b from fields, m),
      s as (select *, 1 - cast(levenshtein(a, b) as double) / greatest(length(a), length(b), 1)
        + case when contains(b, a) or contains(a, b) then 0.25 else 0.0 end as score from n),
      r as (select *, row_number() over (partition by source_id, missing order by score desc, position) as rn from s where score >= 0.35)
    select b.source_id, m.missing, coalesce(string_agg(field, ',' order by rn) filter (rn <= 3), '') as similar
    from (select distinct source_id from fields) b join m on true left join r on r.source_id = b.source_id and r.missing = m.missing
    group by 1, 2""",
)
def similar_fields(spark, sf):
    entries = F.array_sort(F.collect_list(F.struct("position", "field")))
    sources = brand_fields(spark, sf).groupBy("source_id").agg(F.transform(entries, lambda e: e["field"]).alias("available"))
    wanted = F.array(*[F.lit(name) for name in ("blue bolts", "gizmo", "xyzzy")])
    asked = sources.select("source_id", "available", F.explode(wanted).alias("missing"))
    close = M.similar_fields(F.col("missing"), F.col("available"))
    return asked.select("source_id", "missing", F.array_join(close, ",").alias("similar"))


@check(
    "template_diff",
    f"""with {_BRAND_FIELDS}, l as (select source_id, field as rule_key, 'scalar' as semantic_type, '/m/' || field as entity_path,
        true as enabled from fields where position % 5 <> 0),
      r as (select source_id, field as rule_key, case when position % 3 = 0 then 'state' else 'scalar' end as semantic_type,
        '/m/' || case when position % 4 = 0 then 'x' else field end as entity_path, position % 6 <> 0 as enabled from fields where position % 7 <> 0)
    select coalesce(l.source_id, r.source_id) as source_id, coalesce(l.rule_key, r.rule_key) as rule_key,
      case when l.rule_key is null then 'added' when r.rule_key is null then 'missing' else concat_ws(',',
        case when l.semantic_type <> r.semantic_type then 'semantic_type' end, case when l.entity_path <> r.entity_path then 'entity_path' end,
        case when l.enabled <> r.enabled then 'enabled' end) end as changes,
      case when l.rule_key is not null and r.rule_key is not null and l.semantic_type = r.semantic_type and l.entity_path = r.entity_path
        and l.enabled = r.enabled then 'same' else 'changed' end as status
    from l full outer join r on l.source_id = r.source_id and l.rule_key = r.rule_key""",
)
def template_diff(spark, sf):
    fields = brand_fields(spark, sf)
    base = fields.select("source_id", "position", F.col("field").alias("rule_key"), F.array("field").alias("source_fields"))
    name, position = F.col("rule_key"), F.col("position")
    left = base.filter("position % 5 <> 0").select(
        "*", F.lit("scalar").alias("semantic_type"), F.concat(F.lit("/m/"), name).alias("entity_path"), F.lit(True).alias("enabled")
    )
    right = base.filter("position % 7 <> 0").select(
        "*",
        F.when(position % 3 == 0, "state").otherwise("scalar").alias("semantic_type"),
        F.concat(F.lit("/m/"), F.when(position % 4 == 0, F.lit("x")).otherwise(name)).alias("entity_path"),
        (position % 6 != 0).alias("enabled"),
    )
    diff = M.template_diff(left, right)
    return diff.select("source_id", "rule_key", F.array_join("changes", ",").alias("changes"), "status")


# ---- mappings: one per customer over its orders -------------------------------------------------------------


def customer_mappings(spark, sf):
    keys = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct()
    source = F.concat(F.lit("c"), F.col("k").cast("string")).alias("source_id")
    k = F.col("k")
    mappings = keys.select(
        source,
        F.lit("tabular").alias("family"),
        F.when(k % 4 == 0, "o_orderdate").when(k % 4 == 1, "o_totalprice").when(k % 4 == 2, "missing").otherwise("").alias("primary_timeline"),
        F.when(k % 5 == 0, "unix_s").otherwise("auto").alias("timeline_unit"),
        F.when(k % 6 == 0, "ascending").when(k % 6 == 1, "descending").otherwise("source").alias("timeline_sort"),
    )
    none = F.lit(None).cast("string")
    rest = [
        F.array().cast("array<string>").alias("template_missing_fields"),
        F.array().cast("array<struct<field: string, candidates: array<string>>>").alias("match_candidates"),
        F.lit(False).alias("match_ambiguous"),
    ]
    price = keys.select(
        source, F.lit(0).alias("pos"), F.lit("price").alias("stream_id"), F.lit("price").alias("rule_key"), F.lit("price").alias("name"),
        F.array(F.lit("o_totalprice")).alias("source_fields"), F.lit("scalar").alias("semantic_type"),
        F.lit("/metrics/price").alias("entity_path"), F.lit(True).alias("enabled"), F.lit(False).alias("required"),
        F.when(k % 8 == 0, "m").alias("expected_unit"), F.when(k % 8 == 0, "mm").alias("source_unit"), *rest,
    )
    other = keys.select(
        source, F.lit(1).alias("pos"), F.lit("other").alias("stream_id"), F.lit("other").alias("rule_key"), F.lit("other").alias("name"),
        F.array(F.lit("o_orderstatus"), F.lit("o_status")).alias("source_fields"),
        F.when(k % 3 == 0, "image").when(k % 3 == 1, "state").otherwise("points3d").alias("semantic_type"),
        F.when(k % 2 == 0, "/metrics/price").otherwise("/state one").alias("entity_path"), (k % 7 != 0).alias("enabled"),
        (k % 2 == 0).alias("required"), none.alias("expected_unit"), none.alias("source_unit"), *rest,
    )
    orders = table(spark, sf, "orders")
    owner = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    profiles = P.field_profiles(orders, owner, "o_orderkey", ["o_orderdate", "o_totalprice", "o_orderstatus"])
    # the profile is a stored catalogue table
    return mappings, price.unionByName(other), materialize(profiles, "profiles")


_ISSUES = """
k as (select o_custkey as k, bool_and(coalesce(d >= pd, true)) as date_ok, bool_and(coalesce(p >= pp, true)) as price_ok
  from (select o_custkey, o_orderdate as d, lag(o_orderdate) over w as pd, o_totalprice as p, lag(o_totalprice) over w as pp
    from orders window w as (partition by o_custkey order by o_orderkey)) group by 1),
t as (select *, case k % 4 when 0 then 'o_orderdate' when 1 then 'o_totalprice' when 2 then 'missing' else '' end as field,
  case k % 6 when 0 then 'ascending' when 1 then 'descending' else 'source' end as sort from k),
issues as (
  select k, 'error' as severity, 'invalid_timeline_sort' as code, cast(null as varchar) as stream_id, cast(null as varchar) as field,
    cast(null as varchar) as detail from t where sort = 'descending'
  union all select k, 'warning', 'missing_time_column', null, 'missing', null from t where k % 4 = 2
  union all select k, 'warning', 'non_monotonic_time', null, field, null from t
    where sort <> 'ascending' and ((k % 4 = 0 and not date_ok) or (k % 4 = 1 and not price_ok))
  union all select k, 'warning', 'time_unit_mismatch', null, field, case k % 4 when 0 then 'datetime' else 'seconds' end from t
    where k % 5 = 0 and k % 4 in (0, 1)
  union all select k, 'warning', 'field_unit_mismatch', 'price', null, null from t where k % 8 = 0
  union all select k, 'error', 'unsupported_semantic_type', 'other', null, null from t where k % 7 <> 0 and k % 3 = 0
  union all select k, 'error', case when k % 2 = 0 then 'required_field_missing' else 'field_missing' end, 'other', 'o_status', null
    from t where k % 7 <> 0
  union all select k, 'error', 'invalid_entity_path', 'other', null, '/state_one' from t where k % 7 <> 0 and k % 2 = 1
  union all select k, 'error', 'duplicate_entity_path', 'other', null, '/metrics/price_2' from t where k % 7 <> 0 and k % 2 = 0
  union all select k, 'error', 'missing_coordinate_axes', 'other', null, null from t where k % 7 <> 0 and k % 3 = 2)"""


@check(
    "mapping_validation",
    f"with {_ISSUES} select 'c' || cast(k as varchar) as source_id, severity, code, stream_id, field, detail from issues",
)
def mapping_validation(spark, sf):
    issues = V.mapping_issues(*customer_mappings(spark, sf))
    return issues.select("source_id", "severity", "code", "stream_id", "field", "detail")


@check(
    "validation_report",
    f"""with {_ISSUES}, c as (select k, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings
      from issues group by 1)
    select 'c' || cast(t.k as varchar) as source_id, coalesce(errors, 0) = 0 as valid, coalesce(errors, 0) as errors,
      coalesce(warnings, 0) as warnings, case when t.k % 5 = 0 then 'unix_s' when t.k % 4 = 0 then 'datetime'
      when t.k % 4 = 1 then 'seconds' else 'auto' end as effective_timeline_unit from t left join c on c.k = t.k""",
)
def validation_report(spark, sf):
    mappings, streams, profiles = customer_mappings(spark, sf)
    return V.validate(mappings, streams, profiles)[0]


@check(
    "repair_actions",
    f"""with {_ISSUES}, names as (select v, p, cast(levenshtein('ostatus', replace(v, '_', '')) as double)
        / greatest(7, length(replace(v, '_', ''))) as loss from (values ('o_orderdate', 0), ('o_totalprice', 1), ('o_orderstatus', 2)) x(v, p)),
      close as (select v, row_number() over (order by loss, p) - 1 as n from names where 1 - loss >= 0.35), s as (
      select k, code, 0 as n, 'set_timeline_sort' as action, 'source' as value from issues where code = 'invalid_timeline_sort'
      union all select k, code, 0, 'set_timeline_sort', 'ascending' from issues where code = 'non_monotonic_time'
      union all select k, code, 0, 'set_timeline_unit', detail from issues where code = 'time_unit_mismatch'
      union all select k, code, 0, 'set_entity_path', detail from issues where code in ('invalid_entity_path', 'duplicate_entity_path')
      union all select k, code, n, 'set_timeline_field', v from issues, (values (0, 'o_orderdate'), (1, 'o_totalprice'), (2, '')) x(n, v)
        where code = 'missing_time_column'
      union all select k, code, n, 'set_semantic_type', v from issues, (values (0, 'boxes2d'), (1, 'points2d'), (2, 'points3d'),
        (3, 'scalar'), (4, 'scalar_group'), (5, 'state'), (6, 'text_log'), (7, 'trajectory3d'), (8, 'transform3d')) x(n, v)
        where code = 'unsupported_semantic_type'
      union all select k, code, n, 'replace_source_field', v from issues, close where code in ('field_missing', 'required_field_missing')
      union all select k, code, (select count(*) from close), 'set_stream_enabled', 'false' from issues where code = 'field_missing')
    select 'c' || cast(k as varchar) as source_id, code, cast(n as integer) as n, action, value from s""",
)
def repair_actions(spark, sf):
    mappings, streams, profiles = customer_mappings(spark, sf)
    issues = V.validate(mappings, streams, profiles)[1]
    value = F.element_at(
        F.map_values(F.map_filter("params", lambda key, _: ~key.isin("stream_id", "old_field"))), 1
    )
    listed = issues.select("source_id", "code", F.posexplode("suggestions").alias("n", "_s")).select("source_id", "code", "n", "_s.*")
    return listed.select("source_id", "code", "n", "action", value.alias("value"))


# ---- streams: the parts of each brand ---------------------------------------------------------------------------


def brand_streams(spark, sf):
    part = table(spark, sf, "part")
    path = F.concat(F.lit("/m/"), F.when(F.col("p_size") % 10 == 0, F.col("p_name")).otherwise(F.regexp_replace("p_name", " ", "_")))
    return part.select(
        F.col("p_brand").alias("source_id"),
        F.col("p_partkey").cast("int").alias("pos"),
        F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("stream_id"),
        F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("rule_key"),
        F.col("p_name").alias("name"),
        F.array("p_name").alias("source_fields"),
        F.lit("scalar").alias("semantic_type"),
        path.alias("entity_path"),
        F.lit(True).alias("enabled"),
        F.lit(False).alias("required"),
        F.lit("tabular").alias("family"),
    )


@check(
    "duplicate_paths",
    """with s as (select p_brand as source_id, p_partkey as pos, '/m/' || case when p_size % 10 = 0 then p_name else replace(p_name, ' ', '_') end
        as path, p_size % 10 = 0 as broken, '/m/' || replace(p_name, ' ', '_') as base from part),
      r as (select *, row_number() over (partition by source_id, broken, base order by pos) as turn,
        count(*) filter (not broken) over (partition by source_id, base) > 0 as taken from s)
    select source_id, 's' || cast(pos as varchar) as stream_id, case when broken then 'invalid_entity_path' else 'duplicate_entity_path' end as code,
      case when broken and not taken and turn = 1 then base
        when broken then base || '_' || cast(case when taken then turn + 1 else turn end as varchar)
        else base || '_' || cast(turn as varchar) end as detail
    from r where broken or turn > 1""",
)
def duplicate_paths(spark, sf):
    return V.path_issues(brand_streams(spark, sf)).select("source_id", "stream_id", "code", "detail")


@check(
    "coordinate_axes",
    f"""with f as (select p_brand, p_type, {_FIELD_SQL} as field from part),
      t as (select *, regexp_extract(field, '([^._/-]*)$', 1) as token from f),
      r as (select p_brand, p_type, case when token in ('qx', 'qy', 'qz', 'qw') then token
        when contains(field, 'quat') and right(token, 1) in ('x', 'y', 'z', 'w') then 'q' || right(token, 1)
        when token = 'width' then 'w' else token end as role from t),
      s as (select p_brand as source_id, p_type as stream_id, bool_or(role = 'x') as x, bool_or(role = 'y') as y, bool_or(role = 'z') as z,
        bool_or(role in ('qx', 'qy', 'qz', 'qw', 'roll', 'pitch', 'yaw')) as turned from r group by 1, 2)
    select source_id, stream_id, 'missing_coordinate_axes' as code from s where not (x and y and z)
    union all select source_id, stream_id, 'incomplete_rotation' from s where turned""",
)
def coordinate_axes(spark, sf):
    fields = _fields(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_type"), "p_partkey")
    streams = fields.groupBy(F.col("p_brand").alias("source_id"), F.col("p_type").alias("stream_id")).agg(
        F.collect_set("field").alias("source_fields")
    )
    live = streams.select("*", F.lit("transform3d").alias("semantic_type"), F.lit("tabular").alias("family"))
    return V.coordinate_issues(live).select("source_id", "stream_id", "code")


@check(
    "issue_enrichment",
    """select p_brand as source_id, p_partkey as pos, case when p_partkey % 3 = 0 then null else 's' || cast(p_partkey as varchar) end
      as stream_id, case when p_partkey % 3 <> 0 then p_name end as found from part""",
)
def issue_enrichment(spark, sf):
    streams = brand_streams(spark, sf)
    turn = F.col("pos") % 3
    issues = streams.select(
        "source_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.when(turn == 1, F.col("stream_id")).alias("stream_id"),
        F.when(turn == 2, F.col("rule_key")).alias("rule_key"),
    )
    attached = V.attach_streams(issues, streams)
    return attached.select("source_id", "pos", "stream_id", F.col("stream.source_fields")[0].alias("found"))


@check(
    "top3_candidates",
    f"""with p as ({" union all ".join(_profile_sql(n, f, k) for n, (k, f) in PROFILED.items())}),
      c as (select *, case when contains(field, 'time') or contains(field, 'date') then 1 else 0 end as named,
        coalesce(inferred_time_unit <> 'mixed', false) as known from p where field <> 'o_orderdate')
    select source_id, cast(rank as integer) as rank, field from (select *, row_number() over (partition by source_id
      order by named desc, time_parse_ratio desc, known desc, position) as rank from c where named = 1 or time_parse_ratio > 0) where rank <= 3""",
)
def top3_candidates(spark, sf):
    profiles = event_profiles(spark, sf)
    mappings = profiles.select("source_id", F.lit("o_orderdate").alias("primary_timeline")).distinct()
    return V.time_candidates(profiles, mappings)


# ---- rules over fields that are more or less empty: nations with their customers as fields --------------------

_RULE_CODES = (
    "no_enabled_streams time_nulls time_parse_failure mixed_time_units required_fields_empty fields_empty field_nulls "
    "ambiguous_field_match image_stream_required"
).split()


@check(
    "mapping_rules",
    """with f as (select c_nationkey as k, c_name as field, c_custkey % 3 as e, c_custkey % 7 = 0 as mixed, c_mktsegment as segment
        from customer),
      t as (select k, min(field) as field, min_by(e, field) as e, min_by(mixed, field) as mixed, k % 5 = 4 as off, k % 3 = 1 as images
        from f group by k),
      s as (select k, segment, min(e) = 2 as empty, max(e) > 0 as gaps from f where k % 5 <> 4 group by k, segment),
      found as (
      select k, 'error' as severity, 'no_enabled_streams' as code, cast(null as varchar) as stream_id, cast(null as varchar) as field
        from t where off
      union all select k, 'warning', 'time_nulls', null, field from t where not images and e > 0
      union all select k, 'warning', 'time_parse_failure', null, field from t where not images and e > 0
      union all select k, 'warning', 'mixed_time_units', null, field from t where not images and mixed
      union all select k, case segment when 'BUILDING' then 'error' else 'warning' end,
        case segment when 'BUILDING' then 'required_fields_empty' else 'fields_empty' end, segment, null from s where empty
      union all select k, 'warning', 'field_nulls', segment, null from s where not empty and gaps
      union all select k, 'error', 'ambiguous_field_match', segment, case segment when 'AUTOMOBILE' then 'rule' end from s
        where segment in ('AUTOMOBILE', 'MACHINERY')
      union all select k, 'error', 'image_stream_required', null, 'image' from t where images)
    select 'n' || cast(k as varchar) as source_id, severity, code, stream_id, field from found""",
)
def mapping_rules(spark, sf):
    """A stream per nation and segment over its customers; a third of them is full, half empty and empty each."""
    customer = table(spark, sf, "customer")
    k, e = F.col("c_nationkey"), F.col("c_custkey") % 3
    source = F.concat(F.lit("n"), k.cast("string")).alias("source_id")
    held = F.when(e == 0, 100).when(e == 1, 50).otherwise(0).cast("bigint")
    profiles = customer.select(
        source, F.col("c_name").alias("field"), held.alias("non_null_count"), (1 - held / 100.0).alias("null_ratio"),
        F.lit(None).cast("boolean").alias("time_monotonic"), F.when(e == 0, 1.0).otherwise(0.5).alias("time_parse_ratio"),
        F.when(F.col("c_custkey") % 7 == 0, "mixed").otherwise("unix_s").alias("inferred_time_unit"), F.lit("unix_s").alias("first_time_unit"),
    )
    mappings = customer.groupBy(source, k.alias("k")).agg(F.min("c_name").alias("primary_timeline")).select(
        "source_id", "primary_timeline", F.when(F.col("k") % 3 == 1, "image_folder").otherwise("tabular").alias("family"),
        F.lit("auto").alias("timeline_unit"), F.lit("source").alias("timeline_sort"),
    )
    segment = F.col("c_mktsegment")
    none = F.lit(None).cast("string")
    matches = "array<struct<field: string, candidates: array<string>>>"
    one = F.array(F.struct(F.lit("rule").alias("field"), F.array(F.lit("a"), F.lit("b")).alias("candidates")))
    streams = customer.groupBy(source, k.alias("k"), segment.alias("stream_id")).agg(F.sort_array(F.collect_list("c_name")).alias("source_fields"))
    stream = F.col("stream_id")
    streams = streams.select(
        "source_id", F.length("stream_id").alias("pos"), "stream_id", none.alias("rule_key"), stream.alias("name"), "source_fields",
        F.lit("scalar").alias("semantic_type"), F.concat(F.lit("/m/"), stream).alias("entity_path"), (F.col("k") % 5 != 4).alias("enabled"),
        (stream == "BUILDING").alias("required"), none.alias("expected_unit"), none.alias("source_unit"),
        F.array().cast("array<string>").alias("template_missing_fields"),
        F.when(stream == "AUTOMOBILE", one).otherwise(F.array().cast(matches)).cast(matches).alias("match_candidates"),
        stream.isin("AUTOMOBILE", "MACHINERY").alias("match_ambiguous"),
    )
    issues = V.mapping_issues(mappings, streams, profiles).filter(F.col("code").isin(*_RULE_CODES))
    return issues.select("source_id", "severity", "code", "stream_id", "field")


@check(
    "source_rules",
    """with s as (select 's' || cast(s_suppkey as varchar) as source_id, case s_suppkey % 3 when 0 then 'ros2_db3' when 1 then 'mcap' else 'csv' end
        as source_type from supplier),
      t as (select 's' || cast(p_partkey % 40 as varchar) as source_id, count(*) as n, count(*) filter (p_size > 10 and p_partkey % 40 % 4 <> 0) as good
        from part group by 1),
      p as (select 's' || cast(l_suppkey % 50 as varchar) as source_id, 'f' || cast(l_orderkey as varchar) || '_' || cast(l_linenumber as varchar) as file,
        case when l_suppkey % 5 = 0 then 0 else cast(l_quantity as bigint) end as points, l_linenumber = 7 as odd from lineitem)
    select source_id, 'warning' as severity, 'mcap_topics_unavailable' as code, cast(null as varchar) as field from s left join t using (source_id)
      where source_type = 'mcap' and n is null
    union all select source_id, 'warning', 'ros2_topics_skipped', null from s join t using (source_id) where source_type = 'ros2_db3' and good < n
    union all select source_id, 'error', 'ros2_no_convertible_topics', null from s left join t using (source_id)
      where source_type = 'ros2_db3' and coalesce(good, 0) = 0
    union all select distinct source_id, 'warning', 'point_cloud_sample_warning', file from p where odd
    union all select source_id, 'error', 'point_cloud_coordinates_missing', 'points' from p group by source_id having max(points) <= 0""",
)
def source_rules(spark, sf):
    """Issues of robot recordings and point files, which join the others through ``extra``."""
    k = F.col("s_suppkey")
    supplier = table(spark, sf, "supplier")
    sources = supplier.select(
        F.concat(F.lit("s"), k.cast("string")).alias("source_id"),
        F.when(k % 3 == 0, "ros2_db3").when(k % 3 == 1, "mcap").otherwise("csv").alias("source_type"),
    )
    owner = F.col("p_partkey") % 40
    topics = table(spark, sf, "part").select(
        F.concat(F.lit("s"), owner.cast("string")).alias("source_id"), F.col("p_name").alias("topic"), F.col("p_brand").alias("message_type"),
        ((F.col("p_size") > 10) & (owner % 4 != 0)).alias("convertible"),
    )
    line = table(spark, sf, "lineitem")
    stats = line.select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 50).cast("string")).alias("source_id"),
        F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("file"),
        F.when(F.col("l_suppkey") % 5 == 0, 0).otherwise(F.col("l_quantity")).cast("bigint").alias("point_count"),
        F.when(F.col("l_linenumber") == 7, "odd line").otherwise("").alias("warning"),
    )
    extra = V.bag_issues(sources, topics).unionByName(V.point_cloud_issues(stats))
    mappings, streams, profiles = customer_mappings(spark, sf)
    # the union with issues of mappings: those of one customer are left aside again
    joined = V.mapping_issues(mappings.limit(0), streams.limit(0), profiles.limit(0), extra)
    return joined.select("source_id", "severity", "code", "field")
